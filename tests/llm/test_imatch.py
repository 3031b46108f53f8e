import hashlib
import random

import numpy as np
import xxhash
from quarry.llm import imatch


def brute(rows):
    """{(id, text): (n_chars, sha of the edited text)} by sorting everything."""
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out[i] = (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())
    return out


def test_query(spark, write_docs, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rng = random.Random(1)
    word = lambda: "w" + str(int(rng.paretovariate(0.6)) % 5000)
    texts = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(120)]
    texts += texts[:10] + [None, "", "ab", "日本語テキスト です", "x " * 50]
    rows = [(k * 13 - 40, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    found = {r.doc_id: r for r in imatch.query(spark, write_docs(rows)).collect()}
    want = brute(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in found.items()} == want
    of = {}
    for i, t in rows:
        assert of.setdefault(t or "", found[i].fingerprint) == found[i].fingerprint  # equal texts
    long = [found[i] for i, t in rows if t and len(t) > 200]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.1 > np.mean([r.near_next for r in long])
    assert all(0 <= x <= 1 for r in found.values() for x in (r.near_edited, r.near_next))


def plain_fingerprint(text, band, common):
    """One fingerprint by sets and sorting."""
    big = (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 & big
        return x ^ x >> 32

    h = lambda w: xxhash.xxh64_intdigest(w)
    own = imatch.terms(text)
    picked = [h(w) for w in own if w in band]
    others = sorted(((common.index(w) if w in common else len(common)), h(w)) for w in own if w not in band)
    picked = sorted(picked + [x for _, x in others][: max(0, imatch.FEWEST - len(picked))])
    level = max(1, round(np.log2(max(len(picked), 1))))
    out = np.zeros((imatch.LEVELS, imatch.SUBSETS), np.uint16)
    for k in range(imatch.SUBSETS):
        for j in range(imatch.LEVELS):
            inside = [m for m in (mix(x ^ mix(k + 1)) for x in picked) if m & ((1 << (level - 1 + j)) - 1) == 0]
            if inside:
                out[j, k] = mix(sum(mix(m ^ mix(n + 0x1F123BB5)) for n, m in enumerate(inside)) & big) % 65535 + 1
    return imatch.text_of(level, out)


def test_fingerprints_equal_plain_ones(spark, write_docs):
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(rng.randint(1, 90))) for _ in range(150)] + [None, "", "y" * 500, "y" * 500 + " z"]
    rows = list(enumerate(texts))
    distinct = {(t or "").encode() for t in texts} | {b""}
    held = [imatch.terms(t) for t in distinct]
    seen = {w: sum(w in ws for ws in held) for w in set().union(*held)}
    total = len(set(texts))
    low = max(1, int(np.ceil(imatch.RAREST * total)))
    high = max(low, imatch.COMMONEST * total)
    band = {w for w, n in seen.items() if low <= n <= high}
    common = [w for n, w in sorted((n, w) for w, n in seen.items() if n > high)]
    found = {r.doc_id: r.fingerprint for r in imatch.query(spark, write_docs(rows)).collect()}
    assert found == {i: plain_fingerprint((t or "").encode(), band, common) for i, t in rows}


def test_small_tables(spark, write_docs):
    assert imatch.query(spark, write_docs([])).collect() == []
    (one,) = imatch.query(spark, write_docs([(4, "abcdefgh")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    two = imatch.query(spark, write_docs([(4, "abcdefgh"), (4, "abcdefgh"), (None, None)])).collect()
    assert sorted(r.n_chars for r in two) == [0, 8, 8]


def test_likeness_estimates_overlap():
    rng = random.Random(2)
    known = {f"t{k}".encode(): rng.getrandbits(64) for k in range(5000)}
    a = rng.sample(sorted(known), 400)
    for share in (0.0, 0.5, 0.9):
        b = a[: int(400 * share)] + rng.sample(sorted(set(known) - set(a)), 400 - int(400 * share))
        level, h = imatch.fingerprint_texts([b" ".join(a), b" ".join(b)], known)
        overlap = share * 400 / (800 - share * 400)
        assert abs(imatch.likeness(level[:1], h[:1], level[1:], h[1:])[0] - overlap) < 0.25


def test_copies_do_not_make_terms_frequent(spark, docs_of):
    texts = [f"own{k} shared{k // 2} every" for k in range(200)] + ["hot0 hot1"] * 60 + ["own7 shared3 every"] * 60 + [None, "", ""]
    words, common = imatch.vocabulary(docs_of(list(enumerate(texts))))
    assert {b"hot0", b"hot1", b"own7", b"shared3", b"own8"} <= set(words) and common == [b"every"]


def test_frequencies_are_of_distinct_texts(spark, docs_of, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(imatch, "COPY_BITS", 1 << 16)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 40)}" for _ in range(5)) for _ in range(200)]
    texts += rng.choices(texts, k=150) + [None, "", ""]
    rows = docs_of(list(enumerate(texts))).select("text", F.xxhash64("text").alias("th"))
    total, copied = imatch.copies(rows)
    found = {bytes(r.term).decode(): r.n for r in imatch.document_frequencies(rows, copied).collect()}
    distinct = set(texts)
    assert total == len(distinct)
    assert found == {w: sum(w in (t or "").split() for t in distinct) for w in {w for t in distinct for w in (t or "").split()}}


def test_an_edit_that_brings_band_terms_keeps_the_rest():
    """The text has no band term; the last quarter of its edited form has some."""
    rng = random.Random(4)
    known = {f"t{k}".encode(): rng.getrandbits(64) for k in range(50)}
    for often in ({}, {f"c{k}".encode(): k for k in range(300)}):
        likes = []
        for _ in range(20):
            a = [f"c{k}".encode() for k in rng.sample(range(300), 80)]
            b = a[:60] + rng.sample(sorted(known), 8) + [f"c{k}".encode() for k in rng.sample(range(300), 12)]
            level, h = imatch.fingerprint_texts([b" ".join(a), b" ".join(b)], known, often)
            likes.append(imatch.likeness(level[:1], h[:1], level[1:], h[1:])[0])
        assert np.mean(likes) > 0.2 and min(likes) > 0
