import random

import pytest
import xxhash
from quarry.llm import simhash


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    """{id: least id reachable} of (id, fingerprint) rows, by comparing all pairs."""
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= bits and root(i) != root(j):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_query_equals_brute_force(spark, write_docs):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("the of An tion élan Thé xx yy zz über st").split(" ")[0] + str(rng.randint(0, 400)) for _ in range(n))
    texts = [prose(rng.randint(1, 200)) for _ in range(60)]
    texts += texts[:5] + [t + " tail" for t in texts[:25]] + [t.upper() for t in texts[5:9]] + [None, "", "  ", "one", "One two", "one\x0btwo", "a  b\tc"]
    rows = [(k + 5, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows.append(rows[3])
    found = simhash.query(spark, write_docs(rows)).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    prints = {i: f"{brute_fingerprint(t):016x}" for i, t in rows}
    assert len(found) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, prints[i], want[i]) for i, _ in rows}


@pytest.mark.parametrize("crowded", [1024, 3])
def test_links_lose_nothing(spark, monkeypatch, crowded):
    """Dense families of fingerprints: chains of single flips, stars, and pairs two bits apart in every segment."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(4)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 12)):
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) * rng.randint(0, 1)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 3, (1 << 64) - 1}
    rows = [(k, fp) for k, fp in enumerate(sorted(prints))]
    signed = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in rows]
    found = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows)


def test_pigeonring_keeps_every_pair_within_the_budget():
    import numpy as np

    pairs = np.array([0, *(1 << a for a in range(64)), *((1 << a) | (1 << b) for a in range(64) for b in range(a))], dtype=np.uint64)
    kept = np.zeros(len(pairs), bool)
    for start in range(simhash.SEGMENTS):
        kept |= simhash.within_chain(pairs, np.full(len(pairs), start))
    assert kept.all()


def test_null_id_and_empty_table(spark, write_docs):
    found = simhash.query(spark, write_docs([(None, "a b c d"), (7, "a b c d"), (None, "other text of its own")])).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in found) == [(False, False), (True, False), (True, True)]
    assert simhash.query(spark, write_docs([])).collect() == []
