"""Both repeat removers against brute force over planted repeats."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from quarry.llm import repeats, rlbwt_dedup, superkmer_dedup


def corpus(seed=3):
    """Texts with exact copies, near copies, shared passages, self-repeats, a frequent line, and odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "é", "tion", "th", "er", "ü", "st"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(40)
    texts = [prose(rng.randint(5, 300)) for _ in range(40)]
    texts += texts[:6]
    texts += [t.replace(" an ", " xx ", 1) for t in texts[6:14]]
    texts += [prose(30) + "\n" + passage + " " + prose(rng.randint(0, 40)) for _ in range(5)]
    texts += [prose(rng.randint(0, 20)) + " " + line + " " + prose(rng.randint(0, 20)) for _ in range(25)]
    texts += [passage + "\t" + passage, "ab" * 400, "ab" * 101, "x" * 199, "y" * 201, "word " * 90, "", " ", None, None, "\0" * 250, "é" * 150]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[0], (rows[1][0], "another text under the same id"), (None, texts[2]), (None, None)]


def brute_bytes(rows, window):
    seen = Counter(b[s : s + window] for _, t in rows for b in [(t or "").encode()] for s in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), len(repeats.intervals(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[s : s + window]) for w in split for s in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("frequent", "bodies", "heavy"), [(300, 2000, 10_000), (4, 2000, 20), (2, 3, 20), (1, 1, 10_000)])
@pytest.mark.parametrize(("operator", "brute"), [(rlbwt_dedup, brute_bytes), (superkmer_dedup, brute_words)])
def test_equals_brute_force(spark, write_docs, monkeypatch, operator, brute, frequent, bodies, heavy):
    """However few strings make a minimiser frequent, a bucket crowded (it is cut again and again) or a key heavy."""
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(repeats, "BODIES", bodies)
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rows = corpus()
    found = Counter(tuple(r) for r in operator.query(spark, write_docs(rows)).collect())
    assert found == Counter(brute(rows, operator.WINDOW))


@pytest.mark.parametrize(("operator", "brute"), [(rlbwt_dedup, brute_bytes), (superkmer_dedup, brute_words)])
def test_a_very_long_text(spark, write_docs, operator, brute):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(20_000))
    rows = [(1, text), (2, text[:30_000] + " other words " + text[30_000:60_000]), (3, None)]
    assert Counter(tuple(r) for r in operator.query(spark, write_docs(rows)).collect()) == Counter(brute(rows, operator.WINDOW))


@pytest.mark.parametrize("operator", [rlbwt_dedup, superkmer_dedup])
def test_empty_table(spark, write_docs, operator):
    assert operator.query(spark, write_docs([])).collect() == []


def test_suffix_array_and_statistics():
    rng = random.Random(5)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        blob = b"\0".join(parts) + b"\0"
        longest, _ = rlbwt_dedup.matching_statistics(blob, np.array([len(p) for p in parts]))
        places = [p[s:] for p in parts for s in range(len(p) + 1)]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [max([common(a, b) for j, b in enumerate(places) if j != i], default=0) for i, a in enumerate(places)]
        assert longest.tolist() == want


def test_blocks_and_regrouping(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc") for _ in range(3000))] * 2
    kind = rlbwt_dedup.byte_windows()
    whole = [(t, h, f + k) for block in repeats.runs(rlbwt_dedup.text_bytes(texts), kind) for t, h, f, n in zip(*(x.tolist() for x in block), strict=True) for k in range(n)]
    monkeypatch.setattr(repeats, "BLOCK", 500)
    parts = [(t, h, f + k) for block in repeats.runs(rlbwt_dedup.text_bytes(texts), kind) for t, h, f, n in zip(*(x.tolist() for x in block), strict=True) for k in range(n)]
    assert whole == parts
