import math
import random
from collections import Counter

import numpy as np
import pytest
from quarry.llm import weak_quality as op


def test_em_finds_the_good_labellers():
    rng = random.Random(1)
    right = [0.95, 0.9, 0.85, 0.6, 0.55, 0.8, 0.7]
    patterns, truth = {}, {}
    for _ in range(20000):
        good = rng.random() < 0.8
        p = "".join("0" if rng.random() < 0.2 else "+-"[(rng.random() < r) != good] for r in right)
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    posterior = op.expectation_maximisation(patterns)
    agree = sum(sum(g == (posterior[p] > 0.5) for g in gs) for p, gs in truth.items()) / 20000
    majority = sum(sum(g == (p.count("+") >= p.count("-")) for g in gs) for p, gs in truth.items()) / 20000
    assert agree > 0.93 and agree >= majority
    assert op.expectation_maximisation({}) == {} and op.expectation_maximisation({"0000000": 3}) == {"0000000": 0.5}


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("crc32(cast(doc_id as string)) % 2 = 0")
    rest = labels.join(half, "doc_id", "left_anti")
    found = op.predict(docs, op.fit(docs, half)).join(rest, "doc_id").collect()
    assert np.mean([(r.quality_score >= 0.5) == bool(r.quality) for r in found]) > 0.93
    clean = [r for r in found if r.quality and not r.toxic]
    assert np.mean([r.keep for r in clean]) > 0.95
    toxic = [r for r in found if r.toxic]
    assert np.mean([r.toxic_words > 0 for r in toxic]) > 0.4


def test_defined_results(spark, docs_of):
    plain = "The cat of the house went over the hill, and it was a good day for all of them in town.\n"
    docs = docs_of([(1, None), (2, ""), (3, " \n"), (4, plain), (4, plain), (5, "BUY!!! NOW!!! " * 60), (6, "a"), (None, plain), (7, "spam " * 30000)])
    found = op.predict(docs, op.fit(docs)).collect()
    assert len(found) == 9 and all(r.quality_score == 0 and not r.keep for r in found if r.doc_id in (1, 2, 3))
    four = [r for r in found if r.doc_id == 4]
    assert four[0] == four[1] and four[0].keep and all(r.toxic_words == 0 for r in found)
    empty = docs_of([])
    assert op.predict(empty, op.fit(empty)).collect() == []


def plain_votes(text):
    """A text's votes, by loops over its characters and words."""
    b = text.encode()
    ws = b.split()
    kinds = Counter("upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122 else "digit" if 48 <= c <= 57 else "blank" if c in b" \t\n\r" else "high" if c > 127 else "sign" for c in b)
    n, lines = len(ws), b.split(b"\n")
    letters = max(kinds["upper"] + kinds["lower"], 1)
    signs, upper = kinds["sign"] / max(len(b), 1), kinds["upper"] / letters
    stutter = sum(x == y for x, y in zip(ws, ws[1:], strict=False)) / max(n - 1, 1)
    top = max(Counter(ws).values(), default=0) / max(n, 1)
    length = (len(b) - kinds["high"] / 2 - kinds["blank"]) / max(n, 1)
    variety = len(set(ws)) / max(n, 1)
    rules = [
        (n >= 10 and signs > 0.07, 0 < signs < 0.05), (upper > 0.25, upper < 0.08), (n >= 20 and stutter > 0.08, n >= 20 and stutter < 0.03), (n >= 20 and top > 0.15, n >= 40 and top < 0.1),
        (1 - len(set(lines)) / len(lines) > 0.3, False), (n >= 10 and not 3 <= length <= 6.6, n >= 10 and 4 <= length <= 6), (n >= 50 and variety < 0.3, n >= 30 and variety > 0.55),
    ]
    return "".join("-" if bad else "+" if good else "0" for bad, good in rules)


def plain_posterior(patterns):
    """Expectation-maximisation by loops."""
    good = {p: min(max(0.5 + (p.count("+") - p.count("-")) / (2 * len(p)), 0.05), 0.95) for p in patterns}
    for _ in range(200):
        new = {}
        side = []
        for q in (good, {p: 1 - x for p, x in good.items()}):
            mass = sum(patterns[p] * q[p] for p in patterns)
            share = [{v: (sum(patterns[p] * q[p] for p in patterns if p[k] == v) + 0.5) / (sum(patterns[p] * q[p] for p in patterns if p[k] != "0") + 1) for v in "+-"} for k in range(7)]
            side.append({p: math.log((mass + 1) / (sum(patterns.values()) + 2)) + sum(math.log(share[k][v]) for k, v in enumerate(p) if v != "0") for p in patterns})
        new = {p: 1 / (1 + math.exp(side[1][p] - side[0][p])) for p in patterns}
        done = max(abs(new[p] - good[p]) for p in patterns) < 1e-9
        if done:
            break
        good = new
    return good


def test_weak_labels_equal_plain_ones(spark, docs_of):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "cat", "HOUSE", "a", "!!!", "über", "x1", "verylongwordindeed"])
    texts = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(120)] + ["BUY NOW! " * 40, "same line here\n" * 30, "ok ok ok " * 30]
    patterns = Counter(map(plain_votes, texts))
    want = plain_posterior(patterns)
    docs = docs_of(list(enumerate(texts)))
    model = op.fit(docs)
    found = {r.doc_id: r for r in op.predict(docs, model).collect()}
    assert all(abs(found[k].weak_label - want[plain_votes(t)]) < 1e-6 for k, t in enumerate(texts))
    assert all(r.keep == (r.quality_score >= op.KEEP_ABOVE) for r in found.values())


def test_samples_stay_bounded_with_many_copies(spark, docs_of, monkeypatch):
    """However many rows are equal: the scorer's sample and the labelled one."""
    monkeypatch.setattr(op, "SAMPLE", 50)
    monkeypatch.setattr(op, "LABELLED_SAMPLE", 50)
    seen = []
    monkeypatch.setattr(op, "train", lambda x, y, train=op.train: seen.append(len(x)) or train(x, y))
    for text in ("a copied text of some words", "another one", "a third one here"):  # one of them is drawn
        docs = docs_of([(1, text)] * 2000)
        labels = spark.createDataFrame([(1, 1)] * 2000, "doc_id long, toxic int")
        op.fit(docs, labels)
    assert max(seen) <= 100


@pytest.mark.parametrize("copies", [1, 30])
def test_marks_ignore_copies(spark, copies):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randint(0, 300))
    clean = [" ".join(word() for _ in range(40)) for _ in range(200)]
    bad = [" ".join([*(word() for _ in range(30)), rng.choice(["vilefoo", "vilebar", "vilebaz"])]) for _ in range(40)]
    copied = ["a copied text with very special words vilefoo"] * copies
    rows = [(t, 0) for t in clean] + [(t, 1) for t in bad + copied]
    found = op.marks(spark.createDataFrame(rows, "text string, toxic int"))
    assert found and all(m.startswith("vile") for m in found)
