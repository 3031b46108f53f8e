import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quarry.llm import suffix_tree_lm as lm


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    """Base scores by counting everything."""
    train = Counter()
    for i, t in rows:
        if not held_out(i):
            train.update([*(t or "").encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        out.append((i, held_out(i), len(tokens), sum(train[w] > 0 for w in tokens), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    return out


def test_base_scores(spark, write_docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT_SHARE", 0.01)  # so that both the broadcast and the joined words are used
    rows = [(k, f"The cat Sat on the mat{k % 9} and word{k}") for k in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\x0b"), (203, "THE É é the"), (204, "long" * 5000), (3, rows[3][1])]
    found = lm.query(spark, write_docs(rows)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == Counter(brute(rows))


def test_beats_the_base_on_held_out_texts(spark):
    rows = lm.query(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert len(rows) > 10 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_vocabulary_of_odd_bytes(spark, docs_of):
    """Words are what bytes.lower() and bytes.split() give, whatever the bytes."""
    texts = [None, "", " ", "A b\x0bC\x0cd\te\r\nf  A ", "\x1cx\x1dy\x1e \x1f\x85 \xa0z\u2003w \x00", "É é İ ẞ K k", " lead", "trail "]
    odd = b"A\xff B\xc3 \x90 \xc3"
    rows = docs_of(enumerate(texts)).select("text").union(spark.range(3).selectExpr(f"cast(unhex('{odd.hex()}') as string)"))
    want = Counter(w for t in [*((t or "").encode() for t in texts), odd, odd, odd] for w in [*t.lower().split(), None])
    found = lm.vocabulary(rows).collect()
    assert {r.word if r.word is None else bytes(r.word): r.c for r in found} == want


def test_vocabulary_beyond_what_a_task_holds(spark):
    many, each = lm.HELD_WORDS // 50, 100  # words of a text, texts: every word is in two of them
    rows = spark.range(each, numPartitions=1).select(F.expr(f"array_join(transform(sequence(id * {many}, id * {many} + {2 * many - 1}), x -> 'w' || x), ' ')").alias("text"))
    found = lm.vocabulary(rows).groupBy("c").agg(F.count("*").alias("n")).collect()
    assert {r.c: r.n for r in found} == {1: 2 * many, 2: (each - 1) * many, each: 1}


def test_spelling_counts_are_summed_over_the_batches_of_a_task():
    """Batches of a few words each gave a row for each key and batch before."""
    words = [b"banana", b"bandana", b"cabana", b"nab", b"abba"]
    batches = [pa.record_batch([pa.array(words, pa.binary())], names=["word"]) for _ in range(200)]
    want = Counter()
    for w in words * 200:
        sym = [lm.START, *(b + 1 for b in w), lm.WORD_END]
        for k in range(1, len(sym)):
            for d in range(min(k, lm.SHALLOW) + 1):
                want[sum(s << (9 * e) for e, s in enumerate(sym[k - d : k + 1][::-1]))] += 1
    rows = [pair for b in lm._count_level(range(lm.SHALLOW + 1), None)(iter(batches)) for pair in zip(*b.to_pydict().values(), strict=True)]
    assert len(rows) == len(want) and dict(rows) == want


def test_places_of_hashes():
    rng = np.random.default_rng(5)
    some = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for keys in (some[:0], some[:1], some[:2000], np.append(some[:999], np.array([0, 1, 2, (1 << 64) - 1], np.uint64)), np.arange(500, dtype=np.uint64)):
        keys = np.unique(keys)
        asked = np.concatenate([some, keys, np.array([0, 1, (1 << 63), (1 << 64) - 1], np.uint64)])
        where = {k: n for n, k in enumerate(keys.tolist())}
        assert lm.Places(keys).find(asked).tolist() == [where.get(k, -1) for k in asked.tolist()]


def brute_scores(docs, spelled):
    """The same model by dictionaries: ``docs`` are (id, trained, tokens); ``spelled`` gives the log10 of a spelling."""
    train = [t for _, ok, t in docs if ok]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    bar, left = max(1.0, lm.FREQUENT_SHARE * n), lm.DISCOUNT * v / n
    single = lambda w: max(count[w] - lm.DISCOUNT, 0) / n + left * 10 ** spelled(w)
    symbol = lambda w: w if w is None or (count[w] and count[w] >= bar) else lm.RARE
    root = {w: single(w) for w in count if symbol(w) != lm.RARE}
    root[lm.RARE] = max(1 - sum(root.values()), 1e-12)
    tree = {}

    def chance(context, x):
        while context and context not in tree:
            context = context[1:]
        if not context:
            return root[x]
        kept, passed = tree[context]
        return kept.get(x, 0) + passed * chance(context[1:], x)

    for depth in (1, 2):
        seen = {}
        for t in train:
            padded = ("^",) * depth + t
            for k in range(len(t)):
                seen.setdefault(padded[k : k + depth], Counter())[symbol(t[k])] += 1
        for context, follow in seen.items():
            m = sum(follow.values())
            big = {x: c for x, c in follow.items() if c >= lm.LEAST_ENTRY * m}
            told = sum(c * math.log(c / m / chance(context[1:], x)) for x, c in big.items())
            if m >= lm.LEAST_COUNT and told >= lm.DIVERGENCE:
                kept = {x: (c - lm.DISCOUNT) / m for x, c in big.items()}
                tree[context] = (kept, 1 - sum(kept.values()))
    out = []
    for i, _, t in docs:
        padded, total = ("^", "^") + t, 0.0
        for k, w in enumerate(t):
            x = symbol(w)
            total += math.log10(chance(padded[k : k + 2], x)) + (math.log10(single(w) / root[x]) if x == lm.RARE else 0)
        out.append((i, round(total, 4)))
    return out, tree


@pytest.mark.parametrize(("hot", "bucket", "share"), [(lm.HOT, lm.BUCKET, lm.FREQUENT_SHARE), (12, 40, lm.FREQUENT_SHARE), (12, 40, 0.004)])
def test_scores_equal_a_plain_tree(spark, docs_of, monkeypatch, hot, bucket, share):
    """Whatever is broadcast, joined or dealt to buckets; context entries below their least share are left out."""
    monkeypatch.setattr(lm, "FREQUENT_SHARE", share)
    monkeypatch.setattr(lm, "LEAST_ENTRY", 0.02)
    monkeypatch.setattr(lm, "HOT_SHARE", 0.0)
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "of", "cat", "dog", "the cat", "of the", f"x{rng.randint(0, 60)}"]) for _ in range(n))
    texts = [prose(rng.randint(0, 40)) for _ in range(70)]
    texts += texts[:9] + ["the cat of the dog"] * 20 + [None, "", "of THE cat", "new \x0bwords é", "the " * 300]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[5]), (4, "the same id")]
    docs = [(i, i is not None and i % 5 != 0, (*(t or "").encode().lower().split(), None)) for i, t in rows]
    trees = []
    monkeypatch.setattr(lm, "learn_spelling", lambda *a, learn=lm.learn_spelling: trees.append(learn(*a)) or trees[-1])
    found = lm.score(docs_of(rows), "doc_id % 5 <> 0", hot=hot, bucket=bucket).collect()
    known = {}
    spelled = lambda w: trees[0].text_end() if w is None else known.setdefault(w, None) or known.update({w: float(trees[0].words([w])[0])}) or known[w]
    want, tree = brute_scores(docs, spelled)
    assert sum(len(c) == 1 for c in tree) > 5 and sum(len(c) == 2 for c in tree) > 5
    assert all(abs(a - b) < 1e-4 for a, b in zip(sorted(x for _, x in want), sorted(r.score for r in found), strict=True))
    got, expected = (sorted(((-1 if i is None else i), x) for i, x in y) for y in ([(r.doc_id, r.score) for r in found], want))
    assert [i for i, _ in got] == [i for i, _ in expected] and max(abs(a - b) for (_, a), (_, b) in zip(got, expected, strict=True)) < 1e-4


def test_word_order_and_repeated_passages_count(spark, docs_of):
    rng = random.Random(9)
    passage = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    rows = [(k, " ".join(passage)) for k in range(4)] + [(10 + k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(60))) for k in range(60)]
    shuffled = passage[:]
    rng.shuffle(shuffled)
    found = {r.doc_id: r.score for r in lm.score(docs_of([*rows, (100, " ".join(passage)), (101, " ".join(shuffled))]), "doc_id < 100").collect()}
    assert found[100] > 0.5 * found[101]


def test_many_copies_under_one_id(spark, docs_of):
    found = lm.score(docs_of([(1, "the same text here")] * 3000 + [(2, "another text")]), "doc_id = 1", hot=100, bucket=500).collect()
    assert len(found) == 3001 and len({round(r.score, 9) for r in found}) == 2


def test_no_training_text(spark, docs_of):
    (r,) = lm.score(docs_of([(1, "ab")]), "doc_id = 2").collect()
    assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0
    assert abs(r.score - 4 * math.log10(1 / 258)) < 1e-9
    assert lm.score(docs_of([]), "doc_id = 2").collect() == []


def tree():
    words = [b"banana", b"bandana", b"cabana", b"nab", b"abba"] * 40
    sym, size = lm.spell(words)
    levels = []
    for d in range(lm.DEPTH + 1):
        at, before, key = lm.contexts(sym, size, d)
        both = Counter(zip(key[before >= d].tolist(), sym[at[before >= d]].tolist(), strict=True))
        if d == 1:
            both[(lm.START, lm.TEXT_END)] += 1
        levels.append(tuple(np.array(x, t) for x, t in zip(([k for k, _ in both], [s for _, s in both], [*both.values()]), (np.uint64, np.int64, np.int64), strict=True)))
    return lm.grow(levels)


def test_distributions_sum_to_one():
    t = tree()
    symbols = np.array([*range(1, 257), lm.WORD_END, lm.TEXT_END])
    assert len(t.keys) > 10  # contexts beyond the root were retained
    for key in t.keys:
        assert abs((10 ** t.log10(np.full(len(symbols), key), symbols)).sum() - 1) < 1e-9


def test_longest_suffix_states():
    t = tree()
    sym, size = lm.spell([b"bandana", b"zzz"])
    _, _, key = lm.contexts(sym, size, lm.DEPTH)
    kept = set(t.keys.tolist())
    for k, state in zip(key.tolist(), t.find(key).tolist(), strict=True):
        want = next((s for d in range(lm.DEPTH, 0, -1) if (s := k & ((1 << (9 * d)) - 1)) in kept), 0)
        assert t.keys[state] == want
    good, bad = t.words([b"banana", b"qqqqqq"])
    assert good > bad
