import random

import corpus_pipeline
import pytest
from quarry.llm import simhash
from quarry.storage import materialise


def near_copy(text, rng, edits):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = "changed" + str(rng.randint(0, 9999))
    return " ".join(words)


def jaccard(a, b, n=5):
    x, y = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_groups_against_brute_force(spark, docs_of):
    rng = random.Random(3)
    prose = lambda n: " ".join("w" + str(int(rng.paretovariate(0.5)) % 3000) for _ in range(n))
    texts = [prose(rng.randint(60, 300)) for _ in range(120)]
    texts += [near_copy(t, rng, 1) for t in texts[:40]] + texts[40:50] + ["", "", "one", "one", "two words"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    found = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(rows)).collect()}
    assert set(found) == set(range(len(texts)))
    similar = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.85]
    assert sum(found[a] == found[b] for a, b in similar) >= 0.95 * len(similar) > 30
    for a in range(120):  # unlike texts stay apart
        assert found[a] == a or any(jaccard(texts[a], texts[b]) >= 0.7 for b in range(a))


def test_near_groups_at_the_threshold_itself(spark, docs_of):
    """Pairs of texts with replaced ends, at 0.7 to 0.9: all of 0.8 and more are found (but for the index's recall), and
    none below it is."""
    rng = random.Random(6)
    rows, pairs = [], []
    for k in range(240):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice((60, 104, 204, 404)))]
        wanted = (0.7, 0.75, 0.78, 0.8, 0.8, 0.82)[k % 6]
        n = len(words) - 4
        common = -(-2 * n * wanted // (1 + wanted))  # of n shingles, rounded up
        cut = int(n - common)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - cut] + [f"v{rng.randint(0, 10**6)}" for _ in range(cut)]))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    found = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(rows)).collect()}
    linked = [found[2 * k] == found[2 * k + 1] for k in range(240)]
    assert all(found[2 * k] == 2 * k for k in range(240))
    assert not any(x for x, j in zip(linked, pairs, strict=True) if j < 0.8)
    like = [x for x, j in zip(linked, pairs, strict=True) if 0.8 <= j < 0.83]
    assert len(like) > 100 and sum(like) >= 0.97 * len(like)


@pytest.mark.parametrize("n", [1, 16_384, 262_145, 10**6, 15 * 10**6, 10**9])
def test_the_index_finds_nearly_all_pairs_at_every_size(n):
    bits, segments = simhash.wide_shape(n)
    equal = (1 - simhash.differing(simhash.SIMILARITY)) ** bits  # a segment of a pair at the threshold
    assert 1 - (1 - equal) ** segments >= 0.989


@pytest.mark.parametrize("shingles", [1 << 20, 500])
def test_confirmed_components_against_brute_force(spark, docs_of, monkeypatch, shingles):
    """A family of texts around the threshold, in one group of candidates and dealt over many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    rng = random.Random(7)
    base = " ".join("w" + str(rng.randint(0, 3000)) for _ in range(150))
    rows = [(k, near_copy(base, rng, rng.randint(1, 4))) for k in range(60)] + [(5, "another text of the same id")]
    want = {k: k for k in range(60)}
    for a in range(60):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8 and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {k: low if c == high else c for k, c in want.items()}
    assert 1 < len(set(want.values())) < 60
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(rows)).collect()}
    assert got == want


@pytest.mark.parametrize("block", [2048, 4])
def test_blocks_lose_nothing(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(4)
    base = " ".join("w" + str(rng.randint(0, 3000)) for _ in range(200))
    rows = [(k + 9, near_copy(base, rng, 1)) for k in range(30)]
    assert {r.component_id for r in simhash.near_groups(docs_of(rows)).collect()} == {9}


def test_every_stage_takes_effect(spark, docs_of, tmp_path):
    """Planted: a text without letters, junk, near copies, a shared passage."""
    rng = random.Random(5)
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(150).collect()
    texts = list(dict.fromkeys(r.text for r in source if len(r.text) > 600))
    passage = " ".join(f"passage{k} so{k} the" if k % 5 == 0 else f"passage{k} to{k}" for k in range(30))
    unlike = [" ".join(reversed(t.split())) for t in texts[:4]]  # no near copies of the others
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, None), (n + 1, "12 !! 34", "en"), (n + 2, "JUNK!! " * 200, "en"), (None, "a text of no id", "en")]
    rows += [(n + 3, near_copy(texts[0], rng, 1), "en"), (n + 4, texts[1], "en"), (5, texts[5], "en")]
    rows += [(n + 5, unlike[2] + " " + passage + " end", "en"), (n + 6, unlike[3] + " " + passage, "en")]
    docs_of([r for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert not {n, n + 1, None} & kept[0].keys() and n + 2 in kept[0]
    assert n + 2 not in kept[1] and len(kept[1]) > 0.9 * n
    assert not {n + 3, n + 4} & kept[2].keys() and {0, 1, 5} <= kept[2].keys()
    assert {n + 5, n + 6} <= kept[2].keys() and all("passage7" not in t for t in kept[3].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept[3].keys()


def test_empty_table(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
