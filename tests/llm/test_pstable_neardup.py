import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from quarry.llm import pstable_neardup as op


def table(spark, rows, tmp_path, kind=T.FloatType()):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind)), T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("rep", T.StringType()), T.StructField("n", T.StringType())])
    spark.createDataFrame([(i, x, 1, "v", "r", "n") for i, x in rows], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def planted(seed=1, dim=64):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(300)]
    for _ in range(25):
        centre = rng.standard_normal(dim)
        rows += [centre + rng.standard_normal(dim) * rng.uniform(0.1, 0.45) for _ in range(rng.integers(2, 12))]
    rows += [rows[310]] * 40 + [2 * rows[310], -rows[311]]
    return [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(rows)]


def brute(rows):
    x = np.array([r for _, r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    return link


@pytest.mark.parametrize("block", [2048, 5])
def test_recall_and_exactness(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rows = planted()
    found = {r.vec_id: r for r in op.query(spark, table(spark, rows, tmp_path)).collect()}
    link = brute(rows)
    assert len(found) == len(rows)
    n = np.array([found[k].n_links for k in range(len(rows))])
    assert (n <= link.sum(axis=1)).all()  # none below the threshold
    assert n.sum() >= 0.95 * link.sum()
    comp = np.array([found[k].component_id for k in range(len(rows))])
    reach = np.arange(len(rows))
    while True:
        new = np.minimum(reach, np.where(link, reach[None, :], len(rows)).min(axis=1))
        if (new == reach).all():
            break
        reach = new
    assert (comp >= reach).all() and (comp == reach).mean() > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_recall_over_twenty_thousand_vectors(spark, tmp_path):
    """Pairs planted around the threshold among strangers; recall is counted over all pairs at 0.9 or more."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 64))
    for k in range(0, 6000, 3):  # a vector and two relatives of cosines 0.88 to 0.97
        for j in (1, 2):
            c = rng.uniform(0.88, 0.97)
            side = rng.standard_normal(64)
            side -= side @ x[k] / (x[k] @ x[k]) * x[k]
            x[k + j] = c * x[k] / np.linalg.norm(x[k]) + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x = x.astype(np.float32)
    found = op.query(spark, table(spark, [(k, v.tolist()) for k, v in enumerate(x)], tmp_path)).toPandas().set_index("vec_id")["n_links"]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.concatenate([(unit[a : a + 2000] @ unit.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(x), 2000)])
    got = found.sort_index().to_numpy()
    assert want.sum() > 4000 and (got <= want).all() and got.sum() >= 0.96 * want.sum()


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e-30, 0.0]), (10, [3e38, 3e37]), (11, [0.0, -1.0])]
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in op.query(spark, table(spark, rows, tmp_path)).collect())
    lone = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 8, 11)]
    assert found == sorted([*lone, (7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (10, 3, 7, False)])


def test_empty_table_and_doubles(spark, tmp_path):
    assert op.query(spark, table(spark, [], tmp_path / "a")).collect() == []
    rows = [(1, [1e300, 1e299]), (2, [1e300, 1.1e299])]
    assert [r.n_links for r in op.query(spark, table(spark, rows, tmp_path / "b", T.DoubleType())).collect()] == [1, 1]


def test_buckets_of_a_batch_are_checked_together(monkeypatch):
    """Small buckets over several tables: right sums, and steps that follow the batches instead of the buckets."""
    k, tables, calls = 9, 12, []
    for name in ("unit", "signatures"):
        plain = getattr(op, name)
        monkeypatch.setattr(op, name, lambda *a, plain=plain, **b: calls.append(len(a[0])) or plain(*a, **b))
    rng = np.random.default_rng(3)
    pairs = [c + 0.2 * rng.standard_normal((3, d)) for d in (16, 24) for c in rng.standard_normal((300, d))]
    vectors, weight = [v.astype(np.float32) for p in pairs for v in p], rng.integers(1, 4, 1800)
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])
    placed = pa.Table.from_batches(op._buckets(k, tables, np.float32)([pa.record_batch([np.arange(1800), weight, [v.tobytes() for v in vectors]], schema=schema)]))
    for at, c in enumerate(("one", "two", "side"), 2):
        placed = placed.add_column(at, c, pa.array(np.zeros(placed.num_rows, np.int32)))
    batches = placed.sort_by([("table", "ascending"), ("bucket", "ascending")]).combine_chunks().to_batches(max_chunksize=4321)
    buckets = len(placed.group_by(["table", "bucket"]).aggregate([]))
    calls.clear()
    links = {}
    for b in op._check(0.9, np.float32, k, tables)(iter(batches)):
        for r, n in zip(b.column("rep").to_pylist(), b.column("links").to_pylist(), strict=True):
            links[r] = links.get(r, 0) + n
    assert buckets > 5000 and len(calls) < 1000, (buckets, len(calls))
    want = {}
    sig = [op.signatures(op.unit([v.tobytes()], np.float32), k, tables)[0] for v in vectors]
    for half in (range(900), range(900, 1800)):
        x = np.array([vectors[r] for r in half], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in np.argwhere(x @ x.T >= 0.9) + half[0]:
            if i != j and (sig[i] == sig[j]).any():
                want[int(i)] = want.get(int(i), 0) + int(weight[j])
    assert len(want) > 1000 and {r: n for r, n in links.items() if n} == want


def test_spanning_pairs_of_a_dense_group():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (50, 40), (200, 3000)):
        i, j = rng.integers(0, n, (2, m))
        a, b = op.spanning(n, i, j)
        assert len(a) < n and op.forest(zip(a.tolist(), b.tolist(), strict=True)) == op.forest(zip(i.tolist(), j.tolist(), strict=True))
