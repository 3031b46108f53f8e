"""Exact top-k by inner product: a self-join or join of two vector tables in blocks, and a single query.

Vectors are packed into written blocks of bounded size, which the tasks read where they need them instead of having
them shuffled to each of the pairs.  A task runs a left block past right ones and keeps the k best of each left row
on the way; only these are shuffled, and a window merges what several tasks found.  Scores are sums in double precision
in the order of the vectors, wherever their blocks are, so that equal vectors tie; ties go to the lesser id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.scalars import cosine, dot
from quarry.storage import materialise

#: Vectors of a written part; bytes of a packed block of them.
BLOCK, BLOCK_BYTES = 4096, 1 << 20
#: Left rows of one product, pairs whose scores are summed at once, left blocks and k that a task keeps the best of.
ROWS, PAIRS, HELD, MOST_KEPT = 512, 1 << 16, 16, 1000


def _blocks(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``nr, ids, n, vs, wide``: written blocks, ``vs`` being the bytes of n vectors; and the number of parts."""
    kind, of = (dict(vectors.dtypes)[c] for c in (id_col, vector_col))
    number = np.dtype("<f4" if of == "array<float>" else "<f8")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if number.itemsize == 4 else "array<double>").alias("v")).filter("id is not null and v is not null")
    n = max(1, math.ceil(rows.count() / BLOCK))

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v, number) for v in b.column("v").to_numpy(zero_copy_only=False)])
            step = max(1, BLOCK_BYTES // max(1, x.shape[1] * number.itemsize))
            for at in range(0, len(x), step):
                ids, some = b.column("id").slice(at, step), x[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(some)], pa.int32()), pa.array([some.tobytes()], pa.binary())], ["ids", "n", "vs"])

    packed = rows.repartition(n, F.xxhash64("id")).mapInArrow(pack, f"ids array<{kind}>, n int, vs binary")
    return materialise(packed.withColumns({"nr": F.monotonically_increasing_id(), "wide": F.lit(number.itemsize)})), n


def _or_all(least: np.ndarray) -> np.ndarray:
    """Where rounding leaves no bound (infinite scores), every pair is summed."""
    return np.where(np.isnan(least), -np.inf, least)


class _Best:
    """The k best right rows so far of each row of a left block, and the scores they have to reach."""

    def __init__(self, ids, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.most = self.norm.max(initial=0.0)
        self.floor = np.full(len(x), -np.inf)
        self.rows, self.b, self.sim = np.zeros(0, np.int64), None, np.zeros(0)

    @np.errstate(over="ignore", invalid="ignore")
    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        k, found, norm = min(self.k, len(y)), [], np.sqrt(np.einsum("ij,ij->i", y, y))
        sound, most = np.isfinite(norm).all(), norm.max(where=np.isfinite(norm), initial=0.0)
        kind = np.float32 if sound and max(most, self.most) < 1e15 else np.float64  # scores that choose the pairs to sum
        off = 4 * (y.shape[1] + 4) * np.finfo(kind).eps * most  # what rounding can change in them
        x, turned = self.x.astype(kind), y.astype(kind).T
        for at in range(0, len(x), ROWS):
            s = x[at : at + ROWS] @ turned
            if not sound:
                s[np.isnan(s)] = -np.inf
            least = _or_all(self.floor[at : at + ROWS] - (slack := off * self.norm[at : at + ROWS] + 1e-30))
            rows = np.flatnonzero(s.max(axis=1) >= least)
            s, least, slack = s[rows], least[rows].astype(kind), slack[rows]
            near = s >= least[:, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * k)
            if len(many):
                cut = _or_all(np.partition(s[many], len(y) - k, axis=1)[:, len(y) - k] - 2 * slack[many])
                near[many] = s[many] >= np.maximum(cut, least[many]).astype(kind)[:, None]
            i, j = np.divmod(np.flatnonzero(near), len(y))
            found.append((rows[i] + at, j))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(i):
            return
        sim = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            each = self.x[i[at : at + PAIRS]] * y[j[at : at + PAIRS]]
            total = np.zeros(len(each))
            for d in range(each.shape[1]):
                total += each[:, d]
            sim[at : at + PAIRS] = total
        real = ~np.isnan(sim)
        rows, sim = np.concatenate([self.rows, i[real]]), np.concatenate([self.sim, sim[real]])
        b = ids[j[real]] if self.b is None else np.concatenate([self.b, ids[j[real]]])
        by = np.lexsort((b if b.dtype != object else np.unique(b, return_inverse=True)[1], -sim, rows))
        by = by[np.arange(len(by)) - np.searchsorted(rows[by], rows[by]) < self.k]
        self.rows, self.b, self.sim = rows[by], b[by], sim[by]
        full = np.bincount(self.rows, minlength=len(self.x))
        last = np.cumsum(full) - 1
        self.floor[full == self.k] = self.sim[last[full == self.k]]


def topk_join(left: DataFrame, right: DataFrame, k: int, id_col: str = "hex_id", vector_col: str = "embedding") -> DataFrame:
    """``a, b, rank, sim``: the k rows of ``right`` with the largest inner product for each of ``left`` (a row of a
    self-join finds itself too; k beyond the table's size gives all rows).  Rows with a null id or vector are out."""
    spark, kind = left.sparkSession, dict(left.dtypes)[id_col]
    a, n = _blocks(left, id_col, vector_col)
    b, _ = (a, n) if left is right else _blocks(right, id_col, vector_col)
    two = b.select(*[F.col(c).alias(f"{c}_b") for c in ("ids", "n", "vs", "wide")])
    # every task reads the right blocks it needs; those of a left block follow one another in few tasks
    pairs = a.hint("shuffle_replicate_nl").crossJoin(two).coalesce(max(n, 2 * spark.sparkContext.defaultParallelism))
    arrow = pa.string() if kind == "string" else pa.int64()

    def told(best: _Best):
        if best.b is not None:
            yield pa.RecordBatch.from_arrays([best.ids.take(pa.array(best.rows)), pa.array(best.b, arrow), pa.array(best.sim)], ["a", "b", "sim"])

    def best(batches):
        vectors = lambda batch, row, end: np.frombuffer(batch.column(f"vs{end}")[row].as_buffer(), f"<f{batch.column(f'wide{end}')[row].as_py()}").reshape(batch.column(f"n{end}")[row].as_py(), -1).astype(np.float64)
        held: dict = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, y = batch.column("ids_b")[row].values.cast(arrow), vectors(batch, row, "_b")
                if (key := batch.column("nr")[row].as_py()) not in held:
                    if len(held) == HELD:
                        yield from told(held.pop(next(iter(held))))
                    held[key] = _Best(pa.array(batch.column("ids")[row].as_py(), arrow), vectors(batch, row, ""), k)
                held[key].meet(ids.to_numpy(zero_copy_only=False), y)
                if k > MOST_KEPT:
                    yield from told(held.pop(key))
        for some in held.values():
            yield from told(some)

    ranked = pairs.mapInArrow(best, f"a {kind}, b {kind}, sim double")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("rank") <= k).select("a", "b", "rank", "sim")


def topk_query(vectors: DataFrame, query: list[float], k: int, id_col: str = "hex_id", vector_col: str = "embedding") -> DataFrame:
    """``id, sim, cos`` of the k rows with the largest inner product with one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    scored = rows.select(F.col(id_col).alias("id"), dot(F.col(vector_col), q).alias("sim"), cosine(F.col(vector_col), q).alias("cos"))
    return scored.orderBy(F.desc("sim"), "id").limit(k)


def unordered(pairs: DataFrame, at_least: float) -> DataFrame:
    """``lo, hi, sim``: pairs of unlike ids at or above a similarity, each once whichever side listed it."""
    kept = pairs.filter((F.col("sim") >= at_least) & (F.col("a") != F.col("b")))
    return kept.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("sim").alias("sim"))
