"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions and quantised with a random shift; a table's bucket is
the tuple of its quantised projections (as a 32-bit hash).  The directions of a table and the number of tables
follow from the number of vectors and the wished recall at the threshold.  Pairs of a bucket are checked by exact
cosine in double precision, in blocks; a pair that shares buckets in several tables counts in the first of them,
so no pair is ever written out: a task returns sums of links and a spanning forest.  The buckets of a batch are
checked together, those of one size by one product, because most hold a few vectors.

Equal vectors are one node with a weight, so a group of copies costs one row.  A bucket of more than ``BLOCK``
distinct vectors is compared block by block in as many tasks.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing;
vectors of unlike dimension never link; repeated rows are vectors of their own.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import mix, record
from quarry.operators.components import connected_components, forest
from quarry.operators.joins import heavy_keys, spread_join
from quarry.storage import materialise

COSINE = 0.9
WIDTH = 2.0
RECALL = 0.97
#: Random vectors that share a bucket with a vector, in the mean over one table; distinct vectors of a block.
STRANGERS = 16
BLOCK = 2048
#: Rows of a group that are multiplied at once; components and products that one vectorised step holds.
STRIP = 256
CELLS = 1 << 20
#: Buckets of more than BLOCK vectors, up to which these are broadcast.
MOST_CROWDED = 1 << 20


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for two points this far apart."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors: few strangers in a bucket, the recall at the threshold."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(6, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(far)))
    return k, max(4, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def nodes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vector as bytes, null where it can't link."""
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>").alias("x"))
    dtype = np.float32 if kind == "float" else np.float64
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def apply(batches):
        for b in batches:
            x, out = b.column("x"), []
            flat = pc.fill_null(x.values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            at = x.offsets.to_numpy()
            for k, ok in enumerate(x.is_valid().to_pylist()):
                v = flat[at[k] : at[k + 1]]
                out.append((v + 0.0).astype(dtype).tobytes() if ok and len(v) and np.isfinite(v).all() and v.any() else None)
            yield record(schema, b.column("vec_id"), out)

    return rows.mapInArrow(apply, "vec_id long, v binary")


def unit(v: list[bytes], dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(v), dtype=dtype).astype(np.float64).reshape(len(v), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.lru_cache(maxsize=1)
def projections(dim: int, k: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (a column each) and shifts of all tables, drawn once in a worker."""
    rng = np.random.default_rng([seed, dim, k, tables])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, width, k * tables)


def signatures(x: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = 11, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Buckets (rows x tables) of unit vectors, of the tables from ``start`` to ``stop`` if given."""
    direction, shift = projections(x.shape[1], k, tables, width, seed)
    stop = tables if stop is None else stop
    some = slice(k * start, k * stop)
    q = np.floor((x @ direction[:, some] + shift[some]) / width).astype(np.int64).reshape(len(x), stop - start, k).astype(np.uint64)
    out = np.zeros((len(x), stop - start), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(3) + q[:, :, j])
    return (out >> np.uint64(32)).astype(np.uint32)


def _buckets(k: int, tables: int, dtype):
    schema = pa.schema([("table", pa.int32()), ("bucket", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])

    def apply(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                v, size = part.column("v").to_pylist(), pc.binary_length(part.column("v")).to_numpy()
                for dim in np.unique(size):
                    rows = np.flatnonzero(size == dim)
                    sig = signatures(unit([v[r] for r in rows], dtype), k, tables)
                    i, t = np.divmod(np.arange(sig.size), tables)
                    take = lambda c, rows=rows, i=i: part.column(c).take(pa.array(rows[i]))  # noqa: B023, E731
                    yield record(schema, t.astype(np.int32), sig.ravel().astype(np.int64) + (int(dim) << 32), take("rep"), take("n"), take("v"))

    return apply


def near_pairs(x: np.ndarray, size: np.ndarray, cosine: float):
    """Rows ``i < j`` of one group (groups lie one after the other) that are near.  Groups of one size are multiplied
    together, large ones a strip of rows at a time."""
    start = np.cumsum(size) - size
    for s in np.unique(size).tolist():
        first, many = start[size == s], max(1, CELLS // (s * max(min(s, STRIP), x.shape[1])))
        for c in range(0, len(first), many):
            at = first[c : c + many, None] + np.arange(s)
            y = x[at] if len(at) > 1 else x[None, at[0, 0] : at[0, 0] + s]
            for a in range(0, s, STRIP):
                g, i, j = np.nonzero(y[:, a : a + STRIP] @ y[:, a:].transpose(0, 2, 1) >= cosine)
                ok = i < j
                yield at[g[ok], i[ok] + a], at[g[ok], j[ok] + a]


def unseen(x: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Which pairs share no bucket in a table before their own.  Buckets are worked out again for what is near alone,
    for two tables first, then for twice as many: most pairs far above the threshold are told by the first."""
    new, left, start = np.ones(len(i), bool), np.arange(len(i)), 0
    while (left := left[table[left] > start]).size:
        stop = min(int(table[left].max()), max(2, 2 * start))
        p, q, place = i[left], j[left], np.zeros(len(x), np.int64)
        place[p] = place[q] = 1
        some, place = np.flatnonzero(place), np.cumsum(place) - 1
        sig = np.concatenate([signatures(x[some[s : s + 1000]], k, tables, start=start, stop=stop) for s in range(0, len(some), 1000)])
        p, q, before = place[p], place[q], np.arange(start, stop)
        shared = np.concatenate([((sig[p[s : s + 50_000]] == sig[q[s : s + 50_000]]) & (before < table[left[s : s + 50_000], None])).any(axis=1) for s in range(0, len(left), 50_000)])
        new[left[shared]] = False
        left, start = left[~shared], stop
    return new


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than ``n`` pairs that connect the same of ``n`` rows."""
    least = np.arange(n)
    while (open_ := least[i] != least[j]).any():
        i, j = i[open_], j[open_]
        a, b = least[i], least[j]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
    hung = np.flatnonzero(least != np.arange(n))
    return hung, least[hung]


def _check(cosine: float, dtype, k: int, tables: int):
    out = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    keys = ("table", "bucket", "one", "two")

    def judge(t: pa.Table, size: np.ndarray, links: dict, edges: list):
        """All pairs of groups of one dimension (or between a group's two blocks)."""
        x = unit(t.column("v").to_pylist(), dtype)
        table, one, two, side, rep, n = (t.column(c).to_numpy() for c in ("table", "one", "two", "side", "rep", "n"))
        for i, j in near_pairs(x, size, cosine):
            ok = (one[i] == two[i]) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            new = unseen(x, i, j, table[i], k, tables)
            i, j = i[new], j[new]
            if len(i):
                total = (np.bincount(i, weights=n[j], minlength=len(x)) + np.bincount(j, weights=n[i], minlength=len(x))).astype(np.int64)
                r = np.flatnonzero(total)
                for node, more in zip(rep[r].tolist(), total[r].tolist(), strict=True):
                    links[node] = links.get(node, 0) + more
                if len(i) > len(x):  # the pairs of a dense group
                    i, j = spanning(len(x), i, j)
                edges += zip(rep[i].tolist(), rep[j].tolist(), strict=True)
            if len(edges) > 200_000:
                edges[:] = [(b, a) for b, a in forest(iter(edges)).items()]

    def groups(t: pa.Table, size: np.ndarray):
        """Groups of two and more, by dimension, in slices of about CELLS components (or one group)."""
        first = np.cumsum(size) - size
        wide = pc.binary_length(t.column("v")).to_numpy()[first] // np.dtype(dtype).itemsize
        for dim in np.unique(wide[size > 1]).tolist():
            g = np.flatnonzero((size > 1) & (wide == dim))
            part = (np.cumsum(size[g]) - size[g]) // max(1, CELLS // dim)
            for some in np.split(g, np.flatnonzero(np.diff(part)) + 1):
                rows = np.repeat(first[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
                yield t.take(pa.array(rows)), size[some]

    def flush(links: dict, edges: list):
        hung = forest(iter(edges))
        yield record(out, [*links, *hung], [*links.values(), *[0] * len(hung)], [*[None] * len(links), *hung.values()])

    def apply(batches):
        held, links, edges = [], {}, []
        for b in itertools.chain(batches, [None]):  # the last group of a batch may go on in the next
            if b is not None and not b.num_rows or b is None and not held:
                continue
            t = pa.Table.from_batches([*held, *([] if b is None else [b])]).combine_chunks()
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), *([t.num_rows] if b is None else [])]
            for part, size in groups(t, np.diff(cuts)) if len(cuts) > 1 else ():
                judge(part, size, links, edges)
                if len(links) > 50_000:
                    yield from flush(links, edges)
                    links, edges = {}, []
            held = t.slice(cuts[-1]).to_batches()
        if links:
            yield from flush(links, edges)

    return apply


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    dtype = np.float32 if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64
    rows = materialise(nodes(vectors, id_col, vector_col))
    classes = materialise(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    k, tables = shape(classes.count(), cosine, recall=recall)
    placed, slim = (classes.mapInArrow(_buckets(k, tables, dtype), "table int, bucket long, rep long, n long, v binary") for _ in range(2))
    sizes = materialise(slim.groupBy("table", "bucket").agg(F.count("*").alias("many")).filter(F.col("many") > BLOCK).select("table", "bucket", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")))
    sizes = F.broadcast(sizes) if sizes.limit(MOST_CROWDED + 1).count() <= MOST_CROWDED else sizes
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("side"), j).alias("one"), F.greatest(F.col("side"), j).alias("two")))).alias("p")
    spread = placed.join(sizes, ["table", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = spread.withColumn("side", block).select("table", "bucket", "rep", "n", "v", "side", pair).select("table", "bucket", "p.one", "p.two", "side", "rep", "n", "v")
    sorted_ = dealt.repartition("table", "bucket", "one", "two").sortWithinPartitions("table", "bucket", "one", "two")
    found = materialise(sorted_.mapInArrow(_check(cosine, dtype, k, tables), "rep long, links long, to long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = connected_components(found.filter("to is not null").select(F.col("rep").alias("src"), F.col("to").alias("dst")))
    whole = classes.join(links, "rep", "left").join(named.withColumnRenamed("id", "rep"), "rep", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    able = spread_join(rows.filter("v is not null"), whole, ["v"], heavy_keys(classes, ["v"]), "vec_id", ["n_links", "component_id"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: links and components of all vectors at a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
