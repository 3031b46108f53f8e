"""Exact repeated windows over a whole corpus: what the byte and the word operators share.

A window is ``window`` consecutive elements (bytes or words) of one text.  Its minimiser is the least hash among
its ``gram``-element grams (the leftmost of equals), so equal windows have equal minimisers wherever they stand.
Consecutive windows that share a minimiser travel as one string to the bucket of that minimiser, and only if the
minimiser occurs at a second place: else none of these windows can occur twice.

1. minimisers of all texts are counted; those that occur twice go back to their texts, with a mark if frequent;
2. the texts send the strings of those minimisers;
3. a bucket holds the strings of whole minimisers and finds their repeated windows with the operator's own index;
4. strings of a frequent minimiser (a line or passage of very many texts) are counted by content first, so that a
   bucket holds distinct ones with their counts.  If these are still more than ``BODIES``, they are cut again, into
   runs of windows that share the minimiser of longer grams as well, and so on up to grams as long as the window, where
   a bucket holds a single string.  So every bucket is bounded, and every window is judged by the operator's index;
5. the repeated windows go back to the texts.

Every step is a shuffle on a uniform hash, holds a bounded group in memory, and can be repeated after a loss.  Joins on
minimisers and contents keep frequent keys spread (``operators.joins``).
Texts and strings are told apart by 128 bits, so repeated rows and clashing ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import documents, mix, raw, record, slices, u64
from quarry.operators.joins import HEAVY, heavy_keys, spread_join
from quarry.storage import materialise

#: Places of a minimiser beyond which its strings are counted by content first, and the distinct strings of a bucket
#: beyond which they are cut by a longer minimiser.
FREQUENT = 300
BODIES = 2000
#: Windows that are treated in one vectorised step, bytes of text in a slice, and of distinct strings in an index.
BLOCK = 1 << 19
SLICE = 1 << 19
INDEXED = 1 << 19
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Elements:
    """Texts as a flat array of element hashes; element a of the flat array is blob[lo[a]:hi[a]]."""

    values: np.ndarray
    sizes: np.ndarray
    blob: bytes
    lo: np.ndarray
    hi: np.ndarray


@dataclass(frozen=True)
class Kind:
    """How an operator sees texts: its elements, its window and gram, and the index that finds repeated windows.

    ``canonical`` turns a cut-out string into the form that is equal for equal element sequences; ``repeated``
    takes distinct strings and how often each occurs and returns, over all their windows, which occur twice."""

    window: int
    gram: int
    elements: Callable[[list[bytes]], Elements]
    canonical: Callable[[bytes], bytes]
    repeated: Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, BLOCK + 4096)
        up, down = np.full(size, u64(base)), np.full(size, u64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _powers[base]
    return up[:n], down[:n]


def gram_hash(values: np.ndarray, gram: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of the ``gram`` values from each position, the same wherever the gram stands."""
    n = len(values)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _power(base, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    return mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, a, m = len(x) - w + 1, 1, x
    while 2 * a <= w:
        m = np.minimum(m[:-a], m[a:])
        a *= 2
    return np.minimum(m[:n], m[w - a : w - a + n])


def runs(e: Elements, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text number, minimiser, first window as flat position, number of windows) for each stretch of
    windows that share a minimiser.  A stretch may be cut in two between blocks, which costs nothing but work."""
    ends = np.cumsum(e.sizes)
    spread = u64(~0xFFFFFFFF)
    for at in range(0, len(e.values) - kind.window + 1, BLOCK):
        values = e.values[at : at + BLOCK + kind.window - 1]
        hashes = gram_hash(values, kind.gram)
        key = (hashes & spread) | np.arange(len(hashes), dtype=np.uint64)
        pos = (sliding_min(key, kind.window - kind.gram + 1) & u64(0xFFFFFFFF)).astype(np.int64)
        first = np.arange(at, at + len(pos))
        text = np.searchsorted(ends, first, side="right")
        valid = first + kind.window <= ends[text]
        new = valid.copy()
        new[1:] &= (pos[1:] != pos[:-1]) | ~valid[:-1]
        start = np.flatnonzero(new)
        if len(start):
            upto = np.cumsum(valid)
            many = np.diff(np.append(upto[start] - 1, upto[-1]))
            yield text[start], hashes[pos[start]], first[start], many


def intervals(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of true values, as half-open ranges."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered(docs: DataFrame, kind: Kind, id_col: str = "doc_id", text_col: str = "text", frequent: int | None = None, bodies: int | None = None, heavy: int | None = None) -> DataFrame:
    """``doc_id, text, starts, ends``: each row with the ranges of elements that repeated windows cover (the
    ranges may touch or overlap, and the lists are null where there are none)."""
    frequent, bodies, heavy = frequent or FREQUENT, bodies or BODIES, heavy or HEAVY
    rows = documents(docs, id_col, text_col).withColumns({"row": F.xxhash64("doc_id", "text"), "row2": F.xxhash64("text", F.lit(1), "doc_id")})
    places = rows.select("text", "row").mapInArrow(_minimisers(kind), "h long, row long")  # rows of equal hash only get each other's minimisers
    counted = materialise(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    twice = counted.select("h", (F.col("n") > frequent).alias("hot"))
    wanted = spread_join(places, twice, ["h"], heavy_keys(counted, ["h"], heavy), "row", ["hot"]).groupBy("row").agg(F.collect_list("h").alias("hs"), F.collect_list("hot").alias("hots"))
    strings = materialise(rows.select("row", "row2", "text").join(wanted, "row").mapInArrow(_strings(kind), "h long, row long, row2 long, start long, body binary, c1 long, c2 long"))
    few = strings.filter("c1 is null").select("h", "row", "row2", "start", "body").repartition("h").sortWithinPartitions("h")
    marks = few.mapInArrow(_buckets(kind), "row long, row2 long, a long, b long")

    often = strings.filter("c1 is not null")
    distinct = materialise(often.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.first("body").alias("body")))
    hits = _hits(distinct, kind, bodies, heavy).groupBy("c1", "c2").agg(F.flatten(F.collect_list("hit")).alias("hit"))
    told = spread_join(often.select("c1", "c2", "row", "row2", "start"), hits, ["c1", "c2"], heavy_keys(distinct.select("c1", "c2", "n"), ["c1", "c2"], heavy), "row", ["hit"])
    marks_often = told.select("row", "row2", "start", "hit").mapInArrow(_spread(kind), "row long, row2 long, a long, b long")

    ranges = marks.unionByName(marks_often).groupBy("row", "row2").agg(F.collect_list("a").alias("starts"), F.collect_list("b").alias("ends"))
    return rows.join(ranges, ["row", "row2"], "left").select("doc_id", "text", "starts", "ends")


def _hits(distinct: DataFrame, kind: Kind, bodies: int, heavy: int) -> DataFrame:
    """``c1, c2, hit``: which windows (numbers) of distinct strings (``c1, c2, n, h, body``) are repeated, counting each
    string ``n`` times.  A string may come in several rows."""
    sizes = materialise(distinct.groupBy("h").agg(F.count("*").alias("n")))
    crowded = sizes.filter(F.col("n") > bodies)
    shape = "c1 long, c2 long, hit array<int>"
    if kind.gram >= kind.window or not crowded.limit(1).count():
        return distinct.repartition("h").sortWithinPartitions("h").mapInArrow(_counted(kind), shape)
    dealt = materialise(spread_join(distinct, sizes.select("h", (F.col("n") > bodies).alias("crowded")), ["h"], heavy_keys(sizes, ["h"], heavy), "c1", ["crowded"]))
    found = dealt.filter("not crowded").drop("crowded").repartition("h").sortWithinPartitions("h").mapInArrow(_counted(kind), shape)
    longer = replace(kind, gram=kind.window if kind.gram > kind.window // 3 else kind.window * 3 // 5)
    parts = materialise(dealt.filter("crowded").select("c1", "c2", "n", "body").mapInArrow(_cut(longer), "p1 long, p2 long, at int, n long, h long, c1 long, c2 long, body binary"))
    within = materialise(parts.groupBy("c1", "c2").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.first("h").alias("h"), F.first("body").alias("body")))
    below = _hits(within.drop("parts"), longer, bodies, heavy).groupBy("c1", "c2").agg(F.flatten(F.collect_list("hit")).alias("hit"))
    told = within.select("c1", "c2").join(below, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"))
    often = heavy_keys(within.select("c1", "c2", F.col("parts").alias("n")), ["c1", "c2"], heavy)
    back = spread_join(parts.select("c1", "c2", "p1", "p2", "at"), told, ["c1", "c2"], often, "p1", ["hit"]).filter(F.size("hit") > 0)
    return found.unionByName(back.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.transform("hit", lambda x: x + F.col("at")).alias("hit")))


def _minimisers(kind: Kind):
    schema = pa.schema([("h", pa.int64()), ("row", pa.int64())])

    def apply(batches):
        for part in slices(batches, limit=SLICE):
            e, row = kind.elements([t or b"" for t in raw(part)]), part.column("row").to_numpy()
            for text, h, _, _ in runs(e, kind):
                yield record(schema, h.view(np.int64), row[text])

    return apply


def _strings(kind: Kind):
    schema = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("row2", pa.int64()), ("start", pa.int64()), ("body", pa.binary()), ("c1", pa.int64()), ("c2", pa.int64())])

    def apply(batches):
        for part in slices(batches, limit=SLICE):
            e, row, row2 = kind.elements([t or b"" for t in raw(part)]), part.column("row").to_numpy(), part.column("row2").to_numpy()
            lists, hots = part.column("hs"), part.column("hots")
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            own = lambda text, h: mix(h ^ mix(text.astype(np.uint64)))
            keys = own(owner, lists.flatten().to_numpy().view(np.uint64))
            hot_keys = keys[hots.flatten().to_numpy(zero_copy_only=False)]
            begin = np.cumsum(e.sizes) - e.sizes
            for text, h, first, many in runs(e, kind):
                key = own(text, h)
                sel = np.flatnonzero(np.isin(key, keys))
                if not len(sel):
                    continue
                t, s, m = text[sel], first[sel], many[sel]
                body, hot = _bodies(e, kind, s, m), np.isin(key[sel], hot_keys)
                c1, c2 = _contents(body, hot)
                yield record(schema, h[sel].view(np.int64), row[t], row2[t], s - begin[t], body, c1, c2)

    return apply


def _bodies(e: Elements, kind: Kind, first: np.ndarray, many: np.ndarray) -> list[bytes]:
    """The strings of runs of ``many`` windows from flat positions on."""
    lo, hi = e.lo[first].tolist(), e.hi[first + many + kind.window - 2].tolist()
    return [kind.canonical(e.blob[a:b]) for a, b in zip(lo, hi, strict=True)]


def _contents(bodies: list[bytes], wanted: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """128-bit hashes of the wanted strings as two columns, null for the others."""
    told = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) if w else bytes(16) for x, w in zip(bodies, wanted.tolist(), strict=True)), np.int64).reshape(-1, 2)
    return tuple(pa.array(told[:, k], pa.int64(), mask=~wanted) for k in (0, 1))


def _whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Regroups sorted batches so that all rows of one ``h`` come together, about ``limit`` bytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, "body", limit):
        held.append(part)
        size += part.column("body").nbytes
        if size >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                size = sum(b.num_rows for b in held) * (size // max(table.num_rows, 1))
    if held:
        yield pa.Table.from_batches(held)


def _buckets(kind: Kind):
    schema = pa.schema([("row", pa.int64()), ("row2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def apply(batches):
        for table in _whole_groups(batches, INDEXED):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(x, len(number)) for x in table.column("body").to_pylist()])
            spans = [intervals(hit) for hit in kind.repeated(list(number), np.bincount(which), kind.window)]
            row, row2, start = (table.column(c).to_pylist() for c in ("row", "row2", "start"))
            out = [(r, r2, s + a, s + b + kind.window - 1) for r, r2, s, w in zip(row, row2, start, which.tolist(), strict=True) for a, b in spans[w]]
            if out:
                yield record(schema, *map(list, zip(*out, strict=True)))

    return apply


def _counted(kind: Kind):
    """The repeated windows of distinct strings, buckets of whole minimisers at a time."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("hit", pa.list_(pa.int32()))])

    def apply(batches):
        for table in _whole_groups(batches, INDEXED):
            found = kind.repeated(table.column("body").to_pylist(), table.column("n").to_numpy(), kind.window)
            keep = [k for k, hit in enumerate(found) if hit.any()]
            if keep:
                at = pa.array(keep)
                c1, c2 = (table.column(c).combine_chunks().take(at) for c in ("c1", "c2"))
                yield record(schema, c1, c2, [np.flatnonzero(found[k]).astype(np.int32) for k in keep])

    return apply


def _cut(kind: Kind):
    """Strings cut into runs of windows that share the minimiser of ``kind``."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("h", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("body", pa.binary())])

    def apply(batches):
        for part in slices(batches, "body", SLICE // 8):
            e = kind.elements(part.column("body").to_pylist())
            begin = np.cumsum(e.sizes) - e.sizes
            p1, p2, n = (part.column(c).to_numpy() for c in ("c1", "c2", "n"))
            for text, h, first, many in runs(e, kind):
                body = _bodies(e, kind, first, many)
                yield record(schema, p1[text], p2[text], (first - begin[text]).astype(np.int32), n[text], h.view(np.int64), *_contents(body, np.ones(len(body), bool)), body)

    return apply


def _spread(kind: Kind):
    schema = pa.schema([("row", pa.int64()), ("row2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def apply(batches):
        for b in batches:
            out = []
            for r, r2, s, hit in zip(*(b.column(c).to_pylist() for c in ("row", "row2", "start", "hit")), strict=True):
                mask = np.zeros(max(hit) + 1, bool)
                mask[hit] = True
                out += [(r, r2, s + x, s + y + kind.window - 1) for x, y in intervals(mask)]
            if out:
                yield record(schema, *map(list, zip(*out, strict=True)))

    return apply


def cover_mask(n: int, starts: list[int] | None, ends: list[int] | None) -> np.ndarray:
    """Which of ``n`` elements the ranges cover."""
    step = np.zeros(n + 1, np.int32)
    if starts:
        np.add.at(step, starts, 1)
        np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
