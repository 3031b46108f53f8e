"""SimHash near-dedup with a pigeonring filter.

Fingerprints of 64 bits are cut into segments that form a ring.  If two differ in at most ``bits`` bits, then
from some segment on every chain of 1, 2, ... consecutive segments keeps within its proportional budget
(floor(length * bits / segments) differences).  The budgets of the first chains are 0 (for 2 bits and 16 segments, of
chains of up to 7), so pairs meet in buckets of such a run of equal segments, 28 bits from one of 16 places on: 16 small
rows for each fingerprint, and a stranger in a bucket only from some 2**28 fingerprints on.  In the bucket the further
budgets prune pairs before the full Hamming check.

A bucket of many distinct fingerprints is not compared pair by pair: its members meet again by the points within
bits/2 flips of them outside the run - two fingerprints within 2 bits share such a point, and at most 37
fingerprints share one - and only these small groups are compared.  Links leave a task as a spanning forest.

Equal fingerprints are one node, so a group of copies costs one row however large it is.
Defined results: null or empty text, or none but white space: fingerprint zero, linked like any other; a null id
never names a component unless no other id is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import documents, id_field, raw, record, slices
from quarry.operators.components import connected_components, forest
from quarry.operators.joins import heavy_keys, spread_join
from quarry.storage import materialise

SHINGLE = 3
BITS = 2
SEGMENTS = 16
SEED = 42
#: Distinct fingerprints of a bucket beyond which its members meet by common points instead.
CROWDED = 1024
_WIDTH = 64 // SEGMENTS
#: Bits of a run of segments whose chains all have the budget 0 (for up to 2 bits).
_RUN = _WIDTH * ((SEGMENTS - 1) // BITS)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of every shingle of lower-cased (A-Z) words; of the whole sequence if it is shorter."""
    ws = text.lower().split()
    if not ws:
        return []
    h = xxhash.xxh64_intdigest
    if len(ws) <= size:
        return [h(b" ".join(ws), SEED)]
    return [h(b" ".join(s), SEED) for s in zip(*(ws[k:] for k in range(size)), strict=False)]


def fingerprint_texts(texts: list[bytes], size: int) -> np.ndarray:
    """A bit is set if it is set in over half of the shingle hashes."""
    hashes = [shingle_hashes(t, size) for t in texts]
    n = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
        ends = np.cumsum(n[some])
        votes = np.zeros((len(some), 64), np.int64)
        for a in range(0, len(flat), 1 << 17):  # the bits of a slice at a time
            b = min(a + (1 << 17), len(flat))
            lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b - 1, side="right") + 1
            begin = np.maximum(np.concatenate([[0], ends])[lo:hi], a) - a
            bits = np.unpackbits(flat[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[lo:hi] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * votes > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""
    rows = documents(docs, id_col, text_col)
    id_type, id_arrow = id_field(rows)
    schema = pa.schema([("doc_id", id_arrow), ("fp", pa.int64())])

    def apply(batches):
        for part in slices(batches):
            yield record(schema, part.column("doc_id"), fingerprint_texts([t or b"" for t in raw(part)], shingle).view(np.int64))

    return rows.mapInArrow(apply, f"doc_id {id_type}, fp long")


def within_chain(x: np.ndarray, start: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which differences (xor of two fingerprints) keep within the chain budgets from segment ``start`` on."""
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for length in range(1, SEGMENTS + 1):
        at = ((start + length - 1) % SEGMENTS * _WIDTH).astype(np.uint64)
        total += np.bitwise_count((x >> at) & np.uint64((1 << _WIDTH) - 1))
        ok &= total <= length * bits // SEGMENTS
    return ok


def _links(start: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray, bits: int) -> dict:
    """The spanning forest of links between rows of equal (start, key), which stand together."""
    same = np.concatenate([(start[1:] == start[:-1]) & (key[1:] == key[:-1]), [False]])
    reach = np.arange(len(key))  # last row of each row's group
    last = np.flatnonzero(~same)
    reach = last[np.searchsorted(last, reach)]
    hung: dict = {}
    apart, rows = 1, np.flatnonzero(same)
    while len(rows):
        rows = rows[rows + apart <= reach[rows]]
        x = fp[rows] ^ fp[rows + apart]
        near = within_chain(x, start[rows], bits)  # prunes candidates ...
        near[near] = np.bitwise_count(x[near]) <= bits  # ... before the full check
        if near.any():
            hung = forest([*((b, a) for b, a in hung.items()), *zip(rep[rows[near]].tolist(), rep[rows[near] + apart].tolist(), strict=True)])
        apart += 1
    return hung


def _compare(bits: int):
    def apply(batches):
        held: list[pa.RecordBatch] = []
        n, hung, kind = 0, {}, None
        for b in batches:
            kind = b.schema.field("rep").type
            held.append(b)
            n += b.num_rows
            if n < 100_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, start = table.column("key").to_numpy(), table.column("start").to_numpy()
            cut = int(np.flatnonzero((key == key[-1]) & (start == start[-1]))[0])
            _join(hung, table.slice(0, cut), bits)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if held:
            _join(hung, pa.Table.from_batches(held), bits)
        if hung:
            yield pa.RecordBatch.from_arrays([pa.array(hung.values(), kind), pa.array(hung.keys(), kind)], names=["src", "dst"])

    return apply


def _join(hung: dict, table: pa.Table, bits: int) -> None:
    col = lambda c: table.column(c).to_numpy()
    found = _links(col("start").astype(np.int64) % SEGMENTS, col("key"), col("fp").view(np.uint64), table.column("rep").to_numpy(), bits)
    merged = forest([*((b, a) for b, a in hung.items()), *((b, a) for b, a in found.items())])
    hung.clear()
    hung.update(merged)


def _points(batches):
    """The fingerprint and its one-bit neighbours outside the run, as keys; starts are told apart by +SEGMENTS."""
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            start, fp = part.column("start").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
            flips = np.array([0, *(1 << j for j in range(64))], dtype=np.uint64)
            turn = (start.astype(np.uint64) * np.uint64(_WIDTH))[:, None]
            inside = ((flips[None, :] >> turn) | (flips[None, :] << ((np.uint64(64) - turn) & np.uint64(63)))) & np.uint64((1 << _RUN) - 1)
            i, j = np.nonzero(inside == 0)
            yield pa.RecordBatch.from_arrays([pa.array((start[i] + SEGMENTS).astype(np.int32)), pa.array((fp[i] ^ flips[j]).view(np.int64)), pa.array(fp[i].view(np.int64)), part.column("rep").take(pa.array(i))], names=["start", "key", "fp", "rep"])


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """A spanning forest (``src, dst``) of the links between nodes (``fp, rep``), one for each fingerprint."""
    if not 0 <= bits <= 2:
        raise ValueError("bits: 0, 1 or 2 (crowded buckets meet by points one flip away)")
    rep = dict(nodes.dtypes)["rep"]
    turned = lambda n: F.shiftrightunsigned("fp", n).bitwiseOR(F.shiftleft("fp", 64 - n)) if n else F.col("fp")
    segment = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), turned(k * _WIDTH).bitwiseAND(F.lit((1 << _RUN) - 1)).alias("key")) for k in range(SEGMENTS)]))
    rows = nodes.select(segment.alias("s"), "fp", "rep").select("s.start", "s.key", "fp", "rep")
    crowded = rows.groupBy("start", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).drop("n")
    few = rows.join(crowded, ["start", "key"], "left_anti")
    many = rows.join(crowded, ["start", "key"], "left_semi").mapInArrow(_points, f"start int, key long, fp long, rep {rep}")
    together = few.unionByName(many).repartition("start", "key").sortWithinPartitions("start", "key")
    return together.mapInArrow(_compare(bits), f"src {rep}, dst {rep}")


def components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id`` from ``doc_id, fp``: the least id reachable over links."""
    prints = materialise(prints)
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    named = connected_components(links(nodes.filter("rep is not null"), bits), forests=True)
    of_fp = nodes.join(named.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return spread_join(prints, of_fp, ["fp"], heavy_keys(nodes, ["fp"]), "doc_id", ["component_id"]).select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of every document."""
    found = components(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: a wide fingerprint.  At a similarity of 0.8 of the shingle sets some 15 % of the bits
# differ, too many for an exact index of 64 bits.  So the fingerprint gets more words, of independent hashes, and
# the ring's chain budgets give way to banding: a segment must be equal, for so many segments that a pair at the
# threshold is found with the wished recall at every size of the input (proportional budgets, 2 to 4 bits of a
# segment of 12 to 18, would let most pairs of strangers meet).  The Hamming check over the first words is wide enough to lose almost no
# pair; what it links is a group of candidates, in which the exact Jaccard similarity of the shingle sets decides.

NEAR_SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
#: Distinct fingerprints that share a segment by chance, in the mean, and that one task compares with each other.
STRANGERS = 64
BLOCK = 2048
#: Segment values that more than BLOCK fingerprints share, up to which these are broadcast.
MOST_CROWDED = 1 << 20
#: Shingles of a block of candidates (a text of more stands alone).
BLOCK_SHINGLES = 1 << 20
#: Words of the fingerprint that the Hamming check reads, and the standard deviations that it allows over the mean.
CHECKED = 2
ALLOWED = 4


def differing(similarity: float) -> float:
    """The share of bits that differ, in the mean, at a Jaccard similarity of the shingle sets."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a segment, segments) for n fingerprints."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / STRANGERS)), 12, 56))
    segments = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - differing(similarity)) ** bits)))
    return bits, max(segments, -(-512 // bits))


def furthest(similarity: float, bits: int = 64 * CHECKED) -> int:
    """The most bits of ``bits`` that a pair of candidates may differ in."""
    p = differing(similarity)
    return int(np.ceil(bits * p + ALLOWED * np.sqrt(bits * p * (1 - p))))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def wide_fingerprints(docs: DataFrame, words: int, shingle: int = NEAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, own, shingles``: fingerprints of ``words`` times 64 bits over the distinct shingles, as bytes, the
    digest of the set of shingles and its size."""
    from quarry.llm.common import mix

    rows = documents(docs, id_col, text_col)
    id_type, id_arrow = id_field(rows)
    schema = pa.schema([("doc_id", id_arrow), ("fp", pa.binary()), ("own", pa.binary()), ("shingles", pa.int64())])
    seeds = mix(np.arange(1, words + 1, dtype=np.uint64))

    def apply(batches):
        for part in slices(batches):
            out = np.zeros((part.num_rows, words), np.uint64)
            hashes = [shingle_set(t or b"", shingle) for t in raw(part)]
            n = np.array([len(h) for h in hashes])
            some = np.flatnonzero(n)
            if len(some):
                flat, own = np.concatenate([hashes[k] for k in some]), n[some]
                begin = np.cumsum(own) - own
                cut = [0, *(np.flatnonzero(np.diff(begin // 100_000)) + 1).tolist(), len(some)]
                for w in range(words):
                    h = mix(flat ^ seeds[w])
                    for a, b in zip(cut, cut[1:], strict=False):  # whole texts, some 100,000 shingles at a time
                        at = begin[a:b] - begin[a]
                        bits = np.unpackbits(h[begin[a] : begin[b - 1] + own[b - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        votes = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                        out[some[a:b], w] = np.packbits(2 * votes > own[a:b, None], axis=1, bitorder="little").view(np.uint64).ravel()
            yield record(schema, part.column("doc_id"), [x.tobytes() for x in out], [digest(h) for h in hashes], n)

    return rows.mapInArrow(apply, f"doc_id {id_type}, fp binary, own binary, shingles long")


def _segments(bits: int, segments: int):
    """The checked words of each fingerprint under the value of each of its segments."""

    def apply(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                rows = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                flat = np.unpackbits(rows, axis=1, bitorder="little")[:, : bits * segments].reshape(part.num_rows, segments, bits)
                key = np.packbits(np.pad(flat, ((0, 0), (0, 0), (0, 64 - bits))), axis=2, bitorder="little").view(np.int64)[:, :, 0]
                i, t = np.divmod(np.arange(key.size), segments)
                checked = pa.array([x.tobytes() for x in rows[:, : 8 * CHECKED]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(key.ravel()), part.column("rep").take(pa.array(i)), checked.take(pa.array(i))], names=["segment", "key", "rep", "fp"])

    return apply


def _compare_wide(most: int):
    names = ("segment", "key", "one", "two")

    def groups(table: pa.Table) -> np.ndarray:
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names])
        return np.append((key[:, 1:] == key[:, :-1]).all(axis=0), False)  # the next row is of the same group

    def join(table: pa.Table, same: np.ndarray, hung: dict) -> None:
        x = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        within = table.column("one").to_numpy() == table.column("two").to_numpy()
        last = np.flatnonzero(~same)
        reach = last[np.searchsorted(last, np.arange(len(x)))]
        apart, rows, found = 1, np.flatnonzero(same), []
        while len(rows := rows[rows + apart <= reach[rows]]):
            for at in range(0, len(rows), 50_000):
                a = rows[at : at + 50_000]
                near = np.bitwise_count(x[a] ^ x[a + apart]).sum(axis=1) <= most
                near &= within[a] | (side[a] != side[a + apart])
                found += zip(rep[a[near]].tolist(), rep[a[near] + apart].tolist(), strict=True)
            if len(found) > 200_000:
                found = [(b, c) for c, b in forest(iter(found)).items()]
            apart += 1
        merged = forest([*((b, c) for c, b in hung.items()), *found])
        hung.clear()
        hung.update(merged)

    def apply(batches):
        held, n, hung, kind = [], 0, {}, None
        for b in batches:
            kind = b.schema.field("rep").type
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                table = pa.Table.from_batches(held).combine_chunks()
                same = groups(table)
                cut = int(np.flatnonzero(~same[:-1])[-1]) + 1 if (~same[:-1]).any() else 0
                if cut:
                    same[cut - 1] = False
                    join(table.slice(0, cut), same[:cut], hung)
                    held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            join(table, groups(table), hung)
        if hung:
            yield pa.RecordBatch.from_arrays([pa.array(hung.values(), kind), pa.array(hung.keys(), kind)], names=["src", "dst"])

    return apply


def joined(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of some sets (none is empty) the place of one that it is linked with, over pairs of a Jaccard similarity
    of ``similarity`` or more.  Sets that are linked already are not compared again."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, root = np.zeros(len(flat), bool), np.full(len(sets), -1)
    rest, held, at = np.arange(len(sets)), flat, ends - size  # those that may be open, their members and where these begin
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], queue = first, [first]
        while queue:
            if 2 * np.count_nonzero(root[rest] < 0) < len(rest):
                stay = root[rest] < 0
                held, rest = held[np.repeat(stay, size[rest])], rest[stay]
                at = np.cumsum(size[rest]) - size[rest]
            if not len(rest):
                break
            a = queue.pop()
            members = flat[ends[a] - size[a] : ends[a]]
            mark[members] = True
            both = np.add.reduceat(mark[held], at, dtype=np.int64)
            mark[members] = False
            near = rest[(both / (size[a] + size[rest] - both) >= similarity) & (root[rest] < 0)]
            root[near] = first
            queue += near.tolist()
    return root


def _confirm(similarity: float):
    def pairs(group: list):
        root = joined([np.frombuffer(x, np.uint64) for x, _ in group], similarity) if len(group) > 1 else np.zeros(len(group), int)
        return [(group[r][1], group[k][1]) for k, r in enumerate(root.tolist()) if r != k]

    def apply(batches):
        group, key, links, kind = [], None, [], None
        for b in batches:
            kind = b.schema.field("rep").type
            for *now, held, rep in zip(*(b.column(c).to_pylist() for c in ("component", "one", "two", "held", "rep")), strict=True):
                if now != key:
                    links += pairs(group)
                    group, key = [], now
                group.append((held, rep))
        hung = forest(iter(links + pairs(group)))
        if hung:
            yield pa.RecordBatch.from_arrays([pa.array(hung.values(), kind), pa.array(hung.keys(), kind)], names=["src", "dst"])

    return apply


def _dealt(many: str, per_block: int):
    return F.ceil(F.col(many) / per_block).cast("int")


def _pairs():
    """Every pair of blocks that holds the row's ``side`` of ``blocks``."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("side"), j).alias("one"), F.greatest(F.col("side"), j).alias("two")))).alias("p")


def confirmed_links(docs: DataFrame, members: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """A forest (``src, dst``) of links between ``members`` (``rep, own, shingles, component``) of a component whose sets
    of shingles have a Jaccard similarity of ``similarity`` or more.  Large components meet by pairs of blocks."""
    rep = id_field(members, "rep")[0]
    arrow = id_field(members, "rep")[1]
    schema = pa.schema([("rep", arrow), ("component", arrow), ("own", pa.binary()), ("held", pa.binary())])

    def read(batches):
        for part in slices(batches):
            sets = [shingle_set(t or b"", shingle) for t in raw(part)]
            own = part.column("own").to_pylist()
            at = [k for k, x in enumerate(sets) if digest(x) == own[k]]  # rows of the same id may hold other texts
            yield record(schema, part.column("rep").take(pa.array(at, pa.int64())), part.column("component").take(pa.array(at, pa.int64())), [own[k] for k in at], [sets[k].tobytes() for k in at])

    texts = documents(docs, id_col, text_col).join(members.select("rep", "own", "component"), F.col("doc_id") == F.col("rep")).select("rep", "component", "own", "text")
    sets = texts.mapInArrow(read, f"rep {rep}, component {rep}, own binary, held binary").distinct()
    sizes = members.groupBy("component").agg(F.count("*").alias("many"), F.sum("shingles").alias("much")).withColumn("blocks", F.greatest(_dealt("many", BLOCK), _dealt("much", BLOCK_SHINGLES)))
    dealt = sets.join(sizes, "component").withColumn("side", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int")).select("component", "rep", "held", _pairs()).select("component", "p.one", "p.two", "rep", "held")
    return dealt.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two").mapInArrow(_confirm(similarity), f"src {rep}, dst {rep}")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``doc_id, component_id``: groups of documents linked by pairs with ``similarity`` of their shingles in common
    (Jaccard) or more: candidates by the fingerprints' Hamming distance, each confirmed exactly.  Null ids are left out."""
    rep = id_field(docs, id_col)[0]
    bits, segments = wide_shape(docs.count(), similarity, recall)
    words = -(-bits * segments // 64)
    prints = materialise(wide_fingerprints(docs, words, shingle, id_col, text_col))
    nodes = materialise(prints.filter("doc_id is not null").groupBy("own", "fp", "shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    able = nodes.filter(F.col("shingles") / (F.col("shingles") + 1) >= similarity)  # smaller sets are like no other set
    placed = able.mapInArrow(_segments(bits, segments), f"segment int, key long, rep {rep}, fp binary")
    slim = able.mapInArrow(_segments(bits, segments), f"segment int, key long, rep {rep}, fp binary").select("segment", "key")
    # most values go to their bucket by one shuffle; those of dense groups are dealt to pairs of blocks
    sizes = materialise(slim.groupBy("segment", "key").agg(F.count("*").alias("many")).filter(F.col("many") > BLOCK).withColumn("blocks", _dealt("many", BLOCK)).select("segment", "key", "blocks"))
    sizes = F.broadcast(sizes) if sizes.limit(MOST_CROWDED + 1).count() <= MOST_CROWDED else sizes
    spread = placed.join(sizes, ["segment", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    side = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = spread.withColumn("side", side).select("segment", "key", "rep", "fp", "side", _pairs()).select("segment", "key", "p.one", "p.two", "side", "rep", "fp")
    sorted_ = dealt.repartition("segment", "key", "one", "two").sortWithinPartitions("segment", "key", "one", "two")
    loose = connected_components(sorted_.mapInArrow(_compare_wide(furthest(similarity)), f"src {rep}, dst {rep}"), forests=True)
    members = materialise(nodes.join(loose.withColumnRenamed("id", "rep"), "rep").filter(F.col("shingles") / (F.col("shingles") + 1) >= similarity).select("rep", "own", "shingles", "component"))
    named = connected_components(confirmed_links(docs, members, similarity, shingle, id_col, text_col), forests=True)
    of_own = nodes.join(named.withColumnRenamed("id", "rep"), "rep", "left").select("own", F.coalesce("component", "rep").alias("component_id"))
    told = prints.filter("doc_id is not null").select("doc_id", "own")
    return spread_join(told, of_own, ["own"], heavy_keys(nodes.select("own", "n"), ["own"]), "doc_id", ["component_id"]).select("doc_id", "component_id")
