"""I-Match document fingerprints over randomised lexicons.

Terms (lower-cased words) count if their document frequency lies in a band, that is, their inverse document
frequency does: rarer ones are noise, more frequent ones tell nothing.  Frequencies are of distinct texts, so copies
of a text don't make its terms frequent.  A text with fewer than ``FEWEST`` band terms takes further ones until it
has as many: more frequent ones from the rarest on, then noise in the order of its hashes.  A text's terms are sorted
and hashed once for each of ``SUBSETS`` random sub-lexicons.  Sub-lexicons are nested by rate (1/2**level); a
fingerprint keeps the three levels around log2 of its number of terms, where a sub-lexicon holds about one of
them.  The share of sub-lexicons with equal hashes, of those that hold a term of either text, is the likeness;
it estimates the overlap of the two term sets.

The lexicon is broadcast: a term of the band is in at least ``RAREST`` of all documents, so there are at most
(mean distinct terms of a document) / RAREST of them, however large the corpus; more frequent ones are fewer still.
A term takes ``LONG_TERM`` bytes at most (a longer one is known by its hash).

Defined results: null text counts as empty; texts without any term have an all-zero fingerprint; equal fingerprints
have likeness 1.  Ids of any type with an order will do; null ids come first, equal ids are ordered by a hash of their
text; after the last document comes the first; a single document is its own next.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import SLICE_BYTES, documents, id_field, mix, raw, record, slices, u64

#: The band of document frequencies, as shares of all distinct texts.
RAREST = 1 / 2000
COMMONEST = 1 / 50
#: Terms that a text is hashed over at least, if it has as many.
FEWEST = 32
SUBSETS = 64
LEVELS = 3
#: Terms of more bytes than this are known by a 128-bit hash; terms a counting worker holds before it passes them on.
LONG_TERM = 64
HELD_TERMS = 400_000
#: Documents of a range of ids in the mean, the most ranges, and the ids drawn for each to find its bounds.
RANGE_ROWS = 200
MOST_RANGES = 1 << 16
DRAWN = 16
#: Bits of the map of texts that may have copies (others of the same bit are only sorted out later).
COPY_BITS = 1 << 24
_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))
_lexicons: dict[int, tuple[dict[bytes, int], dict[bytes, int]]] = {}


def terms(text: bytes) -> set[bytes]:
    return {w if len(w) <= LONG_TERM else b"\0" + xxhash.xxh3_128_digest(w) for w in text.lower().split()}


def copies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many distinct texts there are, and a map of ``COPY_BITS`` bits (as bytes) in which those that occur more
    than once have theirs set; ``rows`` have ``th``, a hash of the text."""
    per_bucket = 8 * 4096  # of bitmap_construct_agg
    groups = rows.groupBy("th").agg(F.count("*").alias("n")).withColumn("bit", F.pmod("th", F.lit(COPY_BITS)))
    told = groups.groupBy(F.floor(F.col("bit") / per_bucket).alias("bucket")).agg(F.count("*").alias("texts"), F.expr(f"bitmap_construct_agg(bit % {per_bucket}) filter (where n > 1)").alias("map")).collect()
    held = np.zeros((-(-COPY_BITS // per_bucket), 4096), np.uint8)
    for r in told:
        if r["map"]:
            held[r["bucket"]] = np.frombuffer(r["map"], np.uint8)
    return sum(r["texts"] for r in told), held.ravel()


def document_frequencies(rows: DataFrame, copied: np.ndarray) -> DataFrame:
    """``term, n``: how many distinct texts of ``rows`` (``text, th``) hold each term, summed in the tasks first.  Only
    texts that may have copies travel to be told apart."""
    schema, shared = pa.schema([("term", pa.binary()), ("n", pa.int64())]), rows.sparkSession.sparkContext.broadcast(copied)

    def count(parts):
        held: dict[bytes, int] = {}
        for part in parts:
            for t in raw(part):
                for w in terms(t or b""):
                    held[w] = held.get(w, 0) + 1
            if len(held) > HELD_TERMS:
                yield record(schema, list(held), list(held.values()))
                held = {}
        if held:
            yield record(schema, list(held), list(held.values()))

    def marked(batch: pa.RecordBatch) -> np.ndarray:
        bit = batch.column("th").to_numpy() % COPY_BITS
        return (shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

    def single(batches):
        yield from count(slices(b.filter(pa.array(~marked(b))) for b in batches))

    def repeated(batches):
        for b in batches:
            yield b.filter(pa.array(marked(b))).select(["text"])

    once = rows.mapInArrow(single, "term binary, n long")
    more = rows.mapInArrow(repeated, "text string").distinct().mapInArrow(lambda batches: count(slices(batches)), "term binary, n long")
    return once.unionByName(more).groupBy("term").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, text_col: str = "text") -> tuple[list[bytes], list[bytes]]:
    """The terms of the band, sorted, and those that are more frequent, the rarest first (both are bounded, see above)."""
    rows = documents(docs, text_col, text_col).select("text", F.xxhash64("text").alias("th"))
    total, copied = copies(rows)
    low = max(1, int(np.ceil(rarest * total)))
    found = document_frequencies(rows, copied).filter(F.col("n") >= low).toPandas()
    told = sorted(zip(found["n"].tolist(), map(bytes, found["term"]), strict=True))
    high = max(low, commonest * total)
    return sorted(t for n, t in told if n <= high), [t for n, t in told if n > high]


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST, text_col: str = "text") -> list[bytes]:
    """The terms of the band, sorted."""
    return vocabulary(docs, rarest, commonest, text_col)[0]


def _table(shared) -> tuple[dict[bytes, int], dict[bytes, int]]:
    key = id(shared)
    if key not in _lexicons:
        _lexicons.clear()
        band, common = shared.value
        _lexicons[key] = {t: xxhash.xxh64_intdigest(t) for t in band}, {t: k for k, t in enumerate(common)}
    return _lexicons[key]


def filled(hashes: list[int], others: set[bytes], common: dict[bytes, int]) -> list[int]:
    """The hashes of a text's band terms and of the first of its others, up to ``FEWEST``."""
    h, last = xxhash.xxh64_intdigest, len(common)
    order = sorted((common.get(w, last), h(w)) for w in others)
    return hashes + [x for _, x in order[: FEWEST - len(hashes)]]


def fingerprint_texts(texts: list[bytes], known: dict[bytes, int], common: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(level, hashes [texts x LEVELS x SUBSETS]); 0 is a sub-lexicon without a term of the text.  ``known``: the band's
    hashes; ``common``: the ranks of more frequent terms."""
    counts, flat = [], []
    for t in texts:
        own = terms(t)
        band = known.keys() & own
        hashes = [known[w] for w in band]
        if len(hashes) < FEWEST:
            hashes = filled(hashes, own - band, common or {})
        counts.append(len(hashes))
        flat += hashes
    n = np.array(counts)
    level = np.maximum(1, np.round(np.log2(np.maximum(n, 1)))).astype(np.int64)
    h, doc = np.array(flat, dtype=np.uint64), np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))  # distinct terms in sorted order
    h, doc = h[order], doc[order]
    mask = (np.uint64(1) << (level - 1).astype(np.uint64)) - np.uint64(1)
    mask_of = mask[doc]
    out = np.zeros((len(texts), LEVELS, SUBSETS), np.uint16)
    for k in range(SUBSETS):
        m = mix(h ^ _SEEDS[k])
        sel = np.flatnonzero((m & mask_of) == 0)
        m, d, deep = m[sel], doc[sel], mask_of[sel]
        for j in range(LEVELS):
            inside = (m & deep) == 0
            m, d, deep = m[inside], d[inside], (deep[inside] << np.uint64(1)) | np.uint64(1)
            if not len(m):
                break
            begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            nth = np.arange(len(m)) - np.repeat(begin, np.diff(np.append(begin, len(m))))
            folded = mix(np.add.reduceat(mix(m ^ mix(nth.astype(np.uint64) + u64(0x1F123BB5))), begin))
            out[d[begin], j, k] = (folded % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return level, out


def likeness(level_a, a, level_b, b) -> np.ndarray:
    """Row by row, for arrays of fingerprints."""
    far = np.abs(level_a - level_b) > 2
    at = np.minimum(np.maximum(level_a, level_b), np.minimum(level_a, level_b) + 1)  # the sparsest level both have
    rows = np.arange(len(a))
    x, y = a[rows, np.clip(at - level_a + 1, 0, LEVELS - 1)], b[rows, np.clip(at - level_b + 1, 0, LEVELS - 1)]
    some = ((x > 0) | (y > 0)).sum(axis=1)
    like = np.where(far | (some == 0), 0.0, ((x == y) & (x > 0)).sum(axis=1) / np.maximum(some, 1))
    same = (level_a == level_b) & (a == b).all(axis=(1, 2))
    return np.where(same, 1.0, like)


def text_of(level: int, hashes: np.ndarray) -> str:
    return f"{level:02x}:{hashes.astype('>u2').tobytes().hex()}"


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``range, guest, doc_id, th, packed`` (the text, compressed for its way) in ranges of ascending ids, each with
    the row that follows its last one as a guest."""
    rows = documents(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    id_type, id_arrow = id_field(rows)
    total = rows.count()
    wanted = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    # bounds from a sample of ids and texts' hashes: they decide where a row goes, not what comes out
    drawn = rows.select("doc_id", "th").sample(min(1.0, 1.2 * DRAWN * wanted / max(total, 1)), 7).limit(2 * DRAWN * wanted) if wanted > 1 else rows.select("doc_id", "th").limit(0)
    order = lambda i, th: (i is not None, i if i is not None else th, th)  # nulls first; equal ids by the text's hash
    picked = sorted(order(*r) for r in drawn.collect())
    cuts = sorted({picked[len(picked) * k // wanted] for k in range(1, wanted)}) if picked else []
    schema = pa.schema([("doc_id", id_arrow), ("th", pa.int64()), ("range", pa.int32())])

    def ranges_of(ids: pa.Array, th: pa.Array) -> np.ndarray:
        return np.array([bisect_right(cuts, order(*x)) for x in zip(ids.to_pylist(), th.to_pylist(), strict=True)], np.int32)

    def place(batches):
        for b in batches:
            yield record(schema, b.column("doc_id"), b.column("th"), ranges_of(b.column("doc_id"), b.column("th")))

    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th")).alias("f")
    firsts = rows.select("doc_id", "th").mapInArrow(place, f"doc_id {id_type}, th long, range int").groupBy("range").agg(first).select("range", "f.doc_id", "f.th").collect()
    firsts = sorted(((r["range"], r["doc_id"], r["th"]) for r in firsts), key=lambda r: r[0])
    before = {(i, th): firsts[k - 1][0] for k, (_, i, th) in enumerate(firsts)}  # the range before a first row, cyclic
    out = pa.schema([("range", pa.int32()), ("guest", pa.int32()), ("doc_id", id_arrow), ("th", pa.int64()), ("packed", pa.binary())])

    def route(batches):
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for part in slices(batches):
            ids, th = part.column("doc_id"), part.column("th")
            at = ranges_of(ids, th)
            guests = [(k, before[key]) for k, key in enumerate(zip(ids.to_pylist(), th.to_pylist(), strict=True)) if key in before]
            text = pa.array([pack(t or b"") for t in raw(part)], pa.binary())
            yield record(out, at, np.zeros(len(at), np.int32), ids, th, text)
            if guests:
                k = pa.array([g[0] for g in guests])
                yield record(out, [g[1] for g in guests], [1] * len(guests), ids.take(k), th.take(k), text.take(k))

    return rows.mapInArrow(route, f"range int, guest int, doc_id {id_type}, th long, packed binary").repartition("range").sortWithinPartitions("range", "guest", "doc_id", "th")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, words: list[bytes], id_col: str = "doc_id", text_col: str = "text", common: list[bytes] | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    shared = docs.sparkSession.sparkContext.broadcast((words, common or []))
    id_type, id_arrow = id_field(docs, id_col)
    schema = pa.schema([("doc_id", id_arrow), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def apply(batches):
        (known, often), held, unpack = _table(shared), None, zstandard.ZstdDecompressor().decompress
        for part in slices(batches, "packed", SLICE_BYTES // 2):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("range", "guest", "doc_id")), map(unpack, part.column("packed").to_pylist()), strict=True))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            if len(rows) < 2:
                continue
            plain = [t for *_, t in rows]
            told = [t.decode("utf-8", "replace") for t in plain]
            own = [k for k in range(len(rows) - 1) if not rows[k][1]]  # a guest only tells what comes next
            changed = [edited(told[k], told[k + 1]).encode("utf-8", "replace") for k in own]
            level, hashes = fingerprint_texts(plain + changed, known, often)
            a, nxt, e = np.array(own, int), np.array(own, int) + 1, np.arange(len(own)) + len(rows)
            yield record(
                schema, [rows[k][2] for k in own], [len(told[k]) for k in own], [hashlib.sha256(c).hexdigest() for c in changed], [text_of(level[k], hashes[k]) for k in own], [text_of(level[k], hashes[k]) for k in e],
                likeness(level[a], hashes[a], level[e], hashes[e]), likeness(level[a], hashes[a], level[nxt], hashes[nxt]),
            )

    ddl = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs, id_col, text_col).mapInArrow(apply, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprints of every document and of its edited text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words, common = vocabulary(docs)
    return fingerprint_documents(docs, words, common=common)
