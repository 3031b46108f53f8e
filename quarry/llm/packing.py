"""Best-fit packing of tokenised documents into sequences of bounded length.

A document longer than a sequence is cut into full pieces and a rest.  The plan is made on the histogram of
piece lengths, whose size depends on the capacity and not on the data: pieces over a third of the capacity pair
at most twice per sequence by greedy matching (largest with the largest that still fits, which is optimal for
such pieces), then smaller ones go, longest first, into the tightest gap that holds them.  Pieces of one length
are numbered in parallel (salted, so that one frequent length is spread), and the number decides the place.

Defined results: null or empty text is the one token that ends a document; repeated rows are packed as often as
they occur; ties (equal lengths) are ordered by a hash of the id, then id and piece; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import documents, id_field, raw, record, slices
from quarry.llm.segments import WordEncoder
from quarry.storage import materialise

CAPACITY = 2048
END_ID = 0
#: Rows that one number series of a piece length holds at most, in the mean, and the most series of a length.
SERIES_ROWS = 20_000
MOST_SERIES = 4096


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the pieces of each document.

    No token of this vocabulary crosses white space, and its normaliser treats each side on its own, so the words
    between ASCII white space are encoded one by one, each distinct word once."""
    rows = documents(docs, id_col, text_col)
    id_type, id_arrow = id_field(rows)
    schema = pa.schema([("doc_id", id_arrow), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def apply(batches):
        encoder, wide = WordEncoder.of(vocabulary), 4 * capacity
        for part in slices(batches):
            ids, n = encoder.encode([t or b"" for t in raw(part)])
            ends = np.cumsum(n + 1)
            whole = np.full(len(ids) + len(n), END_ID, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            whole, cols = whole.tobytes(), ([], [], [], [], [])
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), (4 * (ends - n - 1)).tolist(), (4 * ends).tolist(), strict=True):
                for piece, at in enumerate(range(a, b, wide)):
                    own = whole[at : min(at + wide, b)]
                    for c, v in zip(cols, (doc_id, piece, (at - a) // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        c.append(v)
            yield record(schema, *cols)

    return rows.mapInArrow(apply, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Sequences as (lengths of pieces, how many sequences are like this)."""
    left = {n: c for n, c in histogram.items() if c}
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # free room -> open sequences
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= capacity - a and left[n] > (n == a)), None)
            if b is None:
                gaps[capacity - a].append(((a,), left[a]))
                left[a] = 0
            else:
                k = left[a] // 2 if a == b else min(left[a], left[b])
                gaps[capacity - a - b].append(((a, b), k))
                left[a] -= k
                left[b] -= k
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = next((g for g in range(s, capacity + 1) if gaps.get(g)), capacity)
            held, many = gaps[gap].pop() if gaps.get(gap) else ((), n)
            each = min(gap // s, n)  # the tightest gap stays the tightest until it is too small
            bins = min(many, n // each)
            gaps[gap - each * s].append((held + (s,) * each, bins))
            if many > bins and held:
                gaps[gap].append((held, many - bins))
            n -= each * bins
    return [(list(held), many) for group in gaps.values() for held, many in group if held]


def places(patterns: list[tuple[list[int], int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (key, sequence, offset), sorted by key = length * 2**48 + first number: piece number k of a length
    lies in sequence + (k - first number), at offset."""
    nth: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for held, many in patterns:
        at = 0
        for n in held:
            out.append(((n << 48) + nth[n], base, at))
            nth[n] += many
            at += n
        base += many
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces (doc_id, piece, start, length, ids_crc32)."""
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counted, capacity), capacity)
    series = int(min(MOST_SERIES, max(16, max(counted.values(), default=0) // SERIES_ROWS)))
    salted = pieces.withColumn("series", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(series)).cast("int"))
    numbered = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "series").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = Window.partitionBy("length").orderBy("series").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "series").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = numbered.join(offsets, ["length", "series"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # its size depends on the capacity alone
    id_type, id_arrow = id_field(pieces)
    schema = pa.schema([("doc_id", id_arrow), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def assign(batches):
        keys, first, at = shared.value.T
        for b in batches:
            if b.num_rows:
                key = (b.column("length").to_numpy(zero_copy_only=False) << 48) + b.column("nth").to_numpy(zero_copy_only=False)
                k = np.searchsorted(keys, key, side="right") - 1
                yield record(schema, *b.columns[:5], first[k] + key - keys[k], at[k])

    return rows.mapInArrow(assign, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(materialise(tokenise(docs, vocabulary, capacity, id_col, text_col)), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
