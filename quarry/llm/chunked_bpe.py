"""Byte-pair encoding with content-defined chunk reuse, and decoding.

A rolling hash over 32 bytes cuts texts into chunks, so that a passage that several documents share falls into
the same chunks wherever it stands.  Documents that share content (the least chunk hash) travel to the same
partition; there each distinct chunk is encoded once.  A chunk's ids count only between its outermost safe
points - a single space between two non-spaces, before which no token can end early or start late.  Joins are
repaired by re-encoding the stretch from the last safe point before the join to the first one after it, over as
many chunks as it takes, so the ids agree exactly with those of the whole text.

Partitions are rebalanced: a large group of copies is split over tasks, each of which encodes its chunks once.

Defined results: null text counts as empty: no ids, SHA-256 of nothing.  Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import documents, id_field, raw, record, slices
from quarry.llm.segments import ByteEncoder, byte_letters

#: Rolling-hash window (a power of two), mean chunk length and longest chunk, in bytes.
WINDOW = 32
MEAN_CHUNK = 1024
LONGEST_CHUNK = 16384
#: Bytes of chunks that a worker remembers.
REMEMBERED_BYTES = 24 << 20
_gear = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(b: np.ndarray) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes up to each position (of fewer at the start)."""
    h, k = _gear[b], 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k % 32))
        k *= 2
    return h * np.uint32(2654435761)


def cuts(text: bytes) -> tuple[list[int], int]:
    """Where the chunks of a text start and end (on character bounds), and its least chunk hash."""
    b = np.frombuffer(text, dtype=np.uint8)
    h = rolling(b)
    at = np.flatnonzero((h >> np.uint32(8)) % MEAN_CHUNK == 0)
    found, low, last = [0], int(h[at].min()) if len(at) else int(h[-1]) if len(h) else 0, 0
    for p in [*(at + 1).tolist(), len(text)]:
        while p - last > LONGEST_CHUNK:
            last = _bound(text, last + LONGEST_CHUNK)
            found.append(last)
        p = _bound(text, p)
        if p > last:
            found.append(p)
            last = p
    return found, low


def _bound(text: bytes, p: int) -> int:
    while p < len(text) and text[p] & 0xC0 == 0x80:
        p += 1
    return p


@lru_cache(2)
def byte_table(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that each id stands for: all bytes, where each id's start, how many it has."""
    encoder = ByteEncoder.of(vocabulary).segments
    back = {c: b for b, c in enumerate(byte_letters())}
    special = {k for k, t in encoder.tokenizer.get_added_tokens_decoder().items()}
    size = max(encoder.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    parts = [b""] * size
    for token, k in encoder.tokenizer.get_vocab(with_added_tokens=True).items():
        parts[k] = token.encode() if k in special else bytes(back[c] for c in token)
    lengths = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def decode(ids: np.ndarray, vocabulary: str) -> bytes:
    """The decoded text in UTF-8; bytes that are no UTF-8 turn into U+FFFD."""
    return _gather(byte_table(vocabulary), ids).decode("utf-8", "replace").encode()


class ChunkEncoder:
    """Encodes texts chunk by chunk; what it remembers is bounded."""

    def __init__(self, vocabulary: str):
        self.coder = ByteEncoder.of(vocabulary)
        self.known: dict[bytes, tuple] = {}
        self.size = 0
        self.encoded = 0  # chunks that were not known yet

    def encode(self, texts: list[bytes], cut_at: list[list[int]] | None = None) -> list[np.ndarray]:
        """The ids of each text; ``cut_at`` are its :func:`cuts`, if they are known already."""
        split, fresh = [], {}
        if self.size > REMEMBERED_BYTES:
            self.known, self.size = {}, 0
        for k, text in enumerate(texts):
            at = cut_at[k] if cut_at else cuts(text)[0]
            chunks = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            split.append(chunks)
            for c in chunks:
                if c not in self.known:
                    fresh[c] = None
        inner = []
        for c in fresh:
            safe = ByteEncoder.safe(np.frombuffer(c, np.uint8)) if len(c) > 2 else ()
            a, b = (int(safe[0]), int(safe[-1])) if len(safe) else (len(c), len(c))
            inner.append(c[a:b])
            # before its first safe point, its ids, after its last one (None: it has no safe point)
            self.known[c] = (c[:a], None, c[b:] if len(safe) else None)
            self.size += 4 * len(c)
        for c, ids in zip(fresh, self._split(inner), strict=True):
            head, _, tail = self.known[c]
            self.known[c] = (head, ids, tail)
        self.encoded += len(fresh)
        plans, joins = [], {}
        for chunks in split:
            out, open_ = [], b""
            for c in chunks:
                head, ids, tail = self.known[c]
                open_ += head
                if tail is not None:  # a chunk with a safe point closes the stretch around the join
                    out += [open_, ids]
                    joins[open_] = None
                    open_ = tail
            out.append(open_)
            joins[open_] = None
            plans.append(out)
        # a stretch reaches from one safe point to another, or to an end of its text: its ids are those of the whole
        found = self.coder.segments.lookup({j for j in joins if j})
        told = {j: np.frombuffer(found[j], "<u4").astype(np.int32) if j else _EMPTY for j in joins}
        return [np.concatenate([told[x] if isinstance(x, bytes) else x for x in out]) for out in plans]

    def _split(self, inner: list[bytes]) -> list[np.ndarray]:
        """The ids of what lies between the outermost safe points of each chunk."""
        ids, n = self.coder.encode(inner)
        ends = np.cumsum(n).tolist()
        return [ids[e - k : e].copy() for e, k in zip(ends, n.tolist(), strict=True)]


_EMPTY = np.zeros(0, np.int32)


@lru_cache(2)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [f"{k},".encode() for k in range(size)]
    lengths = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    flat, starts, lengths = table
    n = lengths[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def decimal(ids: np.ndarray) -> bytes:
    """The ids as decimal numbers, joined by commas."""
    return _gather(_decimals(1 << 16), ids)[:-1]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (packed unsigned 16-bit, little-endian) of each whole text."""

    def told(ids: np.ndarray):
        if len(ids) and ids.max() >> 16:
            raise ValueError("the vocabulary has ids of more than 16 bits")
        return (ids.astype("<u2").tobytes(),)

    return _each(docs, vocabulary, id_col, text_col, [("ids", pa.binary())], "ids binary", told)


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text, decoded from its ids."""
    schema = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def told(ids: np.ndarray):
        return len(ids), hashlib.sha256(decimal(ids)).hexdigest(), hashlib.sha256(decode(ids, vocabulary)).hexdigest()

    return _each(docs, vocabulary, id_col, text_col, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", told)


def _each(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, columns: list, ddl: str, told) -> DataFrame:
    rows = documents(docs, id_col, text_col)
    id_type, id_arrow = id_field(rows)
    routed = pa.schema([("doc_id", id_arrow), ("text", pa.binary()), ("cuts", pa.list_(pa.int32())), ("least", pa.int64())])
    out = pa.schema([("doc_id", id_arrow), *columns])

    def route(batches):
        for part in slices(batches):
            texts = [t or b"" for t in raw(part)]
            found = [cuts(t) for t in texts]
            yield record(routed, part.column("doc_id"), texts, [c for c, _ in found], [low for _, low in found])

    def apply(batches):
        encoder = ChunkEncoder(vocabulary)
        for part in slices(batches):
            done = encoder.encode(part.column("text").to_pylist(), part.column("cuts").to_pylist())
            yield record(out, part.column("doc_id"), *([*x] for x in zip(*map(told, done), strict=True)))

    together = rows.mapInArrow(route, f"doc_id {id_type}, text binary, cuts array<int>, least long").hint("rebalance", "least")
    return together.select("doc_id", "text", "cuts").mapInArrow(apply, f"doc_id {id_type}, {ddl}")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: ids and decoded text of every document, as digests."""
    import public_tokenizers

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
