"""Byte-level dedup with a run-length index.

Buckets of candidate strings (see ``repeats``) get an index each: suffixes are sorted by doubled prefixes, the
Burrows-Wheeler transform of the strings is kept as runs, and the suffix positions are sampled at run heads and
run ends.  Only there a common prefix with the neighbouring suffix is measured: inside a run it is the one of
the position before, less one.  So one pass over the text from these samples streams the matching statistics
(the longest match of each position with another place), and windows of 200 matching bytes are marked.

Defined results: null or empty text: no bytes, nothing removed, the SHA-256 of nothing.  Of equal windows all
places go, overlapping ones and those of repeated rows as well; strings are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import repeats
from quarry.llm.common import id_field, mix, raw, record, slices

WINDOW = 200
GRAM = 32
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def text_bytes(texts: list[bytes]) -> repeats.Elements:
    blob = b"".join(texts)
    at = np.arange(len(blob))
    return repeats.Elements(_VALUES[np.frombuffer(blob, dtype=np.uint8)], np.array([len(t) for t in texts], dtype=np.int64), blob, at, at + 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of strings that each end in a 0 (the 0s count as distinct, in text order), by doubled prefixes."""
    n, depth = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)]).astype(np.uint64)
    key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(depth):  # 7 symbols of 9 bits; nothing counts after the end of a string
        s = np.where(open_, padded[k : k + n], np.uint64(0))
        open_ &= s > 0
        key = (key << np.uint64(9)) | s
    active = np.argsort(key)
    k = key[active]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[active] = head
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols up to the end of the string
    longest = int(left.max(initial=0))
    while depth <= longest:
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        tied = np.repeat(size > 1, size)
        active = active[tied]
        active = active[left[active] >= depth]  # a shorter one ties with equals only, which text order settles
        if not len(active):
            break
        old = rank[active]
        key = (old << 32) | rank[active + depth]
        order = np.argsort(key)
        active, key, old = active[order], key[order], old[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(active))
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        depth *= 2
    return np.sort((rank[:n] << 32) | np.arange(n)) & 0xFFFFFFFF


def common_prefix(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, which don't go beyond the end of a string."""
    most = np.minimum(left[a], left[b])
    out, going = most.copy(), np.arange(len(a))
    at = 0
    while len(going):
        x = words[a[going] + at] ^ words[b[going] + at]
        differ = x != 0
        low = x[differ]
        low = (low & (~low + np.uint64(1))).astype(np.float64)  # lowest set bit, exact as a power of two
        done = going[differ]
        out[done] = np.minimum(most[done], at + np.log2(low).astype(np.int64) // 8)
        at += 8
        going = going[~differ]
        going = going[most[going] > at]
    return out


def matching_statistics(blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """For each position of the strings (each followed by one 0 place), the longest match with another place;
    and the number of runs of the transform."""
    n = len(blob)
    ends = np.cumsum(sizes + 1) - 1
    b = np.frombuffer(blob, dtype=np.uint8)
    symbols = b.astype(np.int64) + 1
    symbols[ends] = 0
    sa = suffix_array(symbols)
    before = symbols[sa - 1]
    before[sa == 0] = 0
    head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])  # the run-length transform
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:] - 1, n - 1)
    words = np.ndarray(n, "<u8", blob + b"\0" * 16, strides=(1,))
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    longest = np.zeros(n, np.int64)
    for rows, step in ((heads[heads > 0], -1), (tails[tails < n - 1], 1)):
        here, there = sa[rows], sa[rows + step]
        reach = np.zeros(n, np.int64)
        reach[here] = here + common_prefix(words, left, here, there)
        longest = np.maximum(longest, np.maximum.accumulate(reach) - np.arange(n))
    return longest, len(heads)


def repeated(bodies: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """A window is repeated if its string occurs twice or its matching statistic reaches its length."""
    sizes = np.array([len(b) for b in bodies])
    longest, _ = matching_statistics(b"\0".join(bodies) + b"\0", sizes)
    begin = np.cumsum(sizes + 1) - sizes - 1
    return [np.ones(n - window + 1, bool) if c > 1 else longest[a : a + n - window + 1] >= window for a, n, c in zip(begin.tolist(), sizes.tolist(), counts.tolist(), strict=True)]


def byte_windows(window: int = WINDOW, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(window, min(gram, window), text_bytes, bytes, repeated)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, the kept bytes as ``kept``."""
    rows = repeats.covered(docs, byte_windows(window), id_col, text_col)
    id_type, id_arrow = id_field(rows)
    names = [("doc_id", id_arrow), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    schema = pa.schema(names if texts else names[:5])

    def apply(batches):
        for part in slices(batches):
            out = []
            for t, a, b in zip(raw(part), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                kept, n, spans = t or b"", len(t or b""), 0
                if a:
                    gone = repeats.cover_mask(n, a, b)
                    kept, spans = np.frombuffer(kept, dtype=np.uint8)[~gone].tobytes(), len(repeats.intervals(gone))
                out.append((n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(schema) - 1])
            yield record(schema, part.column("doc_id"), *map(list, zip(*out, strict=True)))

    return rows.mapInArrow(apply, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document without the bytes that repeated 200-byte strings cover."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
