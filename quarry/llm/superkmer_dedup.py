"""Word-level substring dedup by super-k-mer partitioning.

Consecutive windows of 35 words that share a minimiser (an 8-word gram) travel as one packed string to the
bucket of the minimiser, where sorting counts the windows exactly: words become numbers, and ranks of 1, 2, 4,
... words are sorted in pairs up to the whole window, so equal ranks are equal word sequences.

Defined results: null or empty text: no words, nothing removed, the SHA-256 of nothing.  Texts shorter than the
window keep all words.  Of equal windows all places go, also within one document and in repeated rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import repeats
from quarry.llm.common import id_field, mix, raw, record, slices

WINDOW = 35
GRAM = 8
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: list[bytes]) -> repeats.Elements:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, hashed by their bytes, without a Python object for each."""
    blob = b" ".join(texts) + b" "
    b = np.frombuffer(blob, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    up, down = repeats._power(repeats._BASES[1], len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    values = mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return repeats.Elements(values, np.diff(np.concatenate([[0], np.searchsorted(lo, ends)])), blob, lo, hi)


def canonical(cut: bytes) -> bytes:
    return b" ".join(cut.split())


def repeated(bodies: list[bytes], counts: np.ndarray, window: int) -> list[np.ndarray]:
    """Sorts the windows of all strings; those whose places add up to two or more are repeated."""
    number: dict[bytes, int] = {}
    split = [b.split() for b in bodies]
    rank = np.array([number.setdefault(w, len(number)) for ws in split for w in ws], dtype=np.uint64)
    sizes = np.array([len(ws) for ws in split])

    def pairs(r: np.ndarray, apart: int) -> np.ndarray:
        return np.unique((r[:-apart] << np.uint64(32)) | r[apart:], return_inverse=True)[1].astype(np.uint64) if apart else r

    have = 1
    while 2 * have <= window:
        rank, have = pairs(rank, have), 2 * have
    rank = pairs(rank, window - have)
    many = sizes - window + 1
    text = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    own = rank[(np.cumsum(sizes) - sizes)[text] + at].astype(np.int64)
    hit = np.bincount(own, weights=counts[text])[own] > 1
    return np.split(hit, np.cumsum(many)[:-1])


def word_windows(window: int = WINDOW, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(window, min(gram, window), words, canonical, repeated)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, the kept words as ``kept``."""
    rows = repeats.covered(docs, word_windows(window), id_col, text_col)
    id_type, id_arrow = id_field(rows)
    names = [("doc_id", id_arrow), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    schema = pa.schema(names if texts else names[:4])

    def apply(batches):
        for part in slices(batches):
            out = []
            for t, a, b in zip(raw(part), part.column("starts").to_pylist(), part.column("ends").to_pylist(), strict=True):
                ws = (t or b"").split()
                n = len(ws)
                if a:
                    ws = list(compress(ws, (~repeats.cover_mask(n, a, b)).tolist()))
                kept = b" ".join(ws)
                out.append((n, n - len(ws), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))[: len(schema) - 1])
            yield record(schema, part.column("doc_id"), *map(list, zip(*out, strict=True)))

    return rows.mapInArrow(apply, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document without the words that repeated 35-word windows cover."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
