"""Language identification with error-correcting output codes.

Each learned language has a codeword of +1/-1; one binary n-gram classifier per position predicts that bit of a
text.  Decoding is loss-weighted: the language whose codeword has the least sum of logistic losses wins, each
bit weighted by how far its classifier separates the two sides.  A text whose best and second-best codewords
lie close together is flagged ambiguous.

Defined results: null text, or text without a letter: ``und``, score 0, not ambiguous; an empty training table:
``und`` for all; repeated rows get the same answer; ties between languages go to the first in sorted order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import documents, id_field, record, remainder, slices

UNKNOWN = "und"
#: Hashed features: all byte pairs, then byte triples folded into as many buckets; the last one weighs nothing.
PAIRS = 1 << 16
FEATURES = 2 * PAIRS
#: Bound of the training sample: about so many documents of each language, picked by a hash of their id.
SAMPLE_PER_LANGUAGE = 3000
#: Posterior of the best language below which a prediction counts as ambiguous.
AMBIGUOUS_BELOW = 0.6
_LETTER = regex.compile(r"\p{L}")  # signs such as 2 or 1/2 in one character are no letters


@dataclass
class LanguageModel:
    languages: list[str]
    codewords: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # features + 1 x bits, log odds
    bit_weight: np.ndarray  # bits


def codewords(n: int) -> np.ndarray:
    """Exhaustive codes up to 7 languages; beyond, the widest-apart of seeded random codes of 10 log2(n) bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1 if k == 0 else (1 if (c >> (k - 1)) & 1 else -1) for k in range(n)] for c in range((1 << (n - 1)) - 1)]
        return np.array(bits, dtype=float).T
    rng, width, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        mixed = np.abs(code.sum(axis=0)) < n  # a bit that is the same for all tells nothing
        code = code[:, mixed]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * width
        if apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all texts (pairs, triples; one for each byte), and where each text starts."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    b = np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8).astype(np.uint32)
    two = (b[:-2] << 8) | b[1:-1]
    three = (((two << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    out = np.stack([two, three + np.uint32(PAIRS)]).astype(np.int32)
    out[:, ends - 1] = FEATURES  # n-grams that would reach into the next text
    out[1, ends - 2] = FEATURES
    return out, ends - size


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learns from rows with text and language.  ``per_language`` bounds the sample; n-gram counts are summed on
    the executors, and what reaches the driver is bounded by languages times features."""
    rows = documents(docs, id_col, text_col, F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages = [x for x, _ in seen]
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((FEATURES + 1, 1), np.float32), np.ones(1))
    share = F.create_map(*[F.lit(y) for x, n in seen for y in (x, min(1.0, per_language / n))])
    pick = (F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < F.element_at(share, F.col("lang"))
    index = {x: k for k, x in enumerate(languages)}
    schema = pa.schema([("k", pa.int32()), ("f", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros((len(index), FEATURES + 1), np.int64)
        for part in slices(batches):
            ids, starts = features(part.column("text").to_pylist())
            which = np.repeat([index[x] for x in part.column("lang").to_pylist()], np.diff(np.append(starts, ids.shape[1])))
            for j in (0, 1):
                total += np.bincount(which * (FEATURES + 1) + ids[j], minlength=total.size).reshape(total.shape)
        total[:, FEATURES] = 0
        k, f = np.nonzero(total)
        yield record(schema, k.astype(np.int32), f.astype(np.int32), total[k, f])

    summed = rows.filter(pick).select("lang", "text").mapInArrow(count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), FEATURES))
    counts[summed["k"], summed["f"]] = summed["n"]
    p = np.empty_like(counts)
    for half in (slice(0, PAIRS), slice(PAIRS, FEATURES)):  # each order of n-gram is a distribution of its own
        p[:, half] = (counts[:, half] + 0.5) / (counts[:, half].sum(axis=1, keepdims=True) + 0.5 * PAIRS)
    weights, apart = np.zeros((FEATURES + 1, code.shape[1]), np.float32), np.ones(code.shape[1])
    if len(languages) > 1:
        for j in range(code.shape[1]):
            yes, no = p[code[:, j] > 0].mean(axis=0), p[code[:, j] < 0].mean(axis=0)
            weights[:FEATURES, j] = np.log(yes) - np.log(no)
            apart[j] = ((yes - no) * weights[:FEATURES, j]).sum()
    return LanguageModel(languages, code, weights, apart / apart.mean())


def decode(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss-weighted decoding of mean log odds per n-gram: language numbers and posteriors."""
    if len(model.languages) == 1:
        return np.zeros(len(margins), int), np.ones(len(margins))
    loss = (np.logaddexp(0, -margins[:, None, :] * model.codewords[None]) * model.bit_weight).sum(axis=2)
    odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss.argmin(axis=1), odds.max(axis=1) / odds.sum(axis=1)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row, from its text alone."""
    rows = documents(docs, id_col, text_col)
    id_type, id_arrow = id_field(rows)
    schema = pa.schema([("doc_id", id_arrow), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times features at most

    def apply(batches):
        m = shared.value
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            told = [k for k, t in enumerate(texts) if t and m.languages and _LETTER.search(t)]
            names, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if told:
                ids, starts = features([texts[k] for k in told])
                size = np.diff(np.append(starts, ids.shape[1]))
                total = sum(np.add.reduceat(m.weights[ids[j]], starts, axis=0) for j in (0, 1)).astype(np.float64)
                # evidence of a text grows with its length up to 64 bytes' worth of n-grams
                best, sure = decode(m, total / size[:, None] * np.minimum(size, 64)[:, None] / 8)
                for k, b in zip(told, best.tolist(), strict=True):
                    names[k] = m.languages[b]
                score[told], unsure[told] = sure, sure < ambiguous_below
            yield record(schema, part.column("doc_id"), names, score, unsure)

    return rows.mapInArrow(apply, f"doc_id {id_type}, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(remainder("doc_id", 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
