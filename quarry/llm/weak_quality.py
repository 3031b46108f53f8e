"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text.  Expectation-maximisation over the counts of vote
patterns (3**labellers at most, summed over the whole corpus) estimates how often each labeller is right about
good and about bad texts and the share of good ones; the posterior of a text's pattern is its weak label.  A
linear scorer over hashed features (shapes of character triples and bucketed statistics) is trained on these
labels from a bounded sample and scores all whole texts.

Toxic language is a second head: from a bounded sample of labelled documents, equal texts once, the words and
word beginnings that mark toxic ones precisely are picked one after another, each for the toxic documents that
the earlier ones missed (so words that only mark a copied document don't get in).

Defined results: null or blank text scores 0 for quality and is rejected; without labels nothing is toxic; a
corpus without any vote scores every text 0.5 and keeps it.  Repeated rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import documents, id_field, raw, record, slices
from quarry.storage import materialise

#: Bounds of the training samples: texts of the scorer, labelled documents of the toxic head.
SAMPLE = 8000
LABELLED_SAMPLE = 10_000
KEEP_ABOVE = 0.5
#: Toxic marks: documents one is seen in, its precision, documents it must add; lengths of word beginnings.
LEAST_SEEN, PRECISION, LEAST_GAIN, BEGINNINGS = 5, 0.9, 3, (4, 6, 8)
REMEMBERED = 100_000
_SHAPES, _BUCKETS = 512, 512
_WORD = re.compile(r"[^\W_]+")
_workers: dict = {}


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, blank, line end, plain punctuation, other sign, beyond ASCII."""
    out = np.full(256, 6, np.uint8)
    out[128:] = 7
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t", 3), (b"\n\r", 4), (b".,;:'\"-()?", 5)):
        out[list(chars)] = k
    return out


_CLASS = _classes()


@dataclass
class Statistics:
    words: int
    sign_share: float
    upper_share: float
    repeat_share: float
    top_share: float
    same_lines: float
    word_length: float
    distinct: float


def statistics(text: bytes, shape: np.ndarray) -> Statistics:
    """``shape``: how many bytes of the text are in each class."""
    ws = text.split()
    n, letters = len(ws), int(shape[0] + shape[1])
    counts = Counter(ws)
    lines = text.split(b"\n")
    return Statistics(
        n,
        float(shape[5] + shape[6]) / max(len(text), 1),
        float(shape[1]) / max(letters, 1),
        sum(map(eq, ws, ws[1:])) / max(n - 1, 1),
        max(counts.values(), default=0) / max(n, 1),
        1 - len(set(lines)) / len(lines),
        float(len(text) - shape[7] / 2 - shape[3] - shape[4]) / max(n, 1),
        len(counts) / max(n, 1),
    )


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


#: The labellers: each may abstain.
LABELLERS = {
    "signs": lambda s: _vote(s.words >= 10 and s.sign_share > 0.07, 0 < s.sign_share < 0.05),
    "capitals": lambda s: _vote(s.upper_share > 0.25, s.upper_share < 0.08),
    "stutter": lambda s: _vote(s.words >= 20 and s.repeat_share > 0.08, s.words >= 20 and s.repeat_share < 0.03),
    "one_word": lambda s: _vote(s.words >= 20 and s.top_share > 0.15, s.words >= 40 and s.top_share < 0.1),
    "same_lines": lambda s: _vote(s.same_lines > 0.3, 0),
    "word_length": lambda s: _vote(s.words >= 10 and not 3 <= s.word_length <= 6.6, s.words >= 10 and 4 <= s.word_length <= 6),
    "variety": lambda s: _vote(50 <= s.words and s.distinct < 0.3, s.words >= 30 and s.distinct > 0.55),
}


def _slice_statistics(texts: list[bytes]) -> tuple[list[Statistics], np.ndarray]:
    """Statistics of each text and its frequencies of class triples."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    c = _CLASS[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    shape = np.bincount(owner * 8 + c, minlength=8 * len(texts)).reshape(-1, 8)
    inside = owner[2:] == owner[:-2]
    triples = np.bincount((owner[2:] * _SHAPES + c[:-2] * 64 + c[1:-1] * 8 + c[2:])[inside], minlength=_SHAPES * len(texts)).reshape(-1, _SHAPES)
    return [statistics(t, s) for t, s in zip(texts, shape, strict=True)], triples


def features(stats: list[Statistics], triples: np.ndarray) -> np.ndarray:
    """Hashed features: roots of triple frequencies, and one place for each statistic's bucket."""
    out = np.zeros((len(stats), _SHAPES + _BUCKETS), np.float32)
    out[:, :_SHAPES] = np.sqrt(triples / np.maximum(triples.sum(axis=1, keepdims=True), 1))
    for k, s in enumerate(stats):
        for name, x in s.__dict__.items():
            bucket = int(np.log2(x + 1)) if name == "words" else int(x * 20) if name != "word_length" else int(2 * min(x, 20))
            out[k, _SHAPES + zlib.crc32(f"{name}:{bucket}".encode()) % _BUCKETS] = 0.5
    return out


def votes_of(stats: Statistics) -> str:
    return "".join("-0+"[1 + int(f(stats))] for f in LABELLERS.values())


def expectation_maximisation(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The posterior chance of good for each pattern of votes ('+', '-', '0'), from how often each occurs."""
    if not patterns:
        return {}
    votes = np.array([["-0+".index(v) - 1 for v in p] for p in patterns])
    weight = np.array(list(patterns.values()), dtype=float)
    good = np.clip(0.5 + votes.sum(axis=1) / (2 * len(LABELLERS)), 0.05, 0.95)  # majority, to begin with
    if not votes.any():
        return dict.fromkeys(patterns, 0.5)
    for _ in range(rounds):
        log = []
        for q in (good, 1 - good):  # a labeller that abstains says nothing
            w = weight * q
            share = {v: (w @ (votes == v) + 0.5) / (w @ (votes != 0) + 1) for v in (-1, 1)}
            log.append(np.log((w.sum() + 1) / (weight.sum() + 2)) + sum((votes == v) @ np.log(share[v]) for v in (-1, 1)))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient; the last weight is the constant."""
    x, y = np.hstack([x, np.ones((len(x), 1), np.float32)]), y.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(4 / max(float((x * x).sum(axis=1).max(initial=1)), 1e-9))
    for k in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -60, 60))) - y) / np.float32(max(len(x), 1)) + np.float32(ridge) * v
        new = v - step * g
        v = new + np.float32(k / (k + 3)) * (new - w)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w.astype(np.float64)


def marks_in(text: str) -> set[str]:
    """The words of a text and their beginnings (with a trailing *)."""
    ws = set(_WORD.findall(text.lower()))
    return ws | {w[:k] + "*" for w in ws for k in BEGINNINGS if len(w) > k}


def marks(rows: DataFrame) -> list[str]:
    """What marks toxic texts, from a bounded table ``text, toxic``; the driver gets no texts."""
    rows = materialise(rows.dropDuplicates(["text"]).select("text", (F.col("toxic") > 0).alias("toxic")))
    spark, schema = rows.sparkSession, pa.schema([("mark", pa.string()), ("n", pa.int64())])

    def counted(keep: set[str] | None):
        def count(batches):
            found: Counter = Counter()
            for part in slices(batches):
                for t in part.column("text").to_pylist():
                    found.update(marks_in(t) if keep is None else marks_in(t) & keep)
            if found:
                yield record(schema, list(found), list(found.values()))

        table = rows.filter("toxic" if keep is None else "not toxic").select("text").mapInArrow(count, "mark string, n long")
        return table.groupBy("mark").agg(F.sum("n").alias("n"))

    yes = {r["mark"]: r["n"] for r in counted(None).filter(F.col("n") >= LEAST_SEEN).collect()}
    no = {r["mark"]: r["n"] for r in counted(set(yes)).collect()}
    candidates = {m for m, n in yes.items() if n >= PRECISION * (n + no.get(m, 0))}
    held = pa.schema([("marks", pa.list_(pa.string()))])

    def hold(batches):
        for part in slices(batches):
            yield record(held, [sorted(marks_in(t) & candidates) for t in part.column("text").to_pylist()])

    left, out = [set(r["marks"]) for r in rows.filter("toxic").select("text").mapInArrow(hold, "marks array<string>").limit(2 * LABELLED_SAMPLE).collect()], []
    gain = Counter(m for ms in left for m in ms)
    while True:
        best = max(gain.items(), key=lambda x: (x[1], -len(x[0]), x[0]), default=(None, 0))
        if best[1] < LEAST_GAIN:
            return out
        out.append(best[0])
        gain.subtract(m for ms in left if best[0] in ms for m in ms)
        left = [ms for ms in left if best[0] not in ms]


@dataclass
class QualityModel:
    posterior: dict[str, float]
    weights: np.ndarray
    marks: list[str]


def _drawn(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows, picked by a hash of the whole row (equal rows come together: what gathers them has a limit
    of its own)."""
    share = min(1.0, bound / max(rows.count(), 1))
    return rows.filter(F.xxhash64(*rows.columns).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30) < share)


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learns from all texts (vote patterns), a bounded sample of them (scorer) and of labelled ones (toxic head);
    ``labels`` has ``doc_id`` and ``toxic``."""
    rows = documents(docs, id_col, text_col).filter("text is not null")
    schema = pa.schema([("votes", pa.string()), ("n", pa.int64())])

    def vote(batches):
        found: Counter = Counter()
        for part in slices(batches):
            found.update(map(votes_of, _slice_statistics([t for t in raw(part) if t.strip()])[0]))
        if found:
            yield record(schema, list(found), list(found.values()))

    patterns = {r["votes"]: r["n"] for r in rows.select("text").mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    posterior = expectation_maximisation(patterns)

    drawn = pa.schema([("votes", pa.string()), ("x", pa.binary())])

    def draw(batches):
        for part in slices(batches):
            stats, triples = _slice_statistics([t for t in raw(part) if t.strip()])
            if stats:
                yield record(drawn, [votes_of(s) for s in stats], [x.astype(np.float16).tobytes() for x in features(stats, triples)])

    sample = _drawn(rows, SAMPLE).select("text").mapInArrow(draw, "votes string, x binary").limit(2 * SAMPLE).toPandas()
    x = np.frombuffer(b"".join(map(bytes, sample["x"])), np.float16).astype(np.float32).reshape(len(sample), -1) if len(sample) else np.zeros((0, _SHAPES + _BUCKETS), np.float32)
    weights = train(x, np.array([posterior[v] for v in sample["votes"]]))

    found: list[str] = []
    if labels is not None:
        told = labels.select(F.col("doc_id"), "toxic").filter("toxic is not null")
        picked = F.broadcast(_drawn(told, LABELLED_SAMPLE).limit(2 * LABELLED_SAMPLE))
        found = marks(rows.join(picked, "doc_id").select("text", "toxic"))
    return QualityModel(posterior, weights, found)


class _Marks:
    """Whether a text holds a mark; what it remembers of words is bounded."""

    def __init__(self, found: list[str]):
        self.whole = {m for m in found if m[-1] != "*"}
        self.begin = {m[:-1] for m in found if m[-1] == "*"}
        self.known: dict[bytes, bool] = {}

    def hits(self, text: bytes) -> int:
        known, n = self.known, 0
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(text.lower().split()):
            hit = known.get(w)
            if hit is None:
                hit = any(p in self.whole or any(p[:k] in self.begin for k in BEGINNINGS if len(p) > k) for p in _WORD.findall(w.decode("utf-8", "replace").lower()))
                if len(w) < 200:
                    known[w] = hit
            n += hit
        return n


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep_above: float = KEEP_ABOVE) -> DataFrame:
    """``doc_id, quality_score, weak_label, toxic_words, keep`` for every row; ``weak_label`` is the posterior of
    the row's votes, ``toxic_words`` its number of distinct words with a toxic mark."""
    rows = documents(docs, id_col, text_col)
    id_type, id_arrow = id_field(rows)
    schema = pa.schema([("doc_id", id_arrow), ("quality_score", pa.float64()), ("weak_label", pa.float64()), ("toxic_words", pa.int32()), ("keep", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: patterns, weights, marks of the sample

    def apply(batches):
        m = shared.value
        if _workers.get("of") is not shared:
            _workers.update({"of": shared, "marks": _Marks(m.marks)})
        for part in slices(batches):
            texts = [t or b"" for t in raw(part)]
            some = np.array([k for k, t in enumerate(texts) if t.strip()], int)
            score, weak, toxic = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            if len(some):
                stats, triples = _slice_statistics([texts[k] for k in some])
                z = features(stats, triples).astype(np.float64) @ m.weights[:-1] + m.weights[-1]
                score[some] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                weak[some] = [m.posterior.get(votes_of(s), 0.5) for s in stats]
                toxic[some] = [_workers["marks"].hits(texts[k]) for k in some] if m.marks else 0
            yield record(schema, part.column("doc_id"), score, weak, toxic, (score >= keep_above) & (toxic == 0))

    return rows.mapInArrow(apply, f"doc_id {id_type}, quality_score double, weak_label double, toxic_words int, keep boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: quality and toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return predict(docs, fit(docs, labels))
