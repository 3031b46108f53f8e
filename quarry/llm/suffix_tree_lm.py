"""Language-model scoring with probabilistic suffix trees.

A text is a chain of tokens: its words and an end.  A context is the last one or two tokens before a token (a mark
stands before the text).  A context seen in training (``LEAST_COUNT`` times or more) stays if its next-token
distribution diverges enough from the one of its longest retained suffix (count times Kullback-Leibler divergence);
a token is scored in the longest retained suffix of its history.  Counts are discounted, and what the discounts leave
goes to the parent's distribution, down to the counts of single tokens (the empty context) and from there to the
spelling of words, byte by byte, by a second suffix tree over the distinct training words.  So every string has a
probability, and a score is the log10 probability of one chain of choices.

Next-token distributions tell tokens apart that make up ``FREQUENT_SHARE`` of all tokens or more (at most
1/FREQUENT_SHARE words, broadcast as flat arrays); the others are one class, within which the single-token
distribution decides.  Contexts are of any words.

Nothing of the context tree is gathered: every occurrence (training or not) travels to the bucket of its last token,
which holds all contexts that end in it and all they are followed by, so that one pass counts, tests, smooths and
scores, and sends back a sum for each document.  There are as many contexts as training gives, without a bound.  Only
contexts of ``HOT`` occurrences or more, too many for a bucket, form a broadcast top of the tree (entries of at least
``LEAST_ENTRY`` of their context, so at most 1/LEAST_ENTRY for each of at most N/HOT contexts); their occurrences go to
the bucket of the longer context instead.  Words too rare for the alphabet get their counts by a join.

Defined results: null text counts as empty: its one token is the end; with no training text at all, every
symbol is equally likely and the base knows no word.  Repeated rows are scored, and learned from, each; a null id
counts as an id.  The order of rows of a partition must be repeatable (as that of a table scan is).
"""

from __future__ import annotations

import gc
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import SLICE_BYTES, documents, id_field, mix, raw, record, slices, u64
from quarry.llm.superkmer_dedup import words as tokens_of
from quarry.storage import materialise

#: Contexts of tokens: the least count, the count-weighted divergence (nats), and the least share of a context's count
#: that an entry needs.
LEAST_COUNT = 1
DIVERGENCE = 5.0
LEAST_ENTRY = 1e-3
#: The share of all tokens that makes a word a symbol of its own, and the discount of a count.
FREQUENT_SHARE = 2.5e-7
DISCOUNT = 0.75
#: Occurrences of a context beyond which it belongs to the broadcast top (and its share of all tokens, if that is
#: more); occurrences of a bucket in the mean; occurrences that a worker sorts into buckets at once, and
#: sums of texts that it holds.
HOT, HOT_SHARE = 50_000, 1e-6
BUCKET = 250_000
HELD = 1_500_000
HELD_SUMS = 4_000_000
#: The spelling tree: longest context in bytes (its symbols of 9 bits and the next one fit a key), depths that are
#: counted in one pass, the least share of all symbols that a context needs, the divergence, the smoothing constant
#: and the least probability that a context keeps.
DEPTH = 5
SHALLOW = 3
LEAST_SHARE = 1e-5
SPELLING_DIVERGENCE = 10.0
SMOOTHING = 10.0
LEAST_CHANCE = 1e-4
#: Symbols of a spelling: bytes 0-255 are 1-256, then the mark before a word, the end of a word, the end of a text.
START, WORD_END, TEXT_END, SYMBOLS = 257, 258, 259, 258
HELD_WORDS = 400_000
#: Symbols of the token tree: the end, any word outside the alphabet, then the alphabet.
END, RARE = 0, 1
_BEFORE, _AFTER = u64(0xA0761D6478BD642F), u64(0xE7037ED1A0B428DB)
_TRAINED = np.uint32(1 << 31)
_HOT, _OTHER = np.uint32(1 << 31), np.uint32(1 << 30)


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word, c``: the tokens of all rows of ``text``, summed in the tasks first; the null word is the end.  Arrow's
    ASCII functions lower and split bytes as ``bytes.lower`` and ``bytes.split`` do."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def told(found: pa.Table, ends: int) -> pa.RecordBatch:
        both = (pa.concat_arrays([pa.array([end], t), *found.column(k).chunks]) for k, end, t in (("word", None, pa.binary()), ("c", ends, pa.int64())))
        return record(schema, *both)

    def count(batches):
        found, ends, fresh, size = schema.empty_table(), 0, [], 0

        def summed() -> pa.Table:
            return pa.concat_tables([found, *fresh]).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(schema.names)

        for part in slices(batches):
            ends += part.num_rows
            text = part.column("text").cast(pa.binary()).view(pa.string())  # any bytes
            words, c = pc.ascii_split_whitespace(pc.ascii_lower(text)).flatten().value_counts().flatten()
            some = pc.greater(pc.binary_length(words), 0)  # a space at an edge splits off an empty string
            fresh.append(pa.table([words.filter(some).cast(pa.binary()), c.filter(some)], schema=schema))
            size += len(words)
            if size > HELD_WORDS:
                found, fresh, size = summed(), [], 0
                if len(found) > HELD_WORDS:
                    yield told(found, ends)
                    found, ends = schema.empty_table(), 0
        if ends:
            yield told(summed(), ends)

    return rows.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ------------------------------------------------------------ spelling


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words, each with its start and end mark, and the lengths with marks."""
    size = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
    out[ends - size] = START
    out[ends - 1] = WORD_END
    out[out == 0] = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return out, size


def contexts(sym: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a symbol follows, how many symbols of its word stand before it, and the last ``depth`` of them as a
    key (earlier ones further up; fewer if the word began later)."""
    begin = np.repeat(np.cumsum(size) - size, size)
    before = np.arange(len(sym)) - begin
    key = np.zeros(len(sym), np.uint64)
    for d in range(1, depth + 1):
        key[d:] |= np.where(before[d:] >= d, sym[:-d] << np.uint64(9 * (d - 1)), np.uint64(0))
    at = np.flatnonzero(before > 0)
    return at, before[at], key[at]


@dataclass
class SpellingTree:
    """Retained contexts in sorted key order (the empty one is first), each with its parent and what it passes
    on to it; the smoothed probabilities of the symbols it keeps, keyed by (context number, symbol)."""

    keys: np.ndarray
    parent: np.ndarray
    passed: np.ndarray
    entries: np.ndarray
    values: np.ndarray

    def find(self, key: np.ndarray) -> np.ndarray:
        """The longest retained suffix of each history."""
        out, todo = np.zeros(len(key), np.int64), np.arange(len(key))
        for d in range(DEPTH, 0, -1):
            k = key[todo] & np.uint64((1 << (9 * d)) - 1)
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            hit = self.keys[at] == k
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
        return out

    def log10(self, key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of each symbol after its history; equal pairs are looked up once."""
        both, where = np.unique((key << np.uint64(9)) | symbol.astype(np.uint64), return_inverse=True)
        return np.log10(self.chance(self.find(both >> np.uint64(9)), (both & np.uint64(511)).astype(np.int64)))[where]

    def chance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        state, todo = state.copy(), np.arange(len(state))
        p = np.ones(len(state))
        while len(todo):
            want = state[todo] * 512 + symbol[todo]
            at = np.minimum(np.searchsorted(self.entries, want), len(self.entries) - 1)
            hit = self.entries[at] == want
            p[todo[hit]] *= self.values[at[hit]]
            todo = todo[~hit]
            p[todo] *= self.passed[state[todo]]
            state[todo] = self.parent[state[todo]]
        return p

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word."""
        if not words:
            return np.zeros(0)
        sym, size = spell(words)
        at, _, key = contexts(sym, size, DEPTH)
        each = self.log10(key, sym[at])
        return np.add.reduceat(each, np.cumsum(size - 1) - size + 1)

    def text_end(self) -> float:
        return float(self.log10(np.array([START], np.uint64), np.array([TEXT_END]))[0])


def grow(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> SpellingTree:
    """The tree from (context key, symbol, count) of each depth, contexts that are too rare left out."""
    symbols = np.concatenate([np.arange(1, 257), [WORD_END, TEXT_END]])
    root = np.zeros(512)
    np.add.at(root, counts[0][1], counts[0][2])
    root[symbols] += 0.5
    tree = SpellingTree(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1), symbols, root[symbols] / root[symbols].sum())
    for d, (key, symbol, n) in enumerate(counts[1:], 1):
        if not len(key):
            continue
        order = np.lexsort((symbol, key))
        key, symbol, n = key[order], symbol[order], n[order].astype(float)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        total = np.add.reduceat(n, begin)
        up = tree.find(key[begin] & np.uint64((1 << (9 * (d - 1))) - 1))
        q = tree.chance(up[owner], symbol)
        stays = np.add.reduceat(n * np.log(n / total[owner] / q), begin) >= SPELLING_DIVERGENCE
        big = n >= LEAST_CHANCE * total[owner]
        passed = (total - np.add.reduceat(np.where(big, n, 0), begin) + SMOOTHING) / (total + SMOOTHING)
        own = big & stays[owner]
        value = n / (total + SMOOTHING)[owner] + passed[owner] * q
        fresh = np.cumsum(stays) - 1 + len(tree.keys)  # numbers before sorting by key
        keys = np.concatenate([tree.keys, key[begin][stays]])
        number = np.empty(len(keys), np.int64)
        order = np.argsort(keys)
        number[order] = np.arange(len(keys))
        entries = np.concatenate([number[tree.entries // 512] * 512 + tree.entries % 512, number[fresh[owner[own]]] * 512 + symbol[own]])
        by = np.argsort(entries)
        tree = SpellingTree(keys[order], number[np.concatenate([tree.parent, up[stays]])][order], np.concatenate([tree.passed, passed[stays]])[order], entries[by], np.concatenate([tree.values, value[own]])[by])
    return tree


def learn_spelling(words: DataFrame, symbols: int, ends: int) -> SpellingTree:
    """Grows the spelling tree from a vocabulary table (``word``); ``symbols`` and ``ends`` are the numbers of its
    symbols and of texts.  A word counts once, however frequent: a spelling gets what discounts leave, and a discount
    leaves as much of every word.  A level has at most 1/LEAST_SHARE contexts."""
    spark = words.sparkSession
    counts: list = []
    frequent: np.ndarray | None = None
    least = max(1.0, LEAST_SHARE * symbols)
    for depths in (range(SHALLOW + 1), *([d] for d in range(SHALLOW + 1, DEPTH + 1))):
        shared = None if frequent is None else spark.sparkContext.broadcast(frequent)
        table = words.select("word").mapInArrow(_count_level(depths, shared), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        table = table.withColumn("context", F.shiftrightunsigned("key", 9))
        sums = table.groupBy("context").agg(F.sum("n").alias("m")).filter((F.col("m") >= least) | (F.col("context") == 0))
        found = table.join(sums, "context", "left_semi").select("key", "n").toPandas()
        key, n = found["key"].to_numpy().astype(np.uint64), found["n"].to_numpy()
        depth = sum(((key >> np.uint64(9 * k)) > 0).astype(int) for k in range(1, DEPTH + 1))  # symbols are never 0
        for d in depths:
            own = depth == d
            level = (key[own] >> np.uint64(9), (key[own] & np.uint64(511)).astype(np.int64), n[own])
            if d < 2 and ends:
                level = tuple(np.append(x, y).astype(x.dtype) for x, y in zip(level, (START if d else 0, TEXT_END, 1), strict=True))
            counts.append(level)
        frequent = np.unique(counts[-1][0])
    return grow(counts)


def _count_level(depths, shared):
    """Counts (context of exactly d symbols, next symbol) for each depth d; with ``shared``, a context is worth
    counting only if its last d - 1 symbols were frequent enough."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def pairs(batches):
        for words in _gathered(batches):
            sym, size = spell(words)
            at, _, key = contexts(sym, size, max(depths))
            both, n = np.unique((key << np.uint64(9)) | sym[at], return_counts=True)
            for d in depths:
                ok = (both >> np.uint64(9 * d)) > 0  # symbols are never 0
                own = both[ok] & np.uint64((1 << (9 * (d + 1))) - 1)
                of = n[ok]
                if shared is not None:
                    up = (own >> np.uint64(9)) & np.uint64((1 << (9 * (d - 1))) - 1)
                    known = np.append(shared.value, np.uint64(0))  # no context is 0
                    ok = known[np.searchsorted(shared.value, up)] == up
                    own, of = own[ok], of[ok]
                yield _summed([own], [of])

    def apply(batches):
        for both, n in _merged(pairs(batches)):
            yield record(schema, both.view(np.int64), n)

    return apply


def _gathered(batches):
    """Lists of words of about a slice's bytes, from batches of any size."""
    held, size = [], 0
    for part in slices(batches, "word"):
        held += part.column("word").to_pylist()
        size += part.column("word").nbytes
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


# ------------------------------------------------------------ single tokens


def log_word(c, tokens: int, left: float, spelled):
    """log10 of (c - discount) / tokens + left * 10**spelled, for counts of 0 as well."""
    own = np.maximum(np.asarray(c, float) - DISCOUNT, 0) / max(tokens, 1)
    rest = np.log10(left) + spelled
    with np.errstate(divide="ignore"):
        return np.where(own > 0, np.log10(own + 10.0 ** np.maximum(rest, -300.0)), rest)


class Places:
    """Finds values among sorted hashes: a search begins where the hashes of the same leading bits do."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, u64(-1))  # nothing lies beyond
        self.last = len(keys)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value; -1: not among them."""
        at = self.starts[values >> self.shift]
        found = self.keys[at]
        todo = np.flatnonzero(found < values)
        while len(todo):
            at[todo] += 1
            found[todo] = self.keys[at[todo]]
            todo = todo[found[todo] < values[todo]]
        return np.where((found == values) & (at < self.last), at, -1)


@dataclass
class Alphabet:
    """The frequent words as sorted hashes with their symbols (the most frequent word has the least); by symbol, the
    log10 of its base and single-token probabilities."""

    hashes: np.ndarray
    symbols: np.ndarray
    base: np.ndarray
    root: np.ndarray

    @cached_property
    def places(self) -> Places:
        return Places(self.hashes)

    @cached_property
    def symbol_at(self) -> np.ndarray:
        return np.append(self.symbols, np.uint32(RARE))  # the last is that of place -1

    def find(self, values: np.ndarray) -> np.ndarray:
        """The symbol of each word hash."""
        return self.symbol_at[self.places.find(values)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("places", "symbol_at")}


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = [tokens_of(words[k : k + 100_000]).values for k in range(0, len(words), 100_000)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def alphabet_of(words: list[bytes], counts: np.ndarray, n: int, v: int, ends: int, left: float, tree: SpellingTree) -> Alphabet:
    by_count = np.argsort(-counts, kind="stable")
    hashes = word_hashes(words)[by_count]
    order = np.argsort(hashes)
    spelled = np.concatenate([np.zeros(0), *(tree.words(words[k : k + 50_000]) for k in range(0, len(words), 50_000))])
    root = np.concatenate([log_word(ends, n, left, tree.text_end())[None], [0.0], log_word(counts, n, left, spelled)[by_count]])
    root[RARE] = np.log10(max(1 - (10 ** root[END] + (10 ** root[2:]).sum()), 1e-12))
    base = np.log10(np.concatenate([[ends, 0], counts[by_count]]) + 1) - np.log10(n + v + 1)
    return Alphabet(hashes[order], (order + 2).astype(np.uint32), base, root)


# ------------------------------------------------------------ contexts of tokens


@dataclass
class Top:
    """Contexts too frequent for a bucket: those of one token (by ``one``, sorted keys) and of two (``two``), their
    entries by (number, symbol), each with its whole probability, and what a context passes on to its parent."""

    keys: tuple[np.ndarray, np.ndarray]
    entries: tuple[np.ndarray, np.ndarray]
    values: tuple[np.ndarray, np.ndarray]
    passed: tuple[np.ndarray, np.ndarray]
    parent: np.ndarray  # of each context of two tokens, the number of its one-token context
    least_entry: float = LEAST_ENTRY

    def number(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Which context a key is; -1: none of these."""
        return self.places[level].find(keys)

    @cached_property
    def places(self) -> tuple[Places, Places]:
        return Places(self.keys[0]), Places(self.keys[1])

    def chance(self, level: int, number: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> np.ndarray:
        if level < 0 or not len(number):
            return root[symbol]
        want = (number.astype(np.int64) << 32) | symbol.astype(np.int64)
        entries, out = self.entries[level], np.empty(len(want))
        at = np.minimum(np.searchsorted(entries, want), max(len(entries) - 1, 0))
        hit = entries[at] == want if len(entries) else np.zeros(len(want), bool)
        out[hit] = self.values[level][at[hit]]
        miss = np.flatnonzero(~hit)
        up = self.parent[number[miss]] if level else number[miss]
        out[miss] = self.passed[level][number[miss]] * self.chance(level - 1, up, symbol[miss], root)
        return out


def context_keys(prev1: np.ndarray, prev2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = mix(prev1 + np.uint64(1))
    return one, mix(one ^ (prev2 * u64(0x9FB21C651E98DF25)))


def encoded(texts: list[bytes], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of the texts, one after another: hash and symbol; the number of tokens of each text."""
    e = tokens_of(texts)
    size = e.sizes + 1
    ends = np.cumsum(size)
    n = int(ends[-1])
    word = np.ones(n, bool)
    word[ends - 1] = False
    values, symbol = np.full(n, _AFTER), np.full(n, END, np.uint32)
    values[word], symbol[word] = e.values, alphabet.find(e.values)
    return values, symbol, size


def histories(texts: list[bytes], alphabet: Alphabet) -> tuple[np.ndarray, ...]:
    """For all tokens of the texts, one after another: text number, symbol, hashes of the two tokens before."""
    values, symbol, size = encoded(texts, alphabet)
    ends = np.cumsum(size)
    n = int(ends[-1])
    place = np.arange(n) - np.repeat(ends - size, size)
    prev1, prev2 = np.full(n, _BEFORE), np.full(n, _BEFORE)
    prev1[1:], prev2[2:] = values[:-1], values[:-2]
    prev1[place == 0] = _BEFORE
    prev2[place < 2] = _BEFORE
    return np.repeat(np.arange(len(texts)), size), symbol, prev1, prev2


def smoothed(group: np.ndarray, symbol: np.ndarray, trained: np.ndarray, parent: np.ndarray, least_entry: float = LEAST_ENTRY) -> np.ndarray:
    """The probability of each occurrence's symbol in its context ``group`` (numbers from 0), if that is retained, else
    ``parent``, its probability in the next shorter one.  Only occurrences that are ``trained`` count."""
    if not len(group):
        return parent
    order = np.argsort(group * (int(symbol.max()) + 1) + symbol)
    g, s, t, q = group[order], symbol[order], trained[order], parent[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    fresh = new | np.concatenate([[True], s[1:] != s[:-1]])
    entry, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    owner = (np.cumsum(new) - 1)[begin]
    c = np.add.reduceat(t.astype(np.int64), begin)
    n = np.bincount(owner, weights=c)
    of = n[owner]
    kept = (c > 0) & (c >= least_entry * of)
    value = np.where(kept, (c - DISCOUNT) / np.maximum(of, 1), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        told = np.where(kept, c * np.log(c / of / q[begin]), 0)
    stays = (n >= LEAST_COUNT) & (np.bincount(owner, weights=told) >= DIVERGENCE)
    passed = 1 - np.bincount(owner, weights=value)
    p = np.where(stays[owner], value + passed[owner] * q[begin], q[begin])
    out = np.empty(len(p := p[entry]))
    out[order] = p
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(both)
    both = both[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(both), 1), bool), both[1:] != both[:-1]]))
    return both[begin], np.add.reduceat(n[order], begin) if len(begin) else n


def _merged(pairs):
    """(keys, counts) summed over the slices of a task before they travel."""
    held, counts, size = [], [], 0
    for both, n in pairs:
        held.append(both)
        counts.append(n)
        size += len(both)
        if size > HELD:
            both, n = _summed(held, counts)
            held, counts, size = [both], [n], len(both)
            if size > HELD // 2:
                yield both, n
                held, counts, size = [], [], 0
    if held:
        yield _summed(held, counts)


def grow_top(rows: DataFrame, alphabet, hot: float, words: dict[int, int]) -> Top:
    """Counts what follows the contexts of ``hot`` occurrences or more in training rows; ``words``: the counts of the
    tokens (by hash) that have so many."""
    spark, root = rows.sparkSession, 10 ** alphabet.value.root
    none = np.zeros(0, np.int64)
    top = Top((np.zeros(0, np.uint64),) * 2, (none, none), (np.zeros(0),) * 2, (np.zeros(0),) * 2, none, LEAST_ENTRY)
    tokens = np.array(list(words), np.uint64)
    many = np.array(list(words.values()), float)
    before = np.full(len(tokens), _BEFORE)
    up = none
    schema = pa.schema([("context", pa.int64()), ("symbol", pa.int64()), ("n", pa.int64())])
    for level in (0, 1):
        if not len(tokens):
            break
        keys = context_keys(tokens, before)[level]
        order = np.argsort(keys)
        keys, tokens, before, many = keys[order], tokens[order], before[order], many[order]
        if level:
            up = up[order]
        if not level:  # contexts by symbol (that of the end stands for a text's start)
            own = np.where(tokens == _BEFORE, np.uint32(END), alphabet.value.find(tokens))
            context_of = np.full(int(own.max()) + 2, -1)  # the last is that of all further symbols
            context_of[own], pairs = np.arange(len(tokens)), None
        else:  # by the numbers of both tokens
            pairs = up * len(context_of) + top.number(0, context_keys(before, before)[0])
            pairs = np.sort(pairs), np.argsort(pairs)
        shared = spark.sparkContext.broadcast((context_of, pairs))

        def found_in(batches, shared=shared):
            context_of, pairs = shared.value
            for part in slices(batches):
                symbol = encoded([(t or b"").lower() for t in raw(part)], alphabet.value)[1]
                one = context_of[np.minimum(symbol, len(context_of) - 1)]  # of the token itself: the context of the next
                one = np.append(one[-1:], one[:-1])  # every text ends in the end, so does the last
                at = np.flatnonzero(one >= 0)
                context = one[at]
                if pairs is not None:
                    start = symbol[at - 1] == END  # before a text's start is nothing but its start
                    both = context * len(context_of) + np.where(start, context, one[at - 1])
                    place = np.minimum(np.searchsorted(pairs[0], both), len(pairs[0]) - 1)
                    own = (pairs[0][place] == both) & (start | (one[at - 1] >= 0))
                    at, context = at[own], pairs[1][place[own]]
                yield np.unique((context << 32) | symbol[at], return_counts=True)

        def count(batches, found_in=found_in):
            for both, n in _merged(found_in(batches)):
                yield record(schema, both >> 32, both & 0xFFFFFFFF, n)

        least = F.least(F.element_at(F.array(*[F.lit(float(LEAST_ENTRY * m)) for m in many]), F.col("context").cast("int") + 1), F.lit(float(hot)))
        found = rows.select("text").mapInArrow(count, "context long, symbol long, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
        found = found.sort_values(["context", "symbol"])
        context, symbol, c = (found[x].to_numpy() for x in ("context", "symbol", "n"))
        kept = c >= LEAST_ENTRY * many[context]
        x, s, k = context[kept], symbol[kept], c[kept]
        q = top.chance(level - 1, up[x] if level else x, s, root)
        stays = np.bincount(x, weights=k * np.log(k / many[x] / q), minlength=len(keys)) >= DIVERGENCE
        value = (k - DISCOUNT) / many[x]
        passed = np.where(stays, 1 - np.bincount(x, weights=value, minlength=len(keys)), 1.0)
        held = stays[x]
        put = lambda old, fresh, level=level: (fresh, old[1]) if level == 0 else (old[0], fresh)
        top = Top(put(top.keys, keys), put(top.entries, (x[held] << 32) | s[held]), put(top.values, (value + passed[x] * q)[held]), put(top.passed, passed), up if level else none, LEAST_ENTRY)
        if level == 0:  # contexts of two tokens that are as frequent: a hot token before a hot token, or the text's start
            hash_of = np.zeros(len(root), np.uint64)
            hash_of[alphabet.value.symbols] = alphabet.value.hashes
            longer = (c >= hot) & (symbol > RARE)
            first, second, number = tokens[context[longer]], hash_of[symbol[longer]], c[longer]
            if _BEFORE in tokens:
                first, second, number = np.append(first, _BEFORE), np.append(second, _BEFORE), np.append(number, many[tokens == _BEFORE])
            one = context_keys(second, second)[0]
            up = top.number(0, one)
            known = up >= 0
            tokens, before, many, up = second[known], first[known], number[known].astype(float), up[known]
    return top


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32 or 64 bits, byte plane by byte plane, compressed."""
    out = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(out)


def _unpacked(blob: bytes, n: int, dtypes) -> list[np.ndarray]:
    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for t in dtypes:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    return out


_PACKS = "bucket int, batch long, kind int, n int, blob binary"
_PACK_SCHEMA = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_NAMES, _SUMS, _TOKENS = 0, 1, 2  # kinds of packs: row keys of a batch, sums of its rows, occurrences


def _emit(alphabet, top, buckets: int):
    """Packs of occurrences for each bucket.  A batch is as many texts as hold about ``HELD`` tokens."""

    def flush(held: list) -> list:
        text = np.concatenate([x[0] + at for x, at in zip(held, np.cumsum([0, *(len(x[4]) for x in held[:-1])]), strict=True)])
        symbol, prev1, prev2 = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        keys, trained = np.concatenate([x[4] for x in held]), np.concatenate([x[5] for x in held])
        batch = xxhash.xxh3_64_intdigest(keys.tobytes()) >> 1
        out = [(batch % buckets, batch, _NAMES, len(keys), _packed(keys[:, 0].copy(), keys[:, 1].copy()))]
        one, two = context_keys(prev1, prev2)
        hot, both = top.value.number(0, one), top.value.number(1, two)
        # the token before the last one: its symbol, or some bits of its hash if it is rare
        earlier = np.concatenate([np.full(2, RARE, np.uint32), symbol[:-2]])
        earlier = np.where((earlier > RARE) & (prev2 != _BEFORE), earlier, (two >> np.uint64(38)).astype(np.uint32) | _OTHER)
        done = np.flatnonzero(both >= 0)
        if len(done):
            root = 10 ** alphabet.value.root
            gain = np.log10(top.value.chance(1, both[done], symbol[done], root)) - alphabet.value.root[symbol[done]]
            sums = np.bincount(text[done], weights=gain, minlength=len(keys))
            some = np.unique(text[done])
            out.append((batch % buckets, batch, _SUMS, len(some), _packed(some.astype(np.uint32), sums[some].astype(np.float32))))
        rest = np.flatnonzero(both < 0)
        where = np.where(hot[rest] < 0, one[rest], two[rest])
        second = np.where(hot[rest] < 0, earlier[rest], hot[rest].astype(np.uint32) | _HOT)
        symbol, text = symbol[rest] | np.where(trained[text[rest]], _TRAINED, np.uint32(0)), text[rest].astype(np.uint32)
        order = np.argsort(where)
        where, second, symbol, text = where[order], second[order], symbol[order], text[order]
        bucket = ((where >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascends with the context's key
        cut = [*np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)).tolist(), len(bucket)]
        for a, b in zip(cut, cut[1:], strict=False):
            new = np.flatnonzero(np.concatenate([[True], where[a + 1 : b] != where[a : b - 1]]))
            many = np.diff(np.append(new, b - a)).astype(np.uint32)
            blob = len(new).to_bytes(4, "little") + _packed(where[a:b][new], many, second[a:b], symbol[a:b], text[a:b])
            out.append((int(bucket[a]), batch, _TOKENS, b - a, blob))
        return out

    def apply(batches):
        held, n = [], 0
        for part in slices(batches):
            text, symbol, prev1, prev2 = histories([(t or b"").lower() for t in raw(part)], alphabet.value)
            keys = np.stack([part.column(c).to_numpy() for c in ("k1", "k2")], axis=1)
            held.append((text, symbol, prev1, prev2, keys, part.column("trained").to_numpy(zero_copy_only=False)))
            n += len(text)
            if n >= HELD:
                yield record(_PACK_SCHEMA, *map(list, zip(*flush(held), strict=True)))
                held, n = [], 0
        if held:
            yield record(_PACK_SCHEMA, *map(list, zip(*flush(held), strict=True)))

    return apply


def _score_buckets(alphabet, top):
    """Sums of log10 gains over the single-token distribution, for each row of a batch, from whole buckets."""

    def add_bucket(packs: list[tuple], totals: dict) -> None:
        where, second, symbol, text = [], [], [], []
        for _, n, blob in packs:
            many = int.from_bytes(blob[:4], "little")
            data = zstandard.ZstdDecompressor().decompress(blob[4:])
            planes = np.frombuffer(data, np.uint8)
            at = 0

            def take(count, dtype, planes=planes):
                nonlocal at
                size = np.dtype(dtype).itemsize
                out = np.ascontiguousarray(planes[at : at + count * size].reshape(size, count).T).view(dtype).ravel()
                at += count * size
                return out

            own, times = take(many, np.uint64), take(many, np.uint32)
            where.append(np.repeat(own, times))
            for column in (second, symbol, text):
                column.append(take(n, np.uint32))
        where, second, symbol, text = map(np.concatenate, (where, second, symbol, text))
        trained, symbol, hot = symbol >= _TRAINED, (symbol & ~_TRAINED).astype(np.int64), second >= _HOT
        root = 10 ** alphabet.value.root
        group = _numbers(where)
        p = np.empty(len(where))
        p[~hot] = smoothed(group[~hot], symbol[~hot], trained[~hot], root[symbol[~hot]], top.value.least_entry)
        p[hot] = top.value.chance(0, (second[hot] & ~_HOT).astype(np.int64), symbol[hot], root)
        p = smoothed(_numbers((group << 32) | second.astype(np.int64)), symbol, trained, p, top.value.least_entry)
        gain = np.log10(p) - alphabet.value.root[symbol]
        ends = np.cumsum([n for _, n, _ in packs]).tolist()
        for (batch, n, _), end in zip(packs, ends, strict=True):
            own = np.bincount(text[end - n : end], weights=gain[end - n : end])
            total = totals.get(batch, own[:0])
            if len(total) < len(own):
                total, own = own, total
            total[: len(own)] += own
            totals[batch] = total

    def flush(totals: dict) -> list[tuple]:
        out = []
        for batch, total in totals.items():
            some = np.flatnonzero(total)
            out.append((batch, _SUMS, len(some), _packed(some.astype(np.uint32), total[some].astype(np.float32))))
        totals.clear()
        return out

    schema = pa.schema(list(_PACK_SCHEMA)[1:])

    def apply(batches):
        held, bucket, totals = [], None, {}
        for b in batches:
            out = []
            for now, batch, kind, n, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "batch", "kind", "n", "blob")), strict=True):
                if now != bucket and held:
                    add_bucket(held, totals)
                    held = []
                    if sum(map(len, totals.values())) > HELD_SUMS:
                        out += flush(totals)
                bucket = now
                if kind == _TOKENS:
                    held.append((batch, n, blob))
                else:
                    out.append((batch, kind, n, blob))
            if out:
                yield record(schema, *map(list, zip(*out, strict=True)))
        if held:
            add_bucket(held, totals)
        if totals:
            yield record(schema, *map(list, zip(*flush(totals), strict=True)))

    return apply


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Equal keys as equal numbers from 0."""
    order = np.argsort(keys)
    k, out = keys[order], np.empty(len(keys), np.int64)
    if len(k):
        out[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    return out


def _by_row(batches):
    """The packs of whole batches as ``k1, k2, gain``."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("gain", pa.float64())])

    def rows(packs: list[tuple]) -> pa.RecordBatch:
        (names,) = {(n, blob) for kind, n, blob in packs if kind == _NAMES}
        k1, k2 = _unpacked(names[1], names[0], (np.int64, np.int64))
        total = np.zeros(names[0])
        for kind, n, blob in packs:
            if kind == _SUMS:
                text, sums = _unpacked(blob, n, (np.uint32, np.float32))
                np.add.at(total, text, sums)
        times = sum(kind == _NAMES for kind, _, _ in packs)  # equal batches of repeated rows come as one
        return record(schema, np.repeat(k1, times), np.repeat(k2, times), np.repeat(total / times, times))

    held, own = [], None
    for b in batches:
        for batch, *pack in zip(*(b.column(c).to_pylist() for c in ("batch", "kind", "n", "blob")), strict=True):
            if batch != own and held:
                yield rows(held)
                held = []
            own = batch
            held.append(tuple(pack))
    if held:
        yield rows(held)


def context_gains(rows: DataFrame, alphabet: Alphabet, n: int, ends: int, frequent: dict[int, int], hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """``k1, k2, gain``: what contexts add to the single-token log10 probability of each row (``k1, k2, text,
    trained``); ``frequent``: the counts of the alphabet's words by hash."""
    context = rows.sparkSession.sparkContext
    limit = max(hot, HOT_SHARE * n)
    words = {h: c for h, c in frequent.items() if c >= limit}
    if ends >= limit:
        words[int(_BEFORE)] = ends
    shared = context.broadcast(alphabet)
    top = context.broadcast(grow_top(rows.filter("trained"), shared, limit, words))
    buckets = max(1, min(1 << 30, int(1.2 * n / bucket)))
    packs = rows.select("text", "k1", "k2", "trained").mapInArrow(_emit(shared, top, buckets), _PACKS)
    sums = materialise(packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_score_buckets(shared, top), _PACKS.split(", ", 1)[1]))
    return sums.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_by_row, "k1 long, k2 long, gain double")


# ------------------------------------------------------------ scoring


def score(docs: DataFrame, training: Column | str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``; ``training`` is a filter on ``doc_id``."""
    spark = docs.sparkSession
    trained = F.coalesce(F.expr(training) if isinstance(training, str) else training, F.lit(False))
    rows = documents(docs, id_col, text_col).withColumn("trained", trained)
    rows = rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})
    counted = materialise(vocabulary(rows.filter("trained")))
    told = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends"), F.sum(F.coalesce(F.length("word"), F.lit(0)) + 1).alias("symbols")).first()
    n, v, ends, symbols = (int(told[k] or 0) for k in ("n", "v", "ends", "symbols"))
    left = DISCOUNT * v / n if n else 1.0
    words = counted.filter("word is not null")
    tree = learn_spelling(words, symbols, ends)
    bar = max(1.0, FREQUENT_SHARE * n)
    often = words.filter(F.col("c") >= bar).toPandas()  # at most 1/FREQUENT_SHARE words
    names, counts = list(map(bytes, often["word"])), often["c"].to_numpy(dtype=np.int64)
    alphabet = alphabet_of(names, counts, n, v, ends, left, tree)
    bottom = float(np.log10(n + v + 1))
    keep = counts >= max(hot, HOT_SHARE * n)
    frequent = dict(zip(word_hashes([w for w, k in zip(names, keep.tolist(), strict=True) if k]).tolist(), counts[keep].tolist(), strict=True))
    del often, names
    gains = materialise(context_gains(rows, alphabet, n, ends, frequent, hot, bucket)) if n else spark.createDataFrame([], "k1 long, k2 long, gain double")
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of the step before

    shared = spark.sparkContext.broadcast((alphabet, tree))
    id_type, id_arrow = id_field(rows)
    rare_type = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int32()), ("s", pa.float64())]))
    schema = pa.schema([("doc_id", id_arrow), ("k1", pa.int64()), ("k2", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("root", pa.float64()), ("rare", rare_type)])

    def apply(batches):
        alphabet, tree = shared.value
        for part in slices(batches):
            e, many = tokens_of([(t or b"").lower() for t in raw(part)]), part.num_rows
            owner, symbol = np.repeat(np.arange(many), e.sizes), alphabet.find(e.values)
            known = symbol != RARE
            add = lambda x, own=owner[known], many=many: np.bincount(own, weights=x, minlength=many)
            base, root = add(alphabet.base[symbol[known]]) + alphabet.base[END], add(alphabet.root[symbol[known]]) + alphabet.root[END]
            at = np.flatnonzero(~known)
            some, first, index = np.unique(e.values[at], return_index=True, return_inverse=True)
            spelled = [e.blob[e.lo[k] : e.hi[k]] for k in at[first].tolist()]
            s = tree.words(spelled)
            both, count = np.unique(owner[at] * max(len(some), 1) + index, return_counts=True)
            row, w = np.divmod(both, max(len(some), 1))
            flat = pa.StructArray.from_arrays([pa.array(spelled, pa.binary()).take(pa.array(w)), pa.array(count.astype(np.int32)), pa.array(s[w])], names=["w", "n", "s"])
            packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=many))]).astype(np.int32)), flat)
            yield record(schema, *(part.column(c) for c in ("doc_id", "k1", "k2")), e.sizes + 1, np.bincount(owner[known], minlength=many) + int(ends > 0), base, root, packed)

    ddl = f"doc_id {id_type}, k1 long, k2 long, n_tokens long, n_known long, base double, root double, rare array<struct<w:binary,n:int,s:double>>"
    partly = materialise(rows.select("doc_id", "k1", "k2", "text").mapInArrow(apply, ddl).withColumn("row", F.monotonically_increasing_id()))
    seldom = words.filter(F.col("c") < bar).select(F.col("word").alias("w"), "c")
    rare = partly.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(seldom, "w", "left")
    own = F.greatest(F.coalesce("c", F.lit(0)) - DISCOUNT, F.lit(0.0)) / max(n, 1)
    rest = float(np.log10(left)) + F.col("s")
    each = F.when(own > 0, F.log10(own + F.pow(F.lit(10.0), F.greatest(rest, F.lit(-300.0))))).otherwise(rest)
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - bottom)).alias("b"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * each).alias("s"))
    # rows that are equal in id and text have equal gains
    of_key = gains.groupBy("k1", "k2").agg(F.avg("gain").alias("gain"))
    joined = partly.drop("rare").join(sums, "row", "left").join(of_key, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("root") + zero("s") + zero("gain")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document scored by what is learned from the documents that are not held out."""
    from quarry.llm.common import remainder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, remainder("doc_id", 7) != 2)
    return found.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
