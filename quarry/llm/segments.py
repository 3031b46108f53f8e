"""Subword ids by segments: texts are cut where no token can cross, and distinct segments are encoded once.

Plain segments (printable characters up to U+00FF) are split by the vocabulary's pattern and their distinct
pieces merged here, many pieces in one vectorised pass; the tokenizers library encodes all others.  Both give
the library's ids.  What a worker remembers of segments and pieces is bounded.
"""

from __future__ import annotations

import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import regex  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Segments and pieces that a worker remembers, and the longest that it does, in characters.
REMEMBERED = 100_000
LONGEST = 200
#: Characters whose class, case and normal form no version of Unicode changes.
_PLAIN = regex.compile(r"[\n\t\x20-\x7e\xa1-\xac\xae-\xff]*\Z")
_NONE = np.int32(1 << 30)
_encoders: dict = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others
    for the letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class MergeTable:
    """Byte-pair merges over many pieces at once: each round applies every piece's best merge, left to right."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        keys = (left << 20) | right
        size = 1 << int(np.ceil(np.log2(8 * len(keys))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.key, self.rank, self.to = np.full(size + 64, -1, np.int64), np.full(size + 64, _NONE), np.zeros(size + 64, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # open addressing: of those that want a free place, one takes it, the others try the next
            free = self.key[slot[todo]] < 0
            _, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.key[slot[won]], self.rank[slot[won]] = keys[won], won
            self.to[slot[won]] = [vocab["".join((pairs[k][0], pairs[k][1]))] for k in won.tolist()]
            todo = np.setdiff1d(todo, won)
            slot[todo] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table place of each pair, or the last place (no such merge)."""
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, slot, len(self.key) - 1).astype(np.int32)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] += 1
            there = self.key[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (there >= 0)]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none is empty), one after another, and how many each has."""
        return self.encode_flat(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces]))

    def encode_flat(self, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that stand one after another in ``b``."""
        sym = self.inner[b]
        sym[np.cumsum(size) - 1] = self.last[b[np.cumsum(size) - 1]]
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        ids, owner = [], []
        place = np.append(np.where(word[1:] == word[:-1], self.find(sym[:-1], sym[1:]), len(self.key) - 1), len(self.key) - 1).astype(np.int32)
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = self.rank[place]
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(sym)))
            best_of = np.repeat(best, count)
            done = best_of == _NONE
            if done.any():
                ids.append(sym[done])
                owner.append(word[done])
                sym, word, place, rank, best_of = (x[~done] for x in (sym, word, place, rank, best_of))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best_of)
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]  # of overlapping equal pairs every second one
            sym[at] = self.to[place[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = np.cumsum(keep) - 1
            sym, word, place = sym[keep], word[keep], place[keep]
            touched = np.zeros(len(sym), bool)
            touched[now[at]] = touched[np.maximum(now[at] - 1, 0)] = True
            new = np.flatnonzero(touched)
            nxt = np.minimum(new + 1, len(sym) - 1)
            inside = (nxt > new) & (word[nxt] == word[new])
            place[new] = np.where(inside, self.find(sym[new], sym[nxt]), len(self.key) - 1)
        owner_ = np.concatenate(owner)
        return np.concatenate(ids)[np.argsort(owner_, kind="stable")], np.bincount(owner_, minlength=len(size))


class PieceTable:
    """Ids of short pieces (up to 16 bytes) without a Python object for each: a hash table in arrays.

    A piece is known by its first eight bytes, its last eight and its length, which tell it exactly."""

    SLOTS = 1 << 19

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(self.SLOTS + 256, -1, np.int32)
        self.key = np.zeros((0, 3), np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    @staticmethod
    def keys(b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """``b`` has eight spare bytes at both ends."""
        words = np.ndarray(len(b) - 7, "<u8", b, strides=(1,))
        size = (hi - lo).astype(np.uint64)
        whole = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, np.uint64(8)))
        return np.stack([words[lo] & whole, np.where(size > 8, words[hi - 8], np.uint64(0)), size], axis=1)

    @staticmethod
    def hashes(key: np.ndarray) -> np.ndarray:
        h = (key[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ ((key[:, 1] + key[:, 2]) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def encode(self, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        key = self.keys(b, lo, hi)
        h = self.hashes(key)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        odd = np.flatnonzero((key[first][which] != key).any(axis=1))  # other pieces of the same hash
        first, which[odd] = np.concatenate([first, odd]), len(first) + np.arange(len(odd))
        row = self._rows(b, lo[first], hi[first], key[first], h[first])[which]
        n = self.count[row]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.at[row] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n

    def _rows(self, b, lo, hi, key, h) -> np.ndarray:
        if len(self.key) + len(key) > self.SLOTS // 2:
            self.clear()
        place = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        row, todo, home = np.full(len(key), -1), np.arange(len(key)), place.copy()
        while len(todo):
            there = self.slot[place[todo]]
            some = there >= 0
            todo, there = todo[some], there[some]
            hit = (self.key[there] == key[todo]).all(axis=1)
            row[todo[hit]] = there[hit]
            todo = todo[~hit]
            place[todo] += 1
            todo = todo[place[todo] < len(self.slot)]
        new = np.flatnonzero(row < 0)
        if len(new):
            size = hi[new] - lo[new]
            ends = np.cumsum(size)
            ids, n = self.merges.encode_flat(b[np.repeat(lo[new] - ends + size, size) + np.arange(ends[-1])], size)
            row[new] = len(self.key) + np.arange(len(new))
            self.key = np.concatenate([self.key, key[new]])
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
            self.count = np.concatenate([self.count, n])
            self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
            todo, place = new, home
            while len(todo):  # of those that want a free slot one takes it, the others try the next
                free = np.flatnonzero(self.slot[place[todo]] < 0)
                _, one = np.unique(place[todo[free]], return_index=True)
                won = free[one]
                self.slot[place[todo[won]]] = row[todo[won]]
                left = np.ones(len(todo), bool)
                left[won] = False
                todo = todo[left]
                place[todo] += 1
                todo = todo[place[todo] < len(self.slot)]  # one that finds no slot is merged again next time
        return row


#: Byte classes of plain lower-case text: 0 white space, 1 letter, 2 digit, 3 other sign, 4 needs the library.
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = 2
_KIND[97:123] = 1
_KIND[ord("'")] = 4


class WordEncoder:
    """Whole texts through a vocabulary that lower-cases and drops white space: words of plain letters, digits and
    signs (ASCII and the accented letters U+00C0 to U+00FF) in arrays, all others word by word."""

    def __init__(self, path: str):
        self.words = SegmentEncoder.of(path, "<u4")
        self.table = PieceTable(self.words.merges)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        key = (path, "words")
        if key not in _encoders:
            _encoders[key] = cls(path)
        return _encoders[key]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        blob = b" ".join([b" " * 7, *texts, b" " * 8])
        original = np.frombuffer(blob, np.uint8)
        b = original.copy()
        b[(b >= 65) & (b <= 90)] += 32
        kind = _KIND[b]
        lead = np.flatnonzero(b == 0xC3)
        tail = b[lead + 1]
        b[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 32
        accented = np.where((tail == 0x97) | (tail == 0xB7), 3, 1).astype(np.uint8)
        accented[(tail & 0xC0) != 0x80] = 4
        kind[lead], kind[lead + 1] = accented, np.where(accented == 4, kind[lead + 1], accented)
        kind[np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))] = 4  # the start of a special token
        inside = kind > 0
        begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        new = inside & ((kind == 2) | np.concatenate([[True], kind[1:] != kind[:-1]]))
        lo = np.flatnonzero(new)
        hi = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
        word = np.searchsorted(begin, lo, side="right") - 1
        hard = np.zeros(len(begin), bool)
        hard[word[(kind[lo] == 4) | (hi - lo > 16)]] = True
        easy = ~hard[word]
        lo, hi = lo[easy], hi[easy]
        ids, n = self.table.encode(b, lo, hi)
        at = lo
        slow = np.flatnonzero(hard)
        if len(slow):
            parts = [blob[x:y] for x, y in zip(begin[slow].tolist(), end[slow].tolist(), strict=True)]
            known = self.words.lookup(set(parts))
            own = [np.frombuffer(known[p], "<u4").astype(np.int32) for p in parts]
            count = np.array([len(x) for x in own])
            at, n, from_ = np.concatenate([lo, begin[slow]]), np.concatenate([n, count]), np.cumsum(np.concatenate([n, count])) - np.concatenate([n, count])
            ids, order = np.concatenate([ids, *own]), np.argsort(at, kind="stable")
            at, n, from_ = at[order], n[order], from_[order]
            ends = np.cumsum(n)
            ids = ids[np.repeat(from_ - ends + n, n) + np.arange(ends[-1])]
        starts = 8 + np.cumsum([0, *(len(t) + 1 for t in texts)])
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, starts)]
        return ids, np.diff(upto)


class ByteEncoder:
    """Texts that start and end at safe points, through a byte-level vocabulary: plain pieces in arrays, stretches
    between safe points that hold anything else through the library.

    The pieces of plain text: a word, a number or a run of signs, each with one blank before it if there is one;
    of a run of white space all but the last character, and the last unless it is such a blank."""

    def __init__(self, path: str):
        self.segments = SegmentEncoder.of(path, "<u4")
        self.table = PieceTable(self.segments.merges)

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        key = (path, "bytes")
        if key not in _encoders:
            _encoders[key] = cls(path)
        return _encoders[key]

    @staticmethod
    def kinds(b: np.ndarray) -> np.ndarray:
        """0 white space, 1 letter, 2 digit, 3 sign, 4 anything else."""
        kind = _BYTE_KIND[b]
        lead = np.flatnonzero(b[:-1] == 0xC3)
        tail = b[lead + 1]
        accented = np.where((tail == 0x97) | (tail == 0xB7), 3, 1).astype(np.uint8)
        accented[(tail & 0xC0) != 0x80] = 4
        kind[lead], kind[lead + 1] = accented, np.where(accented == 4, kind[lead + 1], accented)
        kind[np.flatnonzero((b[:-1] == 60) & (b[1:] == 124))] = 4  # the start of a special token
        return kind

    @classmethod
    def safe(cls, b: np.ndarray) -> np.ndarray:
        """The single blanks between two plain non-spaces: no piece reaches across the place before them."""
        kind = cls.kinds(b)
        plain = (kind > 0) & (kind < 4)
        return np.flatnonzero((b[1:-1] == 0x20) & plain[:-2] & plain[2:]) + 1

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has.  Each text starts with a safe point's blank
        and ends before one, so that they can stand in one array."""
        blob = b"".join([b" " * 7 + b".", *texts, b" .", b" " * 8])
        end_of = len(blob) - 10
        b = np.frombuffer(blob, np.uint8)
        kind = self.kinds(b)
        plain = (kind > 0) & (kind < 4)
        stretch = np.append(np.flatnonzero((b[1:-1] == 0x20) & plain[:-2] & plain[2:]) + 1, end_of)
        stretch = np.unique(stretch[(stretch >= 8) & (stretch <= end_of)])
        begin, end = stretch[:-1], stretch[1:]
        blank = kind == 0
        # a piece starts where the kind changes, but not after the blank that it takes along, and at that blank
        takes = np.zeros(len(b), bool)
        takes[:-1] = (b[:-1] == 0x20) & ~blank[1:]
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        new[1:] &= ~takes[:-1]
        last_blank = np.zeros(len(b), bool)
        last_blank[:-1] = blank[:-1] & ~blank[1:]
        new |= takes | last_blank  # the last character of a run of white space is a piece or goes along
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(b))
        inside = (lo >= 8) & (lo < end_of)
        lo, hi = lo[inside], np.minimum(hi[inside], end_of)
        owner = np.searchsorted(begin, lo, side="right") - 1
        hard = np.zeros(len(begin), bool)
        fours = np.flatnonzero(kind == 4)
        fours = fours[(fours >= 8) & (fours < end_of)]
        hard[np.searchsorted(begin, fours, side="right") - 1] = True
        hard[owner[hi - lo > 16]] = True
        easy = ~hard[owner]
        lo, hi = lo[easy], hi[easy]
        ids, n = self.table.encode(b, lo, hi)
        at, slow = lo, np.flatnonzero(hard)
        if len(slow):
            parts = [blob[x:y] for x, y in zip(begin[slow].tolist(), end[slow].tolist(), strict=True)]
            known = self.segments.lookup(set(parts))
            own = [np.frombuffer(known[p], "<u4").astype(np.int32) for p in parts]
            n = np.concatenate([n, [len(x) for x in own]]).astype(np.int64)
            at, from_ = np.concatenate([lo, begin[slow]]), np.cumsum(n) - n
            ids, order = np.concatenate([ids, *own]), np.argsort(at, kind="stable")
            at, n, from_ = at[order], n[order], from_[order]
            ends = np.cumsum(n)
            ids = ids[np.repeat(from_ - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        starts = 8 + np.cumsum([0, *map(len, texts)])
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, starts)]
        return ids, np.diff(upto)


_BYTE_KIND = _KIND.copy()
_BYTE_KIND[65:91] = 1


class SegmentEncoder:
    """Maps segments to their ids as little-endian bytes and, if asked, as decimal text with trailing commas."""

    def __init__(self, path: str, dtype: str, decimal: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype, self.decimal = np.dtype(dtype), decimal
        self.known: dict = {}
        self.pieces: dict = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower, self.split = self._splitter(spec)
        self.merges = MergeTable(spec["model"]) if self.split else None

    @staticmethod
    def _splitter(spec: dict):
        """(whether text is lower-cased, how plain text falls into pieces), or no splitter for other vocabularies."""
        import public_tokenizers

        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        if pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and norm is None:
            return False, regex.compile(public_tokenizers.PATTERN).findall
        steps = [p["type"] for p in pre.get("pretokenizers", [])]
        if steps == ["Split", "ByteLevel"] and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return True, regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall
        return False, None

    @classmethod
    def of(cls, path: str, dtype: str, decimal: bool = False) -> SegmentEncoder:
        """The encoder of this worker process, with what it remembers from earlier tasks."""
        key = (path, dtype, decimal)
        if key not in _encoders:
            _encoders[key] = cls(path, dtype, decimal)
        return _encoders[key]

    def _value(self, ids):
        packed = np.asarray(ids, self.dtype).tobytes()
        return (packed, "".join([f"{i}," for i in np.asarray(ids).tolist()]).encode()) if self.decimal else packed

    def _joined(self, parts: list):
        if len(parts) == 1:
            return parts[0]
        return (b"".join([p for p, _ in parts]), b"".join([d for _, d in parts])) if self.decimal else b"".join(parts)

    def encode(self, segments: list) -> list:
        """Values of segments, remembered or not."""
        out: list = [None] * len(segments)
        plain, rest = [], []
        split, lower, begin = self.split, self.lower, int(not self.lower)
        for k, s in enumerate(segments):
            s = s.decode("utf-8", "replace") if isinstance(s, bytes) else s
            if not split or len(s) > LONGEST or not (s.isascii() and s.isprintable() or _PLAIN.match(s)) or "<|" in s:
                rest.append((k, s))
                continue
            s = s.lower() if lower else s
            # the usual cases of the split at once: one word, or one word and one full stop or comma
            if (lower or s[:1] == " ") and s[begin:].isalpha():
                plain.append((k, (s,)))
            elif s[-1:] in ".," and (lower or s[:1] == " ") and s[begin:-1].isalpha():
                plain.append((k, (s[:-1], s[-1])))
            else:
                plain.append((k, split(s)))
        if rest:
            for (k, _), e in zip(rest, self.tokenizer.encode_batch_fast([s for _, s in rest], add_special_tokens=False), strict=True):
                out[k] = self._value(e.ids)
        if plain:
            fresh = list({p for _, ps in plain for p in ps}.difference(self.pieces))
            if len(self.pieces) + len(fresh) > REMEMBERED:
                self.pieces, fresh = {}, list({p for _, ps in plain for p in ps})
            if fresh:
                self.pieces.update(zip(fresh, self._values(*self.merges.encode([p.encode() for p in fresh])), strict=True))
            of = self.pieces
            for k, ps in plain:
                out[k] = of[ps[0]] if len(ps) == 1 else self._joined([of[p] for p in ps])
        return out

    def _values(self, ids: np.ndarray, counts: np.ndarray) -> list:
        width, ends = self.dtype.itemsize, np.cumsum(counts).tolist()
        packed = ids.astype(self.dtype).tobytes()
        starts = [0, *ends]
        bare = [packed[a * width : b * width] for a, b in zip(starts, ends, strict=False)]
        if not self.decimal:
            return bare
        told = [f"{i}," for i in ids.tolist()]
        return [(p, "".join(told[a:b]).encode()) for p, a, b in zip(bare, starts, ends, strict=False)]

    def lookup(self, segments: set) -> dict:
        """A table that holds all of ``segments`` (bytes or str); the encoder's own, or a copy with long ones."""
        missing = list(segments.difference(self.known))
        if not missing:
            return self.known
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, missing = {}, list(segments)
        values = self.encode(missing)
        if max(map(len, missing)) > LONGEST:
            found = dict(zip(missing, values, strict=True))
            self.known.update((s, v) for s, v in found.items() if len(s) <= LONGEST)
            return self.known | found
        self.known.update(zip(missing, values, strict=True))
        return self.known
