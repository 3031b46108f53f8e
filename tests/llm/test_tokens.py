"""Chunked encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from quarry.llm import chunked_bpe, packing, segments
from tokenizers import Tokenizer

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def texts():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "ention", "éeau", "Über,", "It's", "don't", "naïve.", "x" * 30, "1234", "ñ", "ÉÀ×÷"]) for _ in range(n))
    shared = prose(900)
    out = [prose(rng.randint(1, 400)) for _ in range(40)]
    out += [prose(20) + " " + shared + "\n\n" + prose(20) for _ in range(5)] + out[:4]
    out += ["", " ", "\n", "a", "  a  b ", "<|endoftext|> x <|endoftext|>y  <|endoftext|>", "<|startoftext|>A", "é" * 5000, " x" * 9000, "a b   c\x1c d\x0be\x0cf", "日本 語 " * 3000]
    out += ["".join(rng.choice(" \n\ta'sdéÉ!1́ <|σΣß·") for _ in range(3000)), "ab" * 20000, "aaaa aaa aa" * 50, "é é", "�\U0001f600 ok", "I'LL we'Ve 's", "x" * 70000, None]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(k, t) for k, t in enumerate(texts())]
    return found + [found[0], (None, "no id")]


def test_chunked_encoding(spark, write_docs, rows):
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = [tuple(r) for r in chunked_bpe.query(spark, write_docs(rows)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_shared_chunks_are_encoded_once():
    x = texts()[40].encode()
    encoder = chunked_bpe.ChunkEncoder(BYTE)
    encoder.encode([x])
    n = encoder.encoded
    encoder.encode([b"other words first, " + x, x + b" more"])
    assert n > 2 and encoder.encoded <= n + 4


def test_ids_round_trip(spark, docs_of, rows):
    for r in chunked_bpe.encode_documents(docs_of(rows[:12]), BYTE).collect():
        assert chunked_bpe.decode(np.frombuffer(bytes(r.ids), "<u2"), BYTE).decode() == rows[r.doc_id][1]


def test_packing(spark, write_docs, rows):
    t = Tokenizer.from_file(WORD)
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048)]
    found = packing.query(spark, write_docs(rows)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def best(lengths, capacity):
    """The fewest bins, by trying everything."""
    lengths, answer = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= answer[0]:
            return
        if k == len(lengths):
            answer[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= capacity and bins[j] not in bins[:j]:
                place(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return answer[0]


def test_plans_are_whole_and_tight():
    rng = random.Random(3)
    for n in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))] if n < 50 else [rng.randint(1, 30) for _ in range(3000)]
        plan = packing.plan({x: lengths.count(x) for x in set(lengths)}, 30)
        assert sorted(x for held, many in plan for x in held * many) == sorted(lengths)
        assert all(sum(held) <= 30 for held, _ in plan)
        used = sum(many for _, many in plan)
        assert used <= (best(lengths, 30) + 1 if n < 50 else 1.03 * max(sum(lengths) / 30, sum(x > 15 for x in lengths)) + 1)
    assert packing.plan({}) == []


def test_words_in_arrays_equal_the_library():
    t = Tokenizer.from_file(WORD)
    xs = [x or "" for x in texts()]
    ids, n = segments.WordEncoder.of(WORD).encode([x.encode() for x in xs])
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in xs]


def test_empty_table(spark, write_docs):
    path = write_docs([])
    assert packing.query(spark, path).collect() == [] and chunked_bpe.query(spark, path).collect() == []
