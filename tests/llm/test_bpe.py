import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gradloom.llm import bpe

ODD = ["a", "e", " ", "  ", "\n", "\t", "th", "ing", "é", "漢", "1", "٣", ".", "'s", "'S", "--", "<|endoftext|>", "<|endoftext", "՘", "\U00010d4a", "😀", " ", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(bpe.default_path()))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_texts_as_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(97, 105), rng.randint(0xA0, 0x2FFF)])) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids(encoder.encode(text)) == expected.ids, repr(text)


def test_every_code_point(encoder, library):
    texts = ["".join(f"a{chr(c)}1 {chr(c)}! " for c in range(at, at + 64)) for at in range(0x80, 0x110000, 64) if not 0xD7C0 < at < 0xE000]
    wrong = [text for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if ids(encoder.encode(text)) != expected.ids]
    assert not wrong


@pytest.mark.parametrize("text", ["a" * 100_001, "ab" * 60_000, " " * 90_000, "=-" * 50_000, "x y " * 40_000 + "<|endoftext|>" * 3])
def test_long_words(encoder, library, text):
    assert ids(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_gadgets_by_brute_force():
    """Small alphabets, many merges: the path is that of merging by rank."""
    rng = random.Random(5)
    for _ in range(60):
        merges, known = [], [b"a", b"b"]
        for _ in range(12):
            u, v = rng.choice(known), rng.choice(known)
            if u + v not in known and len(u + v) < 9 and greedy(list(map(lambda x: bytes([x]), u + v)), merges) == [u, v]:
                merges.append((u, v))
                known.append(u + v)
        automaton = bpe.Automaton(merges)
        for _ in range(200):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14)))
            assert [automaton.label[a] for a in automaton.read(word)] == greedy([bytes([x]) for x in word], merges), (merges, word)


def greedy(parts, merges):
    for u, v in merges:
        at = 0
        while at < len(parts) - 1:
            if parts[at] == u and parts[at + 1] == v:
                parts[at:at + 2] = [u + v]
            at += 1
    return parts


def test_query_rows(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, "", "y"), (3, None, None), (4, "ein Wort <|endoftext|> é " * 2000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    found = sorted(map(tuple, bpe.round_trip(docs, bpe.read_vocabulary(bpe.default_path())).collect()), key=str)
    expected = []
    for i, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        packed, back = np.array(want, "<u4").tobytes(), library.decode(want, skip_special_tokens=False)
        assert back == (text or "")
        expected.append((i, len(want), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    vocabulary = bpe.read_vocabulary(bpe.default_path())
    kept = bpe.encode(docs, vocabulary)
    assert kept.columns == ["doc_id", "text", "tokens", "tokens_"]
    lists = kept.select("doc_id", bpe.token_ids(kept["tokens_"]).alias("ids")).where("doc_id = 1").first()
    assert lists["ids"] == library.encode("Hello world", add_special_tokens=False).ids
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0


def test_decoding_broken_ids(spark, library):
    broken = [[0, 127, 250, 15496], [222], [50256, 60000, 995]]
    rows = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(broken)] + [(3, None)], "i int, tokens binary")
    found = {r["i"]: r["decoded"] for r in bpe.decode(rows, bpe.read_vocabulary(bpe.default_path())).collect()}
    assert found == {**{i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(broken)}, 3: ""}
