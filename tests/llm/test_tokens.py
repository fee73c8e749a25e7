from __future__ import annotations

import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row

from foldspark.llm import bpe, token_count

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a" * 3000, " " * 500, "x\x1cy \x85\xa0z", "it's I'LL we'll'd", "\n\n \n a  b\t\tc", "日本語 😀 café", "0123456789" * 30, "<|endoftext|>", "ab" * 900]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(" \n\tab'sltd.,!?éß日1２½😀\x1c #$") for _ in range(rng.randrange(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def coder():
    return bpe.text_coder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_tiktoken_and_decode(coder, reference):
    for text in texts():
        packed = coder.encode(text)
        assert packed == array("I", reference.encode_ordinary(text)).tobytes()
        assert coder.decode(packed) == text.encode()


def test_neighbours_fit_as_merges_say(coder):
    own, rng = coder.coder, random.Random(5)
    tokens = [t for t in range(3000) if own.whole[t]]
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        alone = [own.ranks[x] for x in own.merged(own.token[a] + own.token[b])]
        assert own.fits[a << 32 | b] == (alone == [a, b])


def test_append_and_replace_are_exact(coder):
    rng, own = random.Random(7), coder.coder
    for _ in range(60):
        data = bytes(rng.choice(b"the ing and of st") for _ in range(400))
        text = bpe.Encoded(own, data[:150])
        text.append(data[150:])
        assert text.ids() == own.encode(data) and text.ids(77) == own.encode(data[:77])
        start = rng.randrange(400)
        end = min(400, start + rng.randrange(9))
        new = bytes(rng.choice(b"xthe ") for _ in range(rng.randrange(9)))
        text.replace(start, end, new)
        assert text.data == data[:start] + new + data[end:]
        assert text.ids() == own.encode(text.data)


def test_replace_stops_once_the_stored_tokens_hold(coder):
    text = bpe.Encoded(coder.coder, b"one two three " * 500)
    assert text.replace(50, 51, b"z") < 1000


def test_round_trip_rows(spark, reference):
    rows = [Row(doc_id=None, text="null id", n_tokens=9), Row(doc_id=1, text=None, n_tokens=9), Row(doc_id=2, text="twice", n_tokens=9), Row(doc_id=2, text="twice", n_tokens=9), Row(doc_id=3, text="word " * 30000, n_tokens=9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        text = {None: "null id", 1: "", 2: "twice", 3: "word " * 30000}[r.doc_id]
        ids = array("I", reference.encode_ordinary(text)).tobytes()
        assert r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []
    assert {r.doc_id for r in bpe.encode(docs, PATH, P.PATTERN).collect()} == {None, 1, 2, 3}


def greedy(word: str, pieces: set[str]) -> int:
    word, at, n = "▁" + word, 0, 0
    longest = max(map(len, pieces))
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in pieces:
                at, n = at + size, n + 1
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


def test_counts_equal_greedy_longest_match():
    pieces = set(token_count.pieces_of(P.path("piece_bpe_32k.model")))
    rng = random.Random(11)
    words = {w for text in texts() for w in text.split()} | {"".join(rng.choice("theiorandsxzé😀") for _ in range(rng.randrange(1, 25))) for _ in range(3000)}
    automaton = token_count.LongestMatch(pieces)
    for word in words:
        assert automaton.count("▁" + word) == greedy(word, pieces)


def test_counts_on_random_small_vocabularies():
    rng = random.Random(13)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 8))} | ({"▁"} if rng.random() < 0.5 else set())
        automaton = token_count.LongestMatch(pieces)
        for _ in range(20):
            word = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 12)))
            assert automaton.count("▁" + word) == greedy(word, pieces), (pieces, word)


def test_count_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "hello world", 0), (4, "hello hello", 0), (4, "hello hello", 0)], "doc_id long, text string, n_words int")
    out = token_count.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in out)
    one = greedy("hello", set(token_count.pieces_of(P.path("piece_bpe_32k.model"))))
    assert got[1:4] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)] and got[4:] == [(4, 2, 2 * one)] * 2 and got[0][1] == 2
