import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionloom.llm import tokens as T

from . import samples

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = [*"a1! \n\t\r", "the", "  ", "23", "'s", "'re", "'", "é", "é", "日本", " ", " ", "\x1c", "\x85", "🙂", "\x00", "ZZZ", "<|endoftext|>", "<|end", "oftext|>", "՘", "\U0003d000", "\U0001df90", "Ᲊ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return T.Counter(*T.read_ranks(PATH))


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_against_the_library(library, counter):
    assert [counter.count(t) for t in mixed(4000, 1)] == [expected(library, t) for t in mixed(4000, 1)]


def test_every_character(library, counter):
    for start in range(0, 0x110000, 4096):
        codes = [c for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)} " for c in codes)
        assert counter.count(text) == expected(library, text), hex(start)


def test_pieces_change_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    for t in mixed(2000, 2):
        assert "".join(T.pieces(t)) == t
        assert counter.count(t) == expected(library, t)


def test_merging_by_looking_at_all_pairs():
    r = random.Random(3)
    for _ in range(300):
        symbols = [r.choice("abc") for _ in range(r.randint(0, 30))]
        known, ranks = ["a", "b", "c"], {}
        for _ in range(20):
            pair = (r.choice(known), r.choice(known))
            if pair not in ranks:
                ranks[pair] = len(ranks)
                known.append("".join(pair))
        left = list(symbols)
        while found := [(ranks[p], i) for i, p in enumerate(zip(left, left[1:], strict=False)) if p in ranks]:
            _, i = min(found)
            left[i : i + 2] = [left[i] + left[i + 1]]
        assert T.merged_count(symbols, ranks) == len(left)


def test_operator(spark, library):
    rows = [*samples.AWKWARD, *[(100 + i, t) for i, t in enumerate(mixed(300, 4))], (9000, "x1!" * 100_000), (9001, samples.prose(60_000)), (9002, "é" * 300_000)]
    got = T.counted(samples.docs(spark, rows), PATH).collect()
    want = [(k, len((t or "").encode()), n := expected(library, t), n > 512) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert T.counted(samples.docs(spark, rows), PATH, limit=0).where("over_limit <> (n_tokens > 0)").count() == 0
    assert T.counted(samples.docs(spark, rows).where("false"), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        T.read_ranks(public_tokenizers.path("word_bpe_49k.json"))


def test_held_words_are_bounded(counter, monkeypatch):
    monkeypatch.setattr(T, "HELD", 10)
    small = T.Counter(counter.ranks, ["<|endoftext|>"])
    text = " ".join(f"w{i}" for i in range(200))
    assert small.count(text) == counter.count(text) and len(small) <= 10
