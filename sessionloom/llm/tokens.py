"""Token counts by byte-pair merging.

Texts are cut into words by the tokenizer's pattern and a word's UTF-8 bytes are
its first symbols. Symbols are a linked list, adjacent pairs that have a rank a
heap: the pair with the lowest rank is popped (of equal ones the leftmost), its
two symbols become one, and the pairs with its new neighbours are pushed. What a
word counts is its symbols less its merges; no identifiers are made.

The tokenizer comes from a ``.json`` file of a byte-level BPE. The driver reads
it (it is of a fixed size) and sends the ranks to the tasks. A special string
within a text is a token of its own, as the library takes it; none are added.

Long texts are cut before white space that follows something else, where no word
ends differently for the cut, so what a task holds besides a text is bounded
unless a text has no such place.

Defined cases: null and empty texts have no bytes and no tokens. Repeated rows
count each, null ids too. Columns other than doc_id and text are not read. No
rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from . import common

PIECE = 1 << 18  # characters
HELD = 1 << 19  # words whose counts a task remembers
LONGEST_HELD = 64
# Fixed value: the pattern of words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = regex.compile(r"(?<=\S)\s")
_WORDS = regex.compile(WORDS)
_state: dict = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the file: itself where it is
    printed, else the next one from U+0100 on."""
    printed = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = (b for b in range(256) if b not in printed)
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}


def newer_letters() -> str:
    """The class of letters and numbers that the pattern library knows and the
    tokenizer, made from an older table, takes for signs: then one is a word with
    a sign before it."""
    found = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    words = ByteLevel(add_prefix_space=False).pre_tokenize_str
    ranges: list[list[str]] = []
    for c in found:
        if unicodedata.category(c) == "Cn" and len(words("!" + c)) == 1:
            if ranges and ord(ranges[-1][1]) + 1 == ord(c):
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"{a}-{b}" for a, b in ranges) + "]"


def words_pattern(text: str) -> regex.Pattern:
    """The pattern of words, without newer letters where the text has such."""
    if text.isascii():
        return _WORDS
    if "newer" not in _state:
        _state["newer"] = re.compile(newer_letters())
    if not _state["newer"].search(text):
        return _WORDS
    if "older" not in _state:
        newer = _state["newer"].pattern
        older = WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{newer}]").replace(r"?\p{L}", rf"?[\p{{L}}--{newer}]").replace(r"?\p{N}", rf"?[\p{{N}}--{newer}]")
        _state["older"] = regex.compile(older, regex.V1)
    return _state["older"]


def read_ranks(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of the pairs, and the special strings."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    model, cut, added = told["model"], told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    cut_so = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or not cut_so or told.get("normalizer") or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} is no plain byte-level BPE")
    if missing := [b for b, c in byte_letters().items() if c not in model["vocab"]]:
        raise ValueError(f"{path} has no symbols for the bytes {missing[:5]}")
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    return {p: i for i, p in enumerate(pairs)}, [t["content"] for t in added]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """What is left of the symbols when no adjacent pair has a rank."""
    n, get = len(symbols), ranks.get
    part, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(p, -1) for p in zip(part, part[1:], strict=False)]  # the rank of each symbol with its next one
    pair.append(-1)
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        if pair[i] != rank:
            continue  # one of the two has been merged since
        j = after[i]
        part[i] += part[j]
        pair[i] = pair[j] = -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pair[i] = rank = get((part[i], part[k]), -1)
            if rank >= 0:
                heapq.heappush(heap, rank * n + i)
        h = before[i]
        if h >= 0:
            pair[h] = rank = get((part[h], part[i]), -1)
            if rank >= 0:
                heapq.heappush(heap, rank * n + h)
    return n - merges


class Counter(dict):
    """Tokens by word, made when first asked for; short words are remembered."""

    def __init__(self, ranks: dict[tuple[str, str], int], special: list[str]):
        super().__init__()
        self.ranks, self.letters = ranks, byte_letters()
        longest_first = sorted(filter(None, special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def __missing__(self, word: str) -> int:
        n = merged_count(list(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))), self.ranks)
        if len(word) <= LONGEST_HELD:
            if len(self) >= HELD:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        plain = self.special.split(text) if self.special else [text]
        # one special string between each two of the plain parts
        return len(plain) - 1 + sum(self._words(piece) for part in plain for piece in pieces(part))

    def _words(self, piece: str) -> int:
        return sum(map(self.__getitem__, words_pattern(piece).findall(piece)))


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    size = size or PIECE
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def counted(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) by row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def work(texts: list) -> dict:
        if _state.get("of") is not shared:
            _state["of"], _state["counter"] = shared, Counter(*shared.value)
        return {"n_tokens": [_state["counter"].count(t) for t in texts]}

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return common.per_text(sized, ["doc_id", "n_bytes"], "n_tokens long", work).withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level vocabulary. The cases are
    those of the module."""
    import public_tokenizers

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
