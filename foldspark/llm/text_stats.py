"""Statistics of whole texts, for the quality rules and the quality classifier.

One pass in Arrow batches, no shuffle. Null text is empty text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, map_texts

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_DIGITS = re.compile("[0-9]")
_UPPER = re.compile("[A-Z\u00c0-\u00de]")
_STOPS = re.compile(r"[.!?](?=\s|$)")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def line_stats(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    if "\n" not in text:
        return int(bool(text.strip(SPACES))), 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def base_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, dup = line_stats(text)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


FEATURES = ("log_words", "word_len", "word_len_sd", "symbols", "digits", "stops", "commas", "upper", "distinct", "top_word", "dup_lines", "line_words", "repeats", "neighbours", "short", "long", "ascii")


def feature_stats(text: str) -> list[float]:
    """FEATURES of a text, all of bounded size."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text) - sum(map(text.count, SPACES))
    sizes = Counter(map(len, words))
    mean = sum(k * c for k, c in sizes.items()) / n
    var = sum(k * k * c for k, c in sizes.items()) / n - mean * mean
    counts = Counter(words)
    lines, dup = line_stats(text)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        min(len(str(n)) - 1 + n / 10 ** len(str(n)), 8.0),
        min(mean, 40.0),
        min(max(var, 0.0) ** 0.5, 40.0),
        min(sum(map(text.count, SYMBOLS)) / n, 4.0),
        min(len(_DIGITS.findall(text)) / chars, 1.0),
        min(len(_STOPS.findall(text)) / n, 1.0),
        min(text.count(",") / n, 1.0),
        min(len(_UPPER.findall(text)) / chars, 1.0),
        len(counts) / n,
        max(counts.values()) / n,
        dup / lines,
        min(n / lines, 400.0) ** 0.5,
        repeated_words(words) / n,
        same / n,
        sum(c for k, c in sizes.items() if k <= 3) / n,
        sum(c for k, c in sizes.items() if k >= 15) / n,
        min(text.isascii() + 0.0, 1.0),
    ]


def with_base_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs and the base statistics as columns __words, __chars, __symbols, __dups, __repeats, __lines."""
    names = ["__words", "__chars", "__symbols", "__dups", "__repeats", "__lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [base_stats(x.as_py() or "") for x in batch.column(len(keep))]
            columns = zip(*stats) if stats else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns)], names=keep + names)

    rows = docs.select(*keep, docs[text_col].alias("__text"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return map_texts(rows, run, ", ".join(kinds + [f"{n} long" for n in names]))


def with_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs and __x, the array of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [feature_stats(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "__x"])

    rows = docs.select(*keep, docs[text_col].alias("__text"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return map_texts(rows, run, ", ".join([*kinds, "__x array<double>"]))
