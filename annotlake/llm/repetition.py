"""Quality rules on repetition: characters inside duplicated n-grams and lines, by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import body, mix, small_batches, span_values, text_slices, word_spans

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words, in windows of three
# Percent of the characters of a text's words that duplicated n-grams of so many words, and duplicated lines, may hold.
MOST_IN_NGRAMS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MOST_IN_LINES = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
KIND = ", ".join([*[f"{c}: bigint" for c in COUNTS], "dup_chars: array<bigint>"])

_BASE = np.uint64(0x9E6C63D0876A9A47)
_DOWN = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers for the spans of bytes, equal only for equal bytes."""
    return span_values(raw, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)


def _rolling(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over word numbers, and the powers that shift a window's sum to the origin."""
    up, down = np.full(len(names) + 1, _BASE, np.uint64), np.full(len(names) + 1, _DOWN, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def _found_twice(names: np.ndarray, texts: np.ndarray, first: np.ndarray, width: int, keys: np.ndarray) -> np.ndarray:
    """Which windows (their first words) occur twice or more in their text.

    Windows with one hash stand together after a sort; their words decide, and should two
    different windows share a hash, all are numbered by their words instead.
    """
    order = np.argsort(keys, kind="stable")
    a, b = first[order[:-1]], first[order[1:]]
    close = np.flatnonzero(keys[order[:-1]] == keys[order[1:]])
    same = texts[a[close]] == texts[b[close]]
    for k in range(width):
        same &= names[a[close] + k] == names[b[close] + k]
    if not same.all():
        whole = np.stack([texts[first], *[names[first + k] for k in range(width)]], axis=1)
        _, numbers = np.unique(whole, axis=0, return_inverse=True)
        return _found_twice(names, texts, first, width, numbers.reshape(-1))
    twice = np.zeros(len(first), bool)
    twice[order[close]] = True
    twice[order[close + 1]] = True
    return twice


def _covered(names: np.ndarray, texts: np.ndarray, at: np.ndarray, width: int, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Which words lie in a window of ``width`` words that their text holds twice or more."""
    left = at[1:][texts] - np.arange(len(names))  # words from here to the end of the text
    first = np.flatnonzero(left >= width)
    keys = mix((sums[first + width] - sums[first]) * down[first]) ^ mix(texts[first].astype(np.uint64))
    hit = first[_found_twice(names, texts, first, width, keys)] if len(first) else first
    turns = np.zeros(len(names) + 1, np.int64)
    turns[hit] += 1
    np.subtract.at(turns, hit + width, 1)
    return np.cumsum(turns[:-1]) > 0


def _lines(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that hold a word: their text, their first word, and whether an earlier line of the text equals them."""
    feeds = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    text = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), offsets[np.minimum(text + 1, len(offsets) - 1)])
    feed = (ends > starts) & (raw[np.maximum(ends, 1) - 1] == 10) if len(raw) else np.zeros(len(starts), bool)
    word = np.searchsorted(words, starts)
    solid = np.flatnonzero((np.searchsorted(words, ends) > word) & (text < len(offsets) - 1))
    names = _names(raw, starts[solid], (ends - feed)[solid])
    _, where = np.unique(text[solid] * (len(raw) + 1) + names, return_index=True)
    again = np.ones(len(solid), bool)
    again[where] = False
    return text[solid], word[solid], again


def measure(raw: np.ndarray, offsets: np.ndarray, widths: list[int]) -> dict[str, np.ndarray]:
    """The counts of several texts, given as bytes and offsets; ``dup_chars`` has one column a width."""
    n = len(offsets) - 1
    starts, ends, at = word_spans(raw, offsets)
    texts = np.repeat(np.arange(n), np.diff(at))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    per_text = lambda v: np.bincount(texts, v, n).astype(np.int64)
    names = _names(raw, starts, ends)
    rolling = _rolling(names)
    text, word, again = _lines(raw, offsets, starts)
    turn = np.zeros(len(starts) + 1, np.int64)  # 1 where a repeated line's words begin, -1 where they end
    last = np.append(word[1:], len(starts))
    np.add.at(turn, word[again], 1)
    np.subtract.at(turn, last[again], 1)
    in_lines = np.cumsum(turn[:-1]) > 0
    return {
        "n_words": np.diff(at),
        "word_chars": per_text(chars),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_lines": np.bincount(text, minlength=n),
        "n_dup_lines": np.bincount(text[again], minlength=n),
        "dup_line_chars": per_text(chars * in_lines),
        "n_repeat_words": per_text(_covered(names, texts, at, 3, *rolling)),
        "dup_chars": np.stack([per_text(chars * _covered(names, texts, at, w, *rolling)) for w in widths], axis=1),
    }


def repetition(text: str, widths: list[int]) -> Column:
    """The counts of a text column as one struct."""

    @F.arrow_udf(f"struct<{KIND}>")
    def counted(column: pa.Array) -> pa.Array:
        found = [measure(raw, offsets, widths) for _, _, raw, offsets in text_slices(column)]
        whole = {c: np.concatenate([f[c] for f in found] or [np.zeros(0)]).astype(np.int64) for c in COUNTS}
        inside = np.concatenate([f["dup_chars"].reshape(-1) for f in found] or [np.zeros(0, np.int64)])
        ends = pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(widths))
        lists = pa.ListArray.from_arrays(ends, pa.array(inside, pa.int64()))
        return pa.StructArray.from_arrays([*[pa.array(whole[c]) for c in COUNTS], lists], names=[*COUNTS, "dup_chars"])

    return counted(body(text))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED)


def accepted(m: Column, most: dict[int, int]) -> Column:
    """The verdict on a struct of counts: no share of the characters above its bound."""
    fine = ~base_failed(m) & (m["dup_line_chars"] * 100 <= m["word_chars"] * MOST_IN_LINES)
    for k, share in enumerate(most.values()):
        fine = fine & (m["dup_chars"][k] * 100 <= m["word_chars"] * share)
    return fine


def with_rules(docs: DataFrame, name: str, most: dict[int, int] | None = None) -> DataFrame:
    """``docs`` with the struct ``name``: the counts, ``base_failed`` and ``kept``.

    Words are runs of other characters than blanks (space, \\t to \\r); ``n_repeat_words``
    counts words in windows of three that the text holds twice or more; ``dup_chars`` has, for
    each length of ``most``, the characters of words inside n-grams that it holds twice or
    more, the first included; lines that equal an earlier one are duplicates, the first isn't.

    Every row is judged by itself, so repeated rows get equal verdicts. A null or empty text
    has no words and fails; a text shorter than an n-gram has none of that length. Texts are
    read whole, about a megabyte of them at once; a longer one is a batch of its own and needs
    some 40 times its size of memory. An empty table gives an empty result.
    """
    most = MOST_IN_NGRAMS if most is None else most
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    counted = docs.select(*[docs[c] for c in kept], repetition("text", list(most)).alias(name))
    m = F.col(name)
    return counted.withColumn(name, F.struct("%s.*" % name, base_failed(m).alias("base_failed"), accepted(m, most).alias("kept")))


def drop_repetitive(docs: DataFrame, most: dict[int, int] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules accept, with all their columns."""
    name = "rules"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return with_rules(docs, name, most).where(F.col(name)["kept"]).drop(name)
