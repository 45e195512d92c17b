"""Quality rules with repetition coverage.

Rolling hashes of word n-grams of several lengths are kept in flat numpy arrays over many texts at once. Equal
hashes are checked word by word, so that results are exact. Coverage is the share of a text's word characters
that lie inside n-grams which the same text has had before; the same is measured for lines.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.llm.common import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW, MAX_WINDOW_PERCENT = 8, 30
#: Most that n-grams seen before may cover of the word characters, by length in words.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE, MAX_LINE_CHAR_SHARE = 0.30, 0.20

_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, dup_line_share double, dup_line_char_share double, "
    + ", ".join(f"dup_{n}gram_share double" for n in MAX_NGRAM_SHARE)
)


def _repeats(keys: np.ndarray, at: np.ndarray, words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-grams that begin at ``at``: which occur again in their text, and which occurred before in it."""
    order = np.argsort(keys, kind="stable")
    sorted_at, sorted_keys = at[order], keys[order]

    def same(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        equal = doc[left] == doc[right]
        for j in range(n):
            equal &= words[left + j] == words[right + j]
        return equal

    alike = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
    real = same(sorted_at[alike], sorted_at[alike + 1])
    if not real.all():  # two n-grams share a hash: sort by the words themselves
        order = np.lexsort([at, *(words[at + j] for j in range(n)), doc[at]])
        sorted_at = at[order]
        alike = np.arange(len(at) - 1)
        real = same(sorted_at[:-1], sorted_at[1:])
    alike = alike[real]
    again, before = np.zeros(len(at), bool), np.zeros(len(at), bool)
    again[order[alike]] = True
    again[order[alike + 1]] = True
    before[order[alike + 1]] = True
    return again, before


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for each text."""
    known: dict[str, int] = {}
    found = [WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    total = int(counts.sum())
    words = np.fromiter((known.setdefault(w, len(known)) for ws in found for w in ws), np.int64, total)
    sizes = np.fromiter(map(len, known), np.int64, len(known))[words] if total else np.zeros(0, np.int64)
    del found
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    left = ends[doc] - np.arange(total)  # words from here to the end of the text

    def per_text(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[ends] - upto[ends - counts]

    word_chars = per_text(sizes)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _SPREAD
    mixed ^= mixed >> np.uint64(32)
    rolling = doc.astype(np.uint64) * _BASE
    shares: dict[int, np.ndarray] = {}
    repeat_words = np.zeros(len(texts), np.int64)
    at, length = np.arange(total), 0
    safe = np.maximum(word_chars, 1)
    for n in sorted({*MAX_NGRAM_SHARE, WINDOW}):
        at = at[left[at] >= n]
        while length < n:  # the hash of n words from that of n - 1
            rolling[: total - length] = rolling[: total - length] * _BASE + mixed[length:]
            length += 1
        again, before = _repeats(rolling[at], at, words, doc, n)
        if n in MAX_NGRAM_SHARE:
            shares[n] = per_text(np.where(_covered(at[before], n, total), sizes, 0)) / safe
        if n == WINDOW:
            repeat_words = per_text(_covered(at[again], n, total).astype(np.int64))
        at = at[again]  # a longer n-gram that repeats begins with a shorter one that does

    lines = np.zeros((4, len(texts)), np.int64)  # lines with a word, repeated ones, characters of each
    for i, text in enumerate(texts):
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(BLANK):
                lines[0, i] += 1
                lines[2, i] += len(line)
                if line in seen:
                    lines[1, i] += 1
                    lines[3, i] += len(line)
                seen.add(line)
    line_share = lines[1] / np.maximum(lines[0], 1)
    line_char_share = lines[3] / np.maximum(lines[2], 1)
    base_failed = (counts < MIN_WORDS) | (100 * repeat_words > MAX_WINDOW_PERCENT * counts)
    kept = ~base_failed & (line_share <= MAX_LINE_SHARE) & (line_char_share <= MAX_LINE_CHAR_SHARE)
    for n, most in MAX_NGRAM_SHARE.items():
        kept &= shares[n] <= most
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[1],
        "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": kept,
        "dup_line_share": line_share, "dup_line_char_share": line_char_share,
    } | {f"dup_{n}gram_share": shares[n] for n in MAX_NGRAM_SHARE}


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdicts of SCHEMA, for each row of docs.

    Words are runs of characters other than space and U+0009 to U+000D. n_repeat_words counts words in windows of
    eight words that the text has twice or more, the first occurrence included; the shares dup_*gram_share count
    only characters in n-grams seen before. A text fails the base rules with fewer than 20 words, or with more
    than 30 % of its words in repeated windows; it is kept if it doesn't, and no share exceeds its limit.
    A null text has no words, like an empty one. Rows are independent: repeated rows give repeated results, other
    columns are ignored, an empty table gives an empty result, and long texts are measured whole.
    """
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in slices(texts):
                columns = measure(texts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), *map(pa.array, columns.values())], ["doc_id", *columns]
                )

    return rows.mapInArrow(run, schema)
