"""Byte-pair merges over a word-count table: counts of pairs are kept up by what each merge changes, and several merges
are made in one round.

The most frequent pairs are looked at in order. A pair that has no symbol in common with the ones before it is neither
made nor broken by their merges, and pairs that these make are no more frequent than the pairs that they replace; so all
pairs down to the first that has a symbol in common, and more frequent than this one, are the next merges, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import alnum_tokens
from textmill.operators.lineage import forget, stored

END = "_"
#: Pairs that are looked at in a round, and so the most merges of one.
LOOK = 64
#: Rounds after which the changes of counts are added up.
ADD_UP = 8


def word_symbols(docs: DataFrame, text: str = "text") -> DataFrame:
    """(symbols, n): the characters of each distinct word and an end mark, with the word's count."""
    words = docs.select(F.explode(alnum_tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.concat(F.filter(F.split("w", ""), lambda c: c != ""), F.array(F.lit(END))).alias("symbols"), "n")


def _pairs(s: Column) -> Column:
    return F.arrays_zip(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))).alias("a"), F.slice(s, F.lit(2), F.size(s)).alias("b"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): adjacent symbols, weighted by the words' counts."""
    return words.select(F.explode(_pairs(F.col("symbols"))).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def merge_pairs(symbols: Column, pairs: list[tuple[str, str]]) -> Column:
    """Every occurrence of a pair becomes one symbol, from left to right without overlap; no symbol is in two pairs."""
    behind = F.create_map(*(F.lit(x) for a, b in pairs for x in (a, b)))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & F.coalesce(F.element_at(behind, last) == x, F.lit(False))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(symbols, F.array().cast("array<string>"), step)


def merge_pair(symbols: Column, a: str, b: str) -> Column:
    return merge_pairs(symbols, [(a, b)])


def next_merges(best: list[tuple[str, str, int]], known: set[str]) -> list[tuple[str, str, int]]:
    """How many of the most frequent pairs, given in order, can be merged at once. known: all symbols there are; a merge that
    makes one of them again is the last of its round, as it adds to the counts of that symbol's pairs."""
    made: list[tuple[str, str, int]] = []
    used: set[str] = set()
    stop = best[-1][2] if len(best) == LOOK else 0  # what comes behind the pairs that were looked at is not known
    for a, b, n in best:
        if used & {a, b}:
            stop = max(stop, n)
            break
        used |= {a, b}
        made.append((a, b, n))
        if a + b in known:
            break
    return [m for k, m in enumerate(made) if not k or m[2] > stop]


def train_bpe(words: DataFrame, merges: int) -> DataFrame:
    """(step, a, b, n) of the first merges: the most frequent pair, ties to the first in the alphabet.

    Each round rewrites the words that hold one of its pairs and sends what this changes in the counts, old pairs less and
    new pairs more. The driver holds the merges and the symbols. words: (symbols, n), each word once."""
    words = stored(words.select("symbols", F.col("n").cast("long").alias("n")))
    counts, changes = stored(pair_counts(words)), []
    known = {r.s for r in words.select(F.explode("symbols").alias("s")).distinct().toLocalIterator()}
    found: list[tuple[int, str, str, int]] = []
    while len(found) < merges:
        now = counts
        for change in changes:
            now = now.unionByName(change)
        if changes:
            now = now.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")
        if len(changes) == ADD_UP:
            fresh = stored(now)
            for old in (counts, *changes):
                forget(old)
            now, counts, changes = fresh, fresh, []
        best = [(r.a, r.b, r.n) for r in now.orderBy(F.desc("n"), "a", "b").limit(LOOK).collect()]
        if not best:
            break
        made = next_merges(best, known)[: merges - len(found)]
        found += [(len(found) + k, *m) for k, m in enumerate(made)]
        known |= {a + b for a, b, _ in made}
        if len(found) == merges:
            break
        # A word that holds both symbols of a pair is looked at; most of the others are passed on as they are.
        has = F.lit(False)
        for a, b, _ in made:
            has = has | (F.array_contains("symbols", a) & F.array_contains("symbols", b))
        step = stored(words.withColumn("old", F.when(has, F.col("symbols"))).withColumn("symbols", F.when(has, merge_pairs(F.col("symbols"), [m[:2] for m in made])).otherwise(F.col("symbols"))))
        touched = step.filter(F.col("old").isNotNull() & (F.size("old") > F.size("symbols")))
        less = touched.select(F.explode(_pairs(F.col("old"))).alias("p"), (-F.col("n")).alias("n"))
        more = touched.select(F.explode(_pairs(F.col("symbols"))).alias("p"), "n")
        changes.append(stored(less.unionByName(more).groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).filter("n <> 0")))
        forget(words)
        words = step.drop("old")
    return words.sparkSession.createDataFrame(found, "step int, a string, b string, n long")


def encode_word(word: Column, merges: list[tuple[str, str]]) -> Column:
    """A word's symbols after the merges in order."""
    symbols = F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit(END)))
    for a, b in merges:
        symbols = merge_pair(symbols, a, b)
    return symbols
