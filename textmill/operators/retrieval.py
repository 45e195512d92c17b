"""Chunks, sections, spans and second stages of retrieval."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.lineage import stored
from textmill.operators.terms import bm25, top_k

_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_WORD = re.compile(r"\S+")


def words_and_sentences(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, stop) of each word, and the number of the first word of each sentence, with the number of words at the end."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    return words, [0, *(bisect_left(starts, m.start()) for m in _END.finditer(text)), len(words)]


def chunk_words(firsts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of ``sentence_chunks`` as (first word, word after the last), from the first words of sentences."""
    units = [(k, min(k + size, q)) for p, q in zip(firsts, firsts[1:], strict=False) for k in range(p, q, size)]
    out, held, start, stop = [], 0, 0, 0  # the words from start to stop are held, those of the units from held on
    for no, (p, q) in enumerate(units):
        if stop > start and q - start > size:
            out.append((start, stop))
            held = next((k for k in range(held, no) if p - units[k][0] <= overlap and q - units[k][0] <= size), no)
            start = units[held][0]
        stop = q
    if stop > start:
        out.append((start, stop))
    return out


def sentence_chunks(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, stop, words) of chunks of whole sentences with at most size words; the next one begins with the last
    sentences that fit in overlap words. A sentence longer than size is cut into windows of size words."""
    words, firsts = words_and_sentences(text)
    return [(words[a][0], words[z - 1][1], z - a) for a, z in chunk_words(firsts, size, overlap)]


#: Characters of texts that a task turns into chunks before it hands them on.
PIECE = 500_000


def pieces(frames, text: str, most: int = PIECE):
    """The frames' rows in their order, in frames of at most ``most`` characters, or of one longer text: what a task makes of
    texts is many times their size, and a batch may have 10,000."""
    for frame in frames:
        at, held = 0, 0
        for i, body in enumerate(frame[text]):
            held += len(body or "")
            if held > most and i > at:
                yield frame.iloc[at:i]
                at, held = i, len(body or "")
        if at < len(frame):
            yield frame.iloc[at:]


def build_index(docs: DataFrame, size: int = 128, overlap: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, no, start, stop, n_words, chunk) of sentence-aware chunks: chunk_id is ``doc:NNNN``, start and
    stop are 0-based character offsets. A null or blank text has none. One pass, nothing moves."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for frame in pieces(frames, text):
            rows = [(k, no, *c, t[c[0] : c[1]]) for k, t in zip(frame[key], frame[text], strict=True) for no, c in enumerate(sentence_chunks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "no", "start", "stop", "n_words", "chunk"])

    chunks = docs.select(key, text).mapInPandas(run, f"{key} {kind}, no int, start int, stop int, n_words int, chunk string")
    return chunks.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit(":"), F.lpad(F.col("no").cast("string"), 4, "0")))


def headings(docs: DataFrame, pattern: str, key: str, text: str) -> DataFrame:
    """(key, start, section) of each heading: pattern has one group before the heading's text and one for it. Texts are cut at
    line ends, so a place is the summed length of the lines before it."""
    lines = docs.select(key, F.split(text, "\n").alias("_l"))
    lengths = F.transform("_l", lambda x: F.length(x) + 1)
    first = F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.regexp_extract(x, pattern, 1).alias("section")))
    found = lines.select(key, lengths.alias("_n"), F.explode(F.filter(first, lambda x: x["section"] != "")).alias("h"))
    start = F.aggregate(F.slice("_n", F.lit(1), F.col("h.i")), F.lit(0), lambda a, x: a + x)
    return found.select(key, start.alias("start"), F.trim("h.section").alias("section"))


def section_of(spans: DataFrame, heads: DataFrame, key: str, start: str = "start") -> DataFrame:
    """spans with section: the last heading at or before their start, or an empty text. An as-of join by one union and one
    running window for each document."""
    rows = spans.withColumns({"_at": F.col(start), "_s": F.lit(None).cast("string"), "_own": F.lit(1)})
    marks = heads.select(key, F.col("start").alias("_at"), F.col("section").alias("_s"), F.lit(0).alias("_own"))
    order = Window.partitionBy(key).orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("section", F.coalesce(F.last("_s", ignorenulls=True).over(order), F.lit("")))
    return both.filter("_own = 1").drop("_at", "_s", "_own")


#: Items that are looked for in one pass, and their characters where they aren't of one or two words.
FEW_ITEMS, ITEM_CHARS = 10_000, 1_000_000


def containing(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str, words: int = 6) -> DataFrame:
    """(item_key, doc_key, item, text) of documents that hold an item's text as it is.

    As many items as one automaton holds are looked for by it in one pass over the documents. Of more, those of one or two words are,
    and for the others words decide: the item's bounds can't cut its inner words, so these stand in the document as they are. Candidates share a run of inner
    words, or in items too short for one the inner word that the fewest documents have. Items of one or two words have
    none: an automaton looks for FEW_ITEMS of them in one pass over the documents, and for more in as many passes as it takes.
    Empty items are in no document."""
    parts = F.split("text", r"\s+")
    asked = items.filter(F.length("text") > 0).select(item_key, F.col("text").alias("item"), parts.alias("_k"))
    few = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("chars")).first()
    if few.n <= FEW_ITEMS and few.chars <= ITEM_CHARS:
        return _holding(asked.select(item_key, "item"), docs, item_key, doc_key)
    long = asked.filter(F.size("_k") >= words + 2).select(item_key, "item", F.array_join(F.slice("_k", 2, words), " ").alias("_g"))
    middle = asked.filter((F.size("_k") < words + 2) & (F.size("_k") > 2)).select(item_key, "item", F.explode(F.array_distinct(F.slice("_k", F.lit(2), F.size("_k") - 2))).alias("_g"))
    rows = docs.select(doc_key, "text", parts.alias("_k"))
    count = F.greatest(F.size("_k") - words + 1, F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    grams = rows.select(doc_key, F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("_k", i, words), " ")))).alias("_g"))
    near = grams.join(long.select(item_key, "_g"), "_g").select(item_key, doc_key)
    held = rows.select(doc_key, F.explode(F.array_distinct("_k")).alias("_g")).join(middle.select("_g").distinct(), "_g", "left_semi")
    uses = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = middle.join(uses, "_g", "left").groupBy(item_key, "item").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r")).filter("_r._n > 0")
    near = near.unionByName(held.join(rarest.select(item_key, F.col("_r._g").alias("_g")), "_g").select(item_key, doc_key)).distinct()
    found = near.join(asked.select(item_key, "item"), item_key).join(docs.select(doc_key, "text"), doc_key).filter(F.contains("text", "item"))
    found = found.select(item_key, doc_key, "item", "text")
    short = asked.filter(F.size("_k") <= 2).select(item_key, "item")
    passes = -(-short.count() // FEW_ITEMS)
    for no in range(passes):
        part = short.filter(F.pmod(F.xxhash64(item_key, "item"), F.lit(passes)) == no)
        found = found.unionByName(_holding(part, docs, item_key, doc_key))
    return found


def _holding(items: DataFrame, docs: DataFrame, item_key: str, doc_key: str) -> DataFrame:
    """containing for a number of items that fits into one automaton."""
    named: dict[str, list] = {}
    for r in items.collect():
        named.setdefault(r["item"], []).append(r[item_key])
    shared = docs.sparkSession.sparkContext.broadcast(named)
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def run(frames):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for item in shared.value:
            automaton.add_word(item, item)
        automaton.make_automaton()
        for frame in frames:
            out = []
            for doc, text in zip(frame[doc_key], frame["text"], strict=True):
                for item in {found for _, found in automaton.iter(text)} if text and shared.value else ():
                    out += [(i, doc, item, text) for i in shared.value[item]]
            yield pd.DataFrame(out, columns=[item_key, doc_key, "item", "text"])

    return docs.select(doc_key, "text").mapInPandas(run, f"{item_key} {kind(items, item_key)}, {doc_key} {kind(docs, doc_key)}, item string, text string")


def occurrences(text: Column, part: Column) -> Column:
    """How often part is in text, not overlapping."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def quote_errors(quotes: DataFrame, pages: DataFrame, quote_key: str, page_key: str) -> DataFrame:
    """(quote_key, page_key, n) of quotes that don't occur exactly once in their page; n is null without that page."""
    joined = quotes.join(pages.select(page_key, F.col("text").alias("_page")), page_key, "left")
    n = F.when(F.col("_page").isNotNull(), occurrences(F.col("_page"), F.col("quote")))
    return joined.select(quote_key, page_key, n.alias("n")).filter(~F.col("n").eqNullSafe(F.lit(1)))


def longest_shared_run(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: int = 4) -> DataFrame:
    """(left_key, right_key, run): the most tokens in a row that both have, where these are at least ``least``.

    Both: (key, tokens array). Runs of least tokens meet by equality; on one diagonal, places that follow each other
    are one run, so a run's length is its number of meetings plus least - 1."""
    def grams(rows: DataFrame, key: str, place: str) -> DataFrame:
        n = F.greatest(F.size("tokens") - least + 1, F.lit(0))
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        each = F.transform(starts, lambda i: F.struct(i.alias("p"), F.array_join(F.slice("tokens", i, least), " ").alias("g")))
        return rows.select(key, F.explode(each).alias("e")).select(key, F.col("e.p").alias(place), F.col("e.g").alias("_g"))

    met = grams(left, left_key, "_p").join(grams(right, right_key, "_q"), "_g")
    order = Window.partitionBy(left_key, right_key, "_d").orderBy("_p")
    island = met.withColumn("_d", F.col("_p") - F.col("_q")).withColumn("_i", F.col("_p") - F.row_number().over(order))
    runs = island.groupBy(left_key, right_key, "_d", "_i").agg((F.count(F.lit(1)) + least - 1).alias("run"))
    return runs.groupBy(left_key, right_key).agg(F.max("run").alias("run"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], cell: int = 512) -> DataFrame:
    """Pairs of spans (start, stop, and other columns with distinct names) of the same keys that share a character.

    Spans meet in cells of so many characters, and a pair counts in the cell where it begins, so a long page is dealt
    over many tasks."""
    def cells(rows: DataFrame, side: str) -> DataFrame:
        named = rows.withColumnsRenamed({"start": f"start_{side}", "stop": f"stop_{side}"}).filter(F.col(f"stop_{side}") > F.col(f"start_{side}"))
        at = lambda c: F.floor(c / cell)
        return named.withColumn("_cell", F.explode(F.sequence(at(F.col(f"start_{side}")), at(F.col(f"stop_{side}") - 1))))

    met = cells(a, "a").join(cells(b, "b"), [*keys, "_cell"])
    begin = F.greatest("start_a", "start_b")
    return met.filter((F.least("stop_a", "stop_b") > begin) & (F.floor(begin / cell) == F.col("_cell"))).drop("_cell")


def agreement(author: DataFrame, checker: DataFrame) -> DataFrame:
    """(agreeing, answerable): items of the author for which a span of the checker's overlaps one of theirs.

    Both: (item_id, page_id, start, stop)."""
    met = overlaps(author, checker, ["item_id", "page_id"]).select("item_id").distinct().withColumn("_hit", F.lit(1))
    items = author.select("item_id").distinct().join(met, "item_id", "left")
    return items.agg(F.count("_hit").alias("agreeing"), F.count(F.lit(1)).alias("answerable"))


def rerank(ranked: DataFrame, score: str, n: int, by: str = "query_id") -> DataFrame:
    """The n best rows of each query by a new score, ties in the order of rank; place counts from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "rank")
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def local_bm25(candidates: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates (query_id, doc_id, rank) with local: BM25 whose statistics are those of each query's candidates alone."""
    pairs = F.struct("query_id", "doc_id")
    near = terms.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")  # the other documents' terms aren't counted
    own = candidates.select("query_id", "doc_id").join(near, "doc_id")
    lengths = own.groupBy("query_id", "doc_id").agg(F.sum("tf").alias("n_terms"))
    totals = lengths.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("n_terms").alias("_avg"))
    hits = own.join(queries, ["query_id", "term"])
    df = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_df"))
    k1, b = 1.5, 0.75
    joined = hits.join(df, ["query_id", "term"]).join(lengths, ["query_id", "doc_id"]).join(totals, "query_id")
    idf = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("_avg")))
    scored = joined.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("local"))
    return candidates.join(scored, ["query_id", "doc_id"], "left").withColumn("local", F.coalesce("local", F.lit(0.0)))


def two_stage(terms: DataFrame, queries: DataFrame, lengths: DataFrame, candidates: int, n: int) -> DataFrame:
    """(query_id, doc_id, rank, local, place): BM25's best candidates, put in a new order by local_bm25."""
    scored = bm25(terms, queries, lengths).withColumn("score", F.round("score", 6))
    first = stored(top_k(scored, candidates, "query_id").select("query_id", "doc_id", "rank"))
    return rerank(local_bm25(first, terms, queries).withColumn("local", F.round("local", 6)), "local", n)


def fuse(rankings: list[DataFrame], base: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): reciprocal rank fusion; ties in the order of first appearance, list by list."""
    both = None
    for no, ranking in enumerate(rankings):
        rows = ranking.select("query_id", "doc_id", "rank", F.lit(no).alias("_list"))
        both = rows if both is None else both.unionByName(rows)
    found = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (base + F.col("rank"))), 9).alias("score"), F.min(F.struct("_list", "rank")).alias("_seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_seen")
    return found.withColumn("rank", F.row_number().over(order)).drop("_seen")


def rerank_with(ranked: DataFrame, texts: DataFrame, scorer: Callable[[str, list[str]], list[float]], n: int) -> DataFrame:
    """rerank by a scorer of (query, texts) that runs once for each query's candidates in a worker; where it fails, the
    first stage's order stays. ranked: (query_id, query, doc_id, rank), a bounded number of rows for each query; texts: (doc_id, text)."""
    joined = stored(ranked.select("query_id", "query", "doc_id", "rank")).join(texts.select("doc_id", "text"), "doc_id")
    names = ["query_id", "doc_id", "rank"]
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names) + ", model_score double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        try:
            scores = [float(x) for x in scorer(group["query"].iloc[0], group["text"].tolist())]
        except Exception:  # noqa: BLE001 - a scorer is the user's; without it the first stage decides
            scores = [-float(r) for r in group["rank"]]
        return group[names].assign(model_score=scores)

    return rerank(joined.groupBy("query_id").applyInPandas(run, schema), "model_score", n)


def same_up_to_ties(a: DataFrame, b: DataFrame, k: int, tolerance: float = 1e-6, by: str = "query_id") -> DataFrame:
    """(by, same): whether b's first k are a's but for orders inside runs of a's scores within the tolerance.

    a: (by, id, rank, score), longer than k where ties cross it; b: (by, id, rank)."""
    order = Window.partitionBy(by).orderBy("rank")
    gap = F.coalesce((F.abs(F.col("score") - F.lag("score").over(order)) > tolerance).cast("int"), F.lit(0))
    blocks = a.withColumn("_new", gap).withColumn("_block", F.sum("_new").over(order)).select(by, "id", "rank", "_block")
    size = blocks.groupBy(by).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_want"))
    place = blocks.filter(F.col("rank") <= k).select(by, "rank", "_block")
    member = blocks.select(by, "id", F.col("_block").alias("_own"))
    got = b.filter(F.col("rank") <= k).select(by, "id", "rank").join(place, [by, "rank"], "left").join(member, [by, "id"], "left")
    counts = got.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("id").alias("_d"), F.bool_and(F.coalesce(F.col("_block") == F.col("_own"), F.lit(False))).alias("_ok"))
    return size.join(counts, by, "left").select(by, F.coalesce(F.col("_ok") & (F.col("_n") == F.col("_want")) & (F.col("_d") == F.col("_want")), F.lit(False)).alias("same"))


def budget_choice(settings: DataFrame, budget: int, most: int = 10) -> DataFrame:
    """The setting (size, k, recall, mrr) with k = min(most, budget div size): the best recall, then MRR, then the smallest size."""
    fits = settings.filter(F.col("k") == F.least(F.lit(most), F.floor(F.lit(budget) / F.col("size"))))
    return fits.agg(F.max_by(F.struct("size", "k", "recall", "mrr"), F.struct("recall", "mrr", -F.col("size"))).alias("b")).select("b.*")
