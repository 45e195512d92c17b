"""Exact Jaccard join of documents on word shingles: size-aware, heavy and light.

Two sets with Jaccard similarity of at least t share, in any global order of shingles, at least k of the first
``n - ceil(t n) + k`` shingles of each. Light (small) sets enumerate all subsets of two shingles of that prefix and
meet in equal subsets; heavy (large) sets scan inverted lists of single prefix shingles, in which the light sets
near to them in size stand too. The boundary between light and heavy is where the summed cost of enumeration and of
scanning, computed from the distribution of set sizes and the list lengths seen, is least. The global order puts
shingles that are frequent in the corpus last, the most frequent ones at the end, so that passages that many documents
share seldom stand in a prefix; the order only decides how many candidates there are, never which links are found.

A posting carries the set's size and the key's place in the order. Two sets meet as candidates only where sizes and
places leave room for a link: under the first shingle that both have, they always do. Identical sets are one class from
the start. A list of up to SHORT_LIST classes gives all such pairs. In a longer list each class is first compared with
one pivot, the class in which the key stands first and which therefore has the fewest rarer shingles. If the list then
holds several components, its members are compared with a pivot of each other component, and at last with all members
of other components that sizes and places leave open: no link between components is lost.

Texts that are alike but don't link would meet in all pairs there, so the members of such lists carry a parity sketch: a
bit for each residue of the hashes, flipped by each shingle. Two sketches differ in no more bits than the sets do in
shingles, so pairs whose sketches differ in more than a link allows are left out before anything is compared; this
is exact, as it can only leave in pairs that don't link. It tells sets of up to some PARITY_BITS shingles apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, join_groups, key_bitmap, materialize, rows_that_may_hold, rows_without
from textmill.llm.components import extended
from textmill.llm.shingles import shingle_sets

#: Similarity as a fraction of whole numbers: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles seen more often than FREQUENT stand last in the order; at most MOST_FREQUENT of them are broadcast (16 MB).
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Lists of up to so many classes give all their pairs.
SHORT_LIST = 16
#: Cost of comparing a candidate pair, where that of writing a posting is 1.
PAIR_COST = 4.0
#: Largest light size that the cost model considers.
MOST_LIGHT = 256
#: Shingles counted together in a task before those seen once are dropped.
COUNT_TOGETHER = 4_000_000
#: Members of a list that meet others of it in one task.
MEMBERS = 1000
#: Partners of one set that are compared in one task; more are dealt over several.
PARTNERS = 512
#: Bits of each hash that sets are compared by at first.
SKETCH = 24
#: Bits of a parity sketch.
PARITY_BITS = 1024
#: Log2 of the 64-bit words of the bitmap of classes to compare (2 MB); if it fills, more sets than needed are built.
BITMAP = 18

_C = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.uint64(1 << 63)


def needed(n: int) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def linked(shared, a, b):
    """Whether sets of a and b shingles that share so many link."""
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def room(n_a, at_a, n_b, at_b):
    """Whether two sets may link that share the shingle at these places, if they share none before: the rest of the
    smaller remainder would be the intersection. For numbers, arrays and columns alike."""
    rest_a, rest_b = n_a - at_a, n_b - at_b
    fits = lambda rest: (DENOMINATOR + NUMERATOR) * rest >= NUMERATOR * (n_a + n_b)
    near = (DENOMINATOR * n_a >= NUMERATOR * n_b) & (DENOMINATOR * n_b >= NUMERATOR * n_a)
    return near & fits(rest_a) & fits(rest_b)


def parity(values: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as int64 words."""
    odd = np.bincount((values & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near(n_a: Column, parity_a: Column, n_b: Column, parity_b: Column) -> Column:
    """Whether two sets may link by their parity sketches: linked sets of a and b shingles differ in no more than
    (a + b) (1 - t) / (1 + t) of them."""
    differ = sum((F.bit_count(parity_a[k].bitwiseXOR(parity_b[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
    return (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (n_a + n_b)


def largest_partner(n: Column, at: Column) -> Column:
    """The size of the largest set that may link to a set of n under the key at this place."""
    return F.floor((DENOMINATOR + NUMERATOR) * (n - at) / NUMERATOR).cast("long") - n


def digest(values: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a set."""
    raw = hashlib.blake2b(values.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Order:
    """The global order of shingles: those of a table of frequent ones last, by rank; the others before, by hash."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray):
        self.frequent, self.rank = frequent, rank

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return values
        at = np.minimum(np.searchsorted(self.frequent, values), len(self.frequent) - 1)
        often = self.frequent[at] == values
        late = values[often]
        return np.concatenate([values[~often], late[np.argsort(self.rank[at[often]], kind="stable")]])


NO_ORDER = Order(np.zeros(0, np.uint64), np.zeros(0, np.int32))


def keys_of(values: np.ndarray, order: Order, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set meets others, and their places: subsets of two if it is light, single shingles if it
    is heavy or nearly so. A subset's place is one before that of its second shingle, as the first is shared too."""
    n = len(values)
    if n <= 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)  # such sets link only to identical ones
    spare = n - needed(n)
    first = order(values)[: spare + 2]
    keys, places = [], []
    if n <= boundary:
        i, j = np.triu_indices(len(first), 1)
        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        keys.append(_mix(low * _C + high) | _FAR)
        places.append(j - 1)
    if n > boundary or DENOMINATOR * n >= NUMERATOR * (boundary + 1):
        keys.append(first[: spare + 1] & ~_FAR)
        places.append(np.arange(spare + 1))
    return np.concatenate(keys), np.concatenate(places)


def choose_boundary(sizes: dict[int, int], met: float) -> int:
    """The largest light size, so that enumerating and scanning cost least; met: other classes met in a list by a
    posting on average. sizes: number of sets by size, where larger ones than MOST_LIGHT may count as one more."""
    scan = 1 + PAIR_COST * met
    best, cheapest = 2, None
    for boundary in range(2, MOST_LIGHT + 1):
        cost = 0.0
        for n, count in sizes.items():
            if n <= 2:
                continue
            spare = n - needed(n)
            if n <= boundary:
                cost += count * (spare + 2) * (spare + 1) / 2
            if n > boundary or DENOMINATOR * n >= NUMERATOR * (boundary + 1):
                cost += count * (spare + 1) * scan
        if cheapest is None or cost < cheapest:
            best, cheapest = boundary, cost
    return best


# -- passes over the texts


def _longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _describe(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node, node2, parity) of every row, where copies in a task but the first lack the parity sketch, and
    (shingle, seen) of shingles that a task saw twice."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "node", "node2", "parity", "shingle", "seen"]
    schema = f"doc_id {kind}, n long, node long, node2 long, parity array<long>, shingle long, seen long"

    def run(batches):
        met, held, size = set(), [], 0

        def repeated(kind):
            values, seen = np.unique(np.concatenate(held), return_counts=True)
            values, seen = values[seen > 1], seen[seen > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(values), kind), none, none, none, pa.nulls(len(values), pa.list_(pa.int64())), _longs(values.view(np.int64)), _longs(seen)], names)

        for batch in batches:
            ids = batch.column(0)
            for start, stop, sets in shingle_sets(batch.column(1)):
                nodes = [digest(s, seed) if len(s) else (None, None) for s in sets]
                bits: list = [None] * len(sets)
                for k, (s, node) in enumerate(zip(sets, nodes, strict=True)):
                    if len(s) > 2 and node not in met:  # copies count once
                        met.add(node)
                        held.append(s)
                        size += len(s)
                        bits[k] = parity(s)
                none = pa.nulls(len(sets), pa.int64())
                own = [ids.slice(start, stop - start), _longs([len(s) for s in sets]), _longs([a for a, _ in nodes]), _longs([b for _, b in nodes]), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, none, none], names)
                if size > COUNT_TOGETHER:
                    yield repeated(ids.type)
                    held, size = [], 0
        if held:
            yield repeated(ids.type)

    found = materialize(docs.mapInArrow(run, schema), "described")
    rows = found.filter("n IS NOT NULL").select("doc_id", "n", "node", "node2", "parity")
    return rows, found.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))


def _postings(docs: DataFrame, order, boundary: int, seed: int) -> DataFrame:
    """(key, node, n, at): each set once per task."""

    def run(batches):
        met = set()
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(1)):
                out: tuple[list, ...] = ([], [], [], [])
                for s in sets:
                    if len(s) <= 2:
                        continue
                    node = digest(s, seed)[0]
                    if node not in met:
                        met.add(node)
                        keys, places = keys_of(s, order.value, boundary)
                        for o, x in zip(out, (keys.view(np.int64), np.full(len(keys), node, np.int64), np.full(len(keys), len(s), np.int32), places.astype(np.int32)), strict=True):
                            o.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["key", "node", "n", "at"])

    return docs.mapInArrow(run, "key long, node long, n int, at int")


def _near_pairs(keys: np.ndarray, nodes: np.ndarray, n: np.ndarray, at: np.ndarray, short: int) -> tuple[list, list, np.ndarray]:
    """From whole lists sorted by key: the candidate pairs (a, b) of short lists, and the rows that are in long ones."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(start, len(keys)))
    of = np.repeat(length, length)
    some = np.flatnonzero((of > 1) & (of <= short))
    a, b = [], []
    for step in range(1, short):
        i = some[: len(some) - step]
        j = some[step:]
        same = keys[i] == keys[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        fit = room(n[i], at[i], n[j], at[j])
        a.append(np.minimum(nodes[i], nodes[j])[fit])
        b.append(np.maximum(nodes[i], nodes[j])[fit])
    return a, b, np.flatnonzero(of > short)


def _lists(postings: DataFrame, parts: int) -> DataFrame:
    """From postings sorted by key, in a stream of bounded memory: (key null, a, b) for each candidate pair in a short
    list, and (key, a, n, at) for each member of a long one."""
    names, short = ["key", "a", "b", "n", "at"], SHORT_LIST

    def run(batches):
        def pairs(a, b):
            code = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
            none = pa.nulls(code.shape[1], pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(code[0]), pa.array(code[1]), none.cast(pa.int32()), none.cast(pa.int32())], names)

        def members(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(len(rows[0]), pa.int64()), pa.array(rows[2]), pa.array(rows[3])], names)

        rest, long = None, None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            new = np.ones(len(now[0]), bool)  # the same class from several tasks counts once
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
            now = [x[new] for x in now]
            if long is not None:
                stop = int(np.searchsorted(now[0], long, "right"))
                if stop:
                    yield members([x[:stop] for x in now])
                now = [x[stop:] for x in now]
            if not len(now[0]):
                rest = None
                continue
            last = int(np.searchsorted(now[0], now[0][-1], "left"))
            long, rest = None, [x[last:] for x in now]
            if len(rest[0]) > short:
                yield members(rest)
                long, rest = int(rest[0][0]), None
            a, b, far = _near_pairs(*(x[:last] for x in now), short) if last else ([], [], [])
            if len(far):
                yield members([x[far] for x in now])
            if a:
                yield pairs(a, b)
        if rest is not None:
            a, b, _ = _near_pairs(*rest, short)
            if a:
                yield pairs(a, b)

    dealt = postings.repartition(parts, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key long, a long, b long, n int, at int")


# -- comparisons


def sketch(values: np.ndarray) -> bytes:
    """The first SKETCH bits of a set's hashes: differences of neighbours, a plane for each of their three bytes, the last
    of which is nearly empty and compresses."""
    steps = np.diff((values >> np.uint64(64 - SKETCH)).astype("<u4"), prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def from_sketch(data) -> np.ndarray:
    low, middle, high = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.uint32)
    return np.cumsum(low | middle << np.uint32(8) | high << np.uint32(16), dtype=np.uint32)


def most_chance(n_a: int, n_b: int) -> int:
    """A number of equal beginnings of different hashes that two sets exceed with a probability below that of a clash of
    two 64-bit hashes (1e-18)."""
    mean = n_a * n_b / 2**SKETCH
    if mean > 0.5:
        return int(mean + 9 * mean**0.5 + 14)
    most, chance = 0, mean
    while chance > 1e-18:
        most += 1
        chance *= mean / (most + 1)
    return most


def _meet(pairs: DataFrame, docs: DataFrame, seed: int, whole: bool) -> DataFrame:
    """(a, b, shared, n_a, n_b, sure) of the pairs (a, b) that link, or that may do so where sure is false.

    Sets are sent as sketches, or as whole hashes, when all rows are sure. Only sets of classes in a pair are built, by
    a bitmap of their nodes; each is sent once, and once more for every pair. Sets with many partners are copied, so that
    no task compares more than some PARTNERS with one."""
    ends = F.explode(F.array("a", "b"))
    word = F.shiftrightunsigned("node", 64 - BITMAP)
    bits = pairs.select(ends.alias("node")).groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 AS int))")).alias("bits"))
    found = bits.toArrow()
    bitmap = np.zeros(1 << BITMAP, np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches):
        met = set()
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(1)):
                out: tuple[list, list] = ([], [])
                for s in sets:
                    if len(s) <= 2:
                        continue
                    node = digest(s, seed)[0]
                    at = node & ((1 << 64) - 1)
                    if node not in met and int(wanted.value[at >> (64 - BITMAP)]) >> (at & 63) & 1:
                        met.add(node)
                        out[0].append(node)
                        out[1].append(s.tobytes() if whole else sketch(s))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([_longs(out[0]), pa.array(out[1], pa.binary())], ["node", "values"])

    # The side with more partners first: it is sent to the others, in copies if they are many.
    uses = pairs.select(ends.alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    use_of = lambda side: uses.select(F.col("node").alias(side), F.col("uses").alias(f"uses_{side}"))
    turned = pairs.select("a", "b").join(use_of("a"), "a").join(use_of("b"), "b")
    more = F.col("uses_a") >= F.col("uses_b")
    turned = turned.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("q"), F.greatest("uses_a", "uses_b").alias("uses"))
    copies = F.floor(F.col("uses") / PARTNERS).cast("int")
    turned = turned.select("p", "q", F.pmod(F.xxhash64("q"), copies + 1).cast("int").alias("copy"))
    sets = docs.mapInArrow(build, "node long, values binary").groupBy("node").agg(F.first("values").alias("values"))
    sets = materialize(sets.join(uses, "node"), "sets")
    left = sets.select(F.col("node").alias("p"), F.explode(F.sequence(F.lit(0), copies)).alias("copy"), F.col("values").alias("set_p"))
    right = sets.select(F.col("node").alias("q"), F.col("values").alias("set_q"))

    def run(batches):
        for batch in batches:
            out = []
            for p, q, x, y in zip(*batch.columns, strict=True):
                if whole:
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared, spare = len(np.intersect1d(x, y, assume_unique=True)), 0
                else:
                    x, y = from_sketch(x.as_buffer()), from_sketch(y.as_buffer())
                    shared, spare = common(x, y), most_chance(len(x), len(y))
                if linked(shared, len(x), len(y)):
                    p, q, sure = p.as_py(), q.as_py(), linked(shared - spare, len(x), len(y))
                    out.append((p, q, shared, len(x), len(y), sure) if p < q else (q, p, shared, len(y), len(x), sure))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*(_longs(c) for c in columns[:5]), pa.array(columns[5], pa.bool_())], ["a", "b", "shared", "n_a", "n_b", "sure"])

    joined = turned.join(left, ["p", "copy"]).join(right, "q").select("p", "q", "set_p", "set_q")
    links = materialize(joined.mapInArrow(run, "a long, b long, shared long, n_a long, n_b long, sure boolean"), "links")
    discard(sets)
    wanted.unpersist()
    return links


def common(x: np.ndarray, y: np.ndarray) -> int:
    """At least as many as the hashes that two sets share, from their sorted beginnings."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _compare(pairs: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """The pairs (a, b) that link: by sketches where these decide, by all hashes where they don't."""
    found = _meet(pairs, docs, seed, whole=False)
    doubt = found.filter("NOT sure").select("a", "b")
    sure = found.filter("sure").select("a", "b")
    return sure if doubt.isEmpty() else sure.unionByName(_meet(doubt, docs, seed, whole=True).select("a", "b"))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _pair(a: str = "a", b: str = "b") -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sketched(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members with the parity sketches of their classes."""
    return members.join(classes.select("node", "parity"), "node")


def _open(members: DataFrame, components: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """members (key, node, n, at, size) with their component and parity sketch, of the lists that hold several."""
    labelled = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    several = materialize(several.filter("_lo < _hi").select("key", "_n"), "several")
    return _sketched(join_groups(labelled, several, ["key"], "_n", total).select("key", "node", "n", "at", "size", "component"), classes)


def _against(members: DataFrame, others: DataFrame) -> DataFrame:
    """The candidate pairs of members with others of the same list and another component, by sizes, places and, if both
    have them, parity sketches. Long lists are dealt over several tasks."""
    deals = F.floor(F.col("size") / MEMBERS).cast("int")
    has = ["parity"] if "parity" in members.columns and "parity" in others.columns else []
    other = others.select("key", F.explode(F.sequence(F.lit(0), deals)).alias("_deal"), *(F.col(c).alias(f"_{c}") for c in ["node", "n", "at", "component", *has]))
    dealt = members.withColumn("_deal", F.pmod(F.xxhash64("node"), deals + 1).cast("int"))
    fits = (F.col("component") != F.col("_component")) & room(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"))
    if has:
        fits = fits & near(F.col("n"), F.col("parity"), F.col("_n"), F.col("_parity"))
    return dealt.join(other, ["key", "_deal"]).filter(fits).select(*_pair("node", "_node")).distinct()


def _candidates(docs: DataFrame, parts: int | None):
    """(rows, classes, pairs, members, seed): the descriptions of rows, the classes of equal sets, the candidate pairs
    of short lists, and the members of long lists that may have a partner there."""
    seed = 0
    while True:  # a clash of two different sets in 64 bits calls for another salt
        rows, counts = _describe(docs, seed)
        classes = materialize(rows.filter("n > 0").groupBy("node", "node2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parity", ignorenulls=True).alias("parity")), "classes")
        if classes.groupBy("node").count().filter("count > 1").isEmpty():
            break
        seed += 1
    session = docs.sparkSession
    often = counts.filter(F.col("seen") > FREQUENT).orderBy(F.desc("seen"), "shingle").limit(MOST_FREQUENT).toArrow()
    shingle, seen = often["shingle"].to_numpy().view(np.uint64), often["seen"].to_numpy()
    rank = np.empty(len(seen), np.int32)
    rank[np.lexsort((shingle, seen))] = np.arange(len(seen), dtype=np.int32)
    by_hash = np.argsort(shingle)
    order = Order(shingle[by_hash], rank[by_hash])
    sizes = {r.n: r["count"] for r in classes.groupBy(F.least("n", F.lit(MOST_LIGHT + 1)).alias("n")).count().collect()}
    total = sum(n * c for n, c in sizes.items())
    met = counts.filter(F.col("seen") <= FREQUENT).agg(F.sum(F.col("seen") * (F.col("seen") - 1))).first()[0] or 0
    boundary = choose_boundary(sizes, met / max(1, total))

    parts = parts or max(int(session.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions() // 2)
    sent = session.sparkContext.broadcast(order)
    lists = materialize(_lists(_postings(docs, sent, boundary, seed), parts), "lists")
    sent.unpersist()
    pairs = lists.filter("key IS NULL").select("a", "b").distinct()
    members = lists.filter("key IS NOT NULL").select("key", F.col("a").alias("node"), "n", "at")
    most = largest_partner(F.col("n"), F.col("at"))
    spans = members.groupBy("key").agg(F.min("n").alias("_least"), F.max(most).alias("_most"), F.count(F.lit(1)).alias("size"))
    spans = materialize(spans.filter("_least <= _most"), "spans")
    members = join_groups(members, spans, ["key"], "size", members.count())
    members = materialize(members.filter((F.col("n") <= F.col("_most")) & (most >= F.col("_least"))).drop("_least", "_most"), "members")
    discard(spans)
    return rows, classes, pairs, members, lists, seed


def _labels(links: DataFrame) -> DataFrame:
    """(node, component): a label that only linked nodes share, and that most of a component's nodes do: the least node
    within two links."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("_other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("_other")))
    label = both.groupBy("node").agg(F.min("_other").alias("_m")).select("node", F.least("node", "_m").alias("component"))
    near = both.join(label.withColumnsRenamed({"node": "_other", "component": "_c"}), "_other").groupBy("node").agg(F.min("_c").alias("_c"))
    return label.join(near, "node").select("node", F.least("component", "_c").alias("component"))


def _joined(links: DataFrame) -> DataFrame:
    """(node, component) of all linked classes, whole components: labels first, then the few edges between these."""
    return materialize(extended(materialize(_labels(links), "labels"), _edges(links)), "components")


def _components(docs: DataFrame, classes: DataFrame, pairs: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """(node, component) of all classes with a link."""
    first = lambda *more: F.min_by(F.struct("node", "n", "at", "size", "component", *more), F.struct("at", F.xxhash64("node"), "node")).alias("_p")
    total = members.count()
    alone = members.withColumn("component", F.col("node"))
    star = _against(alone, alone.groupBy("key").agg(first()).select("key", "_p.*"))
    done = materialize(pairs.unionByName(star).distinct(), "pairs")
    links = _compare(done, docs, seed)
    components = _joined(links)
    # With one pivot of each other component in the list first, then with whoever is still in another one. Components
    # are whole each time, as members of one that looked like two would be compared in pairs.
    for whole in (False, True):
        left = materialize(_open(members, components, classes, total), "open")
        others = left if whole else left.groupBy("key", "component").agg(first("parity")).select("key", "_p.*")
        todo = materialize(_against(left, others).join(done, ["a", "b"], "left_anti"), "todo")
        if not todo.isEmpty():
            links = links.unionByName(_compare(todo, docs, seed))
            done = done.unionByName(todo)
            components = _joined(links)
        discard(left)
    return components


def jaccard_components(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the smallest doc_id that links reach.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z in lower case; a set holds the distinct
    runs of five words, or all words as one if there are fewer. Two rows link if 100 * intersection >= 75 * union.
    A null or empty text, or one without words, has no shingle, links to nothing and is its own component. Rows
    repeated with equal text are one class and share a component. A row with null doc_id links as any other; it never
    names a component, and a component of such rows alone has a null component_id. Other columns are ignored, an empty
    table gives an empty result, and long texts are read whole. parts: partitions of the inverted lists, by default one
    for every two of the input.
    """
    docs = docs.select("doc_id", "text")
    rows, classes, pairs, members, lists, seed = _candidates(docs, parts)
    components = _components(docs, classes, pairs, members, seed)
    named = classes.select("node", "rep").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(names, "component").select("node", "component_id"), "named")
    for old in (classes, lists, members, components):
        discard(old)
    whole = rows.filter("n > 0").select("doc_id", "n", "node").join(named, "node", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def jaccard_links(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, membership): every link between different sets, also those inside a component.

    links: a, b (doc_ids of the two classes' representatives, the smallest of each class), n_a, n_b, shared.
    membership: doc_id, class_id (the representative; null for a row without shingles), n_shingles for each row of docs.
    Nulls, empty texts and repeats are as in jaccard_components. All pairs that sizes and places leave open are compared,
    so the work grows with the number of links inside groups; jaccard_components spares that."""
    docs = docs.select("doc_id", "text")
    rows, classes, pairs, members, _, seed = _candidates(docs, parts)
    alone = _sketched(members.withColumn("component", F.col("node")), classes)
    links = _meet(materialize(pairs.unionByName(_against(alone, alone)).distinct(), "pairs"), docs, seed, whole=True)
    rep = lambda side: classes.select(F.col("node").alias(f"_{side}"), F.col("rep").alias(side))
    named = links.withColumnsRenamed({"a": "_a", "b": "_b"}).join(rep("a"), "_a").join(rep("b"), "_b").select("a", "b", "n_a", "n_b", "shared")
    owned = rows.join(classes.select("node", F.col("rep").alias("class_id")), "node", "left")
    return named, owned.select("doc_id", "class_id", F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the one with the smallest doc_id.

    Rows that repeat this doc_id stay together. Rows without a doc_id can't be told apart: they stay. Rows without
    words link to nothing and stay. An empty table gives an empty result. Only rows whose doc_id may be one that goes are
    joined, told by a bitmap of bounded size."""
    found = jaccard_components(docs).filter("doc_id <> component_id")
    gone = materialize(found.select(F.col("doc_id").alias("_textmill_id")).distinct(), "gone")
    bitmap = materialize(key_bitmap(gone.select(F.xxhash64("_textmill_id").alias("_textmill_key")), "_textmill_key"), "touched")
    # Rows without a doc_id are in no bitmap of ids but by chance, and join with nothing.
    keyed = docs.withColumn("_textmill_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")))
    others = rows_without(keyed, "_textmill_key", bitmap).drop("_textmill_key")
    touched = rows_that_may_hold(keyed, "_textmill_key", bitmap).drop("_textmill_key")
    return others.unionByName(touched.join(gone, F.col("doc_id") == F.col("_textmill_id"), "left_anti"))
