"""Fits: temperature, the noise floor of a calibration error, k-means with a Euclidean silhouette, logistic regression. Each is a bounded number of passes; only parameters come to the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.calibration import width_bin
from textmill.operators.lineage import stored


def fit_temperature(df: DataFrame, nll: callable, low: float = -3.0, high: float = 3.0, points: int = 25, rounds: int = 4) -> tuple[float, float]:
    """(tau, mean loss) at the least mean of nll(tau) over log tau in [low, high].

    Each round is one aggregation over a grid; the next one lies between the best point's neighbours. The mean log
    loss is convex in 1 / tau, so the least point of the grid bounds the minimum. nll: temperature -> Column."""
    best = (1.0, float("nan"))
    for _ in range(rounds):
        logs = np.linspace(low, high, points)
        row = df.agg(*(F.avg(nll(float(np.exp(x)))).alias(f"p{i}") for i, x in enumerate(logs))).first()
        if row[0] is None:
            return best
        i = int(np.argmin(row))
        best = (float(np.exp(logs[i])), float(row[i]))
        low, high = float(logs[max(0, i - 1)]), float(logs[min(points - 1, i + 1)])
    return best


def logit_nll(z: Column, label: Column):
    """The log loss of a binary logit at a temperature."""
    signed = F.when(label == 1, z).otherwise(-z)
    return lambda tau: F.log1p(F.exp(-signed / tau))


def noise_floor(df: DataFrame, m: int = 15, reps: int = 2000, seed: int = 7) -> DataFrame:
    """(mean, p95) of the calibration error of a forecaster that is right with probability conf.

    Equal confidences are counted, and each partition draws binomial outcomes for its counts and sums them by repetition
    and bin, so what is shuffled is reps times m sums a partition."""
    counts = df.groupBy("conf").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", width_bin(F.col("conf"), m))

    def run(frames):
        hits = np.zeros((reps, m))
        for frame in frames:
            for conf, n, b in zip(frame["conf"], frame["n"], frame["bin"], strict=True):
                draw = np.random.default_rng([seed, int(np.float64(conf).view(np.uint64))])
                hits[:, b] += draw.binomial(int(n), conf, reps)
        rep, b = np.nonzero(hits)
        yield pd.DataFrame({"rep": rep, "bin": b, "hits": hits[rep, b]})

    drawn = counts.select("conf", "n", "bin").mapInPandas(run, "rep int, bin int, hits double").groupBy("rep", "bin").agg(F.sum("hits").alias("hits"))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("conf")).alias("want"))
    every = bins.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    gap = F.abs(F.coalesce("hits", F.lit(0.0)) - F.col("want"))
    one = every.join(drawn, ["rep", "bin"], "left").groupBy("rep").agg((F.sum(gap) / F.sum("n")).alias("ece"))
    return one.agg(F.avg("ece").alias("mean"), F.percentile("ece", 0.95).alias("p95"))


#: Queries and rows that meet in one group, and of these the ones whose distances are in memory at once.
QUERIES, ROWS, TILE = 10_000, 100_000, (64, 2048)


def silhouettes(rows: DataFrame, asked: Column, labels: list[str], key: str = "key", vector: str = "vector") -> list[float | None]:
    """The mean Euclidean silhouette by each column of labels, of the rows where asked holds, a stated query set, against all rows.

    Every query meets every row once, whatever the labels: chunks of queries meet blocks of rows, both bounded, and a
    pair of these gives a sum of distances for each query and cluster. The clusters with their sizes, a few, pass through the driver."""
    each = rows.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), F.array(*labels).alias("_l"), asked.alias("_asked"))
    found = each.select(F.posexplode("_l").alias("no", "label")).groupBy("no", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("no", "label").collect()
    if not found:
        return [None] * len(labels)
    at = [{r.label: i for i, r in enumerate(found) if r.no == no} for no in range(len(labels))]
    n_rows = sum(r.n for r in found if r.no == 0)
    chunks, blocks = max(1, -(-each.filter("_asked").count() // QUERIES)), max(1, -(-n_rows // ROWS))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "_k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = each.filter("_asked").select("_k", "_v", "_l", deal(chunks, 1).alias("_q"), every(blocks).alias("_b"))
    right = each.select("_v", "_l", deal(blocks, 2).alias("_b"), every(chunks).alias("_q"))
    names = [f"_s{i}" for i in range(len(found))]
    own = [f"_o{no}" for no in range(len(labels))]

    def places(column) -> np.ndarray:
        return np.array([[at[no][x] for no, x in enumerate(row)] for row in column], np.int32)

    def meet(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(others):
            return pd.DataFrame({c: [] for c in ["_k", *own, *names]})
        x, y = (np.array(frame["_v"].tolist(), float).T.copy() for frame in (queries, others))
        member = np.zeros((len(others), len(names)))
        np.put_along_axis(member, places(others["_l"]), 1.0, axis=1)
        sums = np.zeros((len(queries), len(names)))
        for a in range(0, x.shape[1], TILE[0]):
            for b in range(0, y.shape[1], TILE[1]):
                total = 0.0
                for p, q in zip(x[:, a : a + TILE[0], None], y[:, None, b : b + TILE[1]], strict=True):
                    gap = p - q
                    gap *= gap
                    total += gap
                sums[a : a + TILE[0]] += np.sqrt(total, out=total) @ member[b : b + TILE[1]]
        out = pd.DataFrame(sums, columns=names)
        out.insert(0, "_k", queries["_k"].to_numpy())
        return out.assign(**dict(zip(own, places(queries["_l"]).T, strict=True)))[["_k", *own, *names]]

    kind = each.schema["_k"].dataType.simpleString()
    schema = ", ".join([f"_k {kind}", *(f"{c} int" for c in own), *(f"{c} double" for c in names)])
    met = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(meet, schema)
    sums = met.groupBy("_k", *own).agg(*(F.sum(c).alias(c) for c in names))
    values = []
    for no, o in enumerate(own):
        mine, none = [i for i, r in enumerate(found) if r.no == no], F.lit(None).cast("double")
        a = F.coalesce(none, *(F.when(F.col(o) == i, F.try_divide(F.col(names[i]), F.lit(found[i].n - 1))) for i in mine))
        b = F.least(none, none, *(F.when(F.col(o) != i, F.col(names[i]) / found[i].n) for i in mine))
        alone = F.col(o).isin(*(i for i in mine if found[i].n == 1)) if any(found[i].n == 1 for i in mine) else F.lit(False)
        values.append(F.avg(F.when(alone, 0.0).otherwise((b - a) / F.greatest(a, b))))
    return list(sums.agg(*values).first())


def silhouette(rows: DataFrame, asked: Column, key: str = "key", vector: str = "vector", label: str = "label") -> DataFrame:
    """(silhouette, n): ``silhouettes`` by one column of labels, and the number of queries."""
    n = rows.filter(asked).count()
    return rows.sparkSession.createDataFrame([(silhouettes(rows, asked, [label], key, vector)[0], n)], "silhouette double, n long")


def choose_k(rows: DataFrame, asked: Column, ks=range(3, 7), seed: int = 7, key: str = "key", vector: str = "vector") -> list[tuple[int, float]]:
    """(k, silhouette) for each k of k-means, the best first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # The points are made once; every fit and the silhouettes read them.
    points = stored(rows.select(key, vector)).withColumn("_f", array_to_vector(vector))
    labelled = points
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol=f"_label{k}", maxIter=30).fit(points)
        labelled = model.transform(labelled)
    found = zip(ks, silhouettes(labelled, asked, [f"_label{k}" for k in ks], key, vector), strict=True)
    return sorted(found, key=lambda x: (-(x[1] if x[1] is not None else -2.0), x[0]))


def name_segments(centroids: DataFrame) -> DataFrame:
    """(cluster, name) from standardised centroids (cluster, r, f, m): recency first, then value; repeats are numbered by
    falling value."""
    from pyspark.sql.window import Window

    value = (F.col("f") + F.col("m")) / 2
    recent = F.when(value > 0.75, "Champions").when(value > 0, "Loyal").otherwise("New or promising")
    name = F.when(F.col("r") < 0, recent).when(value > 0, "At risk").otherwise("Lost")
    rows = centroids.select("cluster", value.alias("_v"), name.alias("_n"))
    no = F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("_v"), "cluster"))
    rows = rows.withColumn("_no", no)
    return rows.select("cluster", F.when(F.col("_no") == 1, F.col("_n")).otherwise(F.concat("_n", F.lit(" ("), F.col("_no").cast("string"), F.lit(")"))).alias("name"))


def macro_f1s(rows: DataFrame, label: str, predicted: list[str]) -> list[float]:
    """The macro F1 of each column of predictions, from one pass: the mean over the classes that rows or predictions have, NaN without rows."""
    seen = [F.struct(F.lit(i).alias("no"), F.col(c).alias("y"), (F.col(label) == F.col(p)).cast("long").alias("hit")) for i, p in enumerate(predicted) for c in (label, p)]
    # A row counts once for its own class and once for the predicted one, so a class's hits are counted twice.
    each = rows.select(F.explode(F.array(*seen)).alias("_s")).groupBy("_s.no", "_s.y").agg((F.sum("_s.hit") / F.count(F.lit(1))).alias("f1"))
    found = {r.no: r.f1 for r in each.groupBy("no").agg(F.avg("f1").alias("f1")).collect()}
    return [found.get(i, float("nan")) for i in range(len(predicted))]


def logistic_regression(train: DataFrame, held: DataFrame, strengths=(0.01, 0.1, 1.0), text: str = "text", label: str = "label", dims: int = 1 << 16):
    """(model, strength, macro F1): multinomial logistic regression on TF-IDF with the ridge that is best on held.

    A text is read once: the weights and every fit read the kept hashed counts of train, and held is predicted by all fits
    in one pass."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StringIndexer

    words = PipelineModel([RegexTokenizer(inputCol=text, outputCol="_t", gaps=False, pattern="[a-z0-9]+"), HashingTF(inputCol="_t", outputCol="_tf", numFeatures=dims)])
    counts, held_counts = (words.transform(df.select(text, label)).select("_tf", label) for df in (train, held))
    # On disk, in the partitions of the texts: the memory is for the blocks that each fit keeps.
    counts.persist(StorageLevel.DISK_ONLY)
    try:
        steps = [StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip"), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_x")]
        weights = Pipeline(stages=steps).fit(counts)
        rows, predicted = weights.transform(counts).select("_x", "_y"), weights.transform(held_counts).select("_x", "_y")
        models = [LogisticRegression(featuresCol="_x", labelCol="_y", regParam=c, maxIter=50).fit(rows) for c in strengths]
        names = [f"_p{i}" for i in range(len(models))]
        for model, name in zip(models, names, strict=True):
            predicted = model.copy({model.predictionCol: name, model.rawPredictionCol: "", model.probabilityCol: ""}).transform(predicted)
        scores = macro_f1s(predicted, "_y", names)
    finally:
        counts.unpersist()
    best = max(range(len(models)), key=lambda i: scores[i])
    return (PipelineModel([*words.stages, *weights.stages]), models[best]), strengths[best], scores[best]
