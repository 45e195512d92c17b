"""Extension points: a judge of claims, and an encoder that is loaded once per worker.

User code runs in Arrow batches inside the workers; what is built around it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X


def judge_udf(judge: Callable[[str, list[str]], float]):
    """A function of (claim, sources) as a function of columns; a null claim has no verdict."""

    @F.pandas_udf(T.DoubleType())
    def run(claim: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else float(judge(c, list(s) if s is not None else [])) for c, s in zip(claim, sources, strict=True)], dtype="float64")

    return run


def faithfulness(answers: DataFrame, judge, key: str = "answer_id") -> DataFrame:
    """(key, claims, supported, least): the share of an answer's claims that a judge of columns supports from 0.5, and the lowest
    verdict; nulls for an answer without claims. answers: (key, answer, sources array)."""
    claims = answers.select(key, "sources", F.explode_outer(X.split_claims(F.col("answer"))).alias("claim"))
    judged = claims.select(key, "claim", judge(F.col("claim"), F.col("sources")).alias("p"))
    return judged.groupBy(key).agg(F.count("claim").alias("claims"), F.avg((F.col("p") >= 0.5).cast("int")).alias("supported"), F.min("p").alias("least"))


def embed_udf(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """An encoder of texts as a function of a column: load is called once per worker task and returns the encoder. A null text
    counts as empty."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in encode([t or "" for t in texts])])

    return run
