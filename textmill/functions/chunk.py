"""The chunker as a table function: ``SELECT * FROM chunk(text, 128, 16)`` after ``register(spark)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_WORD = re.compile(r"\S+")


class Chunk:
    """Windows of ``size`` words that overlap by ``overlap``, with character offsets. A null or blank text has none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be less than the size")
        words = [m.span() for m in _WORD.finditer(text or "")]
        for no, first in enumerate(range(0, len(words), size - overlap)):
            last = min(first + size, len(words)) - 1
            start, stop = words[first][0], words[last][1]
            yield no, start, stop, text[start:stop]
            if last == len(words) - 1:
                break


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk", udtf(Chunk, returnType="no int, start int, stop int, chunk string"))
