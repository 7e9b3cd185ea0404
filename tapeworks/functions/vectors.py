"""Vector arithmetic on array columns, and the nearest words of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _zip(a: Column | str, b: Column | str, function) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: function(x.cast("double"), y.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(_zip(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def plus(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def minus(a: Column | str, b: Column | str) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def times(a: Column | str, factor: float) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double") * F.lit(factor))


def neighbours(words: DataFrame, word: str = "word", vector: str = "embedding"):
    """What a pattern script's Like and Unlike ask: (wanted words, how many, nearest or farthest) to a list of words."""
    return lambda wanted, n, nearest: [r[0] for r in like(words, wanted, n, word, vector, unlike=not nearest).collect()]


def like(words: DataFrame, wanted: list, n: int = 10, word: str = "word", vector: str = "embedding", unlike: bool = False) -> DataFrame:
    """The n words nearest to the sum of the wanted words' vectors by cosine (unlike: farthest), with ``score``; the wanted ones aren't among them.

    One pass over the words with the target as a literal, and a top-n that each task cuts first; the wanted words are few and looked up first.
    """
    found = words.where(F.col(word).isin(wanted)).orderBy(word).select(vector).limit(len(wanted)).collect()
    if not found:
        return words.limit(0).select(word, F.lit(0.0).alias("score"))
    total = [sum(float(r[0][k]) for r in found) for k in range(len(found[0][0]))]
    score = cosine(vector, F.array(*(F.lit(x) for x in total)))
    rest = words.where(~F.col(word).isin(wanted)).select(word, score.alias("score"))
    return rest.orderBy(F.col("score").asc() if unlike else F.col("score").desc(), word).limit(n)


def read_text(spark: SparkSession, path: str, word: str = "word", vector: str = "embedding") -> DataFrame:
    """(word, vector) of a text file of vectors: a word and its components in a line, blanks or tabs between. A first line of two numbers, how many words and components, isn't a word."""
    line = F.split(F.trim(F.regexp_replace("value", "[ \\t]+", " ")), " ")
    rows = spark.read.text(path).select(line.alias("p")).where(F.size("p") > 1).where(~((F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]+$") & F.col("p")[1].rlike("^[0-9]+$")))
    return rows.select(F.col("p")[0].alias(word), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias(vector))


def read_binary(spark: SparkSession, path: str, word: str = "word", vector: str = "embedding") -> DataFrame:
    """(word, vector) of binary files of vectors: a line of how many words and components, then for each word its name, a blank, and its components as little-endian 32-bit numbers. A file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                end = data.index(b"\n")
                n, dim = (int(x) for x in data[:end].split())
                at, names, vectors = end + 1, [], []
                for _ in range(n):
                    blank = data.index(b" ", at)
                    names.append(data[at:blank].lstrip(b"\n").decode("utf-8", "replace"))
                    at = blank + 1 + 4 * dim
                    vectors.append(np.frombuffer(data, "<f4", dim, blank + 1))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=[word, vector])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"{word} string, {vector} array<float>")
