"""Application of transducers and patterns to text columns.

Each function gives a column expression that Spark runs in Arrow batches. What a worker needs is compiled on the driver, sent once, and small: its size is the grammar's. Rows are
independent, so the same expressions work on streams. A null text gives null. Words met before in a batch are not searched again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType

from tapeworks.operators import tokens as T
from tapeworks.plans import algebra as A
from tapeworks.plans import lookup as L
from tapeworks.plans.fst import EPSILON, Fst, is_flag
from tapeworks.plans.pmatch import Matcher
from tapeworks.shared import bounded_batches

ANALYSES = "array<struct<weight:float,output:string>>"
LOCATIONS = "array<struct<start:int,length:int,input:string,output:string,tag:string,weight:float,parts:array<int>>>"


def _by_value(function: Callable, schema) -> Callable[[Column | str], Column]:
    """A column function that calls a plain function once for each distinct value of a batch. Batches are bounded by their bytes, as texts may be long."""

    @F.pandas_udf(schema)
    def run(values: pd.Series) -> pd.Series:
        memory: dict[str, object] = {}
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            if v not in memory:
                memory[v] = function(v)
            out.append(memory[v])
        return pd.Series(out, dtype=object)

    def column(c: Column | str) -> Column:
        if (spark := SparkSession.getActiveSession()) is not None:
            bounded_batches(spark)
        return run(c)

    return column


def joined(outputs: Sequence[str]) -> str:
    return "".join(s for s in outputs if s != EPSILON and not is_flag(s))


def _analyser(f: Fst, most: int | None = None, max_weight: float | None = None, obey_flags: bool = True, beam: float | None = None, **limits) -> Callable[[str], list[dict]]:
    c = L.compile_fst(f)

    def run(text: str) -> list[dict]:
        best: dict[str, float] = {}
        for w, out in L.lookup(c, text, obey_flags, None, max_weight=max_weight, **limits):
            s = joined(out)
            best[s] = min(w, best.get(s, float("inf")))
        found = sorted((w, s) for s, w in best.items())
        if beam is not None and found:
            found = [x for x in found if x[0] <= found[0][0] + beam]
        return [{"weight": w, "output": s} for w, s in found[:most]]

    return run


def analyses(f: Fst, **options) -> Callable[[Column | str], Column]:
    """The results for each text, as a set ordered by weight, then output; an unknown word has an empty array. ``most``, ``max_weight`` and ``beam`` keep the lightest."""
    return _by_value(_analyser(f, **options), ANALYSES)


def first_analyses(fsts: Sequence[Fst], **options) -> Callable[[Column | str], Column]:
    """The results of the first of several transducers that has any."""
    runs = [_analyser(f, **options) for f in fsts]
    return _by_value(lambda text: next(filter(None, (run(text) for run in runs)), []), ANALYSES)


def generations(f: Fst, **options) -> Callable[[Column | str], Column]:
    """The inputs that give a text: lookup in the inverse."""
    return analyses(A.invert(f), **options)


def tags(f: Fst, diacritics: bool, seconds: float | None = None) -> Callable[[Column | str], Column]:
    """Each result's flags only, or all but its flags, joined; in order of weight and symbols, equal strings kept."""
    c = L.compile_fst(f)
    return _by_value(lambda text: L.lookup_tags(c, text, diacritics, seconds), ArrayType(StringType()))


def accepts(f: Fst) -> Callable[[Column | str], Column]:
    c = L.compile_fst(f)
    return _by_value(lambda text: L.accepts(c, text), BooleanType())


def infinitely_ambiguous(f: Fst) -> Callable[[Column | str], Column]:
    c = L.compile_fst(f)
    return _by_value(lambda text: L.is_infinitely_ambiguous_for(c, text), BooleanType())


def lookup(df: DataFrame, text: str, f: Fst, keep_misses: bool = False, **options) -> DataFrame:
    """df with ``output`` and ``weight``, a row for each result; with keep_misses, one with nulls for a text without any."""
    bounded_batches(df.sparkSession)
    found = df.withColumn("_found", analyses(f, **options)(text))
    explode = F.explode_outer if keep_misses else F.explode
    return found.withColumn("_one", explode("_found")).select(*df.columns, F.col("_one.output").alias("output"), F.col("_one.weight").alias("weight"))


def lookup_distinct(df: DataFrame, text: str, f: Fst, **options) -> DataFrame:
    """lookup() that searches every distinct text once for all rows; for columns of words that come again and again."""
    words = lookup(df.select(text).where(F.col(text).isNotNull()).distinct().withColumnRenamed(text, "_word"), "_word", f, **options)
    return df.join(words, df[text] == words["_word"]).drop("_word")


def cascade(df: DataFrame, text: str, fsts: Sequence[Fst], how: str = "union", **options) -> DataFrame:
    """Several transducers: 'union' of their results, 'priority-union' (the first that has any), or 'composition' (each reads the one's before it)."""
    if how == "composition":
        out = df.withColumn("_now", F.col(text)).withColumn("_w", F.lit(0.0).cast("float"))
        for f in fsts:
            out = lookup(out, "_now", f, **options).withColumn("_w", (F.col("_w") + F.col("weight")).cast("float")).withColumn("_now", F.col("output")).drop("output", "weight")
        return out.select(*df.columns, F.col("_now").alias("output"), F.col("_w").alias("weight"))
    if how == "union":
        names = [f"_f{k}" for k in range(len(fsts))]
        staged = df.select("*", *(analyses(f, **options)(text).alias(n) for f, n in zip(fsts, names, strict=True)))
        merged = F.array_sort(F.array_distinct(F.concat(*names)))
    elif how == "priority-union":
        # one column for all, so that a text goes to the next transducer only if none before has any result
        staged, merged = df, first_analyses(fsts, **options)(text)
    else:
        raise ValueError(f"unknown cascade {how}")
    return staged.withColumn("_one", F.explode(merged)).select(*df.columns, F.col("_one.output").alias("output"), F.col("_one.weight").alias("weight"))


def within_beam(df: DataFrame, keys: Sequence[str], beam: float, weight: str = "weight") -> DataFrame:
    """Rows at most beam heavier than their key's lightest."""
    least = F.min(weight).over(Window.partitionBy(*keys))
    return df.withColumn("_least", least).where(F.col(weight) <= F.col("_least") + beam).drop("_least")


def weight_classes(df: DataFrame, keys: Sequence[str], n: int, weight: str = "weight") -> DataFrame:
    """Rows of each key's n lightest weights."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(weight))
    return df.withColumn("_class", rank).where(F.col("_class") <= n).drop("_class")


def corrections(lexicon: Fst, errors: Fst, most: int | None = 5, max_weight: float | None = None) -> Callable[[Column | str], Column]:
    """Spelling corrections, lightest first."""
    a, b = L.compile_fst(lexicon), L.compile_fst(errors)
    return _by_value(lambda word: [{"weight": w, "output": s} for w, s in L.correct(a, b, word, most, max_weight)], ANALYSES)


def matched(m: Matcher) -> Callable[[Column | str], Column]:
    """The text with its matches marked, deleted or alone, by the script's options."""
    return _by_value(m.match, StringType())


def tag_counts(m: Matcher) -> Callable[[Column | str], Column]:
    from pyspark.sql.types import IntegerType

    return _by_value(m.tag_counts, MapType(StringType(), IntegerType()))


def counters(m: Matcher) -> Callable[[Column | str], Column]:
    from pyspark.sql.types import IntegerType

    return _by_value(m.counters, MapType(StringType(), IntegerType()))


def _row(loc) -> dict:
    return {"start": loc.start, "length": loc.length, "input": loc.input, "output": loc.output, "tag": loc.tag, "weight": loc.weight, "parts": list(loc.parts)}


def locations(m: Matcher, gaps: bool = True) -> Callable[[Column | str], Column]:
    """All locations, in order of the text; what doesn't match is one location for each gap."""
    return _by_value(lambda text: [_row(x) for group in m.locate(text, gaps) for x in group], LOCATIONS)


def locate(df: DataFrame, text: str, m: Matcher, gaps: bool = False) -> DataFrame:
    """df with a row for each location: start, length, input, output, tag, weight, parts. Texts without any character that a match can begin with are
    left out before Python sees them, unless gaps are asked for."""
    import re

    firsts = m.firsts()
    if not gaps and firsts:
        df = df.where(F.col(text).rlike("[" + "".join(re.escape(c) for c in sorted(firsts)) + "]"))
    names = ("start", "length", "input", "output", "tag", "weight", "parts")
    found = df.withColumn("_one", F.explode(locations(m, gaps)(text)))
    return found.select(*df.columns, *(F.col(f"_one.{n}").alias(n) for n in names))


def tokenized(m: Matcher, form: str = "tokenize", **options) -> Callable[[Column | str], Column]:
    """The text's tokens in one of the output forms."""
    printer = T.Printer(form, **options)
    return _by_value(lambda text: printer.text(m, text), StringType())


def running_text(f: Fst, **options) -> Callable[[Column | str], Column]:
    """Running text with its words analysed, or its analyses generated; the options are those of a Stream."""
    from tapeworks.operators.running_text import Stream

    return _by_value(Stream(f, **options).text, StringType())
