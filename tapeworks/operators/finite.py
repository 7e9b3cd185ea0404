"""Finite languages and relations as DataFrames: (upper, lower, weight) rows, set operations as joins.

For languages that are lists of words these are the algebra's operations at any size; Catalyst picks the joins. Equal pairs keep the smallest weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["upper", "lower"]


def relation(df: DataFrame, upper: str, lower: str | None = None, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("float") if weight else F.lit(0.0).cast("float")
    return least(df.select(F.col(upper).cast("string").alias("upper"), F.col(lower or upper).cast("string").alias("lower"), w.alias("weight")).where("upper is not null and lower is not null"))


def least(df: DataFrame) -> DataFrame:
    return df.groupBy(*PAIR).agg(F.min("weight").alias("weight"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return least(a.unionByName(b))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("weight", "_w"), PAIR).select(*PAIR, (F.col("weight") + F.col("_w")).cast("float").alias("weight"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, PAIR, "left_anti")


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("upper", F.col("lower").alias("_mid"), F.col("weight").alias("_w"))
    y = b.select(F.col("upper").alias("_mid"), "lower", "weight")
    return least(x.join(y, "_mid").select("upper", "lower", (F.col("_w") + F.col("weight")).cast("float").alias("weight")))


def priority_union(a: DataFrame, b: DataFrame, side: str = "upper") -> DataFrame:
    return a.unionByName(b.join(a.select(side).distinct(), side, "left_anti").select(a.columns))


def lenient_composition(a: DataFrame, b: DataFrame) -> DataFrame:
    return priority_union(compose(a, b), a)


def invert(a: DataFrame) -> DataFrame:
    return a.select(F.col("lower").alias("upper"), F.col("upper").alias("lower"), "weight")


def project(a: DataFrame, side: str = "upper") -> DataFrame:
    return least(a.select(F.col(side).alias("upper"), F.col(side).alias("lower"), "weight"))


def reverse(a: DataFrame) -> DataFrame:
    return a.select(F.reverse("upper").alias("upper"), F.reverse("lower").alias("lower"), "weight")


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of a with every pair of b: as many rows as the product has strings."""
    x = a.select(*(F.col(c).alias(f"_{c}") for c in a.columns))
    return least(x.join(b).select(F.concat("_upper", "upper").alias("upper"), F.concat("_lower", "lower").alias("lower"), (F.col("_weight") + F.col("weight")).cast("float").alias("weight")))


def cross_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every string of a with every string of b."""
    return least(a.select("upper", F.col("weight").alias("_w")).join(b.select("lower", "weight")).select("upper", "lower", (F.col("_w") + F.col("weight")).cast("float").alias("weight")))


def n_best(a: DataFrame, n: int) -> DataFrame:
    return a.orderBy("weight", "upper", "lower").limit(n)


def best_for_each(a: DataFrame, n: int, side: str = "upper") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(side).orderBy("weight", *PAIR))
    return a.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def substitute(a: DataFrame, names: dict[str, str], side: str = "both") -> DataFrame:
    """Renames symbols of one code point, all at once."""
    turn = lambda c: F.translate(c, "".join(names), "".join(names.values()))
    if any(len(s) != 1 for p in names.items() for s in p):
        raise ValueError("symbols of one code point only")
    return least(a.select((turn("upper") if side != "lower" else F.col("upper")).alias("upper"), (turn("lower") if side != "upper" else F.col("lower")).alias("lower"), "weight"))


def corrections_by_joins(words: DataFrame, word: str, lexicon: DataFrame, entry: str, distance: int = 1) -> DataFrame:
    """(word, output, weight): for each distinct word the lexicon's words at up to so many insertions, deletions and replacements, and how many.

    Two words at that distance have a common rest after as many deletions from either, so rests are what is joined; the distance itself is then computed. Words of n symbols
    have n rests at distance 1, n * n / 2 at distance 2.
    """

    def rests(df: DataFrame, name: str) -> DataFrame:
        now = every = df.select(F.col(name).alias(f"_{name}"), F.col(name).alias("_rest")).where(F.col(name).isNotNull()).distinct()
        for _ in range(distance):
            cut = F.transform(F.sequence(F.lit(1), F.length("_rest")), lambda k: F.concat(F.substring("_rest", F.lit(1), k - 1), F.substring("_rest", k + 1, F.length("_rest"))))
            now = now.where("_rest <> ''").select(f"_{name}", F.explode(cut).alias("_rest")).distinct()
            every = every.unionByName(now)
        return every.distinct()

    pairs = rests(words, word).join(rests(lexicon, entry).withColumnRenamed(f"_{entry}", "_entry"), "_rest").select(F.col(f"_{word}").alias(word), F.col("_entry").alias("output")).distinct()
    return pairs.withColumn("weight", F.levenshtein(word, "output").cast("float")).where(F.col("weight") <= distance)


def path_sizes(a: DataFrame) -> DataFrame:
    size = F.greatest(F.length("upper"), F.length("lower"))
    return a.groupBy(size.alias("size")).agg(F.count("*").alias("n"))


def of_extreme_length(a: DataFrame, longest: bool) -> DataFrame:
    size = F.greatest(F.length("upper"), F.length("lower"))
    top = a.withColumn("_size", size).agg((F.max if longest else F.min)("_size").alias("_top"))
    return a.withColumn("_size", size).join(F.broadcast(top), F.col("_size") == F.col("_top")).drop("_size", "_top")


def normalized(a: DataFrame, how: str = "log") -> DataFrame:
    """Weights as shares of their sum, or the shares' negative natural or decimal logarithms."""
    total = a.agg(F.sum(F.col("weight").cast("double")).alias("_total"))
    share = F.col("weight").cast("double") / F.col("_total")
    turn = {"norm": share, "log": -F.log(share), "log10": -F.log10(share)}[how]
    return a.join(F.broadcast(total)).select(*PAIR, turn.alias("weight"))


def reweighted(a: DataFrame, function: str = "id", factor: float = 1.0, addition: float = 0.0, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """addition + factor * function(weight), for weights within the bounds."""
    w = F.col("weight").cast("double")
    turn = {"id": w, "exp": F.exp(w), "log": F.log(w), "sqrt": F.sqrt(w), "abs": F.abs(w), "ceil": F.ceil(w).cast("double"), "floor": F.floor(w).cast("double")}[function]
    hit = F.lit(True)
    if lower is not None:
        hit = hit & (w >= lower)
    if upper is not None:
        hit = hit & (w <= upper)
    return a.withColumn("weight", F.when(hit, addition + factor * turn).otherwise(w))
