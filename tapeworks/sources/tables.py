"""Transducers and word lists between files, DataFrames and values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans.fst import FormatError, Fst
from tapeworks.shared import Scratch, joinable, small
from tapeworks.sources import formats

ARCS = "fst_id string, src int, dst int, isym string, osym string, weight float"
FINALS = "fst_id string, state int, weight float"
ALPHABET = "fst_id string, sym string"
META = "fst_id string, name string, semiring string, props map<string,string>"


def to_tables(spark: SparkSession, fsts: dict[str, Fst]) -> dict[str, DataFrame]:
    """The arcs, finals, alphabet and properties of transducers by id."""
    arcs = [(k, s, d, i, o, float(w)) for k, f in fsts.items() for s, i, o, w, d in f]
    finals = [(k, s, float(w)) for k, f in fsts.items() for s, w in f.finals.items()]
    alphabet = [(k, s) for k, f in fsts.items() for s in sorted(f.alphabet)]
    meta = [(k, f.name, f.semiring, f.props) for k, f in fsts.items()]
    return {"arcs": spark.createDataFrame(arcs, ARCS), "finals": spark.createDataFrame(finals, FINALS), "alphabet": spark.createDataFrame(alphabet, ALPHABET), "fsts": spark.createDataFrame(meta, META)}


def word_tables(words: DataFrame, word: str, weight: str | None = None, fst_id: str = "0") -> dict[str, DataFrame]:
    """The tables of a transducer that accepts a column's distinct texts, one state for each beginning: to_tables() of a word list of any size, which the driver never sees.

    Nulls are left out; equal texts have the least of their weights. States are numbered without gaps, the empty beginning is 0.
    """
    scratch = Scratch(words.sparkSession, "words")
    texts = words.select(F.col(word).cast("string").alias("text"), (F.col(weight) if weight else F.lit(0.0)).cast("float").alias("weight")).where("text is not null")
    texts = scratch.keep(texts.groupBy("text").agg(F.min("weight").alias("weight")), "texts")
    begins = texts.where("text <> ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda k: F.substring("text", F.lit(1), k))).alias("begin")).distinct()
    states = scratch.keep(scratch.numbered(begins, "state").withColumn("state", F.col("state") + 1), "states")
    last = F.substring("begin", F.length("begin"), F.lit(1))
    begun = joinable(states)
    before = begun.select(F.col("begin").alias("_before"), F.col("state").alias("_src"))
    arcs = states.withColumn("_to", F.substring("begin", F.lit(1), F.length("begin") - 1)).join(before, F.col("_to") == F.col("_before"), "left")
    arcs = scratch.keep(arcs.select(F.lit(fst_id).alias("fst_id"), F.coalesce("_src", F.lit(0)).alias("src"), F.col("state").alias("dst"), last.alias("isym"), last.alias("osym"), F.lit(0.0).cast("float").alias("weight")), "arcs")
    finals = texts.join(begun, F.col("text") == F.col("begin"), "left").where("state is not null or text = ''")
    finals = finals.select(F.lit(fst_id).alias("fst_id"), F.coalesce("state", F.lit(0)).alias("state"), "weight")
    return {"arcs": arcs, "finals": finals, "alphabet": arcs.select("fst_id", F.col("isym").alias("sym")).distinct()}


def from_tables(tables: dict[str, DataFrame], fst_id: str) -> Fst:
    """The transducer of an id. A grammar is small enough for the driver; texts never come here."""
    f = Fst()
    mine = F.col("fst_id") == fst_id
    for r in tables["arcs"].where(mine).orderBy("src", "isym", "osym", "dst", "weight").collect():
        f.add_arc(r.src, r.dst, r.isym, r.osym, r.weight)
    for r in tables["finals"].where(mine).collect():
        f.set_final(r.state, r.weight)
    f.alphabet |= {r.sym for r in tables["alphabet"].where(mine).collect()}
    for r in tables.get("fsts", tables["arcs"].limit(0)).where(mine).collect() if "fsts" in tables else []:
        f.name, f.semiring, f.props = r.name, r.semiring, dict(r.props or {})
    return f


def save(spark: SparkSession, fsts: dict[str, Fst], path: str) -> None:
    """Parquet tables below a path."""
    for name, df in to_tables(spark, fsts).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, fst_id: str | None = None) -> dict[str, Fst]:
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("arcs", "finals", "alphabet", "fsts")}
    ids = [fst_id] if fst_id else [r[0] for r in tables["fsts"].select("fst_id").distinct().collect()]
    return {k: from_tables(tables, k) for k in ids}


def read_att_table(lines: DataFrame, line: str = "value", order: str | None = None) -> dict[str, DataFrame]:
    """Arc and final tables of table lines, in column expressions. Without an order column the lines are one transducer; with one, ``--`` lines separate them."""
    from pyspark.sql import Window

    text = lines.where(F.trim(line) != "")
    if order:
        # the separators before a line say which transducer it is in; separators are few, lines may be many
        marks = text.where(F.col(line).startswith("--")).select(F.col(order).alias("_at"))
        marks = marks.select("_at", F.lead("_at").over(Window.orderBy("_at")).alias("_next"), F.row_number().over(Window.orderBy("_at")).alias("_n"))
        text = text.join(small(marks), (F.col(order) > F.col("_at")) & (F.col("_next").isNull() | (F.col(order) < F.col("_next"))), "left")
        text = text.where(~F.col(line).startswith("--")).withColumn("fst_id", F.coalesce(F.col("_n"), F.lit(0)).cast("string"))
    else:
        text = text.withColumn("fst_id", F.lit("0"))
    parts = F.split(line, r"\t|(?<!\t) +(?!\t)")
    text = text.withColumn("_p", parts)
    get = lambda k: F.get("_p", F.lit(k))
    label = lambda c: F.when(c == "@0@", "@_EPSILON_SYMBOL_@").when(c == "@_SPACE_@", " ").when(c == "@_TAB_@", "\t").when(c == "@_COLON_@", ":").otherwise(c)
    arcs = text.where(F.size("_p") >= 4).select("fst_id", get(0).cast("long").alias("src"), get(1).cast("long").alias("dst"), label(get(2)).alias("isym"), label(get(3)).alias("osym"), F.coalesce(get(4).cast("float"), F.lit(0.0).cast("float")).alias("weight"))
    finals = text.where(F.size("_p") <= 2).select("fst_id", get(0).cast("long").alias("state"), F.coalesce(get(1).cast("float"), F.lit(0.0).cast("float")).alias("weight"))
    return {"arcs": arcs, "finals": finals}


def write_att_table(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """(fst_id, line) of table lines."""
    label = lambda c: F.when(F.col(c) == "@_EPSILON_SYMBOL_@", "@0@").when(F.col(c) == " ", "@_SPACE_@").when(F.col(c) == "\t", "@_TAB_@").otherwise(F.col(c))
    a = arcs.select("fst_id", F.concat_ws("\t", "src", "dst", label("isym"), label("osym"), F.format_string("%.6f", F.col("weight"))).alias("line"))
    return a.unionByName(finals.select("fst_id", F.concat_ws("\t", "state", F.format_string("%.6f", F.col("weight"))).alias("line")))


def read_file(spark: SparkSession, path: str, kind: str | None = None) -> list[Fst]:
    """Transducers of a file of any store that Spark reads; the kind is told by the suffix or the first bytes."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if not rows:
        raise FormatError(f"nothing at {path}")
    data = bytes(rows[0].content)
    if kind is None:
        kind = "lookup" if formats.is_container(data) else "prolog" if data.lstrip().startswith(b"network(") else "words" if path.endswith((".strings", ".words")) else "att"
    if kind == "lookup":
        return formats.read_archive(data)
    text = data.decode("utf-8")
    if kind == "prolog":
        return formats.read_prolog(text)
    if kind == "words":
        return [formats.read_words(text.splitlines())]
    if kind == "pairs":
        return [formats.read_pairs(text.splitlines())]
    if kind == "spaced":
        return [formats.read_spaced(text.splitlines())]
    if kind == "att":
        return formats.read_att(text)
    raise FormatError(f"unknown kind {kind}")


def words_frame(spark: SparkSession, words: Iterable[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(list(words), "word string, weight float")
