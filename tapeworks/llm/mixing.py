"""Mixing sources to target weights by a low-discrepancy source schedule, in built-in DataFrame operations only.

A source's documents, shuffled by a hash, form a stream of words that is cut into blocks of equally many words and repeats endlessly. A source's target says how many of its
blocks the mix takes, the last one cut. Slot n of the schedule has the golden-ratio point n * 0.618... mod 1; the sources' cumulative numbers of blocks map it to a source. A slot's rank among its
source's slots says which block, in which pass of the stream, it takes; slots of a source that has all its blocks stay empty, and blocks that no slot is left for follow the last one, source after source.
The words that fall to a document are the sum over its blocks, and its first slot says where in the mix it comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.ranks import running
from tapeworks.llm.scratch import Scratch

WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block; slots of a chunk that is ranked by itself; parts of the unit interval by which slots and sources are joined.
BLOCK, CHUNK, PARTS = 128, 1 << 16, 4096
GOLDEN, UNIT = 2654435769, 1 << 32
SEED = "mix"


def n_words(text: str) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    t = F.col(text)
    pieces = F.size(F.split(t, "[\\x20\\x09-\\x0D]+", -1))
    edges = F.when(t.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0) + F.when(t.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(pieces - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row for each source: few rows, so that one task may order them.

    All sizes are shared by weight; a target above most times its source's size stops there, and the excess goes to the others by weight. Ordered by size over
    weight the sources that stop come first, so one pass finds the level that the others share.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    index = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (index + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left.cast("double") / share.cast("double"))
    rows = rows.withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    rows = rows.withColumn("shared", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"])
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * F.col("shared"), F.col("cap").cast("double")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def schedule(spark: SparkSession, shares: DataFrame, slots: int) -> DataFrame:
    """(source, slot, rank) from (source, needs): the source of each slot, in proportion to needs, and its rank among the source's slots, from 0."""
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, total = F.coalesce(F.sum("needs").over(before), F.lit(0)), F.sum("needs").over(whole)
    spans = shares.where("needs > 0").select("source", F.floor(lo / total * UNIT).alias("lo"), F.lead(F.floor(lo / total * UNIT), 1, UNIT).over(Window.orderBy(F.col("source").asc_nulls_last())).alias("hi"))
    spans = spans.where("hi > lo").withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") * PARTS / UNIT), F.floor((F.col("hi") - 1) * PARTS / UNIT))))
    # id * GOLDEN mod UNIT, in halves of 16 bits, since the whole product passes 64 bits
    half = F.lit(1 << 16)
    high = F.pmod(F.pmod(F.shiftright("id", 16), half) * F.lit(GOLDEN), half) * half
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", half) * F.lit(GOLDEN) + high, F.lit(UNIT)).alias("point"))
    points = points.withColumn("part", F.floor(F.col("point") * PARTS / UNIT))
    dealt = points.join(spans, "part").where("point >= lo and point < hi").select("source", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = dealt.groupBy("source", "chunk").count()
    offset = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("count").over(offset), F.lit(0)).alias("offset"))
    ranked = dealt.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    return ranked.select("source", "slot", (F.col("offset") + F.row_number().over(inside) - 1).alias("rank"))


def slots_for(needs: int) -> int:
    """Slots of the schedule for so many blocks: a sixteenth more, which the discrepancy of all but small sources stays below."""
    return needs + needs // 16 + 64


def filled(spark: SparkSession, shares: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, slot, rank): each source's ranks from 0 to needs - 1, once each."""
    total = shares.agg(F.coalesce(F.sum("needs"), F.lit(0))).first()[0]
    slots = slots_for(total)
    needs = shares.select(F.col("source").alias("n_source"), "needs")
    dealt = schedule(spark, shares, slots).join(needs, F.col("source").eqNullSafe(F.col("n_source"))).where("rank < needs").select("source", "slot", "rank")
    dealt = scratch.keep(dealt, "schedule")
    had = dealt.groupBy(F.col("source").alias("h")).agg(F.count("*").alias("had"))
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each source
    short = shares.join(had, F.col("source").eqNullSafe(F.col("h")), "left").select("source", "needs", F.coalesce("had", F.lit(0).cast("long")).alias("had")).where("needs > had")
    short = short.withColumn("at", slots + F.coalesce(F.sum(F.col("needs") - F.col("had")).over(before), F.lit(0)))
    more = short.select("source", "had", "at", F.explode(F.sequence("had", F.col("needs") - 1)).alias("rank"))
    return dealt.unionByName(more.select("source", (F.col("at") + F.col("rank") - F.col("had")).alias("slot"), "rank"))


def mixed(docs: DataFrame, weights: tuple[int, ...], most: int, block: int, key: str, text: str, source: str) -> DataFrame:
    """mix() with each row's source."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words_of(docs, text).alias("size"))
    rows = scratch.keep(rows.withColumn("turn", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "rows")
    aims = scratch.keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    streams = running(rows, ["source"], "turn", "doc_id", F.col("size"), rows.count())
    streams = streams.withColumn("pieces", F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    streams = scratch.keep(streams.withColumn("row", F.monotonically_increasing_id()), "streams")
    sized = aims.where("target > 0").select("source", F.col("source_size").alias("length"), F.floor("target").alias("most"))
    blocks = F.ceil(F.col("length") / block)
    needs = F.floor(F.col("most") / F.col("length")) * blocks + F.ceil(F.pmod("most", "length") / block)
    dealt = filled(spark, sized.select("source", needs.cast("long").alias("needs")), scratch)
    plan = dealt.join(sized.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    plan = plan.withColumn("b", F.pmod(F.col("rank"), blocks)).withColumn("at", F.floor(F.col("rank") / blocks) * F.col("length") + F.col("b") * block)
    whole = F.least(F.lit(block), F.col("length") - F.col("b") * block)
    got = F.least(whole, F.col("most") - F.col("at"))
    takes = plan.groupBy(F.col("s").alias("source"), F.col("b").alias("block")).agg(F.sum(F.when(got == whole, 1).otherwise(0)).alias("passes"), F.max(F.when(got < whole, got).otherwise(0)).alias("part"), F.min("slot").alias("slot"))
    pieces = streams.select("row", "source", "start", "size", F.explode("pieces").alias("block"))
    met = pieces.alias("p").join(takes.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
    lo = F.greatest(F.col("start") - F.col("p.block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("p.block") * block, F.lit(block))
    taken = F.col("passes") * (hi - lo) + F.greatest(F.least(hi, F.col("part")) - lo, F.lit(0))
    sums = met.groupBy(F.col("p.row").alias("r")).agg(F.sum(taken).alias("taken"), F.min(F.when(taken > 0, F.col("slot"))).alias("first_slot"))
    out = streams.join(sums, F.col("row") == F.col("r"), "left").alias("d").join(aims.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")))
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"), F.col("d.source").alias("_source"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot), a row for each row of docs.

    taken is how many of a document's words the mix takes, repeats counted: whole passes of the document, and of one document of each source its first
    words. first_slot is the first slot of the schedule that takes any of its words, -1 if none does. A null text has no words, a null source is a source, the last one. Equal rows
    are separate documents. The same rows give the same mix.
    """
    return mixed(docs, weights, most, block, key, text, source).drop("_source")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, with the same columns: whole copies, then where a part is taken its first words, joined by one space.

    Rows of which the mix takes no word are left out. Of rows that share key, source and size, which can't be told apart in the mix, each gets one's number of words taken.
    """
    found = mixed(docs, weights, most, block, key, text, source)
    found = found.select(F.col("doc_id").alias("_id"), F.col("_source").alias("_from"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    same = Window.partitionBy("_id", "_from", "_size")
    found = found.withColumn("_turn", F.row_number().over(same.orderBy(F.col("_taken").desc()))).where("_taken > 0")
    mine = docs.withColumns({"_k": F.col(key).cast("long"), "_s": F.col(source).cast("string"), "_n": n_words_of(docs, text)})
    mine = mine.withColumn("_t", F.row_number().over(Window.partitionBy("_k", "_s", "_n").orderBy(text)))
    whole, part = F.floor(F.col("_taken") / F.col("_size")), F.pmod("_taken", F.col("_size"))
    copies = whole + F.when(part > 0, 1).otherwise(0)
    alike = F.col("_k").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_from")) & (F.col("_n") == F.col("_size")) & (F.col("_t") == F.col("_turn"))
    rows = mine.join(found, alike).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    cut = F.when(F.col("_copy") <= whole, F.col(text)).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    return rows.withColumn(text, cut).select(*docs.columns)


def n_words_of(docs: DataFrame, text: str) -> Column:
    return n_words(text) if dict(docs.dtypes)[text] == "string" else F.lit(0).cast("long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1, no document more than three times."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::BIGINT AS weight FROM d GROUP BY source
), o AS (
  SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE least(weight * (SELECT arg_min(level, ratio) FROM l WHERE NOT level * weight > cap), cap::DOUBLE) END AS target FROM l
), m AS (
  SELECT source, source_size AS length, floor(target)::BIGINT AS most, (length + 127) // 128 AS blocks, (most // length) * blocks + (most % length + 127) // 128 AS needs FROM t WHERE source_size > 0
), z AS (
  SELECT *, coalesce(sum(needs) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum, sum(needs) OVER ()::BIGINT AS total FROM m
), span AS (
  SELECT *, floor(cum::DOUBLE / total::DOUBLE * 4294967296)::BIGINT AS lo, coalesce(lead(floor(cum::DOUBLE / total::DOUBLE * 4294967296)::BIGINT) OVER (ORDER BY source NULLS LAST), 4294967296) AS hi FROM z
), n AS (
  SELECT coalesce(max(total + total // 16 + 64), 0)::BIGINT AS slots FROM z
), point AS (
  SELECT slot, ((slot % 4294967296)::HUGEINT * 2654435769 % 4294967296)::BIGINT AS point FROM (SELECT unnest(range(0, slots)) AS slot FROM n)
), dealt AS (
  SELECT source, needs, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM point JOIN span ON point >= lo AND point < hi
), had AS (
  SELECT z.source, z.needs, count(slot) AS had FROM z LEFT JOIN dealt ON z.source IS NOT DISTINCT FROM dealt.source AND rank < dealt.needs GROUP BY ALL
), short AS (
  SELECT *, (SELECT slots FROM n) + coalesce(sum(needs - had) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM had
), every AS (
  SELECT source, slot, rank FROM dealt WHERE rank < needs
  UNION ALL SELECT source, pos + rank - had AS slot, rank FROM (SELECT *, unnest(range(had, needs)) AS rank FROM short)
), r AS (
  SELECT doc_id, d.source, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size + greatest(0, least(size, floor(target)::BIGINT % source_size - a)) END::BIGINT AS taken,
    CASE WHEN floor(target) >= source_size THEN a + size ELSE least(a + size, floor(target)::BIGINT) END AS e FROM r
), b AS (
  SELECT doc_id, source, a, unnest(range(a // 128, (e - 1) // 128 + 1)) AS block FROM u WHERE taken > 0
), f AS (
  SELECT b.doc_id, b.source, b.a, min(slot) AS first_slot FROM b JOIN every ON b.source IS NOT DISTINCT FROM every.source AND block = rank GROUP BY ALL
)
SELECT u.doc_id, size, source_size, target, taken, coalesce(first_slot, -1)::BIGINT AS first_slot FROM u LEFT JOIN f ON u.doc_id IS NOT DISTINCT FROM f.doc_id AND u.source IS NOT DISTINCT FROM f.source AND u.a = f.a AND taken > 0
"""
