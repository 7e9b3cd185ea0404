"""Analysis of transducers as tables, and lookup as joins: an implementation of its own beside the compiled one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.fst import EPSILON, IDENTITY, UNKNOWN, CyclicError
from tapeworks.shared import Scratch, joinable, small

SPECIAL = (EPSILON, IDENTITY, UNKNOWN)


def label_tally(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("fst_id", "isym", "osym").agg(F.count("*").alias("n"))


def symbol_tally(arcs: DataFrame) -> DataFrame:
    """How many arcs have a symbol on either side; an arc with it on both counts once."""
    both = arcs.select("fst_id", F.explode(F.array_distinct(F.array("isym", "osym"))).alias("sym"))
    return both.groupBy("fst_id", "sym").agg(F.count("*").alias("n"))


def sizes(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """(fst_id, states, arcs, finals, label_pairs, epsilon_arcs, acceptor); the states are those that arcs and finals name, and the first."""
    named = arcs.select("fst_id", F.explode(F.array("src", "dst", F.lit(0))).alias("s")).unionByName(finals.select("fst_id", F.explode(F.array("state", F.lit(0))).alias("s")))
    n = named.distinct().groupBy("fst_id").agg(F.count("*").alias("states"))
    a = arcs.groupBy("fst_id").agg(F.count("*").alias("arcs"), F.countDistinct("isym", "osym").alias("label_pairs"), F.sum(F.when((F.col("isym") == EPSILON) & (F.col("osym") == EPSILON), 1).otherwise(0)).alias("epsilon_arcs"), F.min(F.col("isym") == F.col("osym")).alias("acceptor"))
    f = finals.groupBy("fst_id").agg(F.count("*").alias("finals"))
    return n.join(a, "fst_id", "left").join(f, "fst_id", "left").na.fill(0)


#: Arcs of all transducers up to which reachable() gives each transducer to one task.
ONE_TASK = 1_000_000


def reachable(arcs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(fst_id, state) reachable from state 0, however many arcs away.

    Where there are few arcs, one task follows those of one transducer. Beyond that each step joins the states found last with the arcs, until no state is new; states are written every ROUNDS steps.
    """
    edges = arcs.select("fst_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    if edges.limit(one_task + 1).count() <= one_task:
        return edges.groupBy("fst_id").applyInArrow(_reached, "fst_id string, state long")
    scratch = Scratch(arcs.sparkSession, "reachable")
    edges = scratch.keep(edges, "edges")
    moves = edges.select(F.col("fst_id").alias("_f"), F.col("src").alias("_src"), F.col("dst").alias("_dst")).hint("merge")
    front = seen = scratch.keep(edges.select("fst_id").distinct().withColumn("state", F.lit(0).cast("long")), "seen")
    while True:
        # states stay beside those that they lead to, with the step that first met them
        after = front.withColumn("step", F.lit(0))
        for k in range(ROUNDS):
            after = after.join(moves, (F.col("fst_id") == F.col("_f")) & (F.col("state") == F.col("_src")) & (F.col("step") == k), "left")
            both = F.array(F.struct("state", "step"), F.struct(F.col("_dst").alias("state"), F.lit(k + 1).alias("step")))
            after = after.select("fst_id", F.explode(both).alias("_s")).where("_s.state is not null").groupBy("fst_id", F.col("_s.state").alias("state")).agg(F.min("_s.step").alias("step"))
        found = scratch.keep(after.join(seen.hint("merge"), ["fst_id", "state"], "left_anti"), "front")
        seen = seen.unionByName(found.select("fst_id", "state"))
        front = found.where(F.col("step") == ROUNDS).select("fst_id", "state")
        if front.isEmpty():
            return seen


def _reached(table: pa.Table) -> pa.Table:
    after: dict[int, list[int]] = {}
    for s, d in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
        after.setdefault(s, []).append(d)
    seen, front = {0}, [0]
    while front:
        front = list({d for s in front for d in after.get(s, ())} - seen)
        seen.update(front)
    return pa.table({"fst_id": pa.array([table["fst_id"][0].as_py()] * len(seen), pa.string()), "state": pa.array(sorted(seen), pa.int64())})


END, STAY, DONE = "@_END_@", "@_STAY_@", -1
#: Joins between two written tables.
ROUNDS = 6


def lookup_by_joins(words: DataFrame, arcs: DataFrame, finals: DataFrame, alphabet: DataFrame, word: str = "word") -> DataFrame:
    """(word, output, weight) of every result, for transducers without flags: each round is one join of the frontier with the arcs, until nothing is left to be read.

    A final state is an arc that is taken at the end of the word to a state that stays. A symbol that the alphabet lacks takes identity and unknown arcs. Arcs that read nothing are followed
    as often in a row as there are states, so that only cycles of them are cut. The frontier is written every ROUNDS rounds. Arcs are broadcast where they are few.
    """
    scratch = Scratch(words.sparkSession, "lookup")
    known = small(alphabet.select(F.col("sym").alias("_sym")).distinct())
    moves = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "isym", "osym", F.col("weight").alias("_w"))
    states = moves.select(F.explode(F.array("src", "dst")).alias("s")).distinct().count()
    ends = finals.select(F.col("state").cast("long").alias("src"), F.lit(DONE).cast("long").alias("dst"), F.lit(END).alias("isym"), F.lit(EPSILON).alias("osym"), F.col("weight").alias("_w"))
    stay = moves.sparkSession.createDataFrame([(DONE, DONE, STAY, EPSILON, 0.0)], "src long, dst long, isym string, osym string, _w float")
    moves = joinable(moves.unionByName(ends).unionByName(stay))
    front = words.select(word).where(F.col(word).isNotNull()).distinct().select(F.col(word), F.lit(0).cast("long").alias("state"), F.lit(0).alias("pos"), F.lit("").alias("output"), F.lit(0.0).cast("float").alias("weight"), F.lit(0).alias("quiet"))
    here, inside = F.col("isym"), F.col("pos") < F.length(word)
    found = []
    while True:
        for _ in range(ROUNDS):
            c = front.withColumn("_c", F.expr(f"substring({word}, pos + 1, 1)")).join(known, F.col("_c") == F.col("_sym"), "left")
            read = inside & F.when(F.col("_sym").isNotNull(), here == F.col("_c")).otherwise(here.isin(IDENTITY, UNKNOWN))
            quiet = (here == EPSILON) & (F.col("quiet") < states)
            step = c.join(moves, (F.col("state") == F.col("src")) & (quiet | (here == STAY) | ((here == END) & ~inside) | read))
            out = F.when(F.col("osym") == EPSILON, F.lit("")).when(F.col("osym").isin(IDENTITY, UNKNOWN), F.col("_c")).otherwise(F.col("osym"))
            silent = here.isin(EPSILON, STAY, END)
            front = step.select(word, F.col("dst").alias("state"), (F.col("pos") + F.when(silent, 0).otherwise(1)).alias("pos"), F.concat("output", out).alias("output"), (F.col("weight") + F.col("_w")).cast("float").alias("weight"), F.when(silent, F.col("quiet") + 1).otherwise(0).alias("quiet"))
        front = scratch.keep(front, "front")
        found.append(front.where(F.col("state") == DONE))
        front = front.where(F.col("state") != DONE)
        if front.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(word, "output").agg(F.min("weight").alias("weight"))


def strings_by_joins(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """(fst_id, upper, lower, weight) of every path of acyclic transducers without flags, by joins of the paths so far with the arcs. A cyclic one raises an error."""
    scratch = Scratch(arcs.sparkSession, "strings")
    text = lambda c: F.when(F.col(c) == EPSILON, F.lit("")).otherwise(F.col(c))
    moves = arcs.select(F.col("fst_id").alias("_f"), F.col("src").cast("long").alias("_src"), F.col("dst").cast("long").alias("_dst"), text("isym").alias("_i"), text("osym").alias("_o"), F.col("weight").alias("_w"))
    # a final state is an arc without symbols to a state below 0, one for each final state, at which the whole path stays
    ends = finals.select(F.col("fst_id").alias("_f"), F.col("state").cast("long").alias("_src"), (-1 - F.col("state").cast("long")).alias("_dst"), F.lit("").alias("_i"), F.lit("").alias("_o"), F.col("weight").alias("_w"))
    moves = scratch.keep(moves.unionByName(ends), "moves")
    most = moves.select("_f", F.explode(F.array("_src", "_dst"))).distinct().groupBy("_f").count().agg(F.max("count")).first()[0] or 0
    ids = moves.select(F.col("_f").alias("fst_id")).distinct()
    moves = joinable(moves)
    none = F.lit(0.0).cast("float")
    front = scratch.keep(ids.select("fst_id", F.lit(0).cast("long").alias("state"), F.lit("").alias("upper"), F.lit("").alias("lower"), none.alias("weight")), "front")
    done, rounds = [], 0
    while not front.isEmpty():
        if rounds > most:
            raise CyclicError("a cyclic transducer has endlessly many paths")
        for _ in range(ROUNDS):
            step = front.join(moves, (F.col("fst_id") == F.col("_f")) & (F.col("state") == F.col("_src")), "left").where("state < 0 or _src is not null")
            grown = lambda c, more: F.concat(c, F.coalesce(more, F.lit(""))).alias(c)
            front = step.select("fst_id", F.coalesce("_dst", "state").alias("state"), grown("upper", "_i"), grown("lower", "_o"), (F.col("weight") + F.coalesce("_w", none)).cast("float").alias("weight"))
        rounds += ROUNDS
        front = scratch.keep(front, "front")
        done.append(front.where("state < 0").select("fst_id", "upper", "lower", "weight"))
        front = front.where("state >= 0")
    out = done[0] if done else front.select("fst_id", "upper", "lower", "weight")
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy("fst_id", "upper", "lower").agg(F.min("weight").alias("weight"))
