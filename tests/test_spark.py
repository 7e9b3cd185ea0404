import datetime
import random
import re
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import text as X
from tapeworks.functions import vectors as V
from tapeworks.operators import apply as ops
from tapeworks.operators import finite as L
from tapeworks.operators import graph as G
from tapeworks.operators import tagging
from tapeworks.plans import algebra as A
from tapeworks.plans import lexc
from tapeworks.plans import paths as P
from tapeworks.plans.fst import CyclicError, FormatError, from_words
from tapeworks.plans.lookup import edit_model
from tapeworks.plans.pmatch import compile_script
from tapeworks.plans.xre import regex
from tapeworks.shared import BATCH_BYTES
from tapeworks.sources import formats, tables
from tapeworks.streaming import apply as stream

TYPES = from_words([("cat", "N", 1.0), ("cat", "V", 2.0), ("dog", "N", 0.5)])


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "cow"), (4, None), (5, "cat")], "id int, w string")


def test_lookup_columns(words):
    rows = {r.id: r.a for r in words.select("id", ops.analyses(TYPES)("w").alias("a")).collect()}
    assert [(x.weight, x.output) for x in rows[1]] == [(1.0, "N"), (2.0, "V")] and rows[3] == [] and rows[4] is None
    assert sorted((r.id, r.output) for r in ops.lookup(words, "w", TYPES).collect()) == [(1, "N"), (1, "V"), (2, "N"), (5, "N"), (5, "V")]
    assert sorted(map(tuple, ops.lookup(words, "w", TYPES).collect())) == sorted(map(tuple, ops.lookup_distinct(words, "w", TYPES).collect()))
    assert {r.id for r in ops.lookup(words, "w", TYPES, keep_misses=True).where("output is null").collect()} == {3, 4}
    assert [r.a for r in words.orderBy("id").select(ops.accepts(TYPES)("w").alias("a")).collect()] == [True, True, False, None, True]
    best = words.where("id = 1").select(ops.analyses(TYPES, most=1)("w").alias("a"), ops.analyses(TYPES, beam=0.5)("w").alias("b")).first()
    assert len(best.a) == len(best.b) == 1
    back = words.sparkSession.createDataFrame([("N",)], "t string")
    assert {x.output for x in back.select(ops.generations(TYPES)("t").alias("a")).first().a} == {"cat", "dog"}


def test_cascades_and_ranks(words):
    other = from_words([("cow", "N", 0.0), ("cat", "X", 0.0)])
    get = lambda how: sorted((r.id, r.output) for r in ops.cascade(words.where("w is not null"), "w", [TYPES, other], how).collect())
    assert get("union") == [(1, "N"), (1, "V"), (1, "X"), (2, "N"), (3, "N"), (5, "N"), (5, "V"), (5, "X")]
    assert get("priority-union") == [(1, "N"), (1, "V"), (2, "N"), (3, "N"), (5, "N"), (5, "V")]
    down = ops.cascade(words, "w", [regex("a -> b"), regex("b -> c")], "composition")
    assert sorted((r.id, r.output) for r in down.collect()) == [(1, "cct"), (2, "dog"), (3, "cow"), (5, "cct")]
    found = ops.lookup(words, "w", TYPES)
    assert ops.weight_classes(found, ["id"], 1).count() == 3 and ops.within_beam(found, ["id"], 0.5).count() == 3
    with pytest.raises(ValueError):
        ops.cascade(words, "w", [TYPES], "other")


def test_patterns(spark):
    df = spark.createDataFrame([(1, "a1 b22"), (2, None), (3, "")], "id int, t string")
    m = compile_script('set need-separators off Define TOP "0-9"+ EndTag(N);')
    got = df.orderBy("id").select(ops.matched(m)("t").alias("m"), ops.tag_counts(m)("t").alias("c"), ops.tokenized(m)("t").alias("k")).collect()
    assert [r.m for r in got] == ["a<N>1</N> b<N>22</N>", None, ""] and got[0].c == {"N": 2} and got[0].k == "1\n22\n\n"
    spans = sorted((r.start, r.length, r.input, r.tag) for r in ops.locate(df, "t", m).collect())
    assert spans == [(1, 1, "1", "N"), (4, 2, "22", "N")] and ops.locate(df, "t", m, gaps=True).count() == 4
    fixes = spark.createDataFrame([("caat",)], "w string").select(ops.corrections(from_words(["cat", "dog"]), edit_model(2, "catdog"))("w").alias("f")).first().f
    assert [x.output for x in fixes] == ["cat"]


def test_finite_languages_agree_with_the_algebra(spark):
    x, y = [("a", "b", 1.0), ("c", "d", 2.0), ("e", "e", 0.0)], [("b", "x", 1.0), ("c", "d", 1.0), ("d", "z", 0.0), ("q", "r", 0.5)]
    frame = lambda rows: spark.createDataFrame(rows, "upper string, lower string, weight float")
    a, b, fa, fb = frame(x), frame(y), from_words(x), from_words(y)
    same = lambda df, f: sorted((r.upper, r.lower, r.weight) for r in df.collect()) == sorted(P.strings(f))
    assert same(L.union(a, b), A.union(fa, fb)) and same(L.intersect(a, b), A.intersect(fa, fb)) and same(L.subtract(a, b), A.subtract(fa, fb))
    assert same(L.compose(a, b), A.compose(fa, fb)) and same(L.priority_union(a, b), A.priority_union(fa, fb)) and same(L.lenient_composition(a, b), A.lenient_composition(fa, fb))
    assert same(L.invert(a), A.invert(fa)) and same(L.project(a, "lower"), A.project(fa, "output")) and same(L.concat(a, b), A.concat(fa, fb)) and same(L.n_best(a, 2), A.n_best(fa, 2))
    assert same(L.reverse(a), A.reverse(fa)) and same(L.cross_product(L.project(a), L.project(b, "lower")), A.cross_product(A.project(fa, "input"), A.project(fb, "output")))


def test_tables_and_files(spark, tmp_path):
    f = lexc.compile_lexc("Multichar_Symbols +N\nLEXICON Root\ncat N ;\nLEXICON N\n+N:0 # ;\n+N:s # ;\n")
    f.name, f.props = "nouns", {"k": "v"}
    tables.save(spark, {"n": f, "t": TYPES}, str(tmp_path / "fsts"))
    back = tables.load(spark, str(tmp_path / "fsts"))
    assert A.equivalent(back["n"], f) and back["n"].name == "nouns" and back["n"].props == {"k": "v"} and A.equivalent(back["t"], TYPES)
    (tmp_path / "a.att").write_text(formats.write_att(f))
    (tmp_path / "a.ol").write_bytes(formats.write_lookup(f))
    (tmp_path / "a.prolog").write_text(formats.write_prolog(f))
    (tmp_path / "w.strings").write_text("cat\ndog\n")
    for name in ("a.att", "a.ol", "a.prolog"):
        assert A.equivalent(tables.read_file(spark, str(tmp_path / name))[0], f), name
    assert [u for u, _, _ in P.strings(tables.read_file(spark, str(tmp_path / "w.strings"))[0])] == ["cat", "dog"]
    with pytest.raises(FormatError):
        tables.read_file(spark, str(tmp_path / "a.att"), "nonsense")
    lines = spark.createDataFrame([(k, x) for k, x in enumerate((formats.write_att(f) + "--\n" + formats.write_att(TYPES)).splitlines())], "n int, value string")
    parts = tables.read_att_table(lines, order="n") | {"alphabet": tables.to_tables(spark, {"0": f, "1": TYPES})["alphabet"]}
    assert A.equivalent(tables.from_tables(parts, "0"), f) and A.equivalent(tables.from_tables(parts, "1"), TYPES)


def test_graph_tables(spark):
    t = tables.to_tables(spark, {"t": TYPES})
    assert G.sizes(t["arcs"], t["finals"]).first().states == TYPES.n_states
    assert G.symbol_tally(t["arcs"]).where("sym = 'c'").first().n == 2 and G.reachable(t["arcs"]).count() == TYPES.n_states
    w = spark.createDataFrame([("cat",), ("dog",), ("cow",)], "word string")
    assert sorted((r.word, r.output, r.weight) for r in G.lookup_by_joins(w, t["arcs"], t["finals"], t["alphabet"]).collect()) == [("cat", "N", 1.0), ("cat", "V", 2.0), ("dog", "N", 0.5)]
    r = tables.to_tables(spark, {"r": regex("[? - a]* 0:%!")})
    assert [x.output for x in G.lookup_by_joins(w.where("word = 'cow'"), r["arcs"], r["finals"], r["alphabet"]).collect()] == ["cow!"]


def test_lexicon_by_joins(spark):
    source = "LEXICON Root\ncat N ;\ndog N ;\nLEXICON N\ns:0 # ;\n# ;\n"
    got = lexc.expand_by_joins(lexc.entries_table(spark, lexc.parse(source))).collect()
    assert sorted((r.upper, r.lower) for r in got) == sorted((u, lo) for u, lo, _ in P.strings(lexc.compile_lexc(source)))


def test_column_functions(spark):
    df = spark.createDataFrame([("banana",)], "t string")
    row = df.select(
        X.mark("t", "an", "X").alias("m"), X.delete("t", "an").alias("d"), X.extract("t", "an", "-").alias("e"), X.contains_once("t", "b").alias("o"), X.contains_at_most_once("t", "an").alias("a"),
        X.replaced("t", "a", "A", "n", "n").alias("r"), X.replaced_optionally("t", "b", "B").alias("v"), X.inserted("t", "-", "b", "a").alias("i"), X.restricted("t", "n", "a", "a").alias("s"), X.variants("t", "OptUpCase").alias("u"), X.implode(X.symbols("t", ["an"])).alias("z"),
    ).first()
    assert tuple(row) == ("b<X>an</X><X>an</X>a", "ba", "an-an", True, False, "banAna", ["Banana", "banana"], "b-anana", True, ["BANANA", "banana"], "banana")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "word string, embedding array<float>")
    assert [r.word for r in V.like(v, ["a"], 1).collect()] == ["b"] and [r.word for r in V.like(v, ["a"], 1, unlike=True).collect()] == ["c"] and V.like(v, ["zz"]).count() == 0
    assert compile_script("Define TOP Like(a, 1) EndTag(L);", neighbours=V.neighbours(v)).match("b c") == "<L>b</L> c"
    got = v.where("word = 'a'").select(V.dot("embedding", "embedding").alias("d"), V.norm("embedding").alias("n"), V.plus("embedding", "embedding").alias("p"), V.minus("embedding", "embedding").alias("m"), V.times("embedding", 3.0).alias("t")).first()
    assert tuple(got) == (1.0, 1.0, [2.0, 0.0], [0.0, 0.0], [3.0, 0.0])


def test_tagger_and_guesser(spark):
    sentences = [("the/D cat/N sleeps/V", 6), ("the/D dog/N runs/V", 6), ("dogs/N run/V", 4), ("the/D run/N ends/V", 2)]
    rows = [(f"{k}-{c}", j, *w.split("/")) for k, (s, n) in enumerate(sentences) for c in range(n) for j, w in enumerate(s.split())]
    tokens = spark.createDataFrame(rows, "s string, p int, w string, t string")
    model = tagging.train(tokens, "s", "p", "w", "t")
    lexicon = tagging.lexicon_of(model["words"])
    new = spark.createDataFrame([("x", 0, "the"), ("x", 1, "run"), ("x", 2, "sleeps"), ("y", 0, "dogs"), ("y", 1, "run")], "s string, p int, w string")
    got = {(r.sequence, r.position): r.tag for r in tagging.decode(new, model, lexicon, "s", "p", "w").collect()}
    assert got == {("x", 0): "D", ("x", 1): "N", ("x", 2): "V", ("y", 0): "N", ("y", 1): "V"}
    table = tagging.affix_table(tokens, "w", "t", 2)
    assert tagging.guess(spark.createDataFrame([("jumps",)], "w string"), table, "w", 1, 2).first().tag == "V"


def test_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h, m), t) for h in range(3) for m, t in ((1, "cat"), (2, "dog"), (3, "cow"))]
    spark.createDataFrame(rows, "ts timestamp, w string").write.parquet(str(tmp_path / "in"))
    m = compile_script("Define TOP [{cat}|{dog}] EndTag(PET);")
    source = spark.readStream.schema("ts timestamp, w string").parquet(str(tmp_path / "in"))
    out = stream.run_once(spark, stream.tagged(source, "w", m), str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.groupBy("tag").agg(F.sum("n").alias("n")).first().n == 6
    windows = stream.counts_by_window(stream.tagged(source, "w", m), "ts", "tag", "1 hour", "0 seconds")
    done = stream.run_once(spark, windows, str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert [r.n for r in done.collect()] and all(r.n == 2 for r in done.collect())


def test_the_rest_stands_without_the_training_data_operators():
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tapeworks.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') for q in e.queries()) and e.oracle_sql()\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
    assert not [p for p in (root / "tapeworks").rglob("*.py") if "llm" not in p.parts and "tapeworks.llm" in p.read_text()]


def test_reachable_states_however_far(spark):
    rows = [("a", k, k + 1) for k in range(300)] + [("a", 300, 0), ("a", 500, 501), ("b", 0, 0), ("b", 1, 0)]
    arcs = spark.createDataFrame(rows, "fst_id string, src int, dst int")
    assert sorted(map(tuple, G.reachable(arcs).collect())) == [("a", k) for k in range(301)] + [("b", 0)]


def test_reachable_states_by_joins(spark):
    rows = [("a", k, k + 1) for k in range(12)] + [("a", 12, 0), ("a", 50, 51), ("b", 0, 0), ("b", 1, 0)]
    arcs = spark.createDataFrame(rows, "fst_id string, src int, dst int")
    assert sorted(map(tuple, G.reachable(arcs, one_task=3).collect())) == [("a", k) for k in range(13)] + [("b", 0)]


def _plans(spark, run):
    """The physical plans of what ran meanwhile."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    newest = lambda: max((x.executionId() for x in (e.apply(k) for e in [store.executionsList()] for k in range(e.size()))), default=-1)
    bus.waitUntilEmpty()
    before = newest()
    run()
    bus.waitUntilEmpty()
    new = [store.execution(k) for k in range(before + 1, newest() + 1)]
    return [x.get().physicalPlanDescription().split("== Initial Plan ==")[0] for x in new if x.isDefined()]


def test_reachable_states_send_no_table_to_the_driver(spark):
    rows = [("a", k, k + 1) for k in range(20)] + [("a", 3, 9), ("a", 20, 2), ("a", 50, 51)]
    arcs = spark.createDataFrame(rows, "fst_id string, src int, dst int")
    got = []
    plans = _plans(spark, lambda: got.extend(map(tuple, G.reachable(arcs, one_task=3).collect())))
    assert sorted(got) == [("a", k) for k in range(21)] and plans and not [p for p in plans if "Broadcast" in p]


def test_many_beginnings_are_joined_by_keys(spark):
    many = spark.range(25_000).select(F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop").alias("w"))
    finals = tables.word_tables(many, "w")["finals"]
    assert "Broadcast" not in finals._jdf.queryExecution().executedPlan().toString()


def test_strings_take_one_join_a_symbol(spark):
    t = tables.to_tables(spark, {"t": from_words(["abcdefghij", "abc", ""])})
    got = []
    plans = _plans(spark, lambda: got.extend(r.upper for r in G.strings_by_joins(t["arcs"], t["finals"]).collect()))
    assert sorted(got) == ["", "abc", "abcdefghij"]
    assert 6 <= sum(len(re.findall(r"[+:]-.*Join.*\(\d+\)", p)) for p in plans) <= 2 * G.ROUNDS


def test_batches_of_long_texts_are_bounded(spark):
    fresh = spark.newSession()
    fresh.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    df = fresh.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 50_000).alias("t"))
    found = ops.lookup(df, "t", regex("x"), keep_misses=True).select(together("t").alias("n"))
    assert found.agg(F.max("n")).first()[0] <= 2 * BATCH_BYTES and fresh.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)


def test_joins_to_the_end_of_long_words(spark):
    long = "ab" * 25
    f = from_words([long, "a"])
    t = tables.to_tables(spark, {"t": f})
    w = spark.createDataFrame([(long,), ("a",), ("ab",), ("",), (None,)], "word string")
    assert sorted(r.output for r in G.lookup_by_joins(w, t["arcs"], t["finals"], t["alphabet"]).collect()) == ["a", long]
    assert sorted((r.upper, r.lower) for r in G.strings_by_joins(t["arcs"], t["finals"]).collect()) == [("a", "a"), (long, long)]
    loop = tables.to_tables(spark, {"t": regex("a [0:x]* b")})
    found = G.lookup_by_joins(spark.createDataFrame([("ab",)], "word string"), loop["arcs"], loop["finals"], loop["alphabet"]).collect()
    assert {"ab", "axb"} <= {r.output for r in found}
    with pytest.raises(CyclicError):
        G.strings_by_joins(loop["arcs"], loop["finals"])


def test_word_tables(spark):
    df = spark.createDataFrame([("cat", 2.0), ("car", 1.0), ("", 0.5), (None, 0.0), ("cat", 1.5)], "w string, x double")
    t = tables.word_tables(df, "w", "x")
    f = tables.from_tables(t, "0")
    assert P.strings(f) == [("", "", 0.5), ("car", "car", 1.0), ("cat", "cat", 1.5)] and sorted(r.dst for r in t["arcs"].collect()) == [1, 2, 3, 4]
    none = tables.word_tables(df.where("false"), "w")
    assert none["arcs"].count() == none["finals"].count() == 0


def test_corrections_by_joins(spark):
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(60)})
    asked = ["", "abc", "aacb", "cccc", "bacab"]

    def edits(w, n):
        if n == 0:
            return {w}
        return {y for x in edits(w, n - 1) for y in ([x[:k] + x[k + 1 :] for k in range(len(x))] + [x[:k] + c + x[k:] for k in range(len(x) + 1) for c in "abc"] + [x[:k] + c + x[k + 1 :] for k in range(len(x)) for c in "abc"])}

    a, v = (spark.createDataFrame([(x,) for x in xs], "w string") for xs in (asked, vocabulary))
    for distance in (1, 2):
        want = {(x, y): float(n) for x in asked for y in vocabulary for n in [next((i for i in range(distance + 1) if y in edits(x, i)), None)] if n is not None}
        assert {(r.w, r.output): r.weight for r in L.corrections_by_joins(a, "w", v, "w", distance).collect()} == want


def test_lexicons_that_never_end(spark):
    with pytest.raises(CyclicError):
        lexc.expand_by_joins(lexc.entries_table(spark, lexc.parse("LEXICON Root\na Root ;\nb # ;\n")))


def test_small_tables_and_numbers(spark):
    from tapeworks.shared import Scratch, shared_dir, small

    df = spark.range(0, 1000, 1, 7)
    numbered = Scratch(spark, "numbers").numbered(df, "n").collect()
    assert sorted(r.n for r in numbered) == list(range(1000)) and len({r.id for r in numbered}) == 1000
    assert "Broadcast" in df.join(small(df), "id")._jdf.queryExecution().toString() and shared_dir(spark)
    assert "hint" not in small(df, 10)._jdf.queryExecution().logical().toString().lower()
