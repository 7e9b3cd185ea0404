"""The registered queries on the smallest tables, against their SQL or against brute force."""

import hashlib
import html
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeworks.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def run(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    got, want = run(spark, name), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df[columns].itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_sentencepiece(spark, duck):
    sentencepiece = pytest.importorskip("sentencepiece")
    from tapeworks.llm.piece_codec import default_model

    p = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = run(spark, "op3_sentencepiece").set_index("doc_id")
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        ids = p.encode(text or "", add_bos=True, add_eos=True)
        assert got.n_tokens[doc] == len(ids) and got.ids_sha256[doc] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got.decoded_sha256[doc] == hashlib.sha256(p.decode(ids).encode()).hexdigest()


def test_language_id(spark, duck):
    got = run(spark, "op4_language_id").set_index("doc_id")
    truth = dict(duck.execute("select doc_id, lang from documents").fetchall())
    assert len(got) == len(truth) and all(got.held_out[d] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in truth)
    held = [d for d in truth if got.held_out[d]]
    assert np.mean([got.lang_pred[d] == truth[d] for d in held]) >= 0.95


def test_sharding(spark, duck):
    got = run(spark, "op6_sharding")
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert sorted(got.doc_id) == sorted(texts)
    counts = Counter(got["shard"])
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    where = defaultdict(set)
    for r in got.itertuples():
        where[texts[r.doc_id]].add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and sum(len(s) > 1 for s in where.values()) == 0


def test_quality(spark, duck):
    got = run(spark, "op7_quality").set_index("doc_id")
    labels = duck.execute("select doc_id, quality from labels").fetchall()
    good, bad = [got.kept[d] for d, q in labels if q], [got.kept[d] for d, q in labels if not q]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.25


def test_html(spark, duck):
    got = run(spark, "op8_html_extraction").set_index("page_id")
    for page, text in duck.execute("select page_id, html from pages").fetchall():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", text, re.S)
        parts = re.split(r"</?(?:p|h1)>|<br>", re.sub(r"</?b>", "", m[1])) if m else []
        want = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)
        assert got.text[page] == want and got.n_chars[page] == len(want)


def test_nearest(spark, duck):
    got = run(spark, "op9_nearest")
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    x = np.array([v for _, v in rows], np.float64)
    hits = []
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hits.append(len(set(g.vec_id) & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20)
        assert sorted(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id])
    assert len(hits) == len([i for i, _ in rows if i % 20 == 0]) and np.mean(hits) >= 0.9
