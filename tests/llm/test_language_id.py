import random
import zlib

import pytest

from tapeworks.llm import byte_cnn, language_id

PARTS = {"en": ["the", "ing", "and", "tion", "with", "er"], "de": ["sch", "und", "ung", "ver", "ß", "ä"], "es": ["ción", "ñ", "que", "los", "ll", "ía"]}


def text(lang, rng, n=80):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(k, text(lang := rng.choice(list(PARTS)), rng), lang) for k in range(400)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "en"), (1003, text("de", rng, 9000), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(labelled):
    truth = {r.doc_id: r.lang for r in labelled.collect()}
    rows = {r.doc_id: r for r in language_id.identify(labelled).collect()}
    for k in (1000, 1001, 1002):
        assert rows[k].lang_pred == "und" and rows[k].score == 0
    assert rows[1003].lang_pred == "de"
    held = [r for k, r in rows.items() if r.held_out and k < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_reruns_agree_and_held_out_labels_are_not_read(labelled):
    from pyspark.sql import functions as F

    first = sorted(map(tuple, language_id.identify(labelled).collect()))
    changed = labelled.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id.identify(changed).collect())) == first


def test_nothing_to_learn_and_empty(odd, none, spark):
    from pyspark.sql import functions as F

    rows = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"} and len(rows) == odd.count()
    assert language_id.identify(none).count() == 0
    assert language_id.keep_languages(none).count() == 0


def test_keep_languages_keeps_columns(odd):
    out = language_id.keep_languages(odd)
    assert out.columns == odd.columns
    ids = {r.doc_id for r in out.collect()}
    assert {0, 1, 2}.isdisjoint(ids) and {4, 7, 11} <= ids


def test_windows_cover_every_byte():
    import numpy as np

    data = np.arange(1, 251, dtype=np.uint8).repeat(3)
    cut, owner, own = byte_cnn.windows(data, np.array([0, 0, 300, 300, 750]))
    assert own.sum() == 750 and np.bincount(owner, minlength=4).tolist() == [0, 2, 0, 2]
    assert np.array_equal(np.concatenate([c[:n] for c, n in zip(cut, own, strict=True)]), byte_cnn.LOWER[data])


def test_number_signs_are_no_letters(spark, labelled):
    odd = spark.createDataFrame([(1, "\u00bd \u00b2 \u2460", None), (2, "_ 12", None), (3, "\u0436", None)], labelled.schema)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, labelled).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"


def test_stage_rejects_long_unsure_texts_and_names_languages(spark, labelled):
    rng = random.Random(9)
    known = labelled.where("lang is not null and doc_id < 1000")
    mixed = [(2000, "12 34 !!", None), (2001, text("de", rng), None), (2002, "zz", None), (2003, text("en", rng), "es")]
    docs = known.unionByName(spark.createDataFrame(mixed, labelled.schema))
    kept = {r.doc_id: r.lang for r in language_id.keep_languages(docs).collect()}
    assert 2000 not in kept and kept[2001] == "de" and 2002 in kept and kept[2003] == "es" and len(kept) == 403
    strict = {r.doc_id for r in language_id.keep_languages(docs, least=1.01, long=5).collect()}
    assert strict == {2002}
