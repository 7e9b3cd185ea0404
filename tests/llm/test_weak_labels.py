import random

import numpy as np

from tapeworks.llm import weak_labels

from .conftest import prose


def test_estimate_recovers_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.8
    rate = np.array([0.3, 0.4, 0.5, 0.6, 0.35, 0.45, 0.25, 0.5])
    votes = np.where(rng.random((6000, 8)) < 0.2, 2, np.where((rng.random((6000, 8)) < rate) & ~truth[:, None], 0, 1))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, tables = weak_labels.estimate(patterns, counts.astype(float))
    assert np.abs(tables[:, weak_labels.BAD, 0] - rate).max() < 0.08
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.95


def counted(votes):
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return patterns, counts.astype(float), inverse.ravel()


def test_estimate_sees_through_bad_labellers():
    """Three of eight labellers accuse three good texts in ten: a rule that any bad vote decides is right about half of the texts only."""
    rng = np.random.default_rng(0)
    good = rng.random(8000) < 0.8
    alarm, hit = (np.array([a] * 5 + [b] * 3) for a, b in ((0.02, 0.3), (0.6, 0.35)))
    bad_vote = rng.random((8000, 8)) < np.where(good[:, None], alarm, hit)
    votes = np.where(rng.random((8000, 8)) < 0.1, 2, np.where(bad_vote, 0, 1))
    patterns, counts, inverse = counted(votes)
    posterior, tables = weak_labels.estimate(patterns, counts)
    any_bad = ((votes != 0).all(1) == good).mean()
    right = ((posterior[inverse] > 0.5) == good).mean()
    assert right > 0.95 > any_bad and np.abs(tables[:, weak_labels.GOOD, 0] - alarm).max() < 0.05


def test_estimate_finds_kinds_of_bad_texts():
    """Bad texts of three kinds, each seen by labellers of its own only."""
    rng = np.random.default_rng(3)
    kind = rng.choice(4, 6000, p=[0.85, 0.06, 0.05, 0.04])
    rate = np.full((4, 8), 0.001)
    rate[1, [0, 1]] = rate[2, [2, 3, 4]] = rate[3, [5, 6]] = 0.95
    votes = np.where(rng.random((6000, 8)) < rate[kind], 0, 1)
    patterns, counts, inverse = counted(votes)
    posterior, tables = weak_labels.estimate(patterns, counts)
    assert ((posterior[inverse] > 0.5) == (kind == 0)).mean() > 0.99 and tables[:, weak_labels.GOOD, 0].max() < 0.01
    none = weak_labels.estimate(np.zeros((0, 8), np.int64), np.zeros(0))
    assert len(none[0]) == 0


def test_registered_query_against_the_labels(spark):
    import os

    data = "/root/testdata/sf0.01"
    if os.path.isdir(data):
        found = weak_labels.op7_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
        assert found[found.quality == 1].kept.mean() > 0.99 and found[found.quality == 0].kept.mean() < 0.1


def test_separates_junk(spark):
    rng, rows = random.Random(1), []
    for k in range(600):
        text = ". ".join(prose(1000 + 10 * k + i, rng.randint(5, 15)).capitalize() for i in range(rng.randint(2, 12))) + "."
        kind = k % 6
        if kind == 0:
            text = {0: text.upper().replace(" ", "!! "), 1: text.replace(" ", " | "), 2: " ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in text.split()), 3: "Same words here. " * 30}[k // 6 % 4]
        rows.append((k, text, kind != 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, truth boolean")
    got = {r.doc_id: r for r in weak_labels.classify(df).collect()}
    good = [got[k].kept for k, _, t in rows if t]
    bad = [got[k].kept for k, _, t in rows if not t]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_odd_rows_and_empty(odd, none):
    rows = weak_labels.classify(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert not by[0].kept and by[0].score == 0 and not by[1].kept and 0 <= by[15].score <= 1
    assert weak_labels.classify(none).count() == 0
