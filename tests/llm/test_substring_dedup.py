import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import substring_dedup
from tapeworks.llm.recompression import anchors
from tapeworks.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    seen = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = min(doc, seen.get(key, doc))
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < doc:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_odd_rows_against_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(tuple(r)[:4] for r in substring_dedup.dedup(odd).collect())
    assert got == brute(rows, 13)


def test_other_window_and_hot_names(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.0)
    rows = [(k, "a b c d e f g h " * (k % 5) + f"u{k} v{k} " + "p q r s t " * 3) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in substring_dedup.dedup(df, window=5).collect()) == brute(rows, 5)


def test_empty_table(none):
    assert substring_dedup.dedup(none).count() == 0


def test_strip_repeats_keeps_columns(odd):
    out = substring_dedup.strip_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[5].text == "" and by_id[4].text is not None and by_id[0].text is None and by_id[2].text == " \t\n "


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4), st.integers(2, 9), st.integers(0, 4))
def test_equal_windows_have_anchors_of_one_name(texts, window, rounds):
    words = Words(pa.array([" ".join(f"w{x}" for x in t) for t in texts]))
    at, names, _ = anchors(words, window, rounds)
    flat = [x for t in texts for x in t]
    assert len(at) == sum(max(0, len(t) - window + 1) for t in texts)
    found = {}
    for k, name in zip(at.tolist(), names.tolist(), strict=True):
        key = tuple(flat[k : k + window])
        assert found.setdefault(key, name) == name


def test_words_are_ascii_white_space_runs():
    texts = ["", None, " a b\x1c c ", "\x0b\x0cx", "日本 語"]
    w = Words(pa.array(texts))
    got = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
