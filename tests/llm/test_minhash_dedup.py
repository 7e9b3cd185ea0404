import random
import re

from tapeworks.llm import minhash_dedup
from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=4, percent=80):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        sets[doc] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d, _ in rows)


def test_odd_rows_against_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in minhash_dedup.near_duplicates(odd).collect()) == brute(rows)


def test_groups_of_drifting_copies(spark):
    rng, rows = random.Random(3), []
    for g in range(6):
        words = prose(100 + g, 150).split()
        for k in range(40):
            if k % 3 == 0:
                words = list(words)
                words[rng.randrange(len(words))] = f"new{g}x{k}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash_dedup.near_duplicates(df).collect()) == brute(rows)


def test_empty_table(none):
    assert minhash_dedup.near_duplicates(none).count() == 0
