import random
import zlib
from collections import Counter, defaultdict

from tapeworks.llm import sharding


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    count = Counter(r.shard for r in rows)
    assert max(count.values(), default=0) - min((count.get(k, 0) for k in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    rows = sharding.shard(odd, 3).collect()
    check(rows, texts, 3)
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_groups_stay_together_and_a_large_one_fills_shards(spark):
    rng, texts = random.Random(2), ["hot"] * 340
    for g in range(60):
        texts += [f"group {g}"] * rng.randint(2, 5)
    texts += [f"single {k}" for k in range(1000 - len(texts))]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(df).collect()
    check(rows, texts, 8)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert len(where["hot"]) <= 4
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") <= 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard(df).collect()))


def test_all_linked_and_empty(spark, none):
    df = spark.createDataFrame([(k, f"t{k % 3}") for k in range(50)], "doc_id long, text string")
    check(sharding.shard(df, 7).collect(), range(50), 7)
    assert sharding.shard(none).count() == 0
