import random

from tapeworks.llm.components import components
from tapeworks.llm.scratch import Scratch


def test_chains_hubs_and_nothing(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5001), (5001, 5000), (5002, 5002)]
    links += [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(70)]
    label = {v: v for e in links for v in e if e[0] != e[1]}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    scratch = Scratch(spark, "test")
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {v: find(v) for v in label}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
