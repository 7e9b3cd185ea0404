import hashlib
import re
from fractions import Fraction

import pytest

from tapeworks.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def aims(sizes):
    """source -> target, by sharing again and again what is above a cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed, total = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in free}
        fixed |= {s: Fraction(3 * sizes[s]) for s in over}


def brute(rows):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = {}
    for n, (_, _, s) in zip(size, rows, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    target = aims(sizes)
    start, out = dict.fromkeys(sizes, 0), []
    for k in sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"mix{rows[k][0]}".encode()).hexdigest(), rows[k][0])):
        doc, _, s = rows[k]
        a, whole = start[s], sizes[s]
        start[s] += size[k]
        most = int(target[s])
        taken = most // whole * size[k] + max(0, min(size[k], most % whole - a)) if whole else 0
        out.append((doc, size[k], whole, round(float(target[s]), 6), taken))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_odd_rows_against_brute_force(odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got(mixing.mix(odd)) == brute(rows)


@pytest.mark.parametrize("block", [1, 7, 128, 5000])
def test_block_size_changes_nothing(spark, block):
    rows = [(k, " ".join(["w"] * (k * 7 % 50)), f"s{k % 5 if k % 2 else 0}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = got(mixing.mix(df, block=block))
    assert out == brute(rows)
    assert all(taken <= 3 * size for _, size, _, _, taken in out)


def test_schedule_is_even(spark):
    df = spark.createDataFrame([("a", 500), ("b", 200), (None, 100)], "source string, needs long")
    rows = mixing.schedule(spark, df, 800).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(800))
    seen = {}
    for r in rows:
        assert r.rank == seen.get(r.source, 0)
        seen[r.source] = r.rank + 1
        for s, w in (("a", 5), ("b", 2), (None, 1)):
            assert abs(seen.get(s, 0) - (r.slot + 1) * w / 8) < 4


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x0b\x0ca b\r\n\tc ", "x\x1cy  z", "a" * 10000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words("text").alias("n"))
    assert [r.n for r in df.collect()] == [len(WORD.findall(t or "")) for t in texts]


def test_empty_table(none):
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


def test_apply_mix_takes_that_many_words(odd):
    takes = {r.doc_id: r.taken for r in mixing.mix(odd).collect() if r.doc_id not in (14,)}
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert {k: v for k, v in words.items() if k != 14} == {k: v for k, v in takes.items() if v}


def test_small_sources_get_their_whole_target(spark):
    small = [1, 10, 50, 100, 130, 260, 1000, 2000]
    df = spark.range(50).selectExpr("id as doc_id", "repeat('w ', 20000) as text", "'big' as source")
    df = df.unionByName(spark.createDataFrame([(100 + n, "w " * n, f"s{n}") for n in small], "doc_id long, text string, source string"))
    out = got(mixing.mix(df))
    assert out == brute([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert [r[4] for r in out if r[0] >= 100] == [3 * n for n in small]


def brute_slots(rows, block=128, golden=2654435769):
    """The first slot of each document, from the schedule written out slot by slot."""
    made = brute(rows)
    target = {}
    for (_, _, s), size in zip(rows, (len(WORD.findall(t or "")) for _, t, _ in rows), strict=True):
        target[s] = target.get(s, 0) + size
    length = dict(target)
    aim = {s: int(t) for s, t in aims(length).items()}
    order = [s for s in sorted(length, key=lambda s: (s is None, (s or "").encode())) if length[s]]
    blocks = {s: -(-length[s] // block) for s in order}
    needs = {s: aim[s] // length[s] * blocks[s] + -(-(aim[s] % length[s]) // block) for s in order}
    total, cum, lo = sum(needs.values()), 0, []
    for s in order:
        lo.append(int(cum / total * 2**32))
        cum += needs[s]
    slots, at = {s: [] for s in order}, mixing.slots_for(total)
    for n in range(at):
        point = n * golden % 2**32
        s = order[max(k for k in range(len(order)) if lo[k] <= point)]
        slots[s].append(n)
    for s in order:
        slots[s] = slots[s][: needs[s]]
        more = needs[s] - len(slots[s])
        slots[s] += range(at, at + more)
        at += more
    start, first = dict.fromkeys(length, 0), {}
    for k in sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"mix{rows[k][0]}".encode()).hexdigest(), rows[k][0])):
        doc, text, s = rows[k]
        size = len(WORD.findall(text or ""))
        a, start[s] = start[s], start[s] + size
        end = a + size if length[s] and aim[s] >= length[s] else min(a + size, aim[s])
        first[doc] = min((slots[s][b] for b in range(a // block, (end - 1) // block + 1)), default=-1) if end > a else -1
    return first, made


def test_first_slots_against_the_schedule_written_out(spark, monkeypatch):
    rows = [(k, " ".join(["w"] * (k * 37 % 400)), f"s{k % 5 if k % 2 else 0}") for k in range(400)]
    rows += [(1000, "a b c", None), (1001, None, "s0"), (1002, "x " * 3000, "t"), (1003, "y", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, made = brute_slots(rows)
    out = mixing.mix(df)
    assert {r.doc_id: r.first_slot for r in out.collect()} == first and got(out) == made
    # another constant is another schedule of the same words
    monkeypatch.setattr(mixing, "GOLDEN", 1640531527)
    other = mixing.mix(df)
    assert got(other) == made
    changed = {r.doc_id: r.first_slot for r in other.collect()}
    assert changed == brute_slots(rows, golden=1640531527)[0] and sum(changed[k] != first[k] for k in first) > 200


def test_points_of_late_slots_stay_within_64_bits(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, 65535, 65536, 2**32 - 1, 2**32 + 5, 10**12 + 7]
    half = F.lit(1 << 16)
    high = F.pmod(F.pmod(F.shiftright("id", 16), half) * F.lit(mixing.GOLDEN), half) * half
    points = spark.createDataFrame([(i,) for i in ids], "id long").select(F.pmod(F.pmod("id", half) * F.lit(mixing.GOLDEN) + high, F.lit(mixing.UNIT)).alias("p")).collect()
    assert [r.p for r in points] == [i * mixing.GOLDEN % 2**32 for i in ids]


def test_rows_that_share_a_key_are_separate_documents(spark):
    rows = [(1, "a " * 30, "s"), (1, "b " * 30, "s"), (1, "c " * 500, "t"), (None, "d " * 40, "s"), (None, "e " * 40, "s"), (None, "f", None), (2, "g " * 900, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = sorted((r.doc_id is None, r.size, r.taken) for r in mixing.mix(df).collect())
    words = {}
    for r in mixing.apply_mix(df).collect():
        words[r.text.split()[0]] = words.get(r.text.split()[0], 0) + len(r.text.split())
    assert sorted(words.values()) == sorted(t for _, _, t in takes if t)
