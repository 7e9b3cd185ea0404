"""A quality classifier from weak labels.

Overlapping heuristic labellers look at a text and vote good, bad or nothing. Expectation-maximisation over the counts of all documents' vote patterns
estimates how often each labeller's votes are good and bad for good texts and for each kind of bad ones (a vote for nothing says nothing), and from that each pattern's posterior. Bad texts are bad
in different ways, each of which some labellers see together; so there may be several kinds, as many as the votes bear out. The posteriors of a bounded sample
of documents (about SAMPLE, by a hash of the key) train a linear scorer on hashed words and character-class trigrams, which scores every whole text. No
given label is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.scratch import bounded_batches
from tapeworks.llm.words import Words, mix, steps

SAMPLE, SLOTS, THRESHOLD = 10000, 1 << 14, 0.5
GOOD, BAD, NOTHING = 1, 0, 2
#: The labellers are built to vote bad on good texts hardly ever: the expected rate, and the weight of this belief as a share of all texts and in texts.
FALSE_ALARMS, SURE, SURE_TEXTS = 0.002, 0.02, 500
BINS = 10
#: How much words weigh beside character classes.
WORD_SCALE = 0.3
LABELLERS = ("symbols", "capitals", "exclamations", "repeats", "sentences", "letterless", "word_length", "length")


def _class_table() -> np.ndarray:
    """Classes of bytes: space, line end, small, capital, digit, beyond ASCII, and each sign for itself."""
    table = np.zeros(256, np.uint8)
    table[:32] = 1
    for k in (10, 11, 12, 13):
        table[k] = 2
    table[32] = 1
    table[97:123], table[65:91], table[48:58], table[128:] = 3, 4, 5, 6
    signs = [k for k in range(33, 127) if not chr(k).isalnum()]
    table[signs] = 7 + np.arange(len(signs))
    return table


CLASSES = _class_table()
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#$%&*|<>{}[]^~=_+\\@"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:?!"]] = True


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(float)


def distinct_share(words: Words) -> np.ndarray:
    """The share of each text's three-word sequences, or of its words if there are fewer than 20, that are distinct; 1 without any."""
    sums = words.sums()
    three = sums.of(np.arange(max(0, len(words.hash) - 2)), np.arange(max(0, len(words.hash) - 2)) + 3)
    out = np.ones(len(words.first) - 1)
    for t, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a >= 20:
            out[t] = len(np.unique(three[a : b - 2])) / (b - a - 2)
        elif b > a:
            out[t] = len(np.unique(words.hash[a:b])) / (b - a)
    return out


def votes(words: Words) -> np.ndarray:
    """A row of votes, one for each labeller, for each text."""
    data, n_texts = words.data, len(words.offsets) - 1
    size = np.maximum(1, np.diff(words.offsets)).astype(float)
    n = np.diff(words.first).astype(float)
    some = np.maximum(1, n)
    letters = _per_text(_LETTERS[data], words.offsets)
    capitals = _per_text((data >= 65) & (data < 91), words.offsets)
    has_letter = np.zeros(len(words.start), bool)
    if len(words.start):
        ends = np.concatenate([[0], np.cumsum(_LETTERS[data])])
        has_letter = ends[words.end] > ends[words.start]
    stop = _STOPS[data[words.end - 1]] if len(words.start) else np.zeros(0, bool)
    distinct = distinct_share(words)

    def by(x, bad, good, when=True):
        return np.where(when, np.where(bad(x), BAD, np.where(good(x), GOOD, NOTHING)), NOTHING)

    out = [
        by(_per_text(_SIGNS[data], words.offsets) / size, lambda x: x > 0.04, lambda x: x < 0.01),
        by(capitals / np.maximum(1, letters), lambda x: x > 0.35, lambda x: x < 0.12, letters >= 20),
        by(_per_text(data == 33, words.offsets) / some, lambda x: x > 0.15, lambda x: x < 0.02),
        by(distinct, lambda x: x < 0.6, lambda x: x > 0.9, n >= 8),
        by(_per_text(stop, words.first) / some, lambda x: (x < 0.01) | (x > 0.6), lambda x: (x > 0.03) & (x < 0.35), n >= 20),
        by(_per_text(~has_letter, words.first) / some, lambda x: x > 0.2, lambda x: x < 0.05, n >= 10),
        by(letters / some, lambda x: (x < 2) | (x > 14), lambda x: (x > 3) & (x < 9)),
        by(n, lambda x: x < 1, lambda x: x > 30),
    ]
    return np.stack(out, axis=1).astype(np.int8)


def _damped(slots: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(slots, return_counts=True)
    value = np.log1p(count)
    return at, scale * value / max(1e-9, float(np.sqrt((value * value).sum())))


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's (slots, values): hashed words, and trigrams of character classes (runs of one class as one), each sort's counts damped and scaled to
    one length; and one slot of weight 1 for how much of the text repeats itself."""
    classes = CLASSES[words.data]
    new = np.ones(len(classes), bool)
    new[1:] = classes[1:] != classes[:-1]
    cuts = words.offsets[:-1][np.diff(words.offsets) > 0]
    new[cuts] = True
    kept = classes[new].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(new)])[words.offsets]

    codes = kept[:-2] * np.uint64(1 << 16) + kept[1:-1] * np.uint64(1 << 8) + kept[2:] if len(kept) > 2 else np.zeros(0, np.uint64)
    of_classes, of_words = (mix(codes) % np.uint64(SLOTS)).astype(np.int64), SLOTS + (mix(words.hash) % np.uint64(SLOTS)).astype(np.int64)
    share = np.minimum(BINS - 1, distinct_share(words) * BINS).astype(np.int64)
    out = []
    for a, b, c, d, bin_ in zip(first[:-1].tolist(), first[1:].tolist(), words.first[:-1].tolist(), words.first[1:].tolist(), share.tolist(), strict=True):
        parts = [_damped(of_classes[a : max(a, b - 2)], 1.0), _damped(of_words[c:d], WORD_SCALE)]
        out.append((np.concatenate([*(p[0] for p in parts), [2 * SLOTS + bin_]]), np.concatenate([*(p[1] for p in parts), [1.0]])))
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, kinds: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pattern's probability of good, tables[labeller, class, vote], and the classes' shares, by expectation-maximisation with one class of good texts (the first) and so many kinds of bad ones.

    Within a class labellers vote independently. With several kinds each begins with the texts that one labeller calls bad, the labellers with most such votes first. That labellers rarely
    accuse good texts is a prior belief of the weight of SURE_TEXTS and SURE of all texts, which the votes can overrule.
    """
    m, n = patterns.shape[1], max(1.0, float(counts.sum()))
    bad = patterns == BAD
    resp = np.zeros((len(patterns), kinds + 1))
    if kinds == 1:
        resp[:, 0] = np.where(bad.any(1), 0.5 ** bad.sum(1), 0.95)
        resp[:, 1] = 1 - resp[:, 0]
    else:
        resp[:, 0] = np.where(bad.any(1), 0.3, 0.95)
        seeds = np.argsort(-(bad * counts[:, None]).sum(0), kind="stable")[:kinds]
        resp[:, 1:] = np.where(bad[:, seeds], 0.7, 0.0) + 0.05 / kinds
        resp /= resp.sum(1, keepdims=True)
    belief = np.array([FALSE_ALARMS, 1 - FALSE_ALARMS]) * (SURE * n + SURE_TEXTS) + 0.5
    tables, before = np.ones((m, kinds + 1, 3)), -np.inf
    for _ in range(rounds):
        weight = resp * counts[:, None]
        total = 0.0
        for j in range(m):
            for c in range(kinds + 1):
                prior = belief if c == 0 else np.array([0.5, 0.5])
                votes_ = np.bincount(patterns[:, j], weights=weight[:, c], minlength=3)[:2] + prior
                tables[j, c, :2] = votes_ / votes_.sum()
                total += float((prior * np.log(tables[j, c, :2])).sum())
        shares = (weight.sum(0) + 1) / (n + kinds + 1)
        log = np.stack([np.log(tables[np.arange(m), c, patterns]).sum(1) for c in range(kinds + 1)], axis=1) + np.log(shares)  # a vote for nothing adds log 1
        top = log.max(1, keepdims=True)
        parts = np.exp(log - top)
        total += float((counts * (top[:, 0] + np.log(parts.sum(1)))).sum())
        resp = parts / parts.sum(1, keepdims=True)
        if abs(total - before) < 1e-9 * abs(total):
            break
        before = total
    return resp[:, 0], tables, shares


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pattern's probability of good, and tables[labeller, BAD or GOOD, vote], of the fit with as many kinds of bad texts as there are labellers.

    Most texts are taken to be good: a fit that calls fewer than half of them so, as where labellers accuse at random, gives way to one with fewer kinds.
    """
    m = patterns.shape[1] if patterns.size else len(LABELLERS)
    posterior, tables, shares = np.zeros(0), np.ones((m, 2, 3)), np.ones(2)
    for kinds in range(m if len(patterns) else 0, 0, -1):
        posterior, tables, shares = fit(patterns, counts, kinds)
        if counts[posterior >= 0.5].sum() >= 0.5 * counts.sum():
            break
    bad = (tables[:, 1:] * shares[None, 1:, None]).sum(1) / shares[1:].sum()
    return posterior, np.stack([bad, tables[:, 0]], axis=1)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Weights of logistic regression on soft labels, by stochastic steps with per-slot rates; the last weight is the constant."""
    weights, seen = np.zeros(2 * SLOTS + BINS + 1), np.full(2 * SLOTS + BINS + 1, 1e-6)
    rng = np.random.default_rng(11)
    good, bad = max(1e-9, labels.sum()), max(1e-9, (1 - labels).sum())
    balance = labels * (len(labels) / (2 * good)) + (1 - labels) * (len(labels) / (2 * bad))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            z = weights[at] @ value + weights[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[k]) * min(20.0, balance[k])
            step = g * value
            seen[at] += step * step
            weights[at] -= rate * step / np.sqrt(seen[at])
            seen[-1] += g * g
            weights[-1] -= rate * g / np.sqrt(seen[-1])
    return weights


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, votes, weak_score, score, kept), a row for each row of docs: the votes as a string of 0 (bad), 1 (good), 2 (nothing), the pattern's
    posterior, the scorer's probability of good, and whether it reaches the threshold. A null or empty text has score 0 and isn't kept; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            v = votes(Words(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string())], names=["votes"])

    # at most three to the power of the number of labellers rows, whatever the corpus
    table = rows.where("length(text) > 0").mapInArrow(vote, "votes string").groupBy("votes").count().orderBy("votes").collect()
    patterns = np.array([[int(c) for c in r["votes"]] for r in table], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([r["count"] for r in table], float)
    posterior, _ = estimate(patterns, counts)
    known = {r["votes"]: float(p) for r, p in zip(table, posterior, strict=True)}
    share = min(1.0, sample / max(1.0, counts.sum()))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = Words(batch.column(1))
            v = ["".join(map(str, r)) for r in votes(words).tolist()]
            f = features(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.get(x, 0.5) for x in v]), pa.array([a.astype("<u2").tobytes() for a, _ in f], pa.binary()), pa.array([b.astype("<f2").tobytes() for _, b in f], pa.binary())], names=["doc_id", "label", "slots", "values"])

    chosen = rows.where("length(text) > 0").where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = chosen.mapInArrow(examples, "doc_id long, label double, slots binary, values binary").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    weights = train([(np.frombuffer(a, "<u2"), np.frombuffer(b, "<f2").astype(float)) for a, b in zip(got.column("slots").to_pylist(), got.column("values").to_pylist(), strict=True)], got.column("label").to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words = Words(batch.column(1))
            empty = np.diff(words.offsets) == 0
            v = ["".join(map(str, r)) for r in votes(words).tolist()]
            z = np.array([weights[a] @ b + weights[-1] for a, b in features(words)])
            p = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            weak = np.where(empty, 0.0, [known.get(x, 0.5) for x in v])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.string()), pa.array(weak), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "votes", "weak_score", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, votes string, weak_score double, score double, kept boolean")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
