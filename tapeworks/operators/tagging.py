"""A part-of-speech tagger of n-gram statistics, and a guesser of unknown words' tags by affixes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE = "#"


def tag_statistics(tokens: DataFrame, sequence: str, position: str, tag: str) -> dict[str, DataFrame]:
    """(t1, t2, t3, n), (t1, t2, n) and (t1, n) counts of tag trigrams, bigrams and unigrams within sequences."""
    w = Window.partitionBy(sequence).orderBy(position)
    grams = tokens.select(F.coalesce(F.lag(tag, 2).over(w), F.lit(EDGE)).alias("t1"), F.coalesce(F.lag(tag).over(w), F.lit(EDGE)).alias("t2"), F.col(tag).alias("t3"))
    return {
        "trigrams": grams.groupBy("t1", "t2", "t3").agg(F.count("*").alias("n")),
        "bigrams": grams.groupBy(F.col("t2").alias("t1"), F.col("t3").alias("t2")).agg(F.count("*").alias("n")),
        "unigrams": grams.groupBy(F.col("t3").alias("t1")).agg(F.count("*").alias("n")),
    }


def word_statistics(tokens: DataFrame, word: str, tag: str) -> DataFrame:
    return tokens.groupBy(F.col(word).alias("word"), F.col(tag).alias("tag")).agg(F.count("*").alias("n"))


def penalties(counts: DataFrame, given: Sequence[str]) -> DataFrame:
    """Counts as negative logarithms of their share among rows that agree in ``given``."""
    total = F.sum("n").over(Window.partitionBy(*given)) if given else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("weight", -F.log(F.col("n") / total))


def train(tokens: DataFrame, sequence: str, position: str, word: str, tag: str) -> dict:
    """The statistics as a model: tag counts, which are as few as the tag set's pairs, for the driver; words and their tags as a table."""
    stats = tag_statistics(tokens, sequence, position, tag)
    tags = {r.t1: r.n for r in stats["unigrams"].collect()}
    bigrams = {(r.t1, r.t2): r.n for r in stats["bigrams"].collect() if r.t2 in tags}
    words = word_statistics(tokens, word, tag)
    return {"tags": tags, "bigrams": bigrams, "words": words, "total": sum(tags.values())}


def decode(tokens: DataFrame, model: dict, lexicon: dict[str, dict[str, int]], sequence: str, position: str, word: str) -> DataFrame:
    """(sequence, position, word, tag): each sequence's best tags by the Viterbi algorithm. ``lexicon``: tag counts of known words."""
    tags, bigrams, total = model["tags"], model["bigrams"], max(1, model["total"])
    follow = {}
    for (a, b), n in bigrams.items():
        follow[a] = follow.get(a, 0) + n

    def step(a: str, b: str) -> float:
        return -math.log((bigrams.get((a, b), 0) + 0.5 * tags[b] / total) / (follow.get(a, 0) + 0.5))

    def emit(w: str, t: str) -> float:
        known = lexicon.get(w)
        if known is None:
            return -math.log(1 / (tags[t] + 1))
        return -math.log((known.get(t, 0) + 1e-6) / (tags[t] + 1e-6))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", kind="stable")
        ways: dict[str, tuple[float, tuple]] = {EDGE: (0.0, ())}
        for w in pdf["word"]:
            options = [t for t in lexicon.get(w, tags) if t in tags] or list(tags)
            ways = {t: min((cost + step(a, t) + emit(w, t), (path, t)) for a, (cost, path) in ways.items()) for t in sorted(options)}
        path, out = min(ways.values())[1], []
        while path:
            path, t = path
            out.append(t)
        return pdf.assign(tag=out[::-1])

    rows = tokens.select(F.col(sequence).cast("string").alias("sequence"), F.col(position).cast("long").alias("position"), F.col(word).cast("string").alias("word"))
    return rows.groupBy("sequence").applyInPandas(best, "sequence string, position long, word string, tag string")


def affix_table(words: DataFrame, word: str, tag: str, longest: int = 5, prefix: bool = False) -> DataFrame:
    """(affix, tag, n): how often words that end (begin) in an affix have a tag."""
    c = F.col(word)
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(c)))
    rows = words.where(F.length(c) > 0).select(F.explode(sizes).alias("k"), c.alias("w"), F.col(tag).alias("tag"))
    affix = F.expr("substring(w, 1, k)") if prefix else F.expr("right(w, k)")
    return rows.select(affix.alias("affix"), "tag").groupBy("affix", "tag").agg(F.count("*").alias("n"))


def guess(words: DataFrame, table: DataFrame, word: str, n: int = 3, longest: int = 5, prefix: bool = False) -> DataFrame:
    """(word, tag, weight, rank): for each distinct word the n likeliest tags of its longest known affix."""
    c = F.col("word")
    rows = words.select(F.col(word).alias("word")).where(F.length(word) > 0).distinct()
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(c)))))
    rows = rows.withColumn("affix", F.expr("substring(word, 1, k)") if prefix else F.expr("right(word, k)"))
    met = rows.join(table, "affix")
    top = met.groupBy("word").agg(F.max("k").alias("_top"))
    met = met.join(top, "word").where(F.col("k") == F.col("_top"))
    share = -F.log(F.col("n") / F.sum("n").over(Window.partitionBy("word")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("weight", "tag"))
    return met.withColumn("weight", share).withColumn("rank", rank).where(F.col("rank") <= n).select("word", "tag", "weight", "rank")


def lexicon_of(words: DataFrame, most: int = 200_000) -> dict[str, dict[str, int]]:
    """The commonest words' tag counts, at most so many rows: what a decoder keeps on each worker."""
    out: dict[str, dict[str, int]] = {}
    for r in words.orderBy(F.col("n").desc(), "word", "tag").limit(most).collect():
        out.setdefault(r.word, {})[r.tag] = r.n
    return out


# the tagger of files: sentences are lines "word<tab>tag", a blank line ends one


def read_sentences(text: str) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = [[]]
    for line in text.splitlines():
        if line.strip():
            word, _, tag = line.partition("\t")
            out[-1].append((word, tag.strip()))
        elif out[-1]:
            out.append([])
    return [s for s in out if s]


def build(text: str) -> dict:
    """Counts of tag trigrams, bigrams and unigrams, and of each word's and each ending's tags."""
    model: dict = {"trigrams": {}, "bigrams": {}, "unigrams": {}, "words": {}, "endings": {}}

    def count(table: dict, *keys: str) -> None:
        for k in keys[:-1]:
            table = table.setdefault(k, {})
        table[keys[-1]] = table.get(keys[-1], 0) + 1

    for sentence in read_sentences(text):
        before = (EDGE, EDGE)
        for word, tag in sentence:
            count(model["trigrams"], " ".join(before), tag)
            count(model["bigrams"], before[1], tag)
            count(model["unigrams"], tag)
            count(model["words"], word, tag)
            for k in range(1, min(5, len(word)) + 1):
                count(model["endings"], word[-k:], tag)
            before = (before[1], tag)
    return model


def reweight_model(model: dict, factor: float = 1.0, addition: float = 0.0) -> dict:
    """The model with every count c of words and endings as factor * c + addition."""
    turn = lambda table: {w: {t: factor * n + addition for t, n in tags.items()} for w, tags in table.items()}
    return model | {"words": turn(model["words"]), "endings": turn(model["endings"])}


def tag_words(model: dict, words: Sequence[str]) -> list[str]:
    """The best tags by trigrams, backed off to bigrams and unigrams; an unknown word has the tags of its longest known ending, or all."""
    total = max(1, sum(model["unigrams"].values()))

    def share(table: dict, key: str, tag: str) -> float:
        found = table.get(key, {})
        return found.get(tag, 0) / sum(found.values()) if found else 0.0

    def step(a: str, b: str, tag: str) -> float:
        return -math.log(0.6 * share(model["trigrams"], f"{a} {b}", tag) + 0.3 * share(model["bigrams"], b, tag) + 0.1 * model["unigrams"].get(tag, 0) / total + 1e-9)

    ways: dict[tuple[str, str], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    for w in words:
        tags = model["words"].get(w) or next((model["endings"][w[k:]] for k in range(len(w)) if w[k:] in model["endings"]), model["unigrams"])
        size, after = sum(tags.values()), {}
        for t, n in sorted(tags.items()):
            cost = -math.log(max(n, 1e-9) / size) + math.log(max(1, model["unigrams"].get(t, 0)) / total)
            for (a, b), (w0, path) in ways.items():
                total_cost = w0 + step(a, b, t) + cost
                if total_cost < after.get((b, t), (math.inf,))[0]:
                    after[b, t] = (total_cost, (path, t))
        ways = after or ways
    path, out = min(ways.values())[1], []
    while path:
        path, t = path
        out.append(t)
    return out[::-1]
