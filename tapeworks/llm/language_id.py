"""Language identification with a byte convolutional network.

The network is trained on a bounded sample of labelled documents: about DOCS_EACH for each language, chosen by a hash of the key, and of each up to
WINDOWS_EACH windows spread evenly over its whole text. It is applied to every window of every text; a text's probabilities are
the means over its windows, weighted by their bytes. Text alone is read; language, source and key are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import byte_cnn
from tapeworks.llm.scratch import Scratch, bounded_batches
from tapeworks.llm.words import steps

#: Bounds of the training sample: documents of each language, and of all languages, windows of each document.
DOCS_EACH, DOCS_ALL, WINDOWS_EACH = 500, 20_000, 12
UNKNOWN = "und"
#: keep_languages() rejects a text of at least LONG characters with a score below LEAST. The score of a shorter one says little, so that only what has no letter goes.
LEAST, LONG = 0.5, 400


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def examples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        cut, text, own = byte_cnn.windows(*_bytes(batch.column(1)))
        counts = np.bincount(text, minlength=batch.num_rows)
        place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        every = np.maximum(1, -(-counts // most))[text]
        rows = np.flatnonzero((place % every == 0) & (own >= 16))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[rows])), batch.column(2).take(pa.array(text[rows])), pa.array(place[rows]), pa.array([x.tobytes() for x in cut[rows]], pa.binary())], names=["doc_id", "lang", "place", "cut"])


def train(labelled: DataFrame, docs_each: int = DOCS_EACH, windows_each: int = WINDOWS_EACH) -> tuple[byte_cnn.Network | None, list[str]]:
    """The network and its languages, from rows (doc_id, text, lang); none without a usable row. The same rows give the same network."""
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    # a table of one row for each language: its size is known before the texts are read, so no text is dealt out to meet it
    counts = Scratch(labelled.sparkSession, "languages").keep(labelled.groupBy("lang").count(), "counts")
    docs_each = min(docs_each, max(1, DOCS_ALL // max(1, counts.count())))
    share = F.least(F.lit(1.0), F.lit(float(docs_each)) / F.col("count"))
    chosen = labelled.join(counts, "lang").where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = chosen.select("doc_id", "text", "lang").mapInArrow(lambda it: examples(it, windows_each), "doc_id long, lang string, place long, cut binary").toArrow()
    rows = rows.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("place", "ascending"), ("cut", "ascending")])
    if not rows.num_rows:
        return None, []
    languages = sorted(set(rows.column("lang").to_pylist()))
    cut = np.frombuffer(b"".join(rows.column("cut").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    labels = np.array([languages.index(x) for x in rows.column("lang").to_pylist()])
    return byte_cnn.train(cut, labels, len(languages)), languages


def predictions(batches: Iterator[pa.RecordBatch], net: byte_cnn.Network | None, languages: list[str]) -> Iterator[pa.RecordBatch]:
    tables = net.tables() if net else None
    for batch in steps(batches):
        n = batch.num_rows
        has_letter = np.array([bool(t) and any(c.isalpha() for c in t) for t in batch.column(1).to_pylist()], bool)
        chosen, score = np.full(n, -1), np.zeros(n)
        if net:
            cut, text, own = byte_cnn.windows(*_bytes(batch.column(1)))
            total = np.zeros((n, len(languages)))
            np.add.at(total, text, net.predict(cut, tables) * own[:, None])
            mean = total / np.maximum(1e-9, total.sum(axis=1, keepdims=True))
            chosen, score = np.where(has_letter, mean.argmax(axis=1), -1), np.where(has_letter, mean.max(axis=1), 0.0)
        names = [languages[k] if k >= 0 else UNKNOWN for k in chosen.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs.

    Learns from the rows of ``labelled``, or of docs itself, that aren't held out and have a language. A null text, one without a letter, and any text when
    nothing could be learned, give ``und`` with score 0. Columns beside key, text and lang are ignored.
    """
    source = docs if labelled is None else labelled
    source = source.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    net, languages = train(source.where(~held_out()))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return rows.mapInArrow(lambda it: predictions(it, net, languages), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, languages: list[str] | None = None, least: float = LEAST, long: int = LONG, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose text is predicted to be in one of the languages (None: any learned one), a null language replaced by the prediction.

    What has no letter goes, and texts of at least ``long`` characters with a score below ``least``.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    net, learned = train(source.where(~held_out()))
    wanted, place, named = set(learned if languages is None else languages), docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            texts = batch.column(place).cast(pa.string())
            sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            bare = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts, pa.nulls(batch.num_rows, pa.bool_())], names=["doc_id", "text", "held_out"])
            for found in predictions(iter([bare]), net, learned):
                names, scores = found.column(2), found.column(3).to_numpy()
                sure = (scores >= least) | (sizes[begin : begin + found.num_rows] < long)
                good = [bool(s) and n in wanted for n, s in zip(names.to_pylist(), sure, strict=True)]
                rows = batch.slice(begin, found.num_rows)
                columns = [c if k != named else pc.coalesce(c, names.cast(c.type)) if pa.types.is_string(c.type) else c for k, c in enumerate(rows.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(good, pa.bool_()))
                begin += found.num_rows

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
