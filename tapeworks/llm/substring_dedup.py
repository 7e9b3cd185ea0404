"""Substring deduplication by recompression.

Every document is parsed by rounds of recompression (``recompression``), which give equal word sequences equal symbols in their
interior. Each window of so many words chooses an anchor among the symbol cuts whose context lies within it, so equal windows
have anchors of one name. Documents are posted under their anchors' names, with the hashes of the windows that chose them. Below one
name, sorted by document, every window hash that came from a smaller document is a verified repeat.

A name that many documents have is dealt to several groups by document. Each group settles all but the first document of each
window there; those firsts, at most one for each group, meet in a second round that is dealt by name and window hash, so that however many
documents and windows a name has, no more than HOT_GROUPS rows come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.recompression import anchors
from tapeworks.llm.scratch import Scratch
from tapeworks.llm.words import Words, mix, steps

WINDOW = 13
#: Documents that are looked at for names that many documents have, the share of them that makes a name a hot one, and the groups it is dealt to.
SAMPLE, HOT_SHARE, HOT_GROUPS = 4000, 0.01, 64
HASH_BYTES = 6
POSTS = "grp long, name long, doc long, places binary, hashes binary"
MARKS = "doc long, places binary, bits binary, open boolean, name long, hashes binary"
FIRSTS = "name long, hash long, doc long, places binary"


def rounds_for(window: int) -> int:
    """So many rounds that most windows hold a whole cut of the last one."""
    return max(1, window.bit_length() - 2)


def posts(batches: Iterator[pa.RecordBatch], window: int, hot: np.ndarray, key: str, text: str) -> Iterator[pa.RecordBatch]:
    """One row for each anchor name of a document and each set of windows that chose it: the name's group, the name, the document, the hashes of the
    windows, and the places (first windows) of all occurrences. What a document repeats within itself so is one row.
    """
    for batch in steps(batches, text):
        words = Words(batch.column(batch.schema.get_field_index(text)))
        if not len(words.hash):
            continue
        windows, names, new = anchors(words, window, rounds_for(window))
        if not len(windows):
            continue
        new[1:] |= windows[1:] != windows[:-1] + 1
        doc = np.searchsorted(words.first, windows, side="right") - 1
        ids = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        sums = words.sums()
        hashes = sums.of(windows, windows + window).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        head = np.flatnonzero(new)
        ends = np.append(head[1:], len(windows))
        spans = sums.of(windows[head], windows[ends - 1] + window)
        same = mix(spans ^ mix(names[head] + mix(doc[head].astype(np.uint64))))
        order = np.argsort(same, kind="stable")
        first = np.append(True, same[order][1:] != same[order][:-1])
        places = (windows[head] - words.first[doc[head]]).astype(np.int32)[order]
        head, ends = head[order[first]], ends[order[first]]
        by_place = np.argsort(head)
        cuts = np.append(np.flatnonzero(first), len(order)).astype(np.int32) * 4
        at = ids[doc[head]].astype(np.int64)
        name = names[head]
        group = name.copy()
        if len(hot):
            here = hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name
            group[here] = mix(name[here] + mix(at[here].astype(np.uint64)) % np.uint64(HOT_GROUPS) + np.uint64(1))
        sizes = ends - head
        rows = np.repeat(head, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        offsets = np.append(0, np.cumsum(sizes)) * HASH_BYTES
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(group.view(np.int64)),
                pa.array(name.view(np.int64)),
                pa.array(at),
                pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(cuts), pa.py_buffer(places)]),
                pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(hashes[rows]))]),
            ],
            names=["grp", "name", "doc", "places", "hashes"],
        )
        yield out.take(pa.array(by_place))


def settle(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by name, group and document. Marks each window whose hash a smaller document of the same group has.

    Kept from batch to batch: of the last group its distinct windows with their smallest documents.
    """
    last, kept_hash, kept_doc = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group, name, doc = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
        packed = batch.column(4)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, HASH_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :HASH_BYTES] = raw
        hashes = wide.view(np.uint64)[:, 0]
        counts = np.diff(offsets) // HASH_BYTES
        row = np.repeat(np.arange(n), counts)
        part = np.append(True, group[1:] != group[:-1]).cumsum()
        was = part[0] if group[0] == last else 0
        order_part = np.concatenate([np.full(len(kept_hash), was), part[row]])
        all_hash, all_doc = np.concatenate([kept_hash, hashes]), np.concatenate([kept_doc, doc[row]])
        tag = mix(all_hash + mix(order_part.astype(np.uint64)))
        order = np.lexsort((all_doc, tag))
        sorted_tag, sorted_doc = tag[order], all_doc[order]
        heads = np.flatnonzero(np.append(True, sorted_tag[1:] != sorted_tag[:-1]))
        lengths = np.diff(np.append(heads, len(order)))
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(sorted_doc[heads], lengths)
        final = order[heads][order_part[order[heads]] == part[-1]]
        marked = (all_doc > least)[len(kept_hash) :]
        last, kept_hash, kept_doc = group[-1], all_hash[final], least[final]
        starts = np.cumsum(counts) - counts
        any_marked = np.logical_or.reduceat(marked, starts)
        all_marked = np.logical_and.reduceat(marked, starts)
        is_hot = hot[np.minimum(np.searchsorted(hot, name.view(np.uint64)), len(hot) - 1)] == name.view(np.uint64) if len(hot) else np.zeros(n, bool)
        still = is_hot & ~all_marked
        out = np.flatnonzero(any_marked | still)
        if not len(out):
            continue
        bits = [marked[starts[i] : starts[i] + counts[i]].astype(np.uint8).tobytes() for i in out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[out]), batch.column(3).take(pa.array(out)), pa.array(bits, pa.binary()), pa.array(still[out]), pa.array(name[out]), packed.take(pa.array(out)).cast(pa.binary()) if still.any() else pa.nulls(len(out), pa.binary())],
            names=["doc", "places", "bits", "open", "name", "hashes"],
        )


def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window that isn't marked: its name and hash, the document, and where it begins."""
    for batch in batches:
        for doc, places, bits, name, hashes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            left = np.flatnonzero(np.frombuffer(bits, np.uint8) == 0)
            at = np.frombuffer(places, np.int32)
            wide = np.zeros((len(left), 8), np.uint8)
            wide[:, :HASH_BYTES] = np.frombuffer(hashes, np.uint8).reshape(-1, HASH_BYTES)[left]
            begins = (left[:, None].astype(np.int32) + at[None, :]).astype(np.int32)
            cuts = (np.arange(len(left) + 1) * 4 * len(at)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(left), name)), pa.array(wide.view(np.int64)[:, 0]), pa.array(np.full(len(left), doc)), pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(begins))])],
                names=["name", "hash", "doc", "places"],
            )


def hot_names(docs: DataFrame, window: int, key: str, text: str) -> np.ndarray:
    """Names that at least HOT_SHARE of a bounded sample of documents have. They decide how work is dealt, never what comes out."""
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / total)) + 1)
    none = np.zeros(0, np.uint64)
    found = (
        some.mapInArrow(lambda it: posts(it, window, none, key, text), POSTS)
        .groupBy("name")
        .agg(F.countDistinct("doc").alias("n"))
        .where(F.col("n") >= max(8, int(HOT_SHARE * min(SAMPLE, total))))
        .select("name")
        .collect()
    )
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, marks: array of (places, bits)): bit i of a mark is 1 where the windows at words place + i also start in a smaller document.

    Null and empty texts, and texts of fewer words than a window, have no windows. Rows without a key take no part. Rows that share a key count
    as one document: a window that only they share is no repeat, and each loses what any of them does.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    hot = hot_names(docs, window, "doc_id", "text")
    found = docs.mapInArrow(lambda it: posts(it, window, hot, "doc_id", "text"), POSTS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = found.repartition(n, "grp").sortWithinPartitions("grp", "doc").mapInArrow(lambda it: settle(it, hot), MARKS)
    marks = scratch.keep(marks, "marks")
    settled = marks.select("doc", "places", "bits")
    if len(hot):
        firsts = marks.where("open").select("doc", "places", "bits", "name", "hashes").mapInArrow(unmarked, FIRSTS)
        least = F.min("doc").over(Window.partitionBy("name", "hash"))
        again = firsts.withColumn("least", least).where("doc > least").select("doc", "places", F.lit(b"\x01").alias("bits"))
        settled = settled.unionByName(again)
    return settled.groupBy("doc").agg(F.collect_list(F.struct("places", "bits")).alias("marks"))


def removed(n: int, window: int, marks: list) -> np.ndarray:
    """Which of n words a marked window covers."""
    change = np.zeros(n + 1, np.int32)
    for mark in marks or ():
        at = np.flatnonzero(np.frombuffer(mark["bits"], np.uint8))
        at = (np.frombuffer(mark["places"], np.int32)[:, None] + at).ravel()
        at = at[at + window <= n]
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def kept_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            gone = removed(len(words), window, marks) if marks else None
            gone = gone if gone is not None and gone.any() else None
            kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined := b" ".join(kept)).hexdigest(), joined.decode("utf-8", "replace") if gone is not None else text))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), a row for each row of docs.

    ``kept`` is the text without the words that a repeated window covers, joined by one space; where nothing goes, the text as it was.
    A null text has no words. Rows without a key are kept whole. Columns beside key and text are ignored, whatever their names.
    """
    found = repeats(docs, window, key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = rows.join(found, rows.doc_id == found.doc, "left").select("doc_id", "text", "marks")
    return both.mapInArrow(lambda it: kept_rows(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def strip_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the text that dedup() keeps, and all other columns as they are."""
    found = repeats(docs, window, key, text).select(F.col("doc").alias("_marks_doc"), F.col("marks").alias("_marks"))
    both = docs.join(found, F.col(key).cast("long") == F.col("_marks_doc"), "left").select(*docs.columns, "_marks")
    place, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            # only marked rows lose anything
            for k in np.flatnonzero(batch.column(width).is_valid().to_numpy(zero_copy_only=False)).tolist():
                words = (texts[k] or "").encode("utf-8", "surrogatepass").split()
                gone = removed(len(words), window, batch.column(width)[k].as_py()).tolist()
                if any(gone):
                    texts[k] = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode("utf-8", "replace")
            columns = [pa.array(texts, batch.schema.field(j).type) if j == place else batch.column(j) for j in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return both.mapInArrow(run, docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS s FROM w, range(1, greatest(len(ws) - 12, 0) + 1) r(p)
), bad AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE lo < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM bad) GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(qs), 0) AS g,
    array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(qs, i)), lambda i: ws[i]) END, ' ') AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
