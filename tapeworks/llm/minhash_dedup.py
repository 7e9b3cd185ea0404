"""Near-duplicates: a signature-coordinate inverted join of MinHash signatures, confirmed on full shingle sets.

Documents with one shingle set form a class with one representative. A representative's signature has K coordinates; a document is posted under
the pairs (coordinate, value). Two sets of similarity s agree in K * s coordinates on average; a pair is a candidate from MATCHES agreements on.
Such a pair must meet in the first K - MATCHES + 1 pairs of any common order (prefix merging), so a document is posted only under that many of its
pairs, the rarest in the corpus, and skips those that no other document has. In a list everybody first meets a few hosts: the member whose pairs are
the most common ones, and one that a hash chooses. Links so found join into components. After that the members of a list are compared in blocks, on long
sketches, wherever they lie in different components, each pair in one of its lists only; what agrees enough is counted on the full sets, so that none is lost.
Two blocks at a time are dealt out, so that a list of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.components import components
from tapeworks.llm.scratch import Scratch
from tapeworks.llm.words import Words, mix, steps

WORDS, PERCENT = 4, 80
#: Coordinates, and the agreements from which a pair is counted as a candidate: at similarity 0.8, 38 of 64 are missed with probability 3e-5.
K, MATCHES = 64, 38
#: A sketch is a longer signature of bytes. At similarity 0.8, 768 of 1024 agreements are missed with probability 3e-5.
SKETCH, SKETCH_MATCHES = 1024, 768
BLOCK, MEMBERS, ORDERS = 4096, 512, 8
_SEEDS = mix(np.arange(1, 2 * (K + SKETCH) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, SHIFTS = _SEEDS[: K + SKETCH] | np.uint64(1), _SEEDS[K + SKETCH :]
SIGNED = "doc_id long, n_shingles long, set_name binary, signature binary"


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    sums = words.sums()
    n = len(words.hash)
    all_hashes = sums.of(np.arange(max(0, n - size + 1)), np.arange(max(0, n - size + 1)) + size)
    for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - first >= size:
            yield np.unique(all_hashes[first : end - size + 1])
        elif end > first:
            yield sums.of(np.array([first]), np.array([end]))
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, begin: int = 0, end: int = K) -> np.ndarray:
    least = np.full(end - begin, np.uint64((1 << 64) - 1))
    for k in range(0, len(hashes), BLOCK):
        x = hashes[k : k + BLOCK][:, None] * FACTORS[begin:end] + SHIFTS[begin:end]
        np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> bytes:
    return signature(hashes, K, K + SKETCH).astype(np.uint8).tobytes()


def sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        counts, names, signatures = [], [], []
        for hashes in shingle_sets(Words(batch.column(1), lower=True), size):
            counts.append(len(hashes))
            names.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            signatures.append(signature(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_name", "signature"])


def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, pair) for each coordinate: the coordinate in the upper half of pair, its value in the lower."""
    place = np.arange(K, dtype=np.int64) << 32
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, K).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), K)), pa.array((values | place).ravel())], names=["doc", "pair"])


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches agree enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
        good = pa.array(np.flatnonzero((x == y).sum(axis=1) >= SKETCH_MATCHES))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["a", "b"])


def sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        sets = list(shingle_sets(Words(batch.column(1), lower=True), size))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([sketch(x) for x in sets], pa.binary())], names=["doc", "hashes", "sketch"])


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, low, high, own block, doc, part, mask, signature, sketch) come sorted by pair, low and high. For each such three, the pairs (a, b) from different
    components whose sketches agree enough, one from either block, in the first list that both are posted in."""

    def links(group: tuple, rows: list) -> pa.RecordBatch:
        pair, low, high = group
        block, docs, parts, masks = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:4])
        signatures, sketches = (np.frombuffer(b"".join(r[k] for r in rows), t).reshape(len(rows), -1) for k, t in ((4, np.uint32), (5, np.uint8)))
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        open_ = parts[x][:, None] != parts[y][None, :]
        if low == high:
            open_ &= docs[x][:, None] < docs[y][None, :]
        p, q = (z[k] for z, k in zip((x, y), np.nonzero(open_), strict=True))
        near = [(sketches[p[k : k + BLOCK]] == sketches[q[k : k + BLOCK]]).sum(axis=1) for k in range(0, len(p), BLOCK)]
        good = np.concatenate(near) >= SKETCH_MATCHES if near else np.zeros(0, bool)
        p, q = p[good], q[good]
        both = (signatures[p] == signatures[q]) & ((masks[p] & masks[q])[:, None] >> np.arange(K) & 1 == 1)
        first = both.argmax(axis=1) == pair >> 32
        p, q = docs[p[first]], docs[q[first]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
            if row[:3] != now:
                if rows:
                    yield links(now, rows)
                now, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield links(now, rows)


def confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose whole sets are similar enough."""
    for batch in batches:
        good = []
        for k in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(i)[k].as_buffer(), np.uint64) for i in (2, 3))
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(both) - shared):
                good.append(k)
        good = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["a", "b"])


class Job:
    """One run over documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int, percent: int, matches: int):
        self.docs, self.size, self.percent, self.matches = docs, size, percent, matches
        self.scratch = Scratch(docs.sparkSession, "minhash")
        self.signed = self.scratch.keep(docs.mapInArrow(lambda it: sign(it, size), SIGNED), "signed")
        classes = self.signed.where("set_name is not null").groupBy("set_name").agg(F.min("doc_id").alias("head"))
        self.classes = self.scratch.keep(classes, "classes")
        mine = self.signed.select("doc_id", "signature").join(self.classes, F.col("doc_id") == F.col("head"), "left_semi")
        self.heads = self.scratch.keep(mine.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), "signature"), "heads")

    def lists(self) -> DataFrame:
        """(pair, doc, common, mask): under which pairs each representative is posted, how common its pairs are, and the coordinates of its posts as bits."""
        posts = self.heads.mapInArrow(coordinates, "doc long, pair long")
        often = posts.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
        own = posts.join(often, "pair").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("pairs"))
        prefix = F.lit(K - self.matches + 1) - (F.lit(K) - F.size("pairs"))
        own = own.where(prefix > 0).select("doc", F.slice("pairs", F.lit(1), prefix).alias("posts"), F.aggregate("pairs", F.lit(0.0), lambda s, x: s + F.log2(x["n"])).alias("common"))
        mask = F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x["pair"], 32).cast("int"))))
        return own.select("doc", "common", mask.alias("mask"), F.explode("posts.pair").alias("pair"))

    def sets(self, members: DataFrame) -> DataFrame:
        """(doc, hashes, sketch) of these documents. The texts are dealt out by a merge join at any size, so that what moves grows as the input does."""
        mine = self.docs.join(members.hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id"])
        size = self.size
        return self.scratch.keep(mine.mapInArrow(lambda it: sets_of(it, size), "doc long, hashes binary, sketch binary"), "sets")

    def confirm(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        percent = self.percent
        x, y = (sets.select(F.col("doc").alias(c), F.col("hashes").alias(f"{c}_hashes")) for c in "ab")
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "a_hashes", "b_hashes")
        return self.scratch.keep(full.mapInArrow(lambda it: confirmed(it, percent), "a long, b long"), f"{name}-links")

    def stars(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between members and hosts of their lists."""
        # the chosen order is one of ORDERS for all lists, so that a member meets the same few hosts in its lists
        order = F.pmod(F.shiftright("pair", 32), F.lit(ORDERS))
        chosen = [F.max_by("doc", F.struct("common", "doc")), F.min_by("doc", F.xxhash64(order, "doc"))]
        hosts = lists.groupBy("pair").agg(F.array_distinct(F.array(*chosen)).alias("hosts"))
        meets = lists.join(hosts, "pair").select("doc", F.explode("hosts").alias("host")).where("doc <> host")
        pairs = meets.select(F.least("doc", "host").alias("a"), F.greatest("doc", "host").alias("b")).distinct()
        x, y = (sets.select(F.col("doc").alias(c), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
        near = pairs.join(x, "a").join(y, "b").select("a", "b", "a_sketch", "b_sketch")
        return self.confirm(near.mapInArrow(agreeing, "a long, b long"), sets, "stars")

    def placed(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """(pair, doc, mask, part): the lists with each member's component."""
        return lists.join(labels.withColumnRenamed("v", "doc"), "doc", "left").select("pair", "doc", "mask", F.coalesce("component", "doc").alias("part"))

    def rest(self, lists: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between members of a list that lie in different components."""
        placed = self.placed(lists, labels)
        # the component with most members of a list needs no comparison within itself; both it and the others are cut into blocks by a hash
        sizes = placed.groupBy("pair", "part").agg(F.count("*").alias("n")).groupBy("pair").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
        few = F.col("all") <= MEMBERS
        cut = lambda n: F.ceil(n / MEMBERS)
        sizes = sizes.where("most < all").select("pair", "main", F.when(few, 0).otherwise(cut(F.col("most"))).alias("mains"), F.when(few, 1).otherwise(cut(F.col("all") - F.col("most"))).alias("others"))
        rows = placed.join(sizes, "pair")
        turn, is_main = F.xxhash64("doc"), (F.col("part") == F.col("main")) & (F.col("mains") > 0)
        rows = rows.withColumn("own", F.when(is_main, F.pmod(turn, "mains")).otherwise(F.col("mains") + F.pmod(turn, "others")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("others") - 1)))
        rows = rows.select("pair", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc", "part", "mask")
        rows = rows.join(self.heads, "doc").join(sets.select("doc", "sketch"), "doc").select("pair", "low", "high", "own", "doc", "part", "mask", "signature", "sketch")
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "pair", "low", "high").sortWithinPartitions("pair", "low", "high")
        pairs = self.scratch.keep(rows.mapInArrow(compared, "a long, b long"), "pairs")
        return self.confirm(pairs, sets, "rest")

    def merged(self, labels: DataFrame, more: DataFrame) -> DataFrame:
        """(v, component) after more links: only the links between components are followed again."""
        x, y = (labels.select(F.col("v").alias(f"v_{c}"), F.col("component").alias(f"part_{c}")) for c in "ab")
        drawn = more.join(x, F.col("a") == F.col("v_a"), "left").join(y, F.col("b") == F.col("v_b"), "left")
        joined = components(drawn.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")), self.scratch)
        new = more.select(F.col("a").alias("v")).union(more.select("b")).distinct().join(labels, "v", "left_anti")
        every = labels.select("v", "component").union(new.select("v", F.col("v").alias("component")))
        joined = joined.select(F.col("v").alias("part"), F.col("component").alias("to"))
        return every.join(joined, F.col("component") == F.col("part"), "left").select("v", F.coalesce("to", "component").alias("component"))

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for each row of the documents."""
        lists = self.scratch.keep(self.lists(), "lists")
        sets = self.sets(lists.select("doc").distinct())
        links = self.stars(lists, sets)
        labels = components(links, self.scratch)
        more = self.rest(lists, sets, labels)
        if not more.isEmpty():
            labels = self.scratch.keep(self.merged(labels, more), "labels")
        heads = self.classes.join(labels, F.col("head") == F.col("v"), "left").select("set_name", F.coalesce("component", "head").alias("component"))
        out = self.signed.select("doc_id", "n_shingles", "set_name").join(heads, "set_name", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, matches: int = MATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row with a key; kept on the row whose key is its component's smallest.

    Null, empty and blank texts have no shingles and are linked with nothing. Texts of fewer words than a shingle have one, their whole sequence.
    Rows that share a key are one document, whose text is that which sorts first; all of them are returned. Columns beside key and text are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    shared = not again.isEmpty()
    if shared:
        one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = docs.join(again, "doc_id", "left_anti").unionByName(one)
    found = Job(docs, size, percent, matches).run().withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if not shared:
        return found
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long"))))
    return found.join(again, "doc_id", "left").withColumn("_copy", copies).select("doc_id", "n_shingles", "component_id", "kept")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8, over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS s FROM w
), one AS (
  SELECT doc_id, unnest(s) AS x FROM sh
), n AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sh
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT v, b FROM reach JOIN both_ways ON r = a
), comp AS (
  SELECT v, min(r) AS c FROM reach GROUP BY v
)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN comp ON v = doc_id
"""
