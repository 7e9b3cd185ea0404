"""Main-text extraction with wrappers inferred from the pages of each host.

Every page is read once as blocks: texts with the path of the elements around them. Pages of a host with text at the same paths have one template. Over all
pages, copies of a page counted once, texts are counted by host, template and path. What nearly every page of a template, or nearly every page of the host with
text at that path, has is fixed; the other texts vary, and the deepest element that has most of them is the template's root. A page's text in the
marked article, or else in the root, is kept, without the roles that no article holds and without fixed texts, unless these are most of it.

``infer`` makes a wrapper of a few pages at hand as a union-free regular expression: within a token stream, what repeats side by side becomes a repeated
group; then the streams are aligned one after the other: equal tokens stay, texts that differ become slots, what only one side has becomes an optional group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.html_tokens import INLINE, Walk, tokens
from tapeworks.llm.scratch import Scratch

COPIES = 16
#: A text is fixed from so many different pages on, if this share of a template's pages has it.
FIXED_PAGES, FIXED_SHARE = 3, 0.8
#: Of a page given to infer(), tokens that take part in the alignment.
TOKENS_MOST = 4000


@dataclass
class Item:
    """A tag, a text (fixed, or a slot where value is None), or a group of items that is repeated or optional."""

    kind: str
    value: str | None = None
    path: str = ""
    out: bool = False
    items: list[Item] = field(default_factory=list)
    chars: int = 0
    optional: bool = False

    def sign(self) -> str:
        if self.kind == "text":
            return "#text"
        return "(" + " ".join(i.sign() for i in self.items) + ")+" if self.kind == "group" else f"<{self.value}>"


def _tidy(text: str) -> str:
    return " ".join(text.split())


def stream(page: str | None) -> list[Item]:
    """A page's tokens without inline mark-up, texts joined, white space alone left out."""
    walk, out, text = Walk(), [], []

    def flush():
        if t := _tidy("".join(text)):
            out.append(Item("text", t, walk.path(), walk.outside(), chars=len(t)))
        text.clear()

    for kind, name, part in tokens(page):
        if kind == "text":
            text.append(name)
        elif name not in INLINE:
            flush()
            walk.step(kind, name, part)
            if kind == "open":
                out.append(Item("tag", name, walk.path(), walk.outside()))
        if len(out) >= TOKENS_MOST:
            break
    flush()
    return fold(out)


def merge_items(a: Item, b: Item) -> Item:
    """One item for two that match: texts that differ become a slot."""
    value = a.value if a.kind != "text" or a.value == b.value else None
    items = [merge_items(x, y) for x, y in zip(a.items, b.items, strict=True)] if a.kind == "group" else []
    return Item(a.kind, value, a.path, a.out, items, a.chars + b.chars, a.optional or b.optional)


def fold(items: list[Item], longest: int = 6) -> list[Item]:
    """Turns runs of equal neighbouring pieces of up to ``longest`` items into repeated groups."""
    for size in range(1, longest + 1):
        signs = [i.sign() for i in items]
        out, k = [], 0
        while k < len(items):
            n = 1
            while signs[k : k + size] == signs[k + n * size : k + (n + 1) * size] and k + (n + 1) * size <= len(items):
                n += 1
            # a repeated piece begins with a tag
            if n > 1 and items[k].kind == "tag":
                body = items[k : k + size]
                for r in range(1, n):
                    body = [merge_items(x, y) for x, y in zip(body, items[k + r * size : k + (r + 1) * size], strict=True)]
                out.append(Item("group", None, body[0].path, body[0].out, body))
                k += n * size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def align(wrapper: list[Item], page: list[Item]) -> list[Item]:
    """The wrapper that also reads the page: what matches is merged, the rest becomes optional."""
    # a single piece matches a group that repeats it
    def grouped(items: list[Item], groups: dict[str, Item]) -> list[Item]:
        out, k = [], 0
        while k < len(items):
            for size in range(min(6, len(items) - k), 0, -1):
                sign = "(" + " ".join(i.sign() for i in items[k : k + size]) + ")+"
                if sign in groups and not any(i.kind == "group" for i in items[k : k + size]):
                    out.append(Item("group", None, items[k].path, items[k].out, items[k : k + size]))
                    k += size
                    break
            else:
                out.append(items[k])
                k += 1
        return out

    known = {i.sign(): i for i in [*wrapper, *page] if i.kind == "group"}
    wrapper, page = grouped(wrapper, known), grouped(page, known)
    out = []
    for op, a, b, c, d in SequenceMatcher(None, [i.sign() for i in wrapper], [i.sign() for i in page], autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge_items(x, y) for x, y in zip(wrapper[a:b], page[c:d], strict=True)]
        else:
            for i in [*wrapper[a:b], *page[c:d]]:
                i.optional = True
                out.append(i)
    return out


def infer(pages: list[str | None]) -> dict:
    """The wrapper of a few pages by alignment: the path of their varying text, and marks of the texts that it fixes."""
    streams = [s for s in map(stream, pages) if s]
    if not streams:
        return {"root": None, "fixed": []}
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    chars: dict[str, int] = {}
    fixed: set[int] = set()

    def visit(items: list[Item]) -> None:
        for i in items:
            visit(i.items)
            if i.kind == "text" and not i.out:
                if i.value is None or len(streams) == 1:
                    chars[i.path] = chars.get(i.path, 0) + i.chars
                elif not i.optional:
                    fixed.add(mark(i.path, i.value))

    visit(wrapper)
    return {"root": root_of(chars), "fixed": sorted(fixed)}


def root_of(chars: dict[str, int]) -> str | None:
    """The deepest element that has most of the varying text, from its characters by path."""
    total = sum(chars.values())
    root, size = "", total
    while total:
        below: dict[str, int] = {}
        for path, n in chars.items():
            if path != root and path.startswith(root and root + "/"):
                child = path[: path.find("/", len(root) + 1)] if "/" in path[len(root) + 1 :] else path
                below[child] = below.get(child, 0) + n
        child = max(below, key=below.get, default=None)
        if child is None or below[child] < 0.8 * size:
            break
        root, size = child, below[child]
    return root or None


def mark(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def blocks_of(page: str | None) -> list[tuple[bool, str, str]]:
    """(in a marked article, path, text) of each block without the roles that no article holds; white space is one space.

    A class or id that names such a role counts unless its element holds what the page is about: the only marked articles, or, where nothing else is left, most of the page's text.
    """
    found: list[tuple[int, str, str, tuple[int, ...], tuple[int, ...]]] = []
    walk, text, hidden = Walk(), [], []

    def flush():
        if text and (t := _tidy("".join(text))):
            found.append((walk.main(), walk.path(), t, *walk.named()))
        text.clear()

    for kind, name, part in tokens(page):
        if kind == "text":
            if not hidden and not walk.outside(named=False):
                text.append(name)
        elif name in INLINE:
            hidden = _hide(hidden, kind, name, part)
        else:
            flush()
            hidden = []
            walk.step(kind, name, part)
    flush()
    spared = _spared(found)
    return [(main > 0, path, t) for main, path, t, around, inner in found if not inner and spared.issuperset(around)]


def _spared(found: list[tuple[int, str, str, tuple[int, ...], tuple[int, ...]]]) -> set[int]:
    """The elements whose class or id doesn't count: those around the longest marked article, if all are in such; without one, those with half of the text, if nothing else is left."""
    if any(main and not around and not inner for main, _, _, around, inner in found):
        return set()
    sizes: dict[int, int] = {}
    for main, _, t, _, inner in found:
        if main and not inner:
            sizes[main] = sizes.get(main, 0) + len(t)
    if sizes:
        longest = max(sizes, key=sizes.get)
        return next(set(around) for main, _, _, around, _ in found if main == longest)
    if any(not around for _, _, _, around, _ in found):
        return set()
    for _, _, t, around, _ in found:
        for n in around:
            sizes[n] = sizes.get(n, 0) + len(t)
    return {n for n, size in sizes.items() if 2 * size >= sum(len(t) for _, _, t, *_ in found)}


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text: white space inside a block is one space, blocks are lines. A page without any gives an empty text."""
    wrapper = wrapper or {"root": None, "fixed": []}
    blocks = blocks_of(page)
    return chosen(blocks, [mark(path, t) for _, path, t in blocks], wrapper["root"], set(wrapper["fixed"]))


def chosen(blocks: list[tuple[bool, str, str]], marks: list[int], root: str | None, fixed: set[int]) -> str:
    """The text of the marked article, or of the root, or of all; without fixed texts, unless these have most of its characters, as in a page of versions of one text."""
    both = list(zip(blocks, marks, strict=True))
    part = [(t, m) for (main, _, t), m in both if main]
    part = part or [(t, m) for (_, path, t), m in both if root is None or path == root or path.startswith(root + "/")]
    part = part or [(t, m) for (_, _, t), m in both]
    rest = [t for t, m in part if m not in fixed]
    if 2 * sum(map(len, rest)) < sum(len(t) for t, _ in part):
        rest = [t for t, _ in part]
    return "\n".join(rest)


def _hide(hidden: list[str], kind: str, name: str, part: str) -> list[str]:
    """The inline elements open now that no article shows."""
    if kind == "open" and part in ("out", "named"):
        return [*hidden, name]
    return hidden[:-1] if kind == "close" and hidden and hidden[-1] == name else hidden


READ = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("template", pa.int64()), ("sign", pa.binary()), ("mains", pa.list_(pa.bool_())), ("paths", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("marks", pa.list_(pa.int64())),
        ("kinds", pa.list_(pa.struct([("mark", pa.int64()), ("path", pa.string()), ("chars", pa.int64())]))), ("places", pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64())]))),
    ]
)
READ_DDL = (
    "page_id long, url string, host string, template long, sign binary, mains array<boolean>, paths array<string>, texts array<string>, marks array<long>, "
    "kinds array<struct<mark: long, path: string, chars: long>>, places array<struct<path: string, chars: long>>"
)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks; besides, for counting, its different texts (kinds) and paths (places) with their characters, and a digest that copies share."""
    for batch in batches:
        rows: list[list] = [[] for _ in READ.names[3:]]
        for page in batch.column(2).to_pylist():
            blocks = blocks_of(page)
            marks = [mark(path, t) for _, path, t in blocks]
            kinds: dict[int, dict] = {}
            places: dict[str, int] = {}
            for (_, path, t), m in zip(blocks, marks, strict=True):
                kinds.setdefault(m, {"mark": m, "path": path, "chars": 0})["chars"] += len(t)
                places[path] = places.get(path, 0) + len(t)
            sign = hashlib.blake2b(repr(marks).encode(), digest_size=16).digest()
            made = (mark("", "\n".join(sorted(places))), sign, *([b[k] for b in blocks] for k in range(3)), marks, list(kinds.values()), [{"path": p, "chars": n} for p, n in places.items()])
            for column, value in zip(rows, made, strict=True):
                column.append(value)
        head = [batch.column(0), batch.column(1), batch.column(3)]
        yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, f.type) for c, f in zip(rows, list(READ)[3:], strict=True))], schema=pa.schema([f.with_type(head[k].type) if k < 3 else f for k, f in enumerate(READ)]))


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [root_of({p["path"]: p["chars"] for p in places}) for places in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), batch.column(3)], names=["host", "template", "root", "fixed"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mains, paths, parts, marks, found, fixed = (batch.column(k).to_pylist() for k in range(2, 8))
        out = [chosen(list(zip(*b, strict=True)), m, root, set(f or ())) for *b, m, root, f in zip(mains, paths, parts, marks, found, fixed, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def infer_all(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, template, root, fixed) of every template, from the blocks of all pages. A template's fixed texts are among its own pages' texts, so a row is about as long as a page's."""
    once = scratch.keep(pages.where(F.size("marks") > 0).select("host", "template", "sign", "kinds", "places").dropDuplicates(["host", "sign"]), "once")
    kinds = once.select("host", "template", F.explode("kinds").alias("k")).groupBy("host", "template", F.col("k.mark").alias("mark"))
    kinds = scratch.keep(kinds.agg(F.count("*").alias("n"), F.first("k.path").alias("path"), F.sum("k.chars").alias("chars")), "kinds")
    places = once.select("host", "template", F.explode("places").alias("p")).groupBy("host", "template", F.col("p.path").alias("path"))
    places = scratch.keep(places.agg(F.count("*").alias("n"), F.sum("p.chars").alias("chars")), "places")
    # on nearly every page of a template, or on nearly every page of the host with text at the path
    own = kinds.where(F.col("n") >= FIXED_PAGES).join(once.groupBy("host", "template").agg(F.count("*").alias("of")), ["host", "template"])
    all_over = kinds.groupBy("host", "mark").agg(F.sum("n").alias("n"), F.first("path").alias("path")).where(F.col("n") >= FIXED_PAGES)
    all_over = all_over.join(places.groupBy("host", "path").agg(F.sum("n").alias("of")), ["host", "path"])
    often = F.col("n") >= F.lit(FIXED_SHARE) * F.col("of")
    fixed = scratch.keep(own.where(often).select("host", "mark").unionByName(all_over.where(often).select("host", "mark")).distinct(), "fixed")
    fixed = scratch.keep(kinds.join(fixed, ["host", "mark"], "left_semi"), "fixed-kinds")
    less = fixed.groupBy("host", "template", "path").agg(F.sum("chars").alias("less"))
    varying = places.join(less, ["host", "template", "path"], "left").select("host", "template", F.struct("path", (F.col("chars") - F.coalesce("less", F.lit(0))).alias("chars")).alias("p"))
    varying = varying.groupBy("host", "template").agg(F.array_sort(F.collect_list("p")).alias("places"))
    found = varying.join(fixed.groupBy("host", "template").agg(F.array_sort(F.collect_list("mark")).alias("fixed")), ["host", "template"], "left")
    return scratch.keep(found.select("host", "template", "places", "fixed").mapInArrow(roots, "host string, template long, root string, fixed array<long>"), "wrappers")


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages.

    A null or empty page gives an empty text. Pages without a host in their url count as one host's. A template's pages are dealt to COPIES groups by key, each with a
    copy of its wrapper, so a host with many pages isn't one task's work. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"), host.alias("host"))
    scratch = Scratch(pages.sparkSession, "wrappers")
    blocks = scratch.keep(rows.mapInArrow(read, READ_DDL), "blocks")
    found = infer_all(blocks, scratch)
    copies = found.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumnRenamed("host", "h").withColumnRenamed("template", "t")
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(COPIES)).cast("int"))
    both = dealt.join(copies, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("part") == F.col("p")), "left")
    return both.select("page_id", "url", "mains", "paths", "texts", "marks", "root", "fixed").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole html of every page."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
