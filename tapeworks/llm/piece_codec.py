"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

For every prefix of a text exactly one token can be the last one of the prefix's encoding. The table holds that token: among the tokens that an
automaton finds to end there, the one that is compatible with the last token of the prefix before it, that is, the two tokens' joined text
encodes to just these two. Reading the table backwards from the end gives the ids. No merge is ever carried out on the text itself.

Tokens never hold a word start after other characters, so the table restarts at each word; words met before come from a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.scratch import bounded_batches
from tapeworks.llm.words import steps

START = "▁"
#: Words that a worker remembers in each of two generations, and token pairs.
WORDS_KEPT, PAIRS_KEPT, WORD_LIMIT = 200_000, 200_000, 64
NORMAL, UNKNOWN, CONTROL, BYTE, OTHER = range(5)
_UNIT = re.compile(f"{START}*[^{START}]+|{START}+")


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ((p.is_unknown, UNKNOWN), (p.is_control, CONTROL), (p.is_byte, BYTE), (p.is_unused, OTHER))
    return [(p.id_to_piece(i), p.get_score(i), next((k for f, k in kinds if f(i)), NORMAL)) for i in range(p.get_piece_size())]


class Codec:
    """Encodes and decodes with a merge-type model with a word-start prefix, escaped spaces, no other normalisation, and byte fallback."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.pieces = pieces
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(START in p.lstrip(START) for p in self.id_of):
            raise ValueError("a piece holds a word start after other characters")
        self.score = [s for _, s, _ in pieces]
        self.byte_id = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
        controls = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.begin, self.end = controls["<s>"], controls["</s>"]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.sizes = [len(p) for p, _, _ in pieces]
        self.packed = [np.uint32(i).tobytes() for i in range(len(pieces))]
        # signs that follow a letter in no piece: no token lies across a letter and such a sign, so a word may be cut there
        joined = {(a, b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        after = {b for a, b in joined if a.isalpha()}
        signs = [c for c in map(chr, [10, *range(33, 127)]) if not c.isalnum() and c not in after]
        self.cut = re.compile(f"(?<=[^\\W\\d_])[{re.escape(''.join(signs))}]") if signs else None
        self.surface = [b"" if kind == CONTROL else bytes([int(p[1:-1], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(START, " ").encode() for p, _, kind in pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.pairs: dict[int, bool] = {}
        self.words = _Memory(self)

    def merged(self, text: str) -> list[int]:
        """The ids of a short known text by merging best pairs; what compatible() asks, and nothing else."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of.get(p, -1) for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two tokens' text encodes to just them; -1 before: whether the token's own text encodes to it."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        ids = [token] if before < 0 else [before, token]
        found = self.pairs[before + 1 << 20 | token] = self.merged("".join(self.pieces[i][0] for i in ids)) == ids
        return found

    def unit(self, text: str) -> bytes:
        """The ids of one word with its word starts, as little-endian unsigned 32-bit integers."""
        n, sizes, pairs = len(text), self.sizes, self.pairs
        last = [0] * (n + 1)  # of each prefix the last token and 1 more; 0: its last character is in no piece
        for at, token in self.automaton.iter(text):
            end = at + 1
            if last[end]:
                continue
            before = last[end - sizes[token]]
            good = pairs.get(before << 20 | token)
            if self.compatible(before - 1, token) if good is None else good:
                last[end] = token + 1
        out, end = [], n
        while end:
            token = last[end] - 1
            if token >= 0:
                out.append(self.packed[token])
                end -= sizes[token]
            else:
                raw = text[end - 1].encode("utf-8", "replace")
                out += [self.packed[self.byte_id[b]] for b in reversed(raw)] if self.byte_id else [self.packed[self.unknown]]
                end -= 1
        out.reverse()
        return b"".join(out)

    def forget(self) -> None:
        """Gives the memory of words back; workers live on after a task."""
        self.words.clear()
        self.words.old = {}

    def encode(self, text: str | None) -> bytes:
        """The ids with begin and end, packed; a null text counts as empty."""
        if not text:
            body = b""
        else:
            escaped = text.replace(" ", START)
            if START + START in escaped or escaped[0] == START or escaped[-1] == START:
                body = b"".join([self.words[u] for u in _UNIT.findall(START + escaped)])
            else:
                body = b"".join(map(self.words.__getitem__, [START + u for u in escaped.split(START)]))
        return np.uint32(self.begin).tobytes() + body + np.uint32(self.end).tobytes()

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: controls have none, the first word start goes, runs of byte tokens are UTF-8 with U+FFFD for each byte in error."""
        ids = np.frombuffer(packed, "<u4")
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if raw[:1] == b" " and (first := next((i for i in ids.tolist() if self.pieces[i][2] != CONTROL), -1)) >= 0 and self.pieces[first][0].startswith(START):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._broken(ids)

    def _broken(self, ids: np.ndarray) -> str:
        out, run = [], b""
        for i in [*ids.tolist(), self.end]:
            if self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for size in range(min(4, len(run)), 0, -1):
                    try:
                        out.append(run[:size].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        if size == 1:
                            out.append("�")
                run = run[size:]
            piece = self.surface[i].decode()
            out.append(piece[1:] if not "".join(out) and self.pieces[i][0].startswith(START) else piece)
        return "".join(out)


class _Memory(dict):
    """Encoded words of the last while: a full generation becomes the old one, and the one before goes."""

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            cut = self.codec.cut and self.codec.cut.search(text)
            if cut:
                return self[text[: cut.start()]] + self[text[cut.start() :]]
            found = self.codec.unit(text)
            if len(text) > WORD_LIMIT:
                return found
        if len(self) >= WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        self[text] = found
        return found


_codecs: dict[str, Codec] = {}


def codec_of(pieces: list[tuple[str, float, int]]) -> Codec:
    """A worker's codec of a model; its tables and memory serve all the worker's tasks."""
    name = hashlib.sha256(repr(pieces).encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(pieces)
    return _codecs[name]


def encoded(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    codec = codec_of(pieces.value)
    for batch in steps(batches):
        packed = [codec.encode(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(packed)], names=["doc_id", "ids"])
    codec.forget()


def decoded(batches: Iterator[pa.RecordBatch], pieces) -> Iterator[pa.RecordBatch]:
    codec = codec_of(pieces.value)
    for batch in batches:
        texts = [None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def digests(batches: Iterator[pa.RecordBatch], pieces, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = codec_of(pieces.value)
    for batch in steps(batches):
        rows, all_ids = [], []
        for text in batch.column(1).to_pylist():
            packed = codec.encode(text)
            if with_ids:
                all_ids.append(packed)
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(packed).encode()).hexdigest()))
        n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
        columns, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(as_lists(all_ids))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)
    codec.forget()


def as_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _run(docs: DataFrame, model: str | None, key: str, column: str, kind: str, function, schema: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    # The vocabulary is the only thing sent to all workers; its size is the model's, whatever the corpus.
    pieces = docs.sparkSession.sparkContext.broadcast(model_pieces(model or default_model()))
    return docs.select(F.col(key).alias("doc_id"), F.col(column).cast(kind).alias(column)).mapInArrow(lambda it: function(it, pieces), schema)


def _as_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids: array of int), a row for each row: begin, the whole text's ids, end. A null or empty text has begin and end only."""
    return _run(_as_text(docs, key, text), model, "doc_id", "text", "string", encoded, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of arrays of ids; null gives null."""
    rows = rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return _run(rows, model, "doc_id", "ids", "array<int>", decoded, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode()'s ids and of what decode() makes of them; if asked for, the ids too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _run(_as_text(docs, key, text), model, "doc_id", "text", "string", lambda it, pieces: digests(it, pieces, with_ids), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' whole texts, with the 32,000-piece model."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
