import hashlib
import random

import numpy as np
import pytest

from tapeworks.llm import piece_codec

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = piece_codec.default_model()
    return piece_codec.Codec(piece_codec.model_pieces(path)), sentencepiece.SentencePieceProcessor(model_file=path)


ODD = ["", " ", "  ", "a", " a", "a ", "▁", "▁▁a b", "a  b   c", "\n\n", "a\tb\r\n c", "日本語テキスト 漢字", "😀😀 x", "\x00a", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaa", "ab" * 400, " " * 37, "x" * 3000, "ﬁ ﻿ ​"]


def test_ids_and_texts_are_the_library_s(both):
    codec, library = both
    rng = random.Random(5)
    letters = "ab cdeéß\n\t▁日😀.,<>0123xyzthein"
    for text in ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(1500)]:
        packed = codec.encode(text)
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert codec.decode(packed) == library.decode(ids), text


def test_decoding_any_ids(both):
    codec, library = both
    rng = random.Random(6)
    for ids in [[], [1, 2], [230, 160, 3, 200, 260], [29871, 29871, 29896], *([rng.randrange(1, 400) for _ in range(12)] for _ in range(300))]:
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_memory_turns_over(both, monkeypatch):
    monkeypatch.setattr(piece_codec, "WORDS_KEPT", 5)
    codec, library = piece_codec.Codec(both[0].pieces), both[1]
    text = " ".join(f"word{k} other" for k in range(200))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(codec.words) <= 5


def test_tables(odd, none, both):
    library = both[1]
    got = {}
    for r in piece_codec.round_trip(odd).collect():
        got.setdefault(r.doc_id, r)
    for r in odd.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    encoded = piece_codec.encode(odd)
    texts = {r.doc_id: r.text for r in piece_codec.decode(encoded).collect()}
    assert texts[0] == "" and texts[4] == next(r.text for r in odd.collect() if r.doc_id == 4)
    assert piece_codec.round_trip(none).count() == 0
    with_ids = piece_codec.round_trip(odd, with_ids=True).first()
    assert len(with_ids.ids) == with_ids.n_tokens
