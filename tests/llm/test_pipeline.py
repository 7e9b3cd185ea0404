import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from tapeworks.llm import piece_codec  # noqa: E402

from .conftest import SCHEMA, prose  # noqa: E402
from .test_minhash_dedup import brute as near_brute  # noqa: E402
from .test_mixing import brute as mix_brute  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, path):
    rng, rows = random.Random(8), []
    for k in range(150):
        lang = "en" if k % 4 else "xx"
        text = prose(k, rng.randint(5, 120)) if lang == "en" else " ".join("".join(rng.choice(["zzo", "qua", "ški", "žu"]) for _ in range(3)) for _ in range(40))
        if k % 10 == 3:
            text += "\n" + prose(5000, 70)
        if k % 17 == 5 and rows:
            text = rows[-1][1]
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    rows += [(200, None, None, None, None), (201, "12 -- 34", "en", "s1", 8), (202, "", None, "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, outs = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outs[name] = docs.collect()
    assert {r.doc_id for r in outs["language_id"]} == {r[0] for r in rows} - {200, 201, 202}
    kept = {d for d, _, _, k in near_brute([(r.doc_id, r.text) for r in outs["language_id"]], size=5) if k}
    assert {r.doc_id for r in outs["minhash_near_dedup"]} == kept
    seen = {}
    for r in outs["minhash_near_dedup"]:
        w = WORD.findall(r.text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            seen[key] = min(r.doc_id, seen.get(key, r.doc_id))
    texts = {r.doc_id: r.text for r in outs["minhash_near_dedup"]}
    for r in outs["substring_dedup"]:
        w, gone = WORD.findall(texts[r.doc_id]), set()
        for i in range(len(w) - 12):
            if seen[tuple(w[i : i + 13])] < r.doc_id:
                gone |= set(range(i, i + 13))
        assert r.text == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[r.doc_id]) and r.n_chars == len(r.text)
    takes = {d: t for d, _, _, _, t in mix_brute([(r.doc_id, r.text, r.source) for r in outs["substring_dedup"]])}
    words = {}
    for r in outs["mixing"]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {d: t for d, t in takes.items() if t}
    codec = piece_codec.Codec(piece_codec.model_pieces(piece_codec.default_model()))
    assert sorted((r.doc_id, r.n_tokens) for r in outs["sentencepiece"]) == sorted((r.doc_id, len(codec.encode(r.text)) // 4) for r in outs["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(outs["sentencepiece"])
