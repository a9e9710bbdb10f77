"""The pipeline, stage by stage, against brute force; and whole, on odd rows and empty tables."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fenwright.llm import _store, decontaminate
from tests.llm.test_documents import BASE, SCHEMA, TEXTS, components, prose, split

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def passes_base(text):
    w = split(text)
    grams, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('tables')}"
    texts = [*TEXTS, *(prose(60 + i, 100 + i) for i in range(20)), *(prose(70, 100) + f" tail{i}" for i in range(4)), prose(50, 500) + " " + " ".join(BASE.split()[5:17]) + " " + prose(20, 501)]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[13], rows[13]], DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(BASE.split()[5:30])), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_against_brute_force(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = _store.written(stage(spark, docs, folder), "test")
        before, after = docs.collect(), out.collect()
        if name == "quality rules":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if passes_base(r.text))
        elif name == "near-duplicate removal":
            kept = {d for d, _, c in components([(r.doc_id, r.text) for r in before], 5, 80) if d == c}
            assert Counter(r.doc_id for r in after) == Counter(kept)
        elif name == "benchmark decontamination":
            clean = [r.doc_id for r in before if not decontaminate.brute_force(r.text, bench)[4]]
            assert Counter(r.doc_id for r in after) == Counter(clean) and len(clean) < len(before)
        elif name == "source mixture":
            size = lambda rows: sum(len(split(r.text)) for r in rows)
            copies = Counter(r.doc_id for r in after)
            assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in before}
            sources = {r.source for r in before}
            assert abs(size(after) - 1.5 * size(before)) <= len(sources) * max(size([r]) for r in before)
        else:
            assert [r.doc_id for r in sorted(after, key=lambda r: r.start)] == sorted(r.doc_id for r in before)
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in before}
            assert all((r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes())) for r in after)
            break
        assert out.columns == docs.columns
        docs = out


def test_run_is_its_stages(spark, folder):
    first = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))


def test_odd_rows_and_empty_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(None,) * 8, (1, "", None, None, None, None, None, None), (2, prose(90, 1), None, None, None, "a", 1, "b")], SCHEMA).write.parquet(f"{root}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/b/documents.parquet")
    for part in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/{part}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/{part}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{root}/a").collect()} == {2}
    assert corpus_pipeline.run(spark, f"{root}/b").count() == 0
