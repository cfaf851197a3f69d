from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from wayfind.llm.mixing import mix_documents
from wayfind.llm.queries import ORACLES, QUERIES
from wayfind.llm.weighted_minhash import near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_each_stage_keeps_the_columns(stages):
    columns = stages["start"].columns
    assert all(stages[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "pieces"]


def test_decisions_take_effect(stages):
    count = {name: df.count() for name, df in stages.items()}
    assert count["start"] > count["quality"] > count["near_duplicates"] == count["personal_data"]
    classes = near_duplicates(stages["quality"]).collect()
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == {r.doc_id for r in classes if r.kept}
    copies = {r.doc_id: r.copies for r in mix_documents(stages["personal_data"]).collect() if r.copies}
    assert Counter(r.doc_id for r in stages["mix"].collect()) == copies
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before = {r.doc_id: r.text for r in stages["near_duplicates"].collect()}
    for r in stages["personal_data"].collect():
        assert not mail.search(r.text)
        assert bool(mail.search(before[r.doc_id])) <= ("[EMAIL]" in r.text)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.piece_ids == library.encode(r.text) for r in stages["pieces"].collect())


def test_odd_rows_pass_all_stages(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "pieces" or out.columns == docs.columns
            docs = spark.createDataFrame(out.toArrow()) if out.count() else out
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())
