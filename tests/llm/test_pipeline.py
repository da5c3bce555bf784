import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rivernet.llm import near_dedup, packing, pii, toxicity

from .test_text_operators import ODD, docs_of

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_single_steps(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    out = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    first = spark.read.parquet(f"{SF}/documents.parquet")
    judged = toxicity.judge_toxicity(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(out["toxicity"]) == ids(judged.filter("kept")) and out["toxicity"].count() > 0.8 * n
    assert ids(out["near_dedup"]) == ids(near_dedup.near_duplicates(out["toxicity"]).filter("kept"))
    assert ids(out["pii"]) == ids(out["near_dedup"]) and pii.find_personal_data(out["pii"]).agg({"n_email": "sum"}).first()[0] == 0
    t = Tokenizer.from_file(packing.TOKENIZER)
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out["mixing"].collect())
    rows = out["packing"].collect()
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == want
    assert zlib.crc32(np.array([1], "<u4").tobytes()) in {r.ids_crc32 for r in rows if r.length == 1}


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows_empty_tables_and_reruns(spark, tmp_path, rows):
    first, last = docs_of(spark, rows), []
    for turn in range(2):
        docs = first
        for name, stage in pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{turn}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{turn}-{name}")
            if name != "packing":
                assert docs.columns == first.columns
        last.append(sorted(map(repr, docs.collect())))
    assert last[0] == last[1] and bool(last[0]) == bool(rows)
