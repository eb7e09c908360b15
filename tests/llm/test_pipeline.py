from __future__ import annotations

import re

import pytest

import corpus_pipeline
from sensorgrid.llm import sentencepiece

from .test_ngram_jaccard import near


@pytest.fixture
def folder(spark, documents, prose, tmp_path):
    base = [(i, prose(80 + i, i)) for i in range(40)]
    item = prose(30, 999)
    rows = [*base, (100, base[0][1]), (101, near(base[1][1], 1, 1)), (102, "123 !!"), (103, None), (104, item + " " + base[2][1]), (105, prose(60, 77) + " mail joe.doe@example.org now"), (105, base[6][1]), (None, base[7][1] + " tail of another kind that is new")]
    docs = documents(rows).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_each_stage_decides(spark, folder):
    path, rows = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, path), "test")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(docs)
    ids = [sorted(-1 if r.doc_id is None else r.doc_id for r in d.collect()) for d in kept]
    every = sorted(-1 if i is None else i for i, _ in rows)
    assert ids[0] == [i for i in every if i not in (102, 103)]
    # 100 and one of the rows 105 copy others; 101 is a near copy; the row without id is near 7, which has one.
    assert ids[1] == sorted({i for i in ids[0] if i not in (100, 101, -1)})
    assert ids[2] == [i for i in ids[1] if i != 104]
    assert ids[3] == ids[4] == ids[2]
    told = {r.doc_id: r.text for r in kept[3].collect()}
    assert "joe.doe" not in told[105] and re.search(r"[a-z]{3}\.[a-z]{3}@[a-z]{7}\.org now$", told[105])
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())
    back = {r.doc_id: r.text for r in sentencepiece.decode(kept[4]).collect()}
    assert back == told
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, kept[4].collect()))
