"""The pipeline against a brute-force version of its stages."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from quillon.llm import quality, queries
from quillon.llm.common import read_table

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    docs = list(zip(t["doc_id"], t["text"], strict=True))
    net = quality.fit(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    score = quality.scorer(net)(pa.array([x.encode() for _, x in docs], pa.binary()))
    docs = [d for d, s in zip(docs, score, strict=True) if s >= 0.3]
    assert 0.5 < len(docs) / len(t["text"]) < 1
    keep = {r[0] for r in brute.exact(docs) if r[3]}
    docs = [d for d in docs if d[0] in keep]
    keep = {r[0] for r in brute.near(docs) if r[3]}
    docs = [d for d in docs if d[0] in keep]
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    dirty = {r[0] for r in brute.contamination(docs, list(zip(b["item_id"], b["text"], strict=True))) if r[5]}
    docs = [d for d in docs if d[0] not in dirty]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: [*tok.encode(x, add_special_tokens=False).ids, 1] for i, x in docs}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(x) for i, x in ids.items()}


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), SF)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    assert np.array([len(corpus_pipeline.STAGES)]) == 5
