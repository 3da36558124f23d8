"""The pipeline's stages in order, over the smallest tables."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.conftest import SF_SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    given, seen = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == given.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < given.count() and seen[0] == seen[1]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_SMALL).collect()}
    assert len(rows) == seen[-1] and all(len(r.ids) == 4 * r.n_tokens for r in rows.values())
    from tokenizers import Tokenizer

    from careflow.llm.catalog import BYTE_BPE, tokenizer

    t = Tokenizer.from_file(tokenizer(BYTE_BPE))
    assert all(np.frombuffer(r.ids, "<u4").tolist() == t.encode(r.text or "", add_special_tokens=False).ids for r in rows.values())
