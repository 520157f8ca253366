"""The pipeline, stage by stage, against what each stage's operator decides by brute force."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import decontaminate, secrets
from tests.llm.test_methods import plain_components, plain_fingerprint, shingles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, library = docs.columns, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    toxic_free = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = decontaminate.Items.of([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.base.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = set(kept) - set(now)
        if name == "quality":
            assert not [k for k in gone if toxic_free.get(k) == 1]
        elif name == "near_duplicates":
            groups = plain_components({k: plain_fingerprint(t) for k, t in kept.items()})
            sets, parent = {k: shingles(t) for k, t in kept.items()}, dict(groups)
            find = lambda x: x if parent[x] == x else find(parent[x])  # noqa: E731, B023
            for a in kept:
                for b in kept:
                    if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            assert gone == {k for k in kept if find(k) != k}
        elif name == "decontamination":
            held = lambda t: any(decontaminate.align(i, items.numbers(decontaminate.words(t.lower())))[0] >= decontaminate.THRESHOLD for i in items.tokens)
            assert gone == {k for k, t in kept.items() if held(t)}
        else:
            assert not gone and not [t for t in now.values() if secrets.base_spans(t)]
            assert all(now[k] == t for k, t in kept.items() if "[SECRET]" not in now[k])
        kept = now
    final = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert final == {k: library.encode(t, add_special_tokens=False).ids for k, t in kept.items()}
