"""The pipeline's rows against plain versions of its stages."""

import collections
import re

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from alignspark.llm import line_dedup, packing, pii
from tests.llm.test_operators import link_components, reference_pieces


def test_pipeline(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    docs = {d: t for d, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    owners = collections.Counter(k for t in docs.values() for k in {line.strip(" \t\n\x0b\x0c\r").encode().lower() for line in t.split("\n")} if k)
    frequent = {k for k, n in owners.items() if n >= line_dedup.LEAST_DOCUMENTS}
    docs = {d: "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r").encode().lower() not in frequent) for d, t in docs.items()}
    linked = link_components(docs.items(), 5, 80)
    docs = {d: t for d, t in docs.items() if linked[d][1] == d}
    docs = {d: pii.redacted(t, pii.spans_of(t)) for d, t in docs.items()}
    want = {(d, i, *p) for d, t in docs.items() for i, p in enumerate(reference_pieces(t))}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(want)
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.02 * packing.lower_bound(np.array([r["length"] for r in got]), 1024) + 2


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "ngram_join", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
