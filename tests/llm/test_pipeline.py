"""The pipeline's stages, each against plain rules on its own input, and the whole run."""

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from resight.llm import pii

from . import cases
from .test_simhash import groups

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@needs_data
def test_run_equals_the_plain_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, DATA)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id for r in kept.collect()}
    assert first == {d for d, t in rows.items() if any(c.isalpha() for c in t or "")}  # all clean documents stay

    one = {c for _, _, c in groups([(d, rows[d]) for d in first])}
    windows = set()
    for t in bench:
        w = cases.WORD.findall(cases.lower(t))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    clean = {}
    for d in one:
        w = cases.WORD.findall(cases.lower(rows[d]))
        hit = {k + j for k in range(len(w)) if tuple(w[k : k + 13]) in windows for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean[d] = rows[d]
    for d, t in clean.items():
        plain = pii.plain_spans(t)
        clean[d] = pii.masked(t, plain + pii.disguised_spans(t, plain))

    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r["size"] for r in got} == {d: len(cases.BLANK.findall(t)) for d, t in clean.items()}
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(taken - target) <= 1 for taken, target in by.values())


def test_stages_keep_columns_and_take_odd_rows(spark):
    folder = DATA
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    for df in (cases.frame(spark), cases.frame(spark, unique=False), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns
            assert out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, folder).count() == df.count()


def test_masking_leaves_clean_texts(spark):
    df = cases.frame(spark).filter(F.col("text").isNotNull())
    before = {r.doc_id: r.text for r in df.collect()}
    after = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["pii"](spark, df, "").collect()}
    for d, t in before.items():
        spans = pii.plain_spans(t)
        if not spans and not pii.disguised_spans(t, spans):
            assert after[d] == t
        else:
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", after[d])
