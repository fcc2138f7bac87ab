"""The pipeline's stages on a small table against brute force."""

from __future__ import annotations

import corpus_pipeline
from motionloom.llm import queries

from .test_operators import AWKWARD, SCHEMA, base_figures, brute_force_components, brute_force_lines, plain, reference_round_trip, shingles


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = dict(docs.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, sf)
    assert kept.columns == columns
    now = dict(kept.select("doc_id", "text").collect())
    for i, t in rows.items():
        n_words, *_, repeated = base_figures(t)
        if n_words < 10 or 100 * repeated > 20 * n_words:
            assert i not in now
    assert all(rows[i] == t for i, t in now.items()) and len(now) > 0.6 * len(rows)

    lines = stages["line_dedup"](spark, kept, sf)
    assert lines.columns == columns
    wanted = {i: t for i, t in brute_force_lines(sorted(now.items()), 2).items() if t == now[i] or t.strip()}
    now = dict(lines.select("doc_id", "text").collect())
    assert now == wanted

    near = stages["near_dedup"](spark, lines, sf)
    assert near.columns == columns
    classes = brute_force_components(sorted(now.items()), 5, 80)
    now = {i: t for i, t in now.items() if classes[i][1] == i}
    assert dict(near.select("doc_id", "text").collect()) == now

    free = stages["decontamination"](spark, near, sf)
    assert free.columns == columns
    items = [shingles(plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = {i: t for i, t in now.items() if not any(100 * len(v & shingles(plain(t))) >= 80 * len(v) for v in items)}
    assert dict(free.select("doc_id", "text").collect()) == now

    coded = stages["bpe"](spark, free, sf).collect()
    assert {r.doc_id for r in coded} == set(now)
    for r in coded[:20]:
        assert tuple(r)[1:] == reference_round_trip(now[r.doc_id], queries.vocabulary())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, coded))


def test_stages_on_awkward_rows_and_empty_tables(spark, sf):
    """Nulls, empty and long texts, repeated rows and ids, columns named like the operators' own."""
    awkward = spark.createDataFrame(AWKWARD, SCHEMA)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i))
    every = sorted((r[0] for r in AWKWARD), key=lambda i: (i is None, i))
    wanted = {
        "quality_rules": [1, 5, 6, 7, 7], "line_dedup": every, "near_dedup": [i for i in every if i != 6], "decontamination": every, "bpe": every,
    }
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, awkward, sf)
        assert ids(found) == wanted[name], name
        assert name == "bpe" or found.columns == awkward.columns
        assert stage(spark, awkward.limit(0), sf).count() == 0
    lines = corpus_pipeline.line_runs(spark, awkward, sf).collect()
    assert {r.text for r in lines if r.doc_id == 7} == {"More."} and [r.text for r in lines if r.doc_id in (2, 3)] == [None, ""]
