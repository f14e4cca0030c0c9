"""The pipeline's rows against a brute-force version, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from llm.helpers import edge
from llm.test_corpus_ops import brute_mix, brute_pairs

from gleanery.llm import toxicity
from gleanery.llm.common import words


def test_rows_by_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    model = toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {i for i, r in rows.items() if toxicity.score_tokens(model, words(r.text))[1] > 1e-3}

    pairs, size = brute_pairs([(i, rows[i].text) for i in left])
    parent = {i: i for i in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, m, n, c in pairs:
        if c >= 0.6 and n <= 1.6 * m:
            parent[root(b)] = root(a)
    best: dict[int, int] = {}
    for i in left:
        g = root(i)
        if g not in best or (size.get(i, 0), -i) > (size.get(best[g], 0), -best[g]):
            best[g] = i
    inside = {i for a, b, m, n, c in pairs if m >= 16 and c >= 0.8 and n > 1.6 * m for i in (a, b) if size[i] == m}
    left = set(best.values()) - inside

    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text: str) -> bool:
        grams = {tuple(w) for w in zip(*(words(text)[k:] for k in range(3)))}
        return any(sum(tuple(i[k : k + 3]) in grams for k in range(len(i) - 2)) >= 0.6 * (len(i) - 2) for i in items)

    left = {i for i in left if not leaks(rows[i].text)}
    want = brute_mix([(i, rows[i].source, rows[i].n_chars) for i in left], None)
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter(r.doc_id for r in got.collect()) == want
    assert set(got.columns) == {*table.columns, "shard", "position"}
    for r in got.collect():
        assert r.text == rows[r.doc_id].text


def test_stages_bear_anything(spark, sf_dir):
    for extra in (True, False):
        docs = edge(spark, clashes=extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.where("false").count() == 0
            assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
