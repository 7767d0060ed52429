"""The pipeline, stage by stage against plain versions, and as a whole."""

from itertools import combinations

import corpus_pipeline as P
from loomkin.llm import packing
from tests.llm.fixtures import SCHEMA, corpus, frame, with_clashes
from tests.llm.test_operators import copies, plain_components, plain_features, plain_hits, plain_lines


def test_stages(spark, tmp_path):
    rows = corpus(3) + [(500 + d, t, "en", "src1", len(t)) for d, t in copies(4)]
    items = [(1, " ".join(next(t for _, t, *_ in rows if t and len(t.split()) > 60).split()[10:40])), (2, "ty ty")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = with_clashes(frame(spark, rows))
    columns = df.columns
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]

    good = stage["quality_rules"](spark, df, str(tmp_path))
    assert good.columns == columns
    one = {r.doc_id: r.text for r in good.collect()}
    feats = {d: plain_features(t) for d, t, *_ in rows}
    assert set(one) <= {d for d, f in feats.items() if f[0] >= 20 and 100 * f[-1] <= 30 * f[0]}

    thin = stage["line_dedup"](spark, good, str(tmp_path))
    assert thin.columns == columns
    gone = plain_lines(list(one.items()))
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in one.items()}
    left = {d: t for d, t in left.items() if t.strip()}
    two = {r.doc_id: r for r in thin.collect()}
    assert {d: r.text for d, r in two.items()} == left and all(r.n_chars == len(r.text) for r in two.values())

    single = stage["ngram_jaccard"](spark, thin, str(tmp_path))
    assert single.columns == columns
    comps = plain_components(list(left.items()))
    three = {r.doc_id: r.text for r in single.collect()}
    assert set(three) == {d for d, (_, c) in comps.items() if c == d}

    clean = stage["decontamination"](spark, single, str(tmp_path))
    assert clean.columns == columns
    four = {r.doc_id: r.text for r in clean.collect()}
    assert set(four) == {d for d, t in three.items() if not plain_hits(t, items)[-1]}

    bins = stage["best_fit_packing"](spark, clean, str(tmp_path)).collect()
    assert {r.doc_id for r in bins} == set(four)
    source = {r.doc_id: r.source for r in clean.collect()}
    for a, b in combinations(bins, 2):
        if a.bin_id == b.bin_id:
            assert source[a.doc_id] is None or source[a.doc_id] != source[b.doc_id]
    assert max(r.bin_offset + r.length for r in bins) <= packing.CAPACITY


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, f in P.STAGES:
        docs = f(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(P.run(spark, sf).collect()) == sorted(docs.collect())


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert frame(spark, []).columns == [c.split()[0] for c in SCHEMA.split(", ")]
