"""The pipeline on the smallest documents, each stage held against a plain version of its decision."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from hoplite.llm import decontaminate, quality, registry, sentencepiece_codec, toxicity  # noqa: E402
from hoplite.llm.common import table  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark, tmp_path):
    from test_ngram_join import brute

    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    columns, kept = docs.columns, {}
    before = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        source = docs
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        kept[i] = {r.doc_id for r in docs.collect()}
        if i == 0:
            m = toxicity.fit(source, labels)
            assert kept[0] == {d for d, t in before.items() if m.score(t.encode()) < 0.5}
        if i == 1:
            m = quality.fit(source, labels)
            assert kept[1] == {d for d in kept[0] if m.scores([before[d].encode()])[0] >= quality.THRESHOLD}
        if i == 2:
            assert kept[2] == {c for _, _, c in brute([(d, before[d]) for d in sorted(kept[1])])}
        if i == 3:
            windows = {tuple(w[j : j + min(10, len(w))]) for r in table(spark, DIR, "benchmark").collect() if (w := decontaminate.words_of(r.text.encode())) for j in range(max(1, len(w) - 9))}
            hit = lambda w: any(tuple(w[j : j + k]) in windows for k in {len(x) for x in windows} for j in range(len(w) - k + 1))
            assert kept[3] == {d for d in kept[2] if not hit(decontaminate.words_of(before[d].encode()))}
    codec = sentencepiece_codec.Codec.load(sentencepiece_codec.default_model_path())
    assert kept[4] == kept[3] and kept[4]
    for r in docs.collect():
        assert codec.decode(r.piece_ids) == before[r.doc_id] and r.n_pieces == len(r.piece_ids)


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracles()) <= set(names)
    import __spark_entry__

    assert {"pipeline", *names} <= set(__spark_entry__.queries())


def folder(spark, path, documents, labels=(), benchmark=()):
    """A folder of tables as the pipeline reads them; documents have further columns with the names that stages use."""
    extra = "row int, key string, doc string, piece_ids int, score double, g long, h long, y int"
    rows = [(i, t, "en", "web", len(t or ""), 1, "k", "d", 2, 0.5, 3, 4, 1) for i, t in documents]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, []))
    assert out.columns == ["doc_id", "n_pieces", "piece_ids", "round_trip"] and out.count() == 0


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(14))
    documents = [(1, "the first clean text of the table"), (1, "the first clean text of the table"), (1, "another text under the same id"), (2, None), (3, ""), (None, "a text without an id here"), (None, "a text without an id here"), (4, f"x {passage} y"), (5, "the first clean text of the table"), (6, "z" * 70_000)]
    sf_dir = folder(spark, tmp_path / "in", documents, [(1, 1, 0), (None, 0, 1)], [(1, passage), (None, None)])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_pieces is None or r.n_pieces == -1) for r in out)
    assert got == [(False, 0, False), (True, 1, False), (True, 1, False), (True, 2, True), (True, 3, False), (True, 6, False)]
    assert all(r.round_trip for r in out)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_leave_nothing_behind(spark, tmp_path):
    from hoplite.plans import workspace

    workspace.release(spark)
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, [(i, f"text number {i // 2} of the corpus with some words") for i in range(6)]))
    assert out.count() == 3
    roots = workspace._roots[spark.sparkContext.applicationId]
    assert len(roots) == 1 and "pipeline" in roots[0]
    workspace.release(spark)
