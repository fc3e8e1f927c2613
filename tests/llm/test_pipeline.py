"""The pipeline's stages against plain uses of their decisions."""

import corpus_pipeline
from crosstide.llm import decontaminate, jaccard_join, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 0").collect()}
    first = corpus_pipeline.materialize(corpus_pipeline.quality(spark, docs, SF), "first")
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == set(texts) - bad
    second = corpus_pipeline.materialize(corpus_pipeline.near_duplicates(spark, first, SF), "second")
    groups = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(first).collect()}
    assert {r.doc_id for r in second.collect()} == set(groups.values())
    third = corpus_pipeline.materialize(corpus_pipeline.decontamination(spark, second, SF), "third")
    found = {r.doc_id for r in decontaminate.contaminated(second, items).collect()}
    assert {r.doc_id for r in third.collect()} == set(groups.values()) - found
    fourth = corpus_pipeline.materialize(corpus_pipeline.mixing(spark, third, SF), "fourth")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(third).collect() if r.copies}
    got: dict = {}
    for r in fourth.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert tuple(r) == tuple(texts[r.doc_id])
    assert got == copies
    last = corpus_pipeline.token_files(spark, fourth, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(i for i, n in copies.items() for _ in range(n))


def test_rows_without_an_id_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.union(docs.limit(2).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    assert corpus_pipeline.quality(spark, odd, SF).where("doc_id is null").count() <= 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_repeated_rows_and_ids_with_two_texts(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (4, text("e")), (None, text("e")), (5, ""), (5, ""), (6, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, text("a")), (None, text("b")), (2, text("c")), (3, text("d")), (4, text("e")), (5, ""), (6, ""), (7, None)], key=str)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first().text
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, text("a")), (1, item + " " + text("b"))]], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in corpus_pipeline.decontamination(spark, docs, SF).collect()] == [text("a")]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_driver_plans_one_pass_at_a_time(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    monkeypatch.setattr(mixing, "materialize", lambda df, name: seen.append(_plan(df)) or corpus_pipeline.materialize(df, name))
    seen.append(_plan(mixing.mix_sources(docs)))
    assert len(seen) > 4 and max(plan.count("Exchange") for plan in seen) <= 12

    seen.clear()
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: seen.append(_plan(df)) or corpus_pipeline.materialize(df, name))
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert {tuple(r) for r in jaccard_join.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert len(seen) > 2 and not any("BroadcastExchange" in plan for plan in seen)
