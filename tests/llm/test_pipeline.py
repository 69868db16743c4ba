"""The pipeline over the smallest tables, and stages over rows with nulls and repeats."""

from pyspark.sql import functions as F

import corpus_pipeline

from kindred.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns and after.exceptAll(docs).isEmpty() and 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_dedup_stage_keeps_one_of_a_group(spark, sf_dir):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a text of its own", "x"), (2, "A b c d e f g.", None), (3, None, None), (4, "other words", "y"), (None, "no id", None), (None, "no id", None), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").withColumns({"KEPT_HASH": F.lit(1), "node": F.lit(2)})
    out = corpus_pipeline.dedup_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=str) == sorted([(1, "a b c d e f g"), (1, "a text of its own"), (3, None), (4, "other words"), (0, "no id")], key=str)


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeats and clashing columns in every stage."""
    long = "a sentence of plain words about nothing in particular. " * 3000
    rows = [(None, None), (None, "no id at all"), (10_001, None), (10_002, ""), (10_003, "   "), (10_004, long), (10_005, "some words here"), (10_005, "some words here"), (10_006, "some words here")]
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("odd").alias("source"), F.length("text").cast("long").alias("n_chars"))
    extra = {"score": F.lit(1.0), "node": F.lit("n"), "row": F.lit(5), "kept_id": F.lit(None).cast("string")}
    docs = docs.limit(60).unionByName(odd).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "near_duplicates":
            assert sum(t == "some words here" for _, t in kept) == 1 and (10_005, "some words here") in kept and (10_004, long) in kept
            # the null and the empty text are one class, the null id its smallest
            assert [i for i, t in kept if not t] == [None]
        else:
            assert sum(t == "some words here" for _, t in kept) in (0, 3) and len({i for i, t in kept if t in (None, "") and (i is None or i > 10_000)}) in (0, 3)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    lengths = {}
    for r in packed.filter("doc_id > 10000 OR doc_id IS NULL").collect():
        lengths.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    assert lengths[10_001, 1] == [1] and lengths[10_002, 1] == [1] and lengths[None, 1] == [1]
    assert all(sum(v) % k[1] == 0 for k, v in lengths.items()) and sum(lengths[10_005, next(t for i, t in lengths if i == 10_005)]) == 2 * next(t for i, t in lengths if i == 10_005)
