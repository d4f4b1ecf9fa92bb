"""The samples that models learn from are bounded by rows, and equal rows teach once."""

import pyarrow as pa
from pyspark.sql import functions as F

from colforge.llm import common, language, toxicity


def caught(monkeypatch, module):
    """Tables that reach the fit of `module`."""
    seen, real = [], common.fit_in_task

    def spy(rows, fit):
        seen.append(rows.count())
        return real(rows, fit)

    monkeypatch.setattr(module, "fit_in_task", spy)
    return seen


def test_many_rows_under_one_id_stay_within_the_bound(spark, monkeypatch):
    ids = spark.range(6000)
    text = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "schön brennt der gold").otherwise("kalo mitu rela"), F.col("id").cast("string"))
    docs = ids.select(F.lit(7).cast("long").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "yy").otherwise("xx").alias("lang"))
    docs = docs.unionByName(docs.where("text LIKE '% 1%'"))
    seen = caught(monkeypatch, language)
    model = language.train(docs, F.lit(True), sample=50)
    assert seen[0] <= 100  # each with a short stretch
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([("kalo rela mitu",)], "text string"), model).collect()] == ["xx"]
    seen = caught(monkeypatch, toxicity)
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    toxicity.train(docs.unionByName(spark.createDataFrame([(8, "fein", "xx")], docs.schema)), labels, sample=40)
    assert seen == [41]


def test_more_languages_than_the_bound(spark):
    docs = spark.createDataFrame([(k, f"wort{k} und {k}", f"l{k:02}") for k in range(30)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True), sample=10)
    assert len(model.model.languages) <= 10


def test_fits_do_not_depend_on_the_place_of_rows(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("x"))
    add = lambda table: (table.num_rows, table["id"].to_pylist()[:5], pa.types.is_int64(table["x"].type))
    for n in (1, 5):
        assert common.fit_in_task(rows.repartition(n), add).model == (200, [0, 1, 2, 3, 4], True)
    assert common.fit_in_task(rows.limit(0), add).model == (0, [], True)
