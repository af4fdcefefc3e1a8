from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import differences

ORACLES = entry.oracle_sql()
# the operators for training data have tests of their own
NAMES = sorted(n for n in entry.queries() if n not in ("pipeline", "ngram_links")
               and not n.startswith("op"))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert name in ORACLES
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert differences(df, ORACLES[name], sf) is None


def test_flagship(spark):
    assert entry.entry(spark).columns == ["user_id", "classification", "n"]


def test_chunking_plan_has_no_shuffle_and_no_python(spark, sf):
    import workload
    from guardmill.plans import pipeline

    docs = workload.governed_documents(workload.table(spark, sf, "documents"))
    plan = pipeline.silver_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("split(") == 1, "the words of a document are cut once"


@pytest.mark.parametrize("name", ["stream_silver", "stream_gold"])
def test_streams_read_tables_that_are_folders(spark, sf, name, tmp_path):
    for table in ("documents", "nation"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(2).write.parquet(
            str(tmp_path / f"{table}.parquet"))
    run = entry.queries()[name]
    assert run(spark, str(tmp_path)).count() == run(spark, sf).count() > 0


def test_every_document_has_its_text_looked_up(spark, sf):
    found = entry.queries()["document_text_lookup"](spark, sf)
    rows = {r.document_id: r.text for r in found.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert rows.keys() == {str(d.doc_id) for d in docs}
    assert all((text == "") == (int(k) % 40 == 0) for k, text in rows.items())


def test_document_files_have_no_folder_each(spark, tmp_path):
    rows = [(1, "s/a", "one"), (2, "s/a", None), (3, None, "x"), (3, None, "xx\x01"), (4, "..", "é"),
            (40, "s/a", "unwritten"), (None, "s/a", "no id")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    folder, _ = entry._document_files(spark, str(tmp_path))
    files = [p for p in Path(folder).rglob("*") if p.is_file()]
    assert sorted(p.read_text() for p in files) == ["\n", "one\n", "xx\x01\n", "é\n"]
    assert len([p for p in Path(folder).rglob("*") if p.is_dir()]) == 3
    found = entry.queries()["document_text_lookup"](spark, str(tmp_path)).collect()
    assert sorted((r.document_id or "", r.text) for r in found) == [
        ("", ""), ("1", "one\n"), ("2", "\n"), ("3", "xx\x01\n"), ("3", "xx\x01\n"),
        ("4", "é\n"), ("40", "")]
