"""Jobs that check while they write, raw files as a stream, stored views."""

import json

import pytest
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import table_schema
from guardmill.operators import quality
from guardmill.operators.chunking import chunk_documents
from guardmill.plans import jobs, pipeline, views
from guardmill.sources import texts
from guardmill.sources.io import Entry
from guardmill.streaming import incremental


def bronze_rows(spark, names, folder=None, **more):
    fields = table_schema("bronze_documents")
    rows = []
    for i, name in enumerate(names):
        row = {f.name: f"{f.name}-{i}" for f in fields}
        row |= {"document_id": f"D{i}", "source_path": name, "classification": "public",
                "allowed_roles": ["admin"], "contains_sensitive_info": False,
                "document_hash": f"h{i}"} | more
        rows.append(tuple(row[f.name] for f in fields))
    return spark.createDataFrame(rows, fields)


def test_report_of_a_write_is_that_of_a_scan(spark, contracts, tmp_path):
    good = bronze_rows(spark, ["a", "b", "c"])
    damaged = good.withColumn("owner", F.when(F.col("source_path") != "b", F.col("owner")))
    reads = []

    @F.udf("string", useArrow=False)
    def counted(x):
        return x

    def job(watch):
        watch("bronze_documents", damaged.withColumn("title", counted("title"))).write.parquet(
            str(tmp_path / "bronze"))
        watch("stray", spark.range(2))

    report = jobs.run_with_report(spark, contracts, str(tmp_path / "q"), job,
                                  expected=["bronze_documents", "silver_chunks"])
    want = quality.quality_report(spark, {
        "bronze_documents": damaged, "stray": spark.range(2), "silver_chunks": None}, contracts)
    assert sorted(map(repr, report.collect())) == sorted(map(repr, want.collect()))
    kinds = {r.kind for r in report.collect()}
    assert kinds == {"check", "warning"} and not reads

    def lines(part):
        return [json.loads(x) for f in sorted((tmp_path / "q" / part).glob("part-*"))
                for x in f.read_text().splitlines()]

    (total,) = lines("summary")
    assert total["status"] == "failed" and total["warnings"] == 2
    assert total["total"] - total["passed"] == 1
    assert {c["dataset_id"] for c in lines("catalog")} == set(contracts.datasets) \
        if "dataset_id" in lines("catalog")[0] else lines("catalog")


def test_checks_of_an_empty_write(spark, contracts, tmp_path):
    empty = bronze_rows(spark, ["a"]).limit(0)

    def job(watch):
        watch("bronze_documents", empty).write.parquet(str(tmp_path / "bronze"))

    report = jobs.run_with_report(spark, contracts, str(tmp_path / "q"), job)
    assert [r.message for r in report.filter("kind = 'warning'").collect()] == [
        "No bronze records found"]
    assert jobs.read_report(spark, str(tmp_path / "q")).count() == report.count()


def test_files_that_arrive_later_and_late_catalogue_rows(spark, tmp_path):
    folder, out = tmp_path / "raw", str(tmp_path / "out")
    catalogue, marks = str(tmp_path / "catalogue"), str(tmp_path / "marks")
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("one two\r\nthree")
    (folder / "sub" / "b.txt").write_bytes(b"four \xff five")

    def run():
        incremental.stream_raw_documents(spark, str(folder), catalogue, out, marks, size=2,
                                         overlap=0, pattern="*.txt").awaitTermination()

    def held():
        rows = incremental.streamed_chunks(spark, out).collect()
        return sorted((r.document_id, r.chunk_index, r.chunk_span.end) for r in rows)

    run()  # no catalogue yet
    assert held() == []
    bronze_rows(spark, ["a.txt"]).write.parquet(catalogue)
    (folder / "c.txt").write_text("six")
    (folder / "ignored.bin").write_text("seven")
    run()
    assert held() == []
    incremental.rerun_unmatched(spark, str(folder), catalogue, out, "r1", 2, 0)
    first = [("D0", 0, 2), ("D0", 1, 3)]
    assert held() == first
    incremental.rerun_unmatched(spark, str(folder), catalogue, out, "r1", 2, 0)  # once more
    assert held() == first
    late = bronze_rows(spark, ["x", "sub/b.txt", "c.txt"]).filter("source_path <> 'x'")
    late.write.mode("append").parquet(catalogue)
    incremental.rerun_unmatched(spark, str(folder), catalogue, out, "r2", 2, 0)
    assert held() == sorted([*first, ("D1", 0, 2), ("D1", 1, 3), ("D2", 0, 1)])
    run()  # nothing new
    assert len(held()) == 5


def test_rerun_without_a_first_run(spark, tmp_path):
    incremental.rerun_unmatched(spark, str(tmp_path), str(tmp_path / "c"),
                                str(tmp_path / "out"), "r")
    assert not (tmp_path / "out").exists()


def test_stored_views_hide_raw_columns(spark, tmp_path):
    path = str(tmp_path / "bronze")
    bronze_rows(spark, ["a", "b"]).write.parquet(path)
    made = views.create_catalog_views(spark, {"bronze_documents": path}, "raw_v", "safe_v")
    assert "safe_v.bronze_documents" in made
    shown = spark.table("safe_v.bronze_documents")
    columns = next(c for n, _, c, _ in fv.SAFE_VIEWS if n == "bronze_documents")
    assert tuple(shown.columns) == tuple(columns)
    assert set(table_schema("bronze_documents").names) - set(shown.columns)
    assert shown.count() == 2
    with pytest.raises(Exception, match="document_hash|UNRESOLVED"):
        spark.sql("SELECT contains_sensitive_info FROM safe_v.v_bronze_documents_catalog")


def test_relative_paths(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "f.txt").write_text("x")
    listed = texts.list_files(spark, str(tmp_path), "*.txt").collect()
    assert [r.relative_path for r in listed] == ["s/f.txt"]
    for folder in (f"file://{tmp_path}", f"file:{tmp_path}/"):
        assert [r.relative_path for r in texts.list_files(spark, folder, "*.txt").collect()
                ] == ["s/f.txt"]


def test_no_text_is_built_when_all_chunks_are_cached(spark, keys, tmp_path):
    docs = spark.createDataFrame([("d1", "one two three four", "h1"), ("d2", "five six", "h2")],
                                 "document_id string, text string, document_hash string")
    settings = pipeline.EmbeddingSettings(key_id="k1", created_at="t", dim=16)
    entry = {"format": "parquet", "path": str(tmp_path / "cache")}
    reader, writer = Entry(options=entry), Entry(options={**entry, "mode": "append"})
    spans = chunk_documents(docs, 3, 1, with_text=False)

    def run(chunks):
        gold = pipeline.build_embeddings(chunks, keys, settings, reader, writer, spans)
        return sorted((r.chunk_id, r.embedding_ciphertext) for r in gold.collect())

    chunks = chunk_documents(docs, 3, 1)
    first = run(chunks)
    assert len(first) == 3
    broken = chunks.withColumn("chunk_text", F.raise_error(F.lit("a text was built")).cast(
        "string"))
    assert run(broken) == first
    # one new document: only its chunks are encoded
    more = docs.unionByName(spark.createDataFrame([("d3", "seven", "h3")], docs.schema))
    spans = chunk_documents(more, 3, 1, with_text=False)
    assert len(run(chunk_documents(more, 3, 1))) == 4
    assert spark.read.parquet(entry["path"]).count() == 4
