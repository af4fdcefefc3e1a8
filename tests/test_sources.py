import gzip
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from guardmill.contracts import table_schema
from guardmill.operators import joins, scratch
from guardmill.plans import pipeline, views
from guardmill.sources import io, tables, texts
from guardmill.streaming import incremental

STAMP = "2030-01-01T00:00:00Z"
META = ("document_id", "title", "source_path", "classification", "owner", "department",
        "allowed_roles", "version", "created_at", "contains_sensitive_info", "document_hash")


def metadata(n, **more):
    return {"document_id": f"DOC-{n:03d}", "title": f"T{n}",
            "source_path": f"data/raw/{n % 2}/DOC-{n:03d}.txt",
            "classification": ["public", "internal"][n % 2], "owner": "me",
            "department": "ops", "allowed_roles": ["hr_manager"], "version": "1.0",
            "created_at": STAMP, "contains_sensitive_info": False,
            "retention_policy": "2_years", "document_hash": f"h{n}", **more}


@pytest.fixture()
def lake(tmp_path):
    data = tmp_path / "data"
    (data / "metadata").mkdir(parents=True)
    (data / "metadata" / "documents.json").write_text(
        "\n".join(json.dumps(metadata(n)) for n in range(6)))
    for n in range(5):  # the sixth has no file
        folder = data / "raw_documents" / str(n % 2)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"DOC-{n:03d}.txt").write_text(f"text of {n}\r\nsecond line " * 30)
    return data, tmp_path / "lake"


def test_read_and_write(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "p")
    io.write_sink(df, format="parquet", path=path, compression="snappy")
    io.write_sink(df, options={"format": "parquet", "mode": "overwrite"}, path=path,
                  mode="append")
    assert io.read_source(spark, options={"format": "parquet", "path": path}).count() == 6
    io.write_sink(df, table_name="io_table", format="parquet")
    assert io.read_source(spark, table_name="io_table").count() == 3
    with pytest.raises(ValueError):
        io.read_source(spark, table_name="t", path="p")
    with pytest.raises(ValueError):
        io.write_sink(df, table_name="t", options={"path": "p"})
    with pytest.raises(TypeError):
        io.read_source(spark, options="format=parquet")
    entries = io.Entries.from_mapping({"a": {"stream": True, "options": {"path": path}}})
    assert entries["a"].stream
    with pytest.raises(KeyError, match="known: a"):
        entries["b"]


def test_streams_in_and_out(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(4).write.parquet(source)
    stream = io.read_source(spark, stream=True, format="parquet", path=source, schema="id long")
    query = io.write_sink(stream, stream=True, format="parquet", path=path,
                          checkpointLocation=str(tmp_path / "marks"),
                          trigger={"availableNow": True})
    query.awaitTermination()
    assert spark.read.parquet(path).count() == 4
    spark.range(2).write.mode("append").parquet(source)
    io.write_sink(io.read_source(spark, stream=True, format="parquet", path=source,
                                 schema="id long"),
                  stream=True, format="parquet", path=path,
                  checkpointLocation=str(tmp_path / "marks"),
                  trigger={"availableNow": True}).awaitTermination()
    assert spark.read.parquet(path).count() == 6
    io.write_sink(io.read_source(spark, stream=True, format="parquet", path=source,
                                 schema="id long"),
                  stream=True, table_name="stream_table", format="parquet",
                  checkpointLocation=str(tmp_path / "marks2"),
                  trigger={"availableNow": True}).awaitTermination()
    assert spark.table("stream_table").count() == 6


def test_absent_sources(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert tables.read_or_none(spark, format="parquet", path=gone) is None
    assert tables.read_or_none(spark, table_name="no_such_table") is None
    empty = tables.read_or_empty(spark, "facts", format="parquet", path=gone)
    assert empty.schema.names == table_schema("facts").names and empty.count() == 0
    assert tables.read_facts(spark, gone).count() == 0
    assert tables.read_audit(spark, gone).count() == 0


def test_users(spark, tmp_path):
    path = tmp_path / "users.json"
    path.write_text(json.dumps([
        {"user_id": "a", "role": "old", "password": "x"},
        {"user_id": "b", "role": "r", "name": "B"},
        {"user_id": "a", "role": "new", "clearance_level": "internal", "password": "y"}]))
    users = tables.read_users(spark, str(path))
    assert "password" not in users.columns
    assert {r.user_id: r.role for r in users.collect()} == {"a": "new", "b": "r"}


def test_fact_layouts(spark, tmp_path):
    fact = {"fact_id": "f{1}", "subject": 'say "hi" }{', "allowed_roles": ["a", "b"],
            "confidence": 0.5}
    (tmp_path / "lines.jsonl").write_text(json.dumps(fact) + "\n\n" + json.dumps(fact) + "\n")
    (tmp_path / "pretty.json").write_text(
        json.dumps(fact, indent=2) + "\n" + json.dumps(fact, indent=4))
    for name, layout in (("lines.jsonl", "lines"), ("pretty.json", "objects")):
        rows = tables.read_facts(spark, str(tmp_path / name), layout).collect()
        assert [(r.fact_id, r.subject, r.allowed_roles) for r in rows] == [
            ("f{1}", 'say "hi" }{', ["a", "b"])] * 2
    with pytest.raises(ValueError):
        tables.read_facts(spark, "x", "other")


def test_document_texts(spark, lake):
    data, _ = lake
    folder = str(data / "raw_documents")
    (data / "raw_documents" / "0" / "twin.txt").write_text("first")
    (data / "raw_documents" / "1" / "twin.txt").write_text("second")
    (data / "raw_documents" / "1" / "odd name%20+x.txt").write_text("odd")
    docs = spark.createDataFrame(
        [("a", "0/DOC-000.txt"), ("b", "elsewhere/DOC-001.txt"), ("c", "none.txt"),
         ("d", "1/twin.txt"), ("e", "x/twin.txt"), ("f", "1/odd name%20+x.txt")],
        "document_id string, source_path string")
    got = {r.document_id: r.text for r in texts.with_document_text(docs, folder).collect()}
    assert got["a"].startswith("text of 0\nsecond line") and "\r" not in got["a"]
    assert got["b"].startswith("text of 1") and got["c"] == ""
    assert got["d"] == "second" and got["e"] == "first" and got["f"] == "odd"
    report = texts.catalogue_coverage(docs, folder).first().asDict()
    assert report == {"files": 7, "documents": 6, "documents_without_file": 1,
                      "files_without_document": 3}
    texts.require_inputs(spark, folder)
    with pytest.raises(FileNotFoundError):
        texts.require_inputs(spark, folder, "*.pdf")


def test_many_files_are_read_where_their_rows_are(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "_logs").mkdir()
    for name, content in (("a/1.txt", b"one\r\n"), ("a/deep/2.txt", b"two \xff"), ("top.txt", b"top"),
                          ("a/empty.txt", b""), ("a/.hidden.txt", b"x"), ("_logs/3.txt", b"x"),
                          ("a/4.md", b"four")):
        (tmp_path / name).write_bytes(content)
    listed = {r.relative_path for r in texts.list_files(spark, str(tmp_path), "*.{txt,pdf}").collect()}
    by_spark = {r.path.rpartition("/")[2] for r in spark.read.format("binaryFile").option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,pdf}").load(
        str(tmp_path)).select("path").collect()}
    assert listed == {"a/1.txt", "a/deep/2.txt", "top.txt"}
    assert {x.rpartition("/")[2] for x in listed} == by_spark
    rows = [(i, ("a/1.txt", "a/deep/2.txt", "none.txt", None)[i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "n int, source_path string")
    found = texts.with_document_text(docs, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan.lower() and "SortMergeJoin" not in plan, "texts are moved"
    assert "binaryFile" not in texts.list_files(spark, str(tmp_path))._jdf.queryExecution(
        ).executedPlan().toString(), "the driver lists all files"
    met = docs.join(texts.list_files(spark, str(tmp_path)), F.col("source_path") == F.col("path"))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    got = found.select("n", F.hex("text").alias("text")).collect()
    whole = [b"one\n".hex().upper(), None, "", ""]
    assert len(got) == 400 and all(r.text == whole[r.n % 4] for r in got if r.n % 4 != 1)
    by_join = texts.file_texts(spark, str(tmp_path), "2.txt").select(F.hex("text")).first()[0]
    assert {r.text for r in got if r.n % 4 == 1} == {by_join}


def test_compressed_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(b"packed"))
    docs = spark.createDataFrame([("z.txt.gz",)], "source_path string")
    assert texts.with_document_text(docs, str(tmp_path)).first().text == "packed"


def test_whole_pipeline(spark, lake, keys):
    data, root = lake
    readers, writers = tables.default_entries(str(data), str(root))
    pipeline.run_bronze(spark, readers, writers, STAMP)
    bronze = io.read_entry(spark, readers["bronze_documents"])
    assert bronze.count() == 6 and "retention_policy" not in bronze.columns
    assert bronze.first().ingestion_timestamp == STAMP
    with_text = texts.with_document_text(bronze, readers["raw_documents"].options["path"])
    settings = pipeline.EmbeddingSettings(key_id="k1", created_at=STAMP, dim=16)
    for _ in range(2):  # the second run reuses the cache
        pipeline.run_gold(with_text, keys, settings, readers, writers, str(root / "facts"),
                          size=20, overlap=5)
    silver = io.read_entry(spark, readers["silver_chunks"])
    gold = io.read_entry(spark, readers["gold_embeddings"])
    assert silver.schema.names == table_schema("silver_chunks").names
    assert gold.count() == silver.count() > 5
    assert {r.chunk_id for r in gold.collect()} == {r.chunk_id for r in silver.collect()}
    assert spark.read.parquet(str(root / "embed_cache")).count() == silver.count()
    assert tables.read_facts(spark, str(root / "facts")).count() == 0
    n_chunks = silver.count()
    pipeline.run_silver(with_text, writers, size=20, overlap=5)
    assert io.read_entry(spark, readers["silver_chunks"]).count() == n_chunks

    made = views.create_catalog_views(spark, {t: str(root / t) for t in (
        "bronze_documents", "silver_chunks", "gold_embeddings")})
    assert len(made) == 11
    hidden = {"embedding_ciphertext", "embedding_nonce", "key_id"}
    assert not hidden & set(spark.table("safe.gold_embedding_catalog").columns)
    assert spark.table("safe.v_public_chunks").filter("classification <> 'public'").count() == 0
    span = spark.table("safe.silver_chunks").filter("chunk_index = 0").first().chunk_span
    assert span == "start=0,end=20"


def test_bronze_needs_every_column(spark):
    with pytest.raises(ValueError, match="title"):
        pipeline.bronze_documents(spark.createDataFrame([("d",)], "document_id string"), STAMP)


def test_bad_values_become_null(spark):
    row = {k: str(v) for k, v in metadata(1).items() if k in META}
    df = spark.createDataFrame([{**row, "contains_sensitive_info": "maybe"}]).withColumn(
        "allowed_roles", F.array(F.lit("a")))
    assert pipeline.bronze_documents(df, STAMP).first().contains_sensitive_info is None


def test_projections(spark, contracts):
    df = spark.createDataFrame([("c", b"x", "k", "h", ["a"])],
                               "chunk_id string, embedding_ciphertext binary, key_id string, "
                               "document_hash string, allowed_roles array<string>")
    assert views.without_fields(df).columns == ["chunk_id", "document_hash", "allowed_roles"]
    assert views.without_fields(df, ()).columns == df.columns
    assert views.screen_safe(df).columns == ["chunk_id", "allowed_roles"]
    assert views.contract_view(df, "gold_embeddings", contracts).columns == [
        "chunk_id", "allowed_roles"]
    assert set(views.gold_forbidden(contracts)) == set(views.gold_forbidden(None))
    with pytest.raises(KeyError):
        views.safe_view(df, "nope")
    names = views.register_views(spark, {"silver_chunks": spark.createDataFrame(
        [], table_schema("silver_chunks"))})
    assert "safe_v_public_chunks" in names and "safe_bronze_documents" not in names


def test_streaming_jobs_equal_the_batch(spark, lake, keys, tmp_path):
    data, _ = lake
    source = str(data / "metadata")
    marks = str(tmp_path / "marks")
    incremental.stream_bronze(incremental.stream_catalogue(spark, source),
                              str(tmp_path / "bronze"), marks, STAMP).awaitTermination()
    (data / "metadata" / "more.json").write_text(json.dumps(metadata(7)))
    incremental.stream_bronze(incremental.stream_catalogue(spark, source),
                              str(tmp_path / "bronze"), marks, STAMP).awaitTermination()
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    assert bronze.count() == 7

    docs = str(tmp_path / "docs")
    with_text = bronze.withColumn("text", F.repeat(F.concat("document_id", F.lit(" ")), 50))
    with_text.write.parquet(docs)
    settings = pipeline.EmbeddingSettings(key_id="k1", created_at=STAMP, dim=16)
    cached = str(tmp_path / "cache")
    reader = io.Entry(options={"format": "parquet", "path": cached})
    writer = io.Entry(options={"format": "parquet", "path": cached, "mode": "append"})

    def run(mark):
        stream = io.read_source(spark, stream=True, format="parquet", path=docs,
                                schema=with_text.schema)
        incremental.stream_gold(stream, keys, settings, reader, writer,
                                str(tmp_path / "gold"), str(tmp_path / mark), 20,
                                5).awaitTermination()
        return {r.chunk_id for r in spark.read.parquet(str(tmp_path / "gold")).collect()}

    batch = {r.chunk_id for r in pipeline.silver_chunks(with_text, 20, 5).collect()}
    assert run("m1") == batch
    entries = spark.read.parquet(cached).count()
    assert run("m2") == batch, "a replay writes the same rows"
    assert spark.read.parquet(cached).count() == entries


def test_joins_agree_however_the_lookup_is_sized(spark):
    big = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'hot', 'k' || id % 50) as k")
    small = spark.range(60).selectExpr("'k' || id as k", "id as v").unionByName(
        spark.createDataFrame([("hot", 99)], "k string, v long"))
    for how in ("inner", "left", "left_semi"):
        plain = big.join(small, "k", how)
        expected = sorted(plain.collect(), key=str)
        for rows, size in ((10_000, 1 << 20), (5, 1 << 20), (10_000, 10)):
            got = joins.lookup_join(big, small, ["k"], how, rows, size, salts=4)
            assert sorted(got.select(plain.columns).collect(), key=str) == expected
    hot = joins.hot_keys(big, ["k"], 0.2)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        plain = big.join(small, "k", how)
        got = joins.spread_join(big, small, ["k"], how, hot, salts=4)
        assert sorted(got.select(plain.columns).collect(), key=str) == sorted(
            plain.collect(), key=str)


def test_checkpoint_folder_is_taken_from_the_session(spark):
    folder = scratch.checkpoint_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    stored = scratch.settled(spark.range(5))
    assert stored.count() == 5 and folder in stored.inputFiles()[0]


def test_checkpoint_folder_is_required(spark, monkeypatch):
    class Bare:
        class conf:  # noqa: N801 - stands in for the session's configuration
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.checkpoint_folder(Bare)


def test_owned_scratch_is_dropped(spark):
    from pathlib import Path

    with scratch.owned_scratch(spark):
        kept = scratch.settled(spark.range(5))
        folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
        assert kept.count() == 5 and folder.exists()
    assert not folder.exists()


def test_a_large_lookup_is_copied_under_hot_keys_only(spark):
    big = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'hot', if(id % 7 = 0, null, "
                                             "'k' || id)) as k")
    lookup = spark.range(4000).selectExpr("'k' || id as k", "id as v").unionByName(
        spark.createDataFrame([("hot", 99)], "k string, v long"))
    copied = []

    def watched(facts, other, on, how, hot, salts=64):
        copied.append((hot.collect(), other.count()))
        return spread(facts, other, on, how, hot, salts)

    spread, joins.spread_join = joins.spread_join, watched
    try:
        for how in ("inner", "left", "left_semi"):
            got = joins.lookup_join(big, lookup, ["k"], how, max_rows=10)
            assert sorted(got.collect(), key=str) == sorted(
                big.join(lookup, "k", how).collect(), key=str)
    finally:
        joins.spread_join = spread
    # no copy is made before the hot keys are known, and only theirs after it
    assert all(
        Row(k="hot") in hot and len(hot) <= 2 and n == 4001 for hot, n in copied)
    assert len(copied) == 3
