"""How stored tables are laid out: by class, in buckets, in partitions replaced in place."""

import uuid
from pathlib import Path

import pytest
from compare import differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
import workload as w
from guardmill.operators import cache, index
from guardmill.plans import pipeline, retrieval
from guardmill.sources.io import Entry, read_entry, write_entry
from guardmill.streaming import audit as audit_stream


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- gold by class ------------------------------------------------------------------------


def test_files_of_forbidden_classes_are_not_read(spark, sf, tmp_path):
    path = str(tmp_path / "gold")
    pipeline.write_gold_by_class(entry._sealed_vectors(spark, sf), path)
    assert len(list((tmp_path / "gold").glob("classification=*"))) == 4
    gold = pipeline.read_gold_by_class(spark, path)
    users = w.users(spark, sf)
    lower = users.filter("role <> 'admin' AND clearance_level IN ('public', 'internal')")
    requests = lower.limit(5).select(
        F.col("user_id").alias("request_id"), "user_id", F.lit("x").alias("query"))
    from guardmill.operators.scratch import settled

    resolved = settled(retrieval.resolved_requests(requests, users, entry.CONTRACTS))
    within = retrieval.open_classes(gold, resolved)
    assert "PartitionFilters: [classification" in plan_of(within)
    classes = {r.classification for r in within.select("classification").distinct().collect()}
    assert classes <= {"public", "internal"} and "public" in classes
    # files of the other classes may be destroyed: none of them is opened
    for name in ("restricted", "confidential"):
        for file in (tmp_path / "gold" / f"classification={name}").glob("*.parquet"):
            file.write_bytes(b"not a file that could be read")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert within.select("chunk_id", "embedding_ciphertext").count() > 0
    rows = retrieval.readable_candidates(gold, resolved, entry.CONTRACTS)
    plain = retrieval.readable_candidates(entry._sealed_vectors(spark, sf), resolved,
                                          entry.CONTRACTS)
    assert sorted(r[0] for r in rows.select("chunk_id").collect()) == sorted(
        r[0] for r in plain.select("chunk_id").collect())


def test_classes_nobody_may_read_are_kept(spark, tmp_path):
    schema = "embedding_id string, chunk_id string, classification string"
    rows = spark.createDataFrame([("e1", "c1", None), ("e2", "c2", "public")], schema)
    pipeline.write_gold_by_class(rows, str(tmp_path / "g"))
    back = pipeline.read_gold_by_class(spark, str(tmp_path / "g"))
    assert {(r.chunk_id, r.classification) for r in back.collect()} == {
        ("c1", None), ("c2", "public")}


# --- bucketed cache -----------------------------------------------------------------------


@pytest.fixture
def cached(spark):
    rows = [(f"c{i % 40}", f"h{i % 3}", f"2024-0{1 + i % 5}-01", bytes([i % 7]), bytes([i]),
             "m") for i in range(200)]
    rows += rows[:30]  # repeated rows
    name = f"cache_{uuid.uuid4().hex[:10]}"
    put = Entry(options={"table_name": name, "format": "parquet", "mode": "append",
                         "bucketBy": list(cache.KEY), "buckets": 4})
    df = spark.createDataFrame(
        rows, "chunk_id string, document_hash string, created_at string, "
              "embedding_nonce binary, embedding_ciphertext binary, model string")
    write_entry(df.filter("created_at < '2024-03'"), put)
    write_entry(df.filter("created_at >= '2024-03'"), put)
    return df, read_entry(spark, Entry(options={"table_name": name})), name


def test_newest_rows_without_moving_the_cache(spark, cached):
    plain, table, name = cached
    found = cache.latest_in_buckets(table)
    plan = plan_of(found)
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = {}
    for r in plain.collect():
        key, order = (r.chunk_id, r.document_hash), (r.created_at, bytes(r.embedding_nonce))
        if key not in want or order > want[key]:
            want[key] = order
    got = {(r.chunk_id, r.document_hash): (r.created_at, bytes(r.embedding_nonce))
           for r in found.collect()}
    assert got == want and found.count() == len(want)


def test_only_the_chunks_are_shuffled(spark, cached):
    plain, table, name = cached
    chunks = spark.createDataFrame([(f"c{i}", f"h{i % 3}", i) for i in range(60)],
                                   "chunk_id string, document_hash string, n int")
    joined = cache.marked(chunks, table, bucketed=True)
    text = joined._jdf.queryExecution().executedPlan().toString()
    # below an exchange there is never the cache
    for part in text.split("Exchange ")[1:]:
        scan = part.split("FileScan parquet", 1)
        assert len(scan) == 1 or name not in scan[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sides = plan_of(cache.marked(chunks, table, bucketed=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sides.count("Exchange hashpartitioning") == 1
    known = {(r.chunk_id, r.document_hash) for r in plain.collect()}
    assert {r.n for r in joined.filter("hit").collect()} == {
        i for i in range(60) if (f"c{i}", f"h{i % 3}") in known}


def test_buckets_need_a_batch_table(spark):
    with pytest.raises(ValueError, match="bucketed"):
        write_entry(spark.range(3), Entry(options={"path": "/nowhere", "bucketBy": "id",
                                                   "buckets": 4}))


# --- upsert in place ----------------------------------------------------------------------


def files_below(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.range(200).select(F.concat(F.lit("i"), "id").alias("id"),
                                   F.lit("first").alias("payload"),
                                   F.lit("1").alias("updated_at"))
    assert len(index.upsert_stored(rows, folder, buckets=16)) == 16
    before = files_below(folder)
    some = rows.filter("id IN ('i3', 'i4')").withColumns(
        {"payload": F.lit("second"), "updated_at": F.lit("2")}).unionByName(
        spark.createDataFrame([("new", "third", "1"), ("new", "fourth", "2")],
                              "id string, payload string, updated_at string"))
    touched = index.upsert_stored(some, folder, buckets=16)
    assert 1 <= len(touched) <= 3
    after = files_below(folder)
    kept = {p for p, t in before.items() if after.get(p) == t}
    assert {int(p.parent.name.split("=")[1]) for p in kept} == set(range(16)) - set(touched)

    def held():
        return {r.id: r.payload for r in index.read_stored(spark, folder).collect()}

    want = {f"i{i}": "first" for i in range(200)} | {"i3": "second", "i4": "second",
                                                     "new": "fourth"}
    assert held() == want
    # run again, as after a failure
    index.upsert_stored(some, folder, buckets=16)
    assert held() == want and index.read_stored(spark, folder).count() == 201
    assert index.upsert_stored(some.limit(0), folder, buckets=16) == []
    with pytest.raises(ValueError, match="buckets"):
        index.upsert_stored(some, folder, buckets=8)


def test_stored_index_takes_new_columns(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert index.read_stored(spark, folder) is None
    index.upsert_stored(spark.createDataFrame([("a", "1"), ("b", "1")],
                                              "id string, updated_at string"), folder, buckets=2)
    index.upsert_stored(spark.createDataFrame([("a", "2", 7)],
                                              "id string, updated_at string, more int"),
                        folder, buckets=2)
    assert {(r.id, r.more) for r in index.read_stored(spark, folder).collect()} == {
        ("a", 7), ("b", None)}


# --- streaming totals ---------------------------------------------------------------------


def test_late_events_change_totals_and_too_late_ones_do_not(spark, tmp_path):
    log, table, marks = (str(tmp_path / n) for n in ("log", "totals", "marks"))
    schema = "timestamp string, user_id string, event_type string, status string, " \
             "returned_count int, filtered_out_count long"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(log)
        audit_stream.stream_audit_totals(spark, log, table, marks,
                                         delay="2 days").awaitTermination()
        return {(r.user_id, r.event_type): (r.events, r.returned, r.filtered_out)
                for r in audit_stream.read_totals(spark, table).collect()}

    assert audit_stream.read_totals(spark, table).count() == 0
    one = arrive(("2024-01-10T10:00:00Z", "u1", "search", "success", 3, 1),
                 ("2024-01-10T11:00:00Z", "u1", "search", "success", 2, None),
                 ("no time", "u1", "search", "success", 9, 9),
                 ("2024-01-10T11:00:00Z", None, "login", None, None, None))
    assert one == {("u1", "search"): (2, 5, 1), (None, "login"): (1, 0, 0)}
    late = arrive(("2024-01-09T10:00:00Z", "u1", "search", "success", 4, 4),
                  ("2024-01-20T10:00:00Z", "u2", "search", "success", 1, 0))
    assert late[("u1", "search")] == (3, 9, 5) and late[("u2", "search")] == (1, 1, 0)
    # ten days behind: its span is closed
    gone = arrive(("2024-01-10T12:00:00Z", "u1", "search", "success", 50, 50))
    assert gone == late


def test_totals_of_a_stream_are_those_of_the_batch(spark, sf):
    found = entry.queries()["audit_totals_stream"](spark, sf)
    assert differences(found, entry.oracle_sql()["audit_totals"], sf) is None
