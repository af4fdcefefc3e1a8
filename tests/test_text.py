import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.functions import sensitivity, text
from guardmill.operators import chunking

NASTY = ("a\x00b  c\u00a0d\u2003e\x85f\x1cg\x0bh\r\n\u3000i\U0001f600j\t \n\n\n\nk \u200b l "
         "\ufeffm \u2028n\u2029 ")
SAMPLES = ["", " ", "\n\t", "one", " two  words ", NASTY, "x" + " " * 5000 + "y",
           "\n" * 300 + "z", "tab\t \nend", "\u00a0lead and trail\u3000"]


def py_clean(raw):
    kept = re.sub("[^\x09\x0a\x0d\x20-\x7e\u00a0-\uffff]", "", raw)
    kept = re.sub(r"[ \t]+\n", "\n", kept)
    return re.sub(r"\n{3,}", "\n\n", kept).strip()


def run(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return df.select("i", *columns).orderBy("i").collect()


def test_clean_and_words_match_python(spark):
    rows = run(spark, SAMPLES, text.clean(F.col("t")).alias("c"),
               text.words(F.col("t")).alias("w"))
    for raw, row in zip(SAMPLES, rows, strict=True):
        assert row.c == py_clean(raw)
        assert row.w == py_clean(raw).split()


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), min_size=20,
                max_size=40))
def test_clean_and_words_match_python_on_random_text(spark, values):
    rows = run(spark, values, text.clean(F.col("t")).alias("c"),
               text.words(F.col("t")).alias("w"))
    for raw, row in zip(values, rows, strict=True):
        assert row.c == py_clean(raw)
        assert row.w == py_clean(raw).split()


def test_name_uuid_matches_python(spark):
    keys = ["", "d:h:0", "DOC-001:abc:17", "\u00e9\u4e2d"]
    rows = run(spark, keys, text.name_uuid(F.col("t")).alias("u"))
    assert [r.u for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]


@pytest.mark.parametrize("size,overlap", [(4, 2), (400, 80), (3, 0), (1, 0), (60, 10)])
def test_chunks_match_python(spark, size, overlap):
    texts = ["", "w " * 9, " ".join(f"w{i}" for i in range(10)),
             " ".join(f"w{i}" for i in range(961))]
    docs = spark.createDataFrame([(f"d{i}", t, "h") for i, t in enumerate(texts)],
                                 "document_id string, text string, document_hash string")
    got = {(r.document_id, r.chunk_index): r for r in
           chunking.chunk_documents(docs, size, overlap).collect()}
    expected = {}
    for i, t in enumerate(texts):
        words = t.split()
        for index, start in enumerate(range(0, len(words), size - overlap)):
            expected[f"d{i}", index] = (start, min(start + size, len(words)),
                                        " ".join(words[start:start + size]))
    assert set(got) == set(expected)
    for key, (start, end, body) in expected.items():
        row = got[key]
        assert (row.chunk_span.start, row.chunk_span.end, row.chunk_text) == (start, end, body)
        assert row.classification == "public" and row.allowed_roles == []
        assert row.chunk_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{key[0]}:h:{key[1]}"))


def test_window_limits():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            text.check_window(size, overlap)


def test_null_classification_is_not_opened(spark):
    docs = spark.createDataFrame([("d", "some words", None)],
                                 "document_id string, text string, classification string")
    assert chunking.chunk_documents(docs).first().classification is None


def test_allowed_roles_may_be_a_string(spark):
    docs = spark.createDataFrame([("d", "some words", "hr")],
                                 "document_id string, text string, allowed_roles string")
    assert chunking.chunk_documents(docs).first().allowed_roles == ["hr"]


def test_rebuilt_texts(spark):
    docs = spark.createDataFrame(
        [("d1", "p1", "a b c d e f g"), ("d2", "p2", "x y")],
        "document_id string, source_path string, text string")
    chunks = chunking.chunk_documents(docs, 3, 1)
    expected = {r.chunk_id: r.chunk_text for r in chunks.collect()}
    rebuilt = chunking.with_chunk_texts(chunks.drop("chunk_text"), docs).collect()
    assert {r.chunk_id: r.chunk_text for r in rebuilt} == expected
    kept = chunking.with_chunk_texts(chunks.withColumn("chunk_text", F.lit("own")), docs)
    assert {r.chunk_text for r in kept.collect()} == {"own"}
    lost = chunks.drop("chunk_text").withColumn("source_path", F.lit("nowhere"))
    assert {r.chunk_text for r in chunking.with_chunk_texts(lost, docs).collect()} == {""}


CASES = [
    ("This is a plain document with no sensitive data.", []),
    ("write to ann.lee+x@example.org now", ["email"]),
    ("badge EMP-123456.", ["employee_id"]),
    ("badge EMP-1234567", []),
    ("CLT-AB-12345 and PROJ-ABC-001", ["client_id", "project_code"]),
    ("paid $12,345.67 today", ["financial_amount"]),
    ("tok_abcdef1234567890 leaked", ["token"]),
    ("The secretary signed", ["keyword:secret"]),
    ("Penetration Test and audit finding", ["keyword:audit_finding",
                                            "keyword:penetration_test"]),
    ("secretoken", ["keyword:secret"]),
    ("TOKEN token Breach", ["keyword:breach", "keyword:token"]),
]


def test_detected_types(spark):
    rows = run(spark, [c[0] for c in CASES], sensitivity.detected_types(F.col("t")).alias("d"))
    for (_, expected), row in zip(CASES, rows, strict=True):
        assert row.d == sorted(expected)


def test_scores_and_thresholds(spark):
    rows = spark.range(0, 19).select("id", *(
        sensitivity.score(F.array_repeat(F.lit("t"), F.col("id").cast("int")),
                          F.lit(level)).alias(level)
        for level in (*fv.CLASSIFICATION_LEVELS, "other"))).collect()
    base = {**fv.CLASSIFICATION_BASE_SCORE, "other": 0.0}
    for row in rows:
        for level, start in base.items():
            assert row[level] == round(min(start + min(row.id * 0.1, 0.5), 1.0), 3)


def test_sensitivity_columns(spark):
    docs = spark.createDataFrame(
        [("d", "mail a@b.org EMP-123456 CLT-AB-12345 PROJ-ABC-001 $1.00 breach",
          "restricted")], "document_id string, text string, classification string")
    row = chunking.chunk_workset(docs).first()
    assert abs(row.sensitivity_score - 1.0) < 1e-6
    assert row.requires_encryption and row.requires_restricted_access
    assert "chunk_text" not in chunking.silver_columns(chunking.chunk_workset(docs)).columns
