"""Questions over scopes of chunks against the definition, and without pairs of a scope."""

import pytest
from pyspark.sql import functions as F

from guardmill.operators import keywords
from guardmill.plans import retrieval

CHUNKS = [
    ("s1", 0, "d0", "The Report of harbour works"), ("s1", 1, "d1", "reporting the HARBOUR"),
    ("s1", 2, "d2", "Owner: Ann\nharbour report"), ("s1", 3, "d3", None),
    ("s2", 0, "d4", "harb our rep ort"), ("s2", 5, "d5", "owner = Bob \nlast"),
    ("s2", 4, "d6", "Owner: Cy\n"), ("s3", 0, None, "überlänge straße wörter"),
    (None, 0, "d7", "report harbour"), ("s4", 1, "d8", ""),
]
CHUNKS += [("hot", i, f"h{i:03d}", "the same words everywhere") for i in range(300)]
ASKED = [
    ("q1", "s1", "harbour report"), ("q2", "s2", "harbour report"), ("q3", "s1", "who owner"),
    ("q4", "s2", "the Owner please"), ("q5", "s1", "a an of"), ("q6", "s3", "WÖRTER länge"),
    ("q7", "s1", None), ("q8", None, "harbour report"), ("q9", "s4", "harbour"),
    ("q10", "s1", "port bour"), ("q11", "s5", "report"), ("q12", "s1", "department"),
]
ASKED += [(f"h{i}", "hot", "same words" if i % 2 else "Everywhere SAME") for i in range(200)]


def frames(spark):
    chunks = spark.createDataFrame(
        CHUNKS, "scope string, position int, document_id string, chunk_text string")
    asked = spark.createDataFrame(ASKED, "request_id string, scope string, query string")
    return asked.repartition(3), chunks.repartition(3)


def test_same_answers_as_pairing_every_chunk(spark):
    asked, chunks = frames(spark)
    pairs = asked.select("request_id", "scope").join(chunks, "scope").drop("scope")
    want = retrieval.extract_answers(asked, pairs)
    got = retrieval.answer_questions(asked, chunks)
    assert sorted(map(repr, got.collect())) == sorted(
        map(repr, want.select(got.columns).collect()))


def test_first_text_that_holds_all_words(spark):
    asked, chunks = frames(spark)
    questions = asked.select(F.col("request_id").alias("question"), "scope", F.expr(
        "transform(filter(split(coalesce(query, ''), ' '), w -> length(w) > 3), w -> lower(w))"
    ).alias("words"))
    want = {}
    for q, scope, query in ASKED:
        words = [w.lower() for w in (query or "").split(" ") if len(w) > 3]
        hits = [(p, d) for s, p, d, t in CHUNKS if scope is not None and s == scope
                and t is not None and words and all(w in t.lower() for w in words)]
        if hits:
            want[q] = min(hits, key=lambda h: h[0])
    got = {r.question: (r.position, r.document_id)
           for r in keywords.first_texts(questions, chunks).collect() if r.found}
    assert got == want and got["q10"] == (0, "d0") and len(got) > 200


def test_copies_meet_once(spark):
    """300 equal texts and 200 questions of two kinds are one text and two questions."""
    asked, chunks = frames(spark)
    hot = chunks.filter("scope = 'hot'")
    texts = hot.groupBy("scope", F.sha2(F.lower("chunk_text"), 256).alias("text_key")).agg(
        F.any_value(F.lower("chunk_text")).alias("lowered"))
    grams = spark.createDataFrame([("hot", "same"), ("hot", "zzzz")], "scope string, gram string")
    assert keywords.postings(texts, grams).count() == 1


@pytest.mark.parametrize("text,want", [("abcde fg hijk", ["abcd", "bcde", "hijk"]),
                                       ("abc", []), ("", []), ("aaaaaa", ["aaaa"])])
def test_grams(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(keywords.grams(F.col("t"))).first()
    assert row[0] == want


def test_no_questions_and_no_chunks(spark):
    asked, chunks = frames(spark)
    assert retrieval.answer_questions(asked.limit(0), chunks).count() == 0
    alone = retrieval.answer_questions(asked, chunks.limit(0))
    assert alone.count() == len(ASKED)
    assert alone.select("answer").distinct().count() == 1


def test_repeated_questions_are_answered_each_for_itself(spark):
    asked, chunks = frames(spark)
    twice = asked.filter("request_id IN ('q1', 'q4', 'q5')")
    found = retrieval.answer_questions(twice.unionByName(twice).unionByName(twice), chunks)
    assert found.count() == 9 and found.distinct().count() == 3


def test_a_coarse_sieve_changes_no_answer(spark, monkeypatch):
    """One word of bits per scope and one gram per question: more texts to test, same answers."""
    asked, chunks = frames(spark)
    longer = asked.unionByName(spark.createDataFrame(
        [("l1", "s1", "reporting harbour"), ("l2", "s1", "reporting works"),
         ("l3", "hot", "everywhere")], asked.schema))
    want = sorted(map(repr, retrieval.answer_questions(longer, chunks).collect()))
    monkeypatch.setattr(keywords, "SIEVE_LONGS", 1)
    monkeypatch.setattr(keywords, "PROBES", 1)
    got = sorted(map(repr, retrieval.answer_questions(longer, chunks).collect()))
    assert got == want and sum("turn" in r or "document d1" in r for r in got) == 1


@pytest.mark.parametrize("words,want", [
    (["reporting", "harbour"], {"reportin", "eporting"}), (["port", "bour"], {"port", "bour"}),
    (["abc"], set()), ([], set()), (["abcdefghijklmnopqrst"], None)])
def test_probes_are_grams_of_the_longest_words(spark, words, want):
    row = spark.createDataFrame([(words,)], "w array<string>").select(
        keywords.probes(F.col("w"))).first()
    found = row[0] or []
    if want is None:
        assert len(found) == keywords.PROBES
        assert all(len(g) == 12 and g in words[0] for g in found)
    else:
        assert set(found) == want
