import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from guardmill.contracts import table_schema
from guardmill.functions import crypto, vectors
from guardmill.operators import cache, chunking, embedding, index
from guardmill.plans import pipeline
from guardmill.sources.io import Entry

STAMP = "2030-01-01T00:00:00Z"


def chunk_rows(spark, n=20):
    docs = spark.createDataFrame(
        [(f"d{i}", f"word{i} and more words {i % 3}", f"h{i}", "internal", f"p{i}")
         for i in range(n)],
        "document_id string, text string, document_hash string, classification string, "
        "source_path string")
    return chunking.chunk_documents(docs)


def settings(**more):
    return pipeline.EmbeddingSettings(**{
        "key_id": "k1", "created_at": STAMP, "dim": 16, **more})


def test_pack_and_unpack(spark):
    values = [[1.5, -2.25, 3.1], None, [], [0.1] * 7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<float>")
    packed = df.withColumn("b", vectors.pack_f32("v"))
    rows = packed.withColumn("u", vectors.unpack_f32(
        F.col("b"), F.size("v"))).orderBy("i").collect()
    for value, row in zip(values, rows, strict=True):
        if value is None:
            assert row.b is None and row.u is None
        else:
            assert bytes(row.b) == np.array(value, "<f4").tobytes()
            assert np.array_equal(np.array(row.u, "f4"), np.array(value, "f4"))
    with pytest.raises(Exception, match="expected 4 x 9"):
        packed.filter("i = 0").select(vectors.unpack_f32(F.col("b"), F.lit(9))).collect()


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2 ** -0.5), 0.0]


def test_hashed_words_match_python(spark):
    texts = ["a b a", "", None, "  X x y ", "café \x00naïve"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = embedding.hashed_vectors(df, "t", 8).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        counts = np.zeros(8)
        for word in (text or "").replace("\x00", "").split():
            counts[vectors.word_bucket(word, 8)] += 1
        norm = np.linalg.norm(counts)
        expected = (counts / (norm or 1)).astype("<f4")
        assert np.array_equal(np.frombuffer(row.vector, "<f4"), expected)


def test_custom_encoder_in_bounded_batches(spark):
    def load():
        def encode(texts):
            assert len(texts) <= 3
            return np.array([[len(t), 0.0, 3.0] for t in texts])
        return encode

    df = spark.createDataFrame([("a" * i,) for i in range(10)] + [(None,)], "t string")
    rows = embedding.encoded_vectors(df, "t", load, 3, batch_size=3).collect()
    for row in rows:
        vector = np.frombuffer(row.vector, "<f4")
        assert np.linalg.norm(vector) == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(Exception, match="expected"):
        embedding.encoded_vectors(df, "t", load, 4, batch_size=3).collect()


def test_seal_open_tamper_and_wrong_key(spark, keys):
    df = spark.createDataFrame([(b"\x01" * 384, "c"), (b"", "c"), (None, "c")],
                               "plain binary, ctx string")
    key = keys.filter("key_id = 'k1'").select("key").first().key
    other = keys.filter("key_id = 'k2'").select("key").first().key
    table = spark.createDataFrame([(key, other)], "key binary, other binary")
    sealed = df.join(table).withColumn(
        "s", crypto.seal(F.col("plain"), F.col("key"), F.col("ctx")))
    body, nonce = crypto.body_of(F.col("s")), crypto.nonce_of(F.col("s"))
    flipped = F.concat(F.substring(body, 1, 1), F.unhex(F.lit("ff")), F.substring(
        body, 3, 10_000))
    rows = sealed.select(
        "plain", F.octet_length(nonce).alias("n"), crypto.open_sealed(
            body, nonce, F.col("key")).alias("good"),
        crypto.open_sealed(body, nonce, F.col("other")).alias("wrong"),
        crypto.open_sealed(flipped, nonce, F.col("key")).alias("bad")).collect()
    for row in rows:
        assert row.good == row.plain and row.wrong is None and row.bad is None
        assert row.plain is None or row.n == 12
    with pytest.raises(Exception, match="AES"):
        sealed.select(crypto.open_strict(body, nonce, F.col("other"))).collect()


def test_gold_rows(spark, keys):
    gold = pipeline.fresh_embeddings(chunk_rows(spark), keys, settings())
    assert gold.schema.names == table_schema("gold_embeddings").names
    rows = gold.collect()
    assert len({r.embedding_id for r in rows}) == len(rows) == 20
    assert len({bytes(r.embedding_nonce) for r in rows}) == 20
    assert {len(r.embedding_ciphertext) for r in rows} == {16 * 4 + 16}
    again = pipeline.fresh_embeddings(chunk_rows(spark), keys, settings()).collect()
    assert sorted(rows) == sorted(again), "a retried task must write the same bytes"


def test_no_key_text_in_plans(spark, keys, tmp_path):
    keys.write.parquet(str(tmp_path / "keys"))
    stored = spark.read.parquet(str(tmp_path / "keys"))
    gold = pipeline.fresh_embeddings(chunk_rows(spark), stored, settings())
    text = embedding.open_vectors(gold, stored)._jdf.queryExecution().toString()
    assert bytes(range(32)).hex() not in text.lower()


def test_unknown_key_leaves_vectors_null(spark, keys):
    gold = pipeline.fresh_embeddings(chunk_rows(spark), keys, settings())
    gone = embedding.open_vectors(gold, keys.filter("key_id = 'k2'"))
    assert gone.filter("vector is not null").count() == 0


def test_text_fields(spark, keys):
    chunks = chunk_rows(spark, 4).withColumn(
        "requires_encryption", F.col("document_id").isin("d1", "d3"))
    sealed = embedding.seal_text_fields(chunks, keys, "k1").collect()
    plain = {r.chunk_id: r.chunk_text for r in chunks.collect()}
    for row in sealed:
        if row.requires_encryption:
            assert row.chunk_text_is_encrypted and row.chunk_text != plain[row.chunk_id]
        else:
            assert row.chunk_text_is_encrypted is None
            assert row.chunk_text == plain[row.chunk_id]
    sealed = embedding.seal_text_fields(chunks, keys, "k1")
    opened = embedding.open_text_fields(sealed, keys, "k1").collect()
    assert {r.chunk_id: r.chunk_text for r in opened} == plain
    wrong = embedding.open_text_fields(sealed, keys, "k2").collect()
    assert {r.chunk_text is None for r in wrong if r.requires_encryption} == {True}
    with pytest.raises(Exception, match="(?i)subquery"):
        embedding.seal_text_fields(chunks, keys.unionByName(keys), "k1").collect()


def test_cache_split_and_latest(spark):
    chunks = spark.createDataFrame(
        [("c1", "a", "p"), ("c2", "b", "p"), ("c3", "c", "p")],
        "chunk_id string, document_hash string, source_path string")
    stored = spark.createDataFrame(
        [("c1", "a", "k", "m", 4, f"2030-01-{d:02d}") for d in range(1, 29)]
        + [("c2", "stale", "k", "m", 4, "2030-01-01"), ("c3", "c", "old", "m", 4, "2030")],
        "chunk_id string, document_hash string, key_id string, model string, "
        "embedding_dim int, created_at string")
    hits, misses = cache.split(chunks, cache.reusable(stored, "m", 4, "k"))
    assert [(r.chunk_id, r.created_at) for r in hits.collect()] == [("c1", "2030-01-28")]
    assert sorted(r.chunk_id for r in misses.collect()) == ["c2", "c3"]
    cold_hits, cold_misses = cache.split(chunks, None)
    assert cold_hits.count() == 0 and cold_misses.count() == 3
    gold = cache.gold_from_hits(hits, "k", STAMP).collect()
    assert gold[0].embedding_model == "m" and gold[0].created_at == STAMP
    assert cache.gold_from_hits(hits, "other", STAMP).count() == 0
    assert cache.gold_from_hits(chunks, "k", STAMP).count() == 0


def test_build_with_cache_encodes_only_misses(spark, keys, tmp_path):
    path = str(tmp_path / "cache")
    reader = Entry(options={"format": "parquet", "path": path})
    writer = Entry(options={"format": "parquet", "path": path, "mode": "append"})
    chunks = chunk_rows(spark)
    first = pipeline.build_embeddings(chunks, keys, settings(), reader, writer).collect()

    def refuse():
        def encode(texts):
            raise AssertionError("nothing should be encoded")
        return encode

    again = pipeline.build_embeddings(chunks, keys, settings(load_encoder=refuse), reader,
                                      writer).collect()
    assert sorted(first) == sorted(again) and len(again) == 20
    assert spark.read.parquet(path).count() == 20
    # another key is a miss for every chunk
    rotated = pipeline.build_embeddings(chunks, keys, settings(key_id="k2"), reader, writer)
    assert {r.key_id for r in rotated.collect()} == {"k2"}
    assert spark.read.parquet(path).count() == 40


def test_index_upsert(spark, keys):
    gold = pipeline.fresh_embeddings(chunk_rows(spark), keys, settings())
    table = pipeline.build_index(gold, keys)
    assert table.count() == 20
    assert not {"embedding_ciphertext", "embedding_nonce", "key_id", "chunk_text"} & set(
        table.columns)
    moved = gold.filter("document_id in ('d1', 'd2')").withColumn("owner", F.lit("new"))
    after = pipeline.build_index(moved, keys, table)
    assert after.count() == 20 and after.filter("owner = 'new'").count() == 2
    with pytest.raises(Exception, match="no vector for candidate"):
        index.index_rows(gold.withColumn("vector", F.lit(None).cast("binary"))).collect()
    nameless = gold.withColumn("chunk_id", F.lit("")).withColumn("embedding_id", F.lit(""))
    assert index.index_rows(nameless.withColumn("vector", F.lit(b"x"))).count() == 0


def test_word_buckets_are_those_of_single_words():
    words = ["", "Word", "WORD", "word", "É", "ÀB", "İx", "ΑΣ", "straße", "\u212a", "a" * 300, "漢"]
    for dim in (1, 16, 64, 1000):
        got = vectors.word_buckets(pa.array(words, pa.string()), dim)
        assert got.tolist() == [vectors.word_bucket(w, dim) if w else -1 for w in words]
    assert vectors.word_buckets(pa.array([], pa.string()), 8).tolist() == []
