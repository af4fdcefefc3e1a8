"""WARC archives, token files, packing."""

import base64
import functools
import gzip
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import crc, edge_rows, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from guardmill.llm import packing, simple8b, token_files, tokens, warc
from guardmill.operators.scratch import scratch_path

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PAGES = "page_id long, url string, html string, digest string, kind string"


def pages(spark):
    rows = [(1, "http://a/\r\nx", "hello"), (2, None, "hello"), (3, "u", None), (4, "u", ""),
            (5, "u", "ä" * 300_000), (6, "u", "ä" * 300_000), (None, "n", "no id"),
            (7, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "x"), (8, "u", "x")]
    return rows, spark.createDataFrame([(*r, "d", "k") for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(spark, least):
    rows, df = pages(spark)
    found = warc.archive_pages(spark, df, scratch_path(spark, "warc"), least_bytes=least)
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(i, first.get(body, i))
    want = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        lead = first.get(body, i)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = lead != i
        want[i, len(body), digest, "revisit" if again else "response",
             lead if again else None] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in found.collect())
    assert got == want
    assert found.filter("NOT digest_ok").count() == 0


def test_no_pages(spark):
    _, df = pages(spark)
    assert warc.archive_pages(spark, df.limit(0), scratch_path(spark, "warc")).count() == 0


def record(payload=b"abc", kind="response", page=1):
    return warc.record_bytes(kind, page, "http://x", payload, warc.sha1_base32(payload), 0)


def read(data, **options):
    return list(warc.read_archive(io.BytesIO(data), **options))


def test_reader_frames_records():
    big = np.random.default_rng(0).bytes(3 << 20)
    data = record() + record(big, page=2) + record(kind="revisit", page=3)
    found = read(data, keep_payload=True)
    assert [r.headers["warc-type"] for r in found] == ["response", "response", "revisit"]
    assert found[1].payload == big and found[0].payload == b"abc" and found[2].payload == b""
    assert all(r.digest_ok for r in found)
    assert [r.offset for r in found] == [0, len(record()), len(record()) + len(
        record(big, page=2))]
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert read(b"") == []


def test_reader_reports_damage():
    plain = gzip.decompress(record())

    def packed(data):
        return gzip.compress(data)

    assert not read(packed(plain.replace(b"abc\r\n", b"abd\r\n")))[0].digest_ok
    for broken in (plain.replace(b"\r\n\r\nHTTP", b"\r\n\r\n+HTTP"), plain[:-1], plain[:40],
                   b"x" + plain, plain + b"more"):
        with pytest.raises(ValueError):
            read(packed(broken))
    with pytest.raises(ValueError):
        read(record()[:-30])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000),
                          st.integers(0, 2 ** 64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    data = np.array(values, dtype=np.uint64)
    assert (simple8b.decode(simple8b.encode(data)) == data).all()


def test_simple8b_packs_runs():
    assert len(simple8b.encode(np.zeros(2400, np.uint64)).words) == 10
    assert len(simple8b.encode(np.ones(600, np.uint64)).words) == 10
    block = simple8b.encode(np.array([1 << 60, 5, (1 << 64) - 1], dtype=np.uint64))
    assert block.places.tolist() == [0, 2]


ODD = st.text(alphabet=" \n\t\x0b\x1c\x85\xa0　abAB'sé́ΣσI1.!<|>", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=5))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_give_the_ids_of_the_whole(path, texts):
    texts += ["a  <|endoftext|>b", "x  y   z \n w  "]
    plain = Tokenizer.from_file(path)
    got = tokens.load(path).encode(texts)
    assert [g.tolist() for g in got] == [
        e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_cache_is_bounded():
    small = tokens.PieceTokenizer(WORD, cache_pieces=5)
    for i in range(30):
        small.encode([f"word{i} other{i}"])
        assert len(small._cache) <= 6


MIXED = st.text(alphabet=" \n\t\r'strevmldSTA10.,×÷àÀßÿ“—\u00a0\u2003\u3000\u0301жя中\x00\x7f",
                max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(MIXED, max_size=6))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_give_the_ids_of_the_whole(path, texts):
    plain, small = plain_and_small(path)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(["cut off", *texts]).slice(1)
    for _ in range(2):
        assert [g.tolist() for g in small.encode(column)] == want


@functools.cache
def plain_and_small(path):
    return Tokenizer.from_file(path), tokens.PieceTokenizer(path, cache_pieces=12)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_are_learnt_without_what_stands_beside_them(path):
    words = ["alpha", "beta", "gamma", "delta's", "élan", "12"]
    texts = [f"{w}{end} {w}{end}" for w in words for end in (".", ",", ")", "\nnext", "!?")]
    encoder = tokens.PieceTokenizer(path)
    encoder.encode(texts)
    parts = {p for t in texts for p, _ in
             Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(t)} - {"\u0120"}
    assert len(encoder._cache) == len(parts)


def test_slices_are_consecutive():
    column = pa.array(["abc", None, "é" * 5, "", "x", "yz"]).slice(1)
    for most in (1, 4, 10, 100):
        found = list(tokens.slices_of_bytes(column, most))
        assert pa.concat_arrays(found).equals(column)
        assert all(len(part) for part in found)
    assert list(tokens.slices_of_bytes(column.slice(0, 0), 5)) == []
    got = tokens.load(BYTE).encode(column)
    assert [len(g) > 0 for g in got] == [False, True, False, True, True]


def test_token_files(spark):
    rows = edge_rows()
    folder = scratch_path(spark, "ids")
    files = token_files.write_ids(frame(spark, rows, True), folder, WORD, file_ids=20_000)
    assert files.count() > 1
    found = token_files.read_documents(files).collect()
    plain = Tokenizer.from_file(WORD)
    want = Counter()
    for i, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), crc(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum(
        [0] + [r.n_tokens for r in ordered])[:-1].tolist()
    names = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert names == sorted(names)
    empty = token_files.write_and_read(spark, frame(spark, []), folder, WORD)
    assert empty.count() == 0


def test_ids_by_range():
    out = io.BytesIO()
    out.close = lambda: None
    writer = token_files.IdWriter(out, block=16)
    data = np.arange(1000, dtype=np.uint32) * 7
    for at in range(0, 1000, 90):
        writer.add(at, data[at:at + 90])
    assert writer.close()[:2] == (12, 1000)

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = token_files.IdReader(Source(out.getvalue()))
    assert (reader.read(333, 100) == data[333:433]).all()
    assert [d[3] for d in reader.documents()][0] == zlib.crc32(data[:90].tobytes())
    with pytest.raises(ValueError):
        token_files.IdReader(Source(out.getvalue()[:-3]))


def test_pieces():
    assert packing.cut_pieces(5, 10) == [(0, 5)]
    assert packing.cut_pieces(10, 10) == [(0, 10)]
    assert packing.cut_pieces(25, 10) == [(0, 5), (5, 10), (15, 10)]
    assert packing.cut_pieces(30, 10) == [(0, 10), (10, 10), (20, 10)]


def fewest(lengths, capacity):
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for j in range(len(free)):
            if free[j] >= lengths[i] and free[j] not in free[:j]:
                place(i + 1, [*free[:j], free[j] - lengths[i], *free[j + 1:]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best


def test_packing_of_small_cases():
    chance, missed = np.random.default_rng(5), 0
    for _ in range(60):
        lengths = np.sort(chance.integers(1, 20, chance.integers(1, 10)))[::-1].copy()
        bound, best = packing.least_bins(lengths, 20), fewest(lengths.tolist(), 20)
        people = packing.first_people(lengths, chance, 0, capacity=20)
        ranked = packing.evolve(lengths, people, bound, chance, capacity=20)
        for bins in ranked:
            assert np.bincount(bins, weights=lengths).max() <= 20
        found = int(ranked[0].max()) + 1
        assert bound <= best <= found
        missed += found - best
    assert missed <= 1


def test_crossover_keeps_every_piece():
    chance = np.random.default_rng(1)
    lengths = np.sort(chance.integers(1, 2048, 500))[::-1].copy()
    people = packing.first_people(lengths, chance, 1)
    child = packing.crossover(lengths, people[0], people[-1], chance)
    assert len(child) == 500 and np.bincount(child, weights=lengths).max() <= 2048
    assert set(child.tolist()) == set(range(int(child.max()) + 1))


@pytest.mark.parametrize("block", [4096, 8])
def test_packing(spark, monkeypatch, block):
    rows = edge_rows() * 2
    pieces = packing.document_pieces(frame(spark, rows, True), BYTE)
    items = pieces.filter("length < 2048").select("uid", "length")
    placed = {r.uid: r for r in packing.pack_items(items, block_pieces=block).collect()}
    sizes = {r.uid: r.length for r in items.collect()}
    assert placed.keys() == sizes.keys()
    bins = {}
    for uid, r in placed.items():
        bins.setdefault(r.sequence_id, []).append((r.offset, sizes[uid]))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(bins) <= packing.least_bins(np.array(list(sizes.values()))) + 1


def test_packed_documents(spark):
    rows = edge_rows()
    found = packing.pack_documents(frame(spark, rows, True), BYTE).collect()
    plain = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for p, (s, n) in enumerate(packing.cut_pieces(len(ids))):
            want[i, p, s, n, crc(ids[s:s + n])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
                   for r in found) == want
    assert packing.pack_documents(frame(spark, []), BYTE).count() == 0


def test_damaged_archives_end_the_job(spark):
    _, df = pages(spark)
    written = warc.write_archives(warc.choose_records(df), scratch_path(spark, "warc"))
    records = warc.read_archives(written)
    assert warc.verified(records) is records
    revisit = F.col("record_type") == "revisit"
    for damaged in (
            records.withColumn("digest_ok", F.col("record_id") != "<urn:page:4>"),
            records.withColumn("payload_digest", F.when(revisit, "A").otherwise(
                F.col("payload_digest"))),
            records.withColumn("payload_bytes", F.when(revisit, F.lit(1).cast("long"))
                               .otherwise(F.col("payload_bytes"))),
            records.withColumn("refers_to", F.when(revisit, "<urn:page:99>"))):
        with pytest.raises(warc.BadArchive):
            warc.verified(damaged)


def test_ids_that_look_like_none(spark):
    rows = [("null", "u", "a", "d", "k"), (None, "u", "b", "d", "k"), ("", "u", "c", "d", "k"),
            ("x\ny", "u", "b", "d", "k")]
    df = spark.createDataFrame(rows[:3], PAGES.replace("long", "string"))
    found = warc.archive_pages(spark, df, scratch_path(spark, "warc")).collect()
    assert {(r.page_id, r.payload_bytes) for r in found} == {("null", 1), (None, 1), ("", 1)}
