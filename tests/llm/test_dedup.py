"""Exact dedup, near duplicates, repeated passages."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import (EXTRA, components, edge_rows, edited, frame, grams, prose,
                   without_repeats)

from guardmill.llm import components as cc
from guardmill.llm import ngram_join, stream_dedup, substring_dedup, wordhash


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for i, t, *_ in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out[i, keep, len(same)] += 1
    return out


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup_edges(spark, extra):
    rows = edge_rows()
    found = stream_dedup.dedup_documents(frame(spark, rows, extra))
    assert counted(found, "doc_id", "keep_id", "group_size") == exact(rows)
    kept = found.filter("kept").collect()
    assert all(r.doc_id == r.keep_id for r in kept)
    assert {r.text_sha256 for r in kept} == {r.text_sha256 for r in found.collect()}


def test_exact_dedup_keeps_one_of_repeated_rows_from_files(spark, tmp_path):
    rows = edge_rows()
    frame(spark, rows, True).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = stream_dedup.dedup_documents(docs)
    assert found.filter("kept").count() == len({r[1] or "" for r in rows})
    stay = stream_dedup.kept_documents(docs)
    assert stay.columns == docs.columns
    assert stay.count() == len({r[1] or "" for r in rows})


def test_exact_dedup_state_goes_on(spark, tmp_path):
    path = str(tmp_path / "in")
    docs = frame(spark, [(1, "a", None, None, 0), (2, "b", None, None, 0)])
    stream_dedup.arrivals(docs).write.parquet(path)
    stream = spark.readStream.schema(stream_dedup.arrivals(docs).schema).parquet(path)
    state = str(tmp_path / "state")
    stream_dedup.keep_state(stream, state)
    later = frame(spark, [(3, "a", None, None, 0)])
    stream_dedup.arrivals(later).write.mode("append").parquet(path)
    found = {(r.keeper.id, r.group_size)
             for r in stream_dedup.keep_state(stream, state).collect()}
    assert found == {(3, 2), (2, 1)}


@pytest.mark.parametrize("store_rows, partitions", [(65_536, 23), (9, 3)])
def test_exact_dedup_state_follows_the_rows(spark, tmp_path, monkeypatch, store_rows, partitions):
    monkeypatch.setattr(stream_dedup, "STORE_ROWS", store_rows, raising=False)
    monkeypatch.setattr(stream_dedup, "scratch_path", lambda _, label: str(tmp_path / label))
    rows = edge_rows() + [(1000 + i, f"t{i // 3}", None, None, 0) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = stream_dedup.dedup_documents(frame(spark, rows))
        assert counted(found, "doc_id", "keep_id", "group_size") == exact(rows)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [p for p in (tmp_path / "dedup/checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert len(stores) == max(spark.sparkContext.defaultParallelism,
                              -(-len(rows) // store_rows))


def test_exact_dedup_compares_bytes(spark):
    docs = frame(spark, [(1, "a", None, None, 0), (2, "b", None, None, 0)])
    both = docs.selectExpr("sha2(text, 256) AS digest")
    stream_dedup.check_bytes(docs, both, both.limit(0), "text")


def test_similar_documents_edges(spark):
    rows = edge_rows()
    found = ngram_join.similar_documents(frame(spark, rows, True))
    assert counted(found, "doc_id", "n_shingles", "component_id") == components(rows)


def near_rows():
    base = prose(11, 200)
    rows = [(i, edited(base, i, i % 9), None, None, 0) for i in range(90)]
    other = prose(12, 60)
    rows += [(100 + i, edited(base, 500 + i, 22 + i % 12), None, None, 0) for i in range(40)]
    return rows + [(200 + i, other + " " + prose(300 + i, 25), None, None, 0)
                   for i in range(40)]


def test_similar_documents_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "_HOT_SHARE", 0.0001)
    rows = near_rows()
    found = ngram_join.similar_documents(frame(spark, rows))
    assert counted(found, "doc_id", "n_shingles", "component_id") == components(rows)
    stay = ngram_join.one_of_each(frame(spark, rows, True))
    assert {r.doc_id for r in stay.collect()} == {c for _, _, c in components(rows)}


@pytest.mark.parametrize("block", [256, 16])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    rows = edge_rows() + near_rows()
    sets = [grams(r[1]) for r in rows]

    def link(x, y):
        return x and 100 * len(x & y) >= 75 * len(x | y)

    found, pairs = ngram_join.linked_documents(frame(spark, rows, True))
    assert counted(found, "doc_id", "n_shingles", "n_links") == Counter(
        (r[0], len(x), sum(bool(link(x, y)) for y in sets) - bool(x))
        for r, x in zip(rows, sets, strict=True))
    assert counted(found, "doc_id", "n_shingles", "component_id") == components(rows)
    # classes are the different sets; of those that link every pair is there, once
    classes = list({x for x in sets if x})
    want = sum(bool(link(x, y)) for i, x in enumerate(classes) for y in classes[:i])
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) == want and all(a < b for a, b in got)
    # copies at a class count one by one
    node = {r.node: r for r in found.filter("node IS NOT NULL").collect()}
    copies = Counter(r.node for r in found.collect())
    links = Counter()
    for a, b in got:
        links[a] += copies[b]
        links[b] += copies[a]
    assert all(r.n_links == links[n] + copies[n] - 1 for n, r in node.items())


def test_overlap_bounds():
    chance = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(chance.integers(0, 60, 30)).astype(np.uint64) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert ngram_join.overlap(x, y) == both <= ngram_join.suffix_bound(x, y)
        need = ngram_join.least_overlap(len(x), len(y))
        assert (both >= need) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_components(spark):
    chance = random.Random(3)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(250)]
    edges += [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = cc.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(x, find(x)) for x in root if find(x) != x}


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_edges(spark, monkeypatch, hot):
    rows = edge_rows() + near_rows()
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", 4)
    found = substring_dedup.remove_repeats(frame(spark, rows, True).coalesce(2),
                                           keep_text=True)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256"
                   ) == without_repeats(rows)
    texts = {r.doc_id: r for r in found.collect()}
    assert texts[13].kept_text and texts[13].spans


def test_paths_of_whole_copies(spark):
    passage = prose(2, 400)
    docs = frame(spark, [(i, passage, None, None, 0) for i in range(3)])
    paths = substring_dedup.compact_paths(substring_dedup.repeated_runs(docs)).collect()
    assert [(p.doc, p.pos, p.n, p.src, p.src_pos) for p in sorted(paths)] == [
        (1, 0, 351, 0, 0), (2, 0, 351, 0, 0)]


def test_paths_end_where_they_branch(spark):
    runs = [(1, 0, 0, 5, 0, 0, 0), (1, 0, 5, 4, 0, 0, 5), (1, 0, 9, 3, 0, 0, 9),
            (2, 0, 7, 5, 0, 0, 0), (2, 0, 12, 4, 0, 0, 5), (3, 0, 0, 6, 0, 0, 40),
            (3, 0, 6, 6, 1, 0, 46)]
    df = spark.createDataFrame(runs, substring_dedup._RUNS).repartition(3)
    got = {tuple(r) for r in substring_dedup.compact_paths(df).collect()}
    assert got == {(1, 0, 0, 9, 0, 0, 0), (1, 0, 9, 3, 0, 0, 9), (2, 0, 7, 9, 0, 0, 0),
                   (3, 0, 0, 6, 0, 0, 40), (3, 0, 6, 6, 1, 0, 46)}


def test_window_hashes():
    texts = [t.encode() for t in ("a b  c\nd e", "", "c d e f", prose(1, 500))]
    hashes, bounds = wordhash.hash_texts(texts)
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    assert hashes[2] == hashes[5] and hashes[0] != hashes[1]
    folded, _ = wordhash.hash_words(b"AbC \xc3\x84")
    assert (folded != wordhash.hash_words(b"abc \xc3\x84", fold=True)[0])[0]
    assert (wordhash.hash_words(b"AbC \xc3\x84", fold=True)[0]
            == wordhash.hash_words(b"abc \xc3\x84")[0]).all()
    long = b"y" * (3 << 20) + b" z " + b"q " * 10
    assert len(wordhash.hash_words(long)[0]) == 12
    values = np.random.default_rng(1).integers(0, 99, 300)
    for width in (1, 2, 7, 26):
        assert (substring_dedup.sliding_min(values, width) == [
            values[i:i + width].min() for i in range(300 - width + 1)]).all()


def test_empty_tables(spark):
    empty = frame(spark, [], True)
    assert stream_dedup.dedup_documents(empty).count() == 0
    assert ngram_join.similar_documents(empty).count() == 0
    assert [df.count() for df in ngram_join.linked_documents(empty)] == [0, 0]
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert len(EXTRA) > 10


def swapped_words(letters="ab", times=10):
    """A word of 1,024 letters that swaps and repeats itself, and it with letters swapped."""
    word = letters[0]
    for _ in range(times):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def test_words_that_swap_and_repeat_themselves(spark):
    one, other = swapped_words()
    for times in range(1, 12):
        a, b = (w.encode() for w in swapped_words("ab", times))
        assert wordhash.hash_words(a)[0][0] != wordhash.hash_words(b)[0][0]
    tail = prose(70, 60)
    rows = [(1, one, None, None, 0), (2, other, None, None, 0),
            (3, f"{one} {tail}", None, None, 0), (4, f"{other} {tail}", None, None, 0),
            (5, " ".join([one] * 60), None, None, 0), (6, " ".join([other] * 60), None, None, 0)]
    found = ngram_join.similar_documents(frame(spark, rows))
    assert counted(found, "doc_id", "n_shingles", "component_id") == components(rows)
    cut = substring_dedup.remove_repeats(frame(spark, rows))
    assert counted(cut, "doc_id", "n_words", "n_removed", "kept_sha256") == \
        without_repeats(rows)


def test_word_hashes_by_length():
    words = [bytes([97 + (i * j) % 23 for j in range(1, n + 1)])
             for n in (1, 7, 8, 9, 16, 17, 255, 256, 257, 3000) for i in range(1, 20)]
    for strong in (0, 1, 2):
        hashes, places = wordhash.hash_words(b"\n ".join(words), strong=strong)
        assert len(hashes) == len(words) and places[1] == 3
        assert len(set(hashes.tolist())) == len(set(words))
        alone = [int(wordhash.hash_words(b" " * (i % 9) + w, strong=strong)[0][0])
                 for i, w in enumerate(words)]
        assert hashes.tolist() == alone
    assert wordhash.hash_words(b"ab")[0] != wordhash.hash_words(b"ab", strong=1)[0]
    assert wordhash.hash_words(b"ab", strong=1)[0] != wordhash.hash_words(b"ab", strong=2)[0]


def test_repeats_where_hashes_collide_often(spark, monkeypatch):
    """Windows that meet others by their hash cost a second pass and no wrong result."""
    tried = []
    monkeypatch.setattr(substring_dedup, "WORD_BITS", 1)
    inside = substring_dedup._wrong_sources
    monkeypatch.setattr(substring_dedup, "_wrong_sources",
                        lambda done: tried.append(inside(done)) or tried[-1])
    passage = prose(80, 70)
    rows = [(i, f"{prose(90 + i, 40)} {passage} {prose(95 + i, 30)}", None, None, 0)
            for i in range(5)]
    rows += [(10 + i, " ".join(["x y"[2 * (i % 2)]] * 55 + [prose(i, 1)]), None, None, 0)
             for i in range(6)]
    rows += [(20, " ".join(["p", "q"] * 60), None, None, 0),
             (21, " ".join(["r", "s"] * 60), None, None, 0),
             (22, " ".join(["t", "u"] * 60), None, None, 0),
             (23, " ".join(["r", "s"] * 60), None, None, 0)]
    cut = substring_dedup.remove_repeats(frame(spark, rows))
    assert counted(cut, "doc_id", "n_words", "n_removed", "kept_sha256") == \
        without_repeats(rows)
    assert tried == [True, False]
