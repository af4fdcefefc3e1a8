"""Sharding, mixing, the classifier, the rules and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from brute import edge_rows, edited, frame, prose, rule_counts, targets, words
from pyspark.sql import functions as F

import corpus_pipeline
from guardmill.llm import columns, mixing, quality_classifier, quality_rules, queries
from guardmill.llm import sharding


def test_word_count_and_list(spark):
    rows = edge_rows()
    got = frame(spark, rows).select(
        "text", columns.word_count(columns.document_text()).alias("n"),
        F.size(columns.word_list(columns.document_text())).alias("m")).collect()
    assert all(r.n == r.m == len(words(r.text)) for r in got)


def test_shards(spark):
    rows = edge_rows()
    found = sharding.shard_documents(frame(spark, rows, True), [1.0] * 4,
                                     grown=[1.0] * 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id == 6}) == 1
    assert sharding.shard_documents(frame(spark, []), [1.0]).count() == 0


def test_shards_follow_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    got = {r["shard"]: r["count"] for r in sharding.with_shard(
        ids, [1.0, 0.0, 3.0], "k").groupBy("shard").count().collect()}
    assert set(got) == {0, 2} and abs(got[2] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("k"), [0.0])
    with pytest.raises(ValueError):
        sharding.with_shard(ids, [1.0], "k", "k")


def mixed(spark, rows, **options):
    return mixing.mix_documents(frame(spark, rows, True), **options).collect()


def test_mix(spark):
    rows = edge_rows()
    found = mixed(spark, rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    assert Counter((r.doc_id, r.size) for r in found) == Counter(
        (r[0], len(words(r[1]))) for r in rows)
    assert all(r.taken <= 3 * r.size for r in found)
    assert {round(r.target, 6) for r in found} == {round(t, 6) for t in want.values()}
    assert found and sorted(map(tuple, found), key=repr) == sorted(
        map(tuple, mixed(spark, list(reversed(rows)))), key=repr)


@pytest.mark.parametrize("slots", [1 << 20, 300])
def test_mix_comes_near_targets(spark, slots):
    rows = [(i, prose(i, 20 + i % 200), None, None if i % 17 == 0 else f"s{i * i % 4}", 0)
            for i in range(300)]
    taken, target = defaultdict(int), {}
    source = {r[0]: r[3] for r in rows}
    found = mixed(spark, rows, slots=slots)
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    total = sum(r.size for r in found)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 3 * max(1, -(-total // slots)), s


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [r.taken for r in mixed(spark, [(1, None, None, None, 0), (2, " ", "", "a", 0)])
            ] == [0, 0]


def test_mix_of_a_large_input_takes_small_sources(spark):
    """Above 2^20 words a small source is still taken up to its target."""
    filler = " ".join(["w"] * 100_000)
    rows = [(i, filler, None, "a", 0) for i in range(60)]
    rows += [(100, prose(1, 3), None, "b", 0), (101, prose(2, 13), None, "c", 0)]
    found = {r.doc_id: r for r in mixed(spark, rows)}
    for i, size in ((100, 3), (101, 13)):
        assert found[i].target == 3.0 * size
        assert abs(found[i].taken - 3 * size) <= 3, found[i]
    got = mixing.mixed_documents(frame(spark, rows, True))
    assert got.filter("doc_id >= 100").count() >= 4


def test_source_words_count_the_slots(spark):
    sizes = {"a": 700, "b": 3, "c": 0, "d": 150, "e": 40}
    goals = {"a": 500.5, "b": 9.0, "c": 0.0, "d": 263.5, "e": 120.0}
    table = spark.createDataFrame([("s" + k, sizes[k], goals[k]) for k in sizes],
                                  "skey string, source_size long, target double")
    for slots in (0, 1, 893, 100_000):
        want, low, total = {}, 0, sum(goals.values())
        points = [(i * mixing.GOLDEN + (1 << 31)) % (1 << 32) for i in range(slots)]
        for k in sizes:
            high = low + goals[k]
            since, until = (math.ceil(v / total * 2 ** 32) for v in (low, high))
            want["s" + k] = min(3 * sizes[k], sum(since <= p < until for p in points))
            low = high
        got = mixing.source_words(table, slots)
        assert {r.skey: r.words for r in got.collect()} == want, slots
    # beyond 2^32 slots, and their error does not grow with them
    slots = 5 * 10 ** 12
    got = mixing.source_words(table.withColumn("source_size", F.lit(slots)), slots).collect()
    assert sum(r.words for r in got) == slots
    assert all(abs(r.words - slots * goals[r.skey[1]] / total) < 100 for r in got)


def test_schedule_ranks_slots_and_takes_blocks(spark):
    """Every slot is ranked within its source, and its rank decides which word it takes."""
    sizes = {"a": 700, "b": 3, "c": 0, "d": 150, "e": 40}
    goals = {"a": 500.5, "b": 9.0, "c": 0.0, "d": 263.5, "e": 120.0}
    table = spark.createDataFrame([("s" + k, sizes[k], goals[k]) for k in sizes],
                                  "skey string, source_size long, target double")
    slots, length = 893, 64
    seen, want, low, total = Counter(), {}, 0, sum(goals.values())
    cuts = []
    for k in sizes:
        high = low + goals[k]
        cuts.append((k, *(math.ceil(v / total * 2 ** 32) for v in (low, high))))
        low = high
    taken = defaultdict(Counter)
    for i in range(slots):
        p = (i * mixing.GOLDEN + (1 << 31)) % (1 << 32)
        k = next(k for k, since, until in cuts if since <= p < until)
        rank, n = want.get(("s" + k, i // length), (seen[k], 0))
        want["s" + k, i // length] = rank, n + 1
        if seen[k] < 3 * sizes[k]:
            taken["s" + k][i // length, seen[k] // sizes[k], seen[k] % sizes[k]] += 1
        seen[k] += 1
    runs = mixing.slot_runs(table, slots, length)
    assert {(r.skey, r.run): (r.rank, r.n) for r in runs.collect()} == want
    got = defaultdict(Counter)
    for r in mixing.scheduled_blocks(runs, table, block=16).collect():
        assert 0 <= r.start and r.start + r.words <= 16
        got[r.skey].update((r.run, r.turn, 16 * r.block + r.start + j) for j in range(r.words))
    assert got == taken


def test_mix_meets_documents_with_the_scheduled_blocks(spark, monkeypatch):
    """`taken` comes from the blocks the schedule takes, whatever their size."""
    rows = [(i, prose(i, i % 23), None, f"s{i % 3}", 0) for i in range(120)]
    whole = sorted(map(tuple, mixed(spark, rows)))
    calls, blocks = [], mixing.scheduled_blocks

    def watched(runs, sources, worth, repeats):
        calls.append(worth)
        return blocks(runs, sources, worth, repeats, mixing.BLOCK_WORDS)

    monkeypatch.setattr(mixing, "scheduled_blocks", watched)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 7)
    assert sorted(map(tuple, mixed(spark, rows))) == whole and calls == [1]


def test_mixed_rows(spark):
    rows = [(i, prose(i, 50), None, "big" if i < 90 else "small", 0) for i in range(100)]
    docs = frame(spark, rows, True)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    count = Counter(r.source for r in got.select("source").collect())
    assert abs(count["small"] - 30) <= 1 and abs(count["big"] - 70) <= 1


def labelled(spark):
    chance, rows, labels = random.Random(1), [], []
    for i in range(400):
        good = chance.random() < 0.7
        text = prose(i % 40 + 1, 80) if good else "".join(
            chance.choices("#$%&XYZ! ", k=400))
        rows.append((i, edited(text, i, 5) if good else text, None, None, 0))
        labels.append((i, int(good), 0))
    return frame(spark, rows, True), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_classifier(spark):
    docs, labels, truth = labelled(spark)
    found = quality_classifier.classify_documents(docs, labels).collect()
    unseen = [r for r in found if r.held_out]
    assert {r.doc_id for r in unseen} == {i for i in truth
                                          if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) > 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    good = quality_classifier.good_documents(docs, labels)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in found if r.predicted}


def test_classifier_learns_nothing_from_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    unseen = quality_classifier.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(unseen, 1 - F.col("quality")).otherwise(
        F.col("quality")))

    def scores(which):
        return {r.doc_id: r.score
                for r in quality_classifier.classify_documents(docs, which).collect()}

    assert scores(labels) == scores(turned)


def test_classifier_edges(spark):
    docs = frame(spark, edge_rows(), True)
    labels = spark.createDataFrame([(None, 1), (1, None), (6, 1), (6, 0), (3, 7)],
                                   "doc_id long, quality int")
    found = quality_classifier.classify_documents(docs, labels).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r.score <= 1 for r in found)
    assert quality_classifier.classify_documents(docs.limit(0), labels).count() == 0
    sample = quality_classifier.training_pieces(*labelled(spark)[:2], pieces=7)
    assert all(r["count"] <= 7 for r in sample.groupBy("label", "part").count().collect())


def test_rule_counts(spark):
    rows = edge_rows() + [(50 + i, t, None, None, 0) for i, t in enumerate((
        "a b c d e a b c d e", "a b c d e f a b c d e", "x a b c d e y a b c d e z",
        "l\nl\n\n \nl\nm", "a a a a a", "a a a a a a"))]
    got = quality_rules.judge_documents(frame(spark, rows, True)).collect()
    want = Counter()
    for i, text, *_ in rows:
        counts = rule_counts(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want[i, *counts, failed] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge_documents(frame(spark, [])).count() == 0


def patterns():
    """Votes of five rules: a tenth of the rows is bad, in two different ways."""
    chance, found = random.Random(2), Counter()
    for _ in range(5000):
        kind = chance.random()
        votes = [int(chance.random() > 0.01) for _ in range(4)] + [chance.choice((1, 0))]
        if kind < 0.05:
            votes[0] = votes[1] = 0
        elif kind < 0.1:
            votes[2] = votes[3] = 0
        found[tuple(votes)] += 1
    return found


def test_label_model_finds_the_bad():
    model = quality_rules.fit_label_model(patterns(), 5)
    assert 0.8 < model.prior < 0.95
    assert model.accuracy(0) > 0.85 > 0.75 > model.accuracy(4)
    # the useless rule weighs next to nothing
    keep, bad = model.votes[4][quality_rules.REJECT]
    assert 0.7 < keep / bad <= 1.01
    assert quality_rules.fit_label_model({}, 3) == quality_rules.start_model(3)


def test_rules_against_labels(spark, sf):
    got = quality_rules.judge_documents(queries.documents(spark, sf)).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed")
    assert got.filter("quality = 1 AND NOT kept").count() <= 0.02 * got.count()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "exact_dedup", "near_dedup", "mix", "pack"]
    packed = corpus_pipeline.run(spark, sf)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"),
                                             F.max(F.col("offset") + F.col("length"))
                                             .alias("end"))
    assert fill.filter("n > 2048 OR n <> end").count() == 0
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter(
        "quality = 0").collect()}
    assert ids and len(ids & bad) <= 0.1 * len(bad)
    texts = [r.text for r in docs.filter(F.col("doc_id").isin(list(ids))).collect()]
    assert len(texts) == len(set(texts))


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]
    last = {}
    for r in rows:
        last[r[1]] = max(r[0], last.get(r[1], -1))
    kept = stages["exact_dedup"](spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == set(last.values())
    from brute import components
    apart = stages["near_dedup"](spark, docs, sf)
    assert apart.columns == docs.columns
    assert {r.doc_id for r in apart.collect()} == {c for _, _, c in components(rows)}


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert public_tokenizers.path("word_bpe_49k.json")


# --- a plain version of the classifier ----------------------------------------------------


def spark_hash(*values):
    """xxhash64 over numbers and texts, as the sample is drawn by."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_scores(rows, labels):
    """Every score from the definition: sample, dictionaries, sizes, logistic curve."""
    import numpy as np
    import zstandard

    q = quality_classifier
    longest, seen = {}, defaultdict(set)
    for i, t, *_ in rows:
        if i is not None and t and len(t) >= len(longest.get(i, "")):
            longest[i] = t
    for i, y, *_ in labels:
        if i is not None and y in (0, 1):
            seen[i].add(y)
    drawn = defaultdict(list)
    for i, kinds in seen.items():
        if len(kinds) == 1 and i in longest and zlib.crc32(str(i).encode()) % 3 != 1:
            part = spark_hash(i, "part") % 2
            size = (q.PIECE, q.CALIBRATION_PIECE)[part]
            for place in range(-(-len(longest[i]) // size)):
                drawn[min(kinds), part].append((
                    spark_hash(i, place, "draw"), i, place,
                    longest[i][place * size:(place + 1) * size]))
    most = (q.DICTIONARY_PIECES, q.CALIBRATION_PIECES)
    drawn = {k: [x[3] for x in sorted(v)[:most[k[1]]]] for k, v in drawn.items()}
    packers = [zstandard.ZstdCompressor(
        level=q.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
        dict_data=zstandard.ZstdCompressionDict("\n".join(drawn[label, 0]).encode(),
                                                dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for label in (1, 0)]

    def difference(text):
        sizes = [sum(len(p.compress(text[a:a + q.PIECE].encode()))
                     for a in range(0, len(text), q.PIECE)) for p in packers]
        return (sizes[1] - sizes[0]) / sum(sizes) if text else 0.0

    x = np.array([difference(t) for label in (0, 1) for t in drawn[label, 1]])
    counts = [len(drawn[label, 1]) for label in (0, 1)]
    y = np.repeat([0.0, 1.0], counts)
    weight = np.repeat([len(x) / 2 / c for c in counts], counts)
    mean, spread = x.mean(), max(x.std(), 1e-9)
    # the curve by plain descent on the same penalised likelihood
    a = b = 0.0
    z = (x - mean) / spread
    for _ in range(20_000):
        error = weight * (1 / (1 + np.exp(-(a + b * z))) - y)
        da = error.mean() + 1e-6 * a
        db = (error * z).mean() + 1e-2 * b
        a, b = a - 2 * da, b - 2 * db
    return [1 / (1 + math.exp(-max(-30, min(30, a + b * (difference(t or "") - mean) / spread))))
            for _, t, *_ in rows]


def test_every_score_by_the_plain_version(spark):
    docs, labels, _ = labelled(spark)
    rows = [tuple(r)[:5] for r in docs.collect()]
    rows += [(7, "x", None, None, 0), (7, prose(3, 900), None, None, 0),
             (None, prose(4, 50), None, None, 0), (999, "", None, None, 0),
             (998, None, None, None, 0), (8, prose(5, 2_000), None, None, 0)]
    known = [tuple(r) for r in labels.collect()] + [(7, 1, 0), (9, 1 - 1, 0)]
    frame_of = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    found = quality_classifier.classify_documents(frame(spark, rows), frame_of)
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in found.collect())
    want = sorted((r[0] is None, r[0] or 0, round(s, 6)) for r, s in zip(
        rows, plain_scores(rows, known), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_pieces_of_an_id_come_from_its_longest_text(spark):
    long = prose(1, 1_500)
    rows = [(i, t, None, None, 0) for i in range(30) for t in ("short", long, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    sample = quality_classifier.training_pieces(frame(spark, rows), labels).collect()
    assert sample and all(r.content and r.content in long for r in sample)


def test_places_in_the_mix(spark):
    """The ranks of all documents' slots are those of their source, each once."""
    rows = [(i, prose(i, 5 + i % 40), None, ("a", "b", None)[i % 7 % 3], 0) for i in range(120)]
    ranks = defaultdict(list)
    source = {r[0]: r[3] for r in rows}
    for r in mixed(spark, rows):
        assert (r.first_slot is None) == (r.taken == 0)
        if r.taken:
            places = [r.first_slot + k * r.source_size + w for k in range(4)
                      for w in range(r.size)][:r.taken]
            ranks[source[r.doc_id]] += places
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values()) and len(ranks) == 3


def test_columns_of_any_name_pass_through(spark):
    from guardmill.llm import ngram_join, stream_dedup

    names = ("__id", "__key", "__copies", "__copy", "__text_key", "__gone", "__file", "__row",
             "__sha", "row", "copy", "key", "id")
    rows = [(i, prose(i % 9, 40), "en", f"s{i % 2}", i) for i in range(30)]
    docs = frame(spark, rows).withColumns({n: F.lit(n) for n in names})
    for kept in (mixing.mixed_documents(docs), ngram_join.one_of_each(docs),
                 stream_dedup.kept_documents(docs)):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all(r[n] == n for r in found for n in names)
