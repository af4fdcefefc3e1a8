"""Similarity join of documents on word n-grams: prefix filtering with rare n-grams first.

Jaccard similarity is taken between sets of n-grams. In a fixed order of all n-grams, rare
ones first, two sets of n that overlap enough share an n-gram within their first
n - ceil(t * n) + 1 (the prefix). N-grams of one document come first of all and can't be
shared, so most documents have nothing in their prefix that another one could match, and
never meet another document.

How often an n-gram occurs is counted by hash ranges ("buckets"): a task sends each bucket
the hashes of its documents' n-grams, 8 bytes each, and gets those back that occur in more
documents. N-grams that many documents of one task share are sent once, with their number.
Hashes have 48 bits besides the bucket's. N-grams are compared by hash only: one of a document
of n collides with one of another's with a chance of about n^2 / 2^56. Words enter by hashes
without structured collisions (see wordhash).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill.operators.joins import hot_keys, spread_join
from guardmill.operators.scratch import settled

from . import blobs, wordhash
from .columns import document_text, free_name, need_columns, shuffle_partitions
from .components import components

WORDS = 5
#: Similarity from which two documents link, in hundredths.
PERCENT = 75
#: A task hands over its n-grams whenever it holds this many, or this many documents.
BATCH_GRAMS = 1 << 19
BATCH_DOCS = 60_000
TEXT_BYTES = 2 << 20
#: An n-gram in so many documents of one batch is sent once for all of them.
LOCAL_HOT = 32
_HOT_SHARE = 0.001
#: Longer posting lists are compared list block by list block.
LIST_BLOCK = 256
_ALL = 0xFFFF

_SENT = "bucket int, batch long, body binary, head boolean"
_SETS = ("uid long, doc_id long, n_shingles long, digest1 long, digest2 long, "
         "n_shared int, tokens binary")
_POSTINGS = "token long, node long, n long, pos long"


# --- sizes and filters ------------------------------------------------------------------


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Overlap from which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """How many of a set's n elements, rare first, a partner must share one of."""
    return n - (-(-percent * n // 100)) + 1


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Upper bound of the overlap of two sorted arrays: halves them at pivots of x."""
    if not len(x) or not len(y) or depth == 0:
        return min(len(x), len(y))
    pivot = x[len(x) // 2]
    i, j = len(x) // 2, int(np.searchsorted(y, pivot))
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


# --- sets -------------------------------------------------------------------------------


def gram_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every window of `words` words; of a shorter text, the whole."""
    hashes, bounds = wordhash.hash_texts(texts, fold=True)
    starts, owner = wordhash.window_starts(bounds, words)
    found, owners = [wordhash.sequence_hashes(hashes, starts, words)], [owner]
    counts = np.diff(bounds)
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        found.append(wordhash.sequence_hashes(hashes, bounds[short], n))
        owners.append(short)
    return np.concatenate(found), np.concatenate(owners)


class _Batch:
    """The n-grams of some documents, as they are sent to the buckets."""

    def __init__(self, uid: int, bits: int):
        self.uid, self._bits = uid, bits
        self._hashes: list[np.ndarray] = []
        self._owners: list[np.ndarray] = []
        self._names: list[int | None] = []
        self.grams = 0

    def add(self, names: list[int | None], texts: list[bytes], words: int) -> None:
        hashes, owner = gram_hashes(texts, words)
        self._hashes.append(hashes)
        self._owners.append((owner + len(self._names)).astype(np.uint16))
        self._names += names
        self.grams += len(hashes)

    def __len__(self) -> int:
        return len(self._names)

    def rows(self) -> Iterator[tuple]:
        hashes = np.concatenate(self._hashes)
        owner = np.concatenate(self._owners)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        if len(hashes):  # a text's n-grams count once
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            hashes, owner = hashes[new], owner[new]
        n = np.bincount(owner, minlength=len(self._names)).astype(np.int64)
        digests = _digests(hashes, owner, n)
        first = np.flatnonzero(np.concatenate(
            ([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
        times = np.diff(first, append=len(hashes))
        many = times >= LOCAL_HOT
        shared = np.repeat(many, times)
        hot = hashes[first[many]]
        names = np.array([0 if v is None else v for v in self._names], dtype="<i8")
        nulls = np.array([v is None for v in self._names], dtype="u1")
        head = blobs.pack(names, nulls, n.astype("<i4"), *digests, hot.astype("<u8"),
                          times[many].astype("<u4"), owner[shared].astype("<u2"))
        yield int(wordhash.mixed(np.array([self.uid], np.uint64))[0]
                  >> np.uint64(64 - self._bits)), self.uid, head, True
        yield from self._buckets(hashes[~shared], owner[~shared], hot, times[many])

    def _buckets(self, hashes, owner, hot, counts) -> Iterator[tuple]:
        shift = np.uint64(64 - self._bits)
        edges = np.arange(1 << self._bits, dtype=np.uint64) << shift
        cold_at = np.append(np.searchsorted(hashes, edges), len(hashes))
        hot_at = np.append(np.searchsorted(hot, edges), len(hot))
        cold, warm = _rest(hashes, self._bits), _rest(hot, self._bits)
        for b in range(1 << self._bits):
            i, j, k, m = cold_at[b], cold_at[b + 1], hot_at[b], hot_at[b + 1]
            if i == j and k == m:
                continue
            yield b, self.uid, blobs.pack(
                *blobs.numbers48(cold[i:j]), owner[i:j].astype("<u2"),
                *blobs.numbers48(warm[k:m]), counts[k:m].astype("<u4")), False


def _rest(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of a hash below its bucket's."""
    return (hashes << np.uint64(bits)) >> np.uint64(16)


def _digests(hashes: np.ndarray, owner: np.ndarray,
             n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes per document: equal for equal sets."""
    order = np.argsort(owner, kind="stable")
    ends = np.concatenate(([0], np.cumsum(n)))
    found = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(wordhash.mixed(hashes[order] ^ np.uint64(salt)), out=total[1:])
        found.append((total[ends[1:]] - total[ends[:-1]]).astype("<u8"))
    return found[0], found[1]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    bucket, batch, body, head = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(batch, pa.int64()),
         pa.array(body, pa.binary()), pa.array(head, pa.bool_())],
        ["bucket", "batch", "body", "head"])


def send_grams(docs: DataFrame, bits: int, words: int, identity: str,
               text: str) -> DataFrame:
    rows = docs.select(F.col(identity).cast("long").alias("id"),
                       document_text(text).cast("binary").alias("text"))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 20
        held = _Batch(uid, bits)
        for batch in batches:
            for names, texts in _portions(batch):
                held.add(names, texts, words)
                if held.grams >= BATCH_GRAMS or len(held) >= BATCH_DOCS:
                    yield _sent(list(held.rows()))
                    uid += 1
                    held = _Batch(uid, bits)
        if len(held):
            yield _sent(list(held.rows()))

    return rows.mapInArrow(send, _SENT)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of about TEXT_BYTES together, and never more than a batch may have."""
    names, texts, size = [], [], 0
    for at in range(0, batch.num_rows, 256):
        ids = batch.column(0).slice(at, 256).to_pylist()
        for name, text in zip(ids, batch.column(1).slice(at, 256).to_pylist(), strict=True):
            names.append(name)
            texts.append(text)
            size += len(text)
            if size >= TEXT_BYTES or len(names) >= 4096:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def answer_bucket(table: pa.Table) -> pa.Table:
    """Per batch the n-grams of this bucket that occur in two documents or more, with their
    document frequency. Batch heads pass through."""
    out, low, owners, weight, source, batches = [], [], [], [], [], []
    for row in table.to_pylist():
        if row["head"]:
            out.append((row["bucket"], row["batch"], row["body"], True))
            continue
        a, b, owner, c, d, counts = blobs.unpack(row["body"])
        low += [blobs.join48(a, b), blobs.join48(c, d)]
        owners += [owner, np.full(len(c), _ALL, dtype=np.uint16)]
        weight += [np.ones(len(a), np.int64), counts.astype(np.int64)]
        source.append(np.full(len(a) + len(c), len(batches), dtype=np.int32))
        batches.append(row["batch"])
    if batches:
        out += _answers(table.column("bucket")[0].as_py(), np.concatenate(low),
                        np.concatenate(owners), np.concatenate(weight),
                        np.concatenate(source), batches)
    if not out:
        return pa.Table.from_batches([], schema=_sent([(0, 0, b"", True)]).schema)
    return pa.Table.from_batches([_sent(out)])


def _answers(bucket, low, owner, weight, source, batches) -> Iterator[tuple]:
    order = np.argsort(low, kind="stable")
    ranked = low[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    times = np.diff(first, append=len(ranked))
    frequency = np.add.reduceat(weight[order], first)
    spread = np.repeat(frequency, times)
    back = order[spread > 1]
    spread = spread[spread > 1]
    by_source = np.argsort(source[back], kind="stable")
    back, spread = back[by_source], np.minimum(spread[by_source], 0xFFFFFFFF)
    ends = np.searchsorted(source[back], np.arange(len(batches) + 1))
    for i, batch in enumerate(batches):
        part = back[ends[i]:ends[i + 1]]
        if len(part):
            yield bucket, batch, blobs.pack(
                *blobs.numbers48(low[part]), owner[part].astype("<u2"),
                spread[ends[i]:ends[i + 1]].astype("<u4")), False


def sets_of_batch(bits: int, percent: int):
    """Builds, from a batch's answers, the shared n-grams of its documents, rare first."""
    def build(table: pa.Table) -> pa.Table:
        head, keys, owners, counts = None, [], [], []
        for row in table.to_pylist():
            if row["head"]:
                head = blobs.unpack(row["body"])
                batch = row["batch"]
                continue
            a, b, owner, df = blobs.unpack(row["body"])
            keys.append(blobs.join48(a, b) | (np.uint64(row["bucket"]) << np.uint64(48)))
            owners.append(owner)
            counts.append(df)
        names, nulls, n, one, two, hot, times, hot_owner = head
        key = np.concatenate([np.empty(0, np.uint64), *keys])
        owner = np.concatenate([np.empty(0, np.uint16), *owners])
        df = np.concatenate([np.empty(0, np.uint32), *counts])
        key, owner, df = _expand(key, owner, df, hot, times, hot_owner, bits)
        order = np.lexsort((key, df, owner))
        key = key[order]
        shared = np.bincount(owner, minlength=len(n))
        ends = np.concatenate(([0], np.cumsum(shared)))
        need = -(-percent * n.astype(np.int64) // 100)
        alive = (shared >= need) & (n > 0)
        rows = [(batch << 16 | i, None if nulls[i] else int(names[i]), int(n[i]),
                 int(one[i].astype(np.int64)), int(two[i].astype(np.int64)), int(shared[i]),
                 key[ends[i]:ends[i + 1]].tobytes() if alive[i] else None)
                for i in range(len(n))]
        kinds = (pa.int64(),) * 5 + (pa.int32(), pa.binary())
        fields = [part.split()[0] for part in _SETS.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds,
                                                        strict=True)], fields)

    return build


def _expand(key, owner, df, hot, times, hot_owner, bits):
    """Gives n-grams that were sent once for many documents back to each of them."""
    once = owner == _ALL
    if not len(hot):
        return key[~once], owner[~once], df[~once]
    known = (hot >> np.uint64(64 - bits) << np.uint64(48)) | _rest(hot, bits)
    by_key = np.argsort(key[once])
    place = by_key[np.searchsorted(key[once][by_key], known)]
    return (np.concatenate([key[~once], np.repeat(known, times)]),
            np.concatenate([owner[~once], hot_owner]),
            np.concatenate([df[~once], np.repeat(df[once][place], times)]))


def gram_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
              identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: uid, doc_id, n_shingles, digest1, digest2, n_shared, tokens.

    `tokens` are the n-grams that other documents have, too, rare first; null where they are
    too few for any link. The number of buckets follows the shuffle partitions, so a
    bucket's share is of the size the session is set up for.
    """
    need_columns(docs, identity, text)
    bits = max(1, min(16, (4 * shuffle_partitions(docs.sparkSession) - 1).bit_length()))
    answers = send_grams(docs, bits, words, identity, text).groupBy("bucket").applyInArrow(
        answer_bucket, _SENT)
    return settled(answers.groupBy("batch").applyInArrow(
        sets_of_batch(bits, percent), _SETS))


# --- candidates and links ---------------------------------------------------------------


def prefix_postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """token, node, n, pos for the shared n-grams in each set's prefix."""
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512).to_pylist()
                found = []
                for r in part:
                    tokens = np.frombuffer(r["tokens"], "<i8")
                    alone = r["n"] - len(tokens)
                    cut = tokens[:max(0, prefix_length(r["n"], percent) - alone)]
                    found.append((cut, np.full(len(cut), r["node"]),
                                  np.full(len(cut), r["n"]),
                                  np.arange(alone, alone + len(cut))))
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["token", "node", "n", "pos"])

    return classes.select("node", "n", "tokens").mapInArrow(explode, _POSTINGS)


def _may_link(na, pa, nb, pb, percent: int):
    """Length and positional filter of two sets that meet at an n-gram.

    From their first shared n-gram on, the sets overlap in no more than the shorter rest.
    So the row of that n-gram passes if the pair links; later n-grams of the pair may fail.
    """
    most = F.least(na - pa, nb - pb)
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & ((100 + percent) * most >= percent * (na + nb)))


def verified(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs a, b that link; every pair is compared once, on all shared n-grams."""
    pairs = settled(pairs.select("a", "b"))
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    hubs = degree.filter(F.col("n") > max(64.0, total * _HOT_SHARE)).select("a")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"),
                              F.col("tokens").alias(f"t{name}"))

    both = spread_join(pairs.join(side("b"), "b"), side("a"), ["a"], "inner", hubs)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    x = np.sort(np.frombuffer(r["ta"], "<u8"))
                    y = np.sort(np.frombuffer(r["tb"], "<u8"))
                    need = least_overlap(r["na"], r["nb"], percent)
                    if suffix_bound(x, y) >= need and overlap(x, y) >= need:
                        links.append((r["a"], r["b"]))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return settled(both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(
        compare, "a long, b long"))


def leader_pairs(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every set with the leader of each of its posting lists: linear in the postings.

    The leader has the fewest n-grams before the shared one, so it is the set with the least
    of its own: of a text and its edited copies, the text.
    """
    lists = settled(postings.groupBy("token").agg(
        F.min(F.struct("pos", "node", "n")).alias("lead"),
        F.count(F.lit(1)).alias("size")).filter("size > 1"))
    total = lists.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    hot = lists.filter(F.col("size") > max(64.0, total * _HOT_SHARE)).select("token")
    met = spread_join(postings, lists.select("token", "lead"), ["token"], "inner", hot)
    lead = {c: F.col(f"lead.{c}") for c in ("node", "n", "pos")}
    return met.filter(_may_link(lead["n"], lead["pos"], F.col("n"), F.col("pos"), percent)
                      & (lead["node"] != F.col("node"))).select(
        F.least(lead["node"], "node").alias("a"),
        F.greatest(lead["node"], "node").alias("b")).distinct()


def remaining_pairs(postings: DataFrame, roots: DataFrame,
                    percent: int = PERCENT) -> DataFrame:
    """All candidate pairs whose sets are not yet known to be connected.

    Lists whose sets are all connected are done.
    """
    root = F.coalesce("b", "node")
    known = settled(postings.join(roots.withColumnRenamed("a", "node"), "node", "left").select(
        "token", "node", "n", "pos", root.alias("root")))
    lists = known.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.count(F.lit(1)).alias("size")).filter("low < high")
    return _met_in_lists(known, lists, percent)


def all_pairs(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All candidate pairs: sets that share an n-gram of their prefixes and pass the length
    and the positional filter there."""
    known = postings.withColumn("root", F.col("node"))
    lists = known.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return _met_in_lists(known, lists, percent)


def _met_in_lists(known: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """a, b: sets of different roots that meet in one of the posting lists.

    Long lists are cut into blocks of LIST_BLOCK sets, and each pair of blocks is a key of its
    own, so no task gets a whole long list.
    """
    open_lists = settled(lists.select("token", F.ceil(
        F.col("size") / LIST_BLOCK).cast("int").alias("blocks")))
    hot = open_lists.filter("blocks > 1").select("token")
    rows = spread_join(known, open_lists, ["token"], "inner", _few(hot))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "node", "n", "pos", "root")
    x, y = keyed.alias("x"), keyed.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i"))
                 & (F.col("x.j") == F.col("y.j")) & (F.col("x.root") != F.col("y.root"))
                 & ((F.col("x.own") < F.col("y.own"))
                    | ((F.col("x.own") == F.col("y.own")) & (F.col("x.i") == F.col("x.j"))
                       & (F.col("x.node") < F.col("y.node"))))
                 & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"),
                             percent))
    return met.select(F.least("x.node", "y.node").alias("a"),
                      F.greatest("x.node", "y.node").alias("b")).distinct()


def _few(hot: DataFrame, most: int = 100_000) -> DataFrame:
    """The hot keys, as long as they are few enough to broadcast; beyond that none, and the
    engine's own handling of skew has to do."""
    return hot if hot.limit(most + 1).count() <= most else hot.limit(0)


def class_links(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """node, links: the documents whose set is another one that links with the node's."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = groups.select(F.col("node").alias("b"), "copies")
    # a set that most others link with is met by many rows
    hubs = hot_keys(both.select("b"), ["b"])
    return spread_join(both, counted, ["b"], "inner", hubs).groupBy(
        F.col("a").alias("node")).agg(F.sum("copies").alias("links"))


def linked_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                     identity: str = "doc_id",
                     text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: (documents, pairs).

    Documents: the rows of `similar_documents` with `n_links`, the number of other documents
    that link with the row's, and `node`, the class of all rows with an equal set, null where
    nothing can link. Pairs: a, b of all different classes that link, each once. Two documents
    link iff their classes are the same or a pair.

    Candidates are all pairs of classes that meet in a prefix; each is verified once, so the
    work and the table of pairs grow with the links between different sets, which for a group
    of different near copies is the square of their number.
    """
    sets, groups, classes, postings = _classes(docs, words, percent, identity, text)
    pairs = verified(all_pairs(postings, percent), classes, percent)
    judged = _Judged(sets, groups, classes, components(pairs))
    return _with_component(judged, class_links(pairs, groups)), pairs


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                      identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: uid, doc_id, n_shingles, component_id.

    Two documents link when their sets' Jaccard similarity is at least `percent` hundredths;
    `component_id` is the least id reachable by links. Words are folded for A-Z. A text of
    fewer than `words` words is one n-gram; null, empty and blank texts have none and link
    with nothing, not even each other. Null ids are never least unless alone; repeated rows
    and ids are documents of their own. No rows give no rows; other columns are not read.

    Equal sets are joined first, by digest. Each set is then compared with the leader of its
    posting lists, which connects groups of near copies with as many comparisons as members;
    after that, all candidate pairs between sets that are still apart are compared. A pair
    inside a component is not compared again, as it can't change the result.
    """
    return _with_component(_judged(docs, words, percent, identity, text))


class _Judged(NamedTuple):
    sets: DataFrame
    groups: DataFrame
    classes: DataFrame
    roots: DataFrame


_DIGEST = ["n_shingles", "digest1", "digest2"]


def _classes(docs: DataFrame, words: int, percent: int, identity: str, text: str) -> tuple:
    """The documents' sets, the groups of equal sets, one set of each, their postings."""
    sets = gram_sets(docs, words, percent, identity, text)
    alive = sets.filter("tokens IS NOT NULL")
    groups = settled(alive.groupBy(*_DIGEST).agg(F.min("uid").alias("node"),
                                                 F.min("doc_id").alias("least_id"),
                                                 F.count(F.lit(1)).alias("copies")))
    classes = settled(alive.join(groups.select(F.col("node").alias("uid")), "uid")
                      .select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"),
                              "tokens"))
    return sets, groups, classes, settled(prefix_postings(classes, percent))


def _judged(docs: DataFrame, words: int, percent: int, identity: str, text: str) -> _Judged:
    """The same with the components instead of the postings."""
    sets, groups, classes, postings = _classes(docs, words, percent, identity, text)
    roots = components(verified(leader_pairs(postings, percent), classes, percent))
    more = verified(remaining_pairs(postings, roots, percent), classes, percent)
    if more.head(1):
        roots = components(roots.unionByName(more))
    return _Judged(sets, groups, classes, roots)


def _with_component(judged: _Judged, links: DataFrame | None = None) -> DataFrame:
    rooted = judged.groups.join(
        judged.roots.withColumnRenamed("a", "node"), "node", "left").select(
        *_DIGEST, "node", "least_id", "copies", F.coalesce("b", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    more = []
    if links is not None:
        rooted = rooted.join(links, "node", "left").withColumn(
            "n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        more = ["n_links", "node"]
    found = settled(rooted.join(least, "root").select(*_DIGEST, "component_id", "copies",
                                                      *more))
    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = found.filter(F.col("copies") > max(64.0, total * _HOT_SHARE)).select(*_DIGEST)
    member = F.col("tokens").isNotNull()
    joined = spread_join(judged.sets.filter(member).drop("tokens"), found.drop("copies"),
                         _DIGEST, "inner", hot)
    columns = ["uid", "doc_id", "n_shingles", "component_id", *more]
    alone = judged.sets.filter(~member).withColumns({
        "component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"),
        "node": F.lit(None).cast("long")})
    return joined.select(*columns).unionByName(alone.select(*columns))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the least of their component, with all their columns.

    Rows with a null id stay; of rows that share the least id all stay. Null, empty and blank
    texts link with nothing and stay; an empty table stays empty. Columns may have any names.
    """
    judged = similar_documents(docs, words, percent, identity, text)
    name = free_name(docs, "__gone")
    gone = judged.filter(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias(name))
    return docs.join(gone.distinct(), docs[identity] == F.col(name), "left_anti")
