"""Removal of long passages that also start in an earlier document, by a de Bruijn graph.

Edges are windows of k words (k-mers), nodes the k-1 words two following windows share. An
edge's source is its place in the document with the least id. Edges are found in bulk: a
window belongs to the least hash among the shorter windows inside it (its anchor), which
moves only every dozen words, so a document is a short row of anchors with the hashes of
their windows. Anchors meet in one shuffle; only those of two documents and more are looked
into. Repeated edges whose sources follow one another are paths; paths that don't branch
are joined to longer ones, and every path is compared with the words at its source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardmill.operators.joins import spread_join
from guardmill.operators.scratch import settled

from . import wordhash
from .columns import document_text, need_columns

WORDS = 50
#: Words whose least hash marks a window.
ANCHOR = 25
TEXT_BYTES = 2 << 20
#: An anchor is hot with more than this share of all anchors; at most 1 / share can be.
HOT_SHARE = 1e-5
HOT_LEAST = 64
#: Families of hashes tried, should windows of different words meet.
ATTEMPTS = 5
#: Bits of a word's hash in the first family.
WORD_BITS = 64
#: Rows of the sorted anchors that are compared together, cut between anchors.
SLICE_ROWS = 200_000

_WINDOWS = ("key long, doc long, mark int, pos int, n int, src long, src_mark int, "
            "src_pos int, body binary")
_RUNS = "doc long, mark int, pos int, n int, src long, src_mark int, src_pos int"
_RUN = ["doc", "mark", "pos", "n", "src", "src_mark", "src_pos"]
_CLAIM = "struct<src:bigint,src_mark:int,src_pos:int,n:int,digest:binary>"


class Family(NamedTuple):
    """How words are hashed: `strong` as in wordhash, and the bits that are kept."""

    strong: int = 0
    bits: int = 64


def _family(attempt: int) -> Family:
    return Family(attempt) if attempt else Family(0, WORD_BITS)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` values in a row."""
    least, span = values, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


class Windows:
    """All windows of some texts: text, place, anchor and hash."""

    def __init__(self, texts: list[bytes], words: int, anchor: int, family: Family = Family()):
        hashes, bounds = wordhash.hash_texts(texts, strong=family.strong)
        hashes >>= np.uint64(64 - family.bits)
        starts, self.owner = wordhash.window_starts(bounds, words)
        self.pos = starts - bounds[:-1][self.owner]
        if not len(starts):
            self.anchor = self.hash = np.empty(0, np.uint64)
            return
        short = wordhash.sequence_hashes(
            hashes, np.arange(len(hashes) - anchor + 1), anchor)
        self.anchor = sliding_min(short, words - anchor + 1)[starts]
        self.hash = wordhash.sequence_hashes(hashes, starts, words)

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and length of the runs of chosen windows with one anchor."""
        at = np.flatnonzero(chosen)
        if not len(at):
            return at, at
        new = np.ones(len(at), dtype=bool)
        new[1:] = ((np.diff(at) != 1) | (self.owner[at[1:]] != self.owner[at[:-1]])
                   | (self.anchor[at[1:]] != self.anchor[at[:-1]]))
        first = np.flatnonzero(new)
        return at[first], np.diff(first, append=len(at))


def _texts(docs: DataFrame, identity: str, text: str) -> DataFrame:
    """doc, mark, text; `mark` tells documents with one id apart."""
    body = document_text(text)
    return docs.filter(F.col(identity).isNotNull()).select(
        F.col(identity).cast("long").alias("doc"), F.hash(body).alias("mark"),
        body.cast("binary").alias("text"))


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, ...]]:
    held: tuple[list, ...] = ([], [], [])
    size = 0
    for at in range(0, batch.num_rows, 256):
        part = [batch.column(i).slice(at, 256).to_pylist() for i in range(3)]
        for row in zip(*part, strict=True):
            for values, value in zip(held, row, strict=True):
                values.append(value)
            size += len(row[2])
            if size >= TEXT_BYTES:
                yield held
                held, size = ([], [], []), 0
    if held[0]:
        yield held


def hot_anchors(texts: DataFrame, words: int, anchor: int, family: Family = Family()) -> np.ndarray:
    """Anchors with more than HOT_SHARE of all: sorted, at most 1 / HOT_SHARE numbers."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            found: list[np.ndarray] = []
            for _, _, bodies in _portions(batch):
                windows = Windows(bodies, words, anchor, family)
                first, _ = windows.runs(np.ones(len(windows.pos), dtype=bool))
                found.append(windows.anchor[first])
            keys, times = np.unique(np.concatenate([np.empty(0, np.uint64), *found]),
                                    return_counts=True)
            total += int(times.sum())
            often = times > 3  # once in a while is not hot
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[often].astype(np.int64)), pa.array(times[often])],
                ["key", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])

    counted = settled(texts.mapInArrow(count, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")))
    total = counted.filter("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counted.filter(F.col("key").isNotNull() & (
        F.col("n") > max(HOT_LEAST, total * HOT_SHARE))).select("key").collect()
    return np.sort(np.array([r["key"] for r in hot], dtype=np.int64)).view(np.uint64)


def window_rows(texts: DataFrame, hot: np.ndarray, words: int, anchor: int,
                family: Family = Family()) -> DataFrame:
    """One row per run of windows with one anchor; see the module's text.

    Windows of hot anchors are rows of their own under their own hash, so passages around a
    hot one spread over all tasks. Of equal ones in a task's portion only the least document
    is sent; the others are settled on the spot (rows with `n`, under any key).
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(hot))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            for docs, marks, bodies in _portions(batch):
                windows = Windows(bodies, words, anchor, family)
                doc = np.array(docs, dtype=np.int64)[windows.owner]
                mark = np.array(marks, dtype=np.int32)[windows.owner]
                is_hot = np.zeros(len(doc), dtype=bool)
                if len(hot) and len(doc):
                    at = np.minimum(np.searchsorted(hot, windows.anchor), len(hot) - 1)
                    is_hot = hot[at] == windows.anchor
                yield _cold_rows(windows, ~is_hot, doc, mark)
                if is_hot.any():
                    yield from _hot_rows(windows, np.flatnonzero(is_hot), doc, mark)

    return texts.mapInArrow(send, _WINDOWS)


def _window_batch(key, doc, mark, pos, n=None, src=None, src_mark=None, src_pos=None,
                  body=None) -> pa.RecordBatch:
    size = len(doc)
    columns = [(key, pa.int64()), (doc, pa.int64()), (mark, pa.int32()), (pos, pa.int32()),
               (n, pa.int32()), (src, pa.int64()), (src_mark, pa.int32()),
               (src_pos, pa.int32()), (body, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, kind) if values is None else pa.array(values, kind)
         for values, kind in columns],
        [part.split()[0] for part in _WINDOWS.split(", ")])


def _cold_rows(windows: Windows, chosen: np.ndarray, doc, mark) -> pa.RecordBatch:
    first, lengths = windows.runs(chosen)
    # a run's windows are consecutive, so its hashes are a slice of all
    hashes = (windows.hash >> np.uint64(16)).astype("<u8").view("u1").reshape(-1, 8)[:, :6]
    flat = np.ascontiguousarray(hashes[chosen]).tobytes()
    ends = np.cumsum(lengths) * 6
    body = pa.Array.from_buffers(
        pa.large_binary(), len(first),
        [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()),
         pa.py_buffer(flat)]).cast(pa.binary())
    return _window_batch(windows.anchor[first].view(np.int64), doc[first], mark[first],
                         windows.pos[first], body=body)


def _hot_rows(windows: Windows, at: np.ndarray, doc, mark) -> Iterator[pa.RecordBatch]:
    order = at[np.lexsort((windows.pos[at], mark[at], doc[at], windows.hash[at]))]
    hashes = windows.hash[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = doc[order] > doc[first]
    # of one id's documents all are sent: none of them is later than the others
    sent = order[~later]
    body = (windows.hash[sent] >> np.uint64(16)).astype("<u8")
    yield _window_batch(windows.hash[sent].view(np.int64), doc[sent], mark[sent],
                        windows.pos[sent], body=[b.tobytes()[:6] for b in body])
    if later.any():
        mine, theirs = order[later], first[later]
        runs = _joined_runs(doc[mine], mark[mine], windows.pos[mine], doc[theirs],
                            mark[theirs], windows.pos[theirs])
        key = wordhash.mixed(runs[0].view(np.uint64) ^ runs[2].astype(np.uint64))
        yield _window_batch(key.view(np.int64), *runs)


def _joined_runs(doc, mark, pos, src, src_mark, src_pos) -> tuple:
    """Single windows as runs in which place and source move together."""
    order = np.lexsort((pos, mark, doc))
    columns = [c[order] for c in (doc, mark, pos, src, src_mark, src_pos)]
    doc, mark, pos, src, src_mark, src_pos = columns
    new = np.ones(len(doc), dtype=bool)
    new[1:] = ~((doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (src[1:] == src[:-1])
                & (src_mark[1:] == src_mark[:-1]) & (pos[1:] == pos[:-1] + 1)
                & (src_pos[1:] == src_pos[:-1] + 1))
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(doc)).astype(np.int32)
    return (doc[first], mark[first], pos[first], n, src[first], src_mark[first],
            src_pos[first])


def _repeated(key, doc, mark, pos, bodies: pa.Array) -> tuple | None:
    """Runs of windows that also start in a document of a lesser id. Rows are sorted by
    key and document."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    shared = (doc[first] != doc[last])[group]  # sorted, so two documents at least
    if not shared.any():
        return None
    key, doc, mark, pos = key[shared], doc[shared], mark[shared], pos[shared]
    kept = bodies.filter(pa.array(shared))
    hashes = np.frombuffer(b"".join(kept.to_pylist()), "u1").reshape(-1, 6)
    lengths = np.array([len(b) // 6 for b in kept.to_pylist()])
    row = np.repeat(np.arange(len(key)), lengths)
    within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide = np.zeros((len(hashes), 8), dtype="u1")
    wide[:, :6] = hashes
    full = wordhash.mixed(wide.view("<u8").reshape(-1).astype(np.uint64)
                          ^ wordhash.mixed(key[row].view(np.uint64)))
    order = np.argsort(full, kind="stable")  # keeps documents in order
    same = np.concatenate(([True], full[order][1:] != full[order][:-1]))
    source = order[np.flatnonzero(same)[np.cumsum(same) - 1]]
    later = doc[row[order]] > doc[row[source]]
    if not later.any():
        return None
    mine, theirs = order[later], source[later]
    return _joined_runs(doc[row[mine]], mark[row[mine]], pos[row[mine]] + within[mine],
                        doc[row[theirs]], mark[row[theirs]],
                        pos[row[theirs]] + within[theirs])


def _run_batch(columns: tuple) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(),
             pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _RUN)


def repeated_runs(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR,
                  identity: str = "doc_id", text: str = "text",
                  family: Family = Family()) -> DataFrame:
    """doc, mark, pos, n, src, src_mark, src_pos: n windows from `pos` on also start, one
    after the other, at `src_pos` of a document with a lesser id."""
    texts = _texts(docs, identity, text)
    hot = hot_anchors(texts, words, anchor, family)
    rows = window_rows(texts, hot, words, anchor, family)
    met = rows.repartition("key").sortWithinPartitions("key", "doc")

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= SLICE_ROWS:
                table, rest = _cut(pa.Table.from_batches(held))
                yield from _matched(table)
                held, count = rest.to_batches(), rest.num_rows
        if held:
            yield from _matched(pa.Table.from_batches(held))

    return settled(met.mapInArrow(match, _RUNS))


def _cut(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """All but the rows of the last key, and those."""
    key = table.column("key").to_numpy()
    at = int(np.searchsorted(key, key[-1]))
    return table.slice(0, at), table.slice(at)


def _matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
    known = pc.is_valid(table.column("n"))
    for batch in table.filter(known).select(_RUN).to_batches():
        yield batch
    table = table.filter(pc.invert(known))
    if not table.num_rows:
        return
    runs = _repeated(*(table.column(c).to_numpy() for c in ("key", "doc", "mark", "pos")),
                     table.column("body").combine_chunks())
    if runs is not None:
        yield _run_batch(runs)


# --- paths ------------------------------------------------------------------------------


def compact_paths(runs: DataFrame) -> DataFrame:
    """Joins runs that follow one another into nonbranching paths; columns as `runs`.

    An edge of this graph is a run by its source. A step leads from an edge to the one that
    follows it in a document, in place and at the source. It is kept where every occurrence
    of the one edge is followed, and of the other preceded, by that same step; elsewhere the
    path branches or ends. Degrees are aggregated per edge and joined back to the runs;
    an edge that many documents have is spread over many tasks.
    """
    edge = F.xxhash64("src", "src_mark", "src_pos", "n")
    line = Window.partitionBy("doc", "mark").orderBy("pos", "src", "src_mark")

    def follows(other: dict) -> F.Column:
        return ((other["src"] == F.col("src")) & (other["src_mark"] == F.col("src_mark"))
                & (other["pos"] == F.col("pos") + F.col("n"))
                & (other["src_pos"] == F.col("src_pos") + F.col("n")))

    named = runs.withColumn("edge", edge)
    after = {c: F.lead(c).over(line) for c in ("src", "src_mark", "pos", "src_pos", "edge")}
    steps = settled(named.withColumn("next", F.when(follows(after), after["edge"])))
    out = steps.groupBy("edge").agg(
        F.min("next").alias("low"), F.max("next").alias("high"),
        F.count("next").alias("followed"), F.count(F.lit(1)).alias("n_out"))
    back = steps.filter("next IS NOT NULL").groupBy("next").agg(
        F.min("edge").alias("one"), F.max("edge").alias("other"),
        F.count(F.lit(1)).alias("preceded")).withColumnRenamed("next", "edge")
    degree = settled(out.join(back, "edge", "left").select(
        "edge", "n_out",
        ((F.col("low") == F.col("high")) & (F.col("followed") == F.col("n_out")))
        .alias("one_out"),
        ((F.col("one") == F.col("other")) & (F.col("preceded") == F.col("n_out")))
        .alias("one_in")))
    total = degree.agg(F.coalesce(F.sum("n_out"), F.lit(0))).first()[0]
    often = degree.filter(F.col("n_out") > max(64.0, total * 0.001)).select("edge")
    marked = spread_join(steps, degree.drop("n_out"), ["edge"], "inner", often)
    before = Window.partitionBy("doc", "mark").orderBy("pos", "src", "src_mark")
    starts = ~(F.coalesce(F.lag("next").over(before) == F.col("edge"), F.lit(False))
               & F.coalesce(F.lag("one_out").over(before), F.lit(False))
               & F.coalesce("one_in", F.lit(False)))
    path = F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(
        before.rowsBetween(Window.unboundedPreceding, 0))
    return (marked.withColumn("starts", starts).withColumn("path", path)
            .groupBy("doc", "mark", "path").agg(
                F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"),
                F.min(F.struct("pos", "src", "src_mark", "src_pos")).alias("at"))
            .select("doc", "mark", "pos", "n", "at.src", "at.src_mark", "at.src_pos"))


# --- removal ----------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR,
                   identity: str = "doc_id", text: str = "text",
                   keep_text: bool = False) -> DataFrame:
    """One row per document: identity, n_words, n_removed, kept_sha256, and with `keep_text`
    also kept_text and spans (first word, number of words, source and its first word).

    A word goes if a window of `words` words over it, as the input has it, also starts in a
    document with a lesser id. Words are taken as they are. Null text has no words; texts
    shorter than a window lose none. Documents without an id lose none and take none from
    others; documents with one id don't take from each other. No rows give no rows; other
    columns are not read.

    Every path is compared with the words at its source. Windows meet by 64-bit hashes (48
    within an anchor), so a difference is next to impossible. Where there is one, all windows
    are found again with other hashes, of words by BLAKE2b, and compared again, so nothing is
    removed in error and no source is missed behind a wrong one.
    """
    need_columns(docs, identity, text)
    for attempt in range(ATTEMPTS):
        done = _cut_documents(docs, words, anchor, identity, text, keep_text,
                              _family(attempt))
        if not _wrong_sources(done):
            break
    else:
        raise ValueError(f"windows met other ones under {ATTEMPTS} families of hashes")
    named = [F.col("doc").alias(identity), "n_words", "n_removed", "kept_sha256"]
    if keep_text:
        named += ["kept_text", F.transform("claims", lambda c: F.struct(
            c["src"].alias("source"), c["src_pos"].alias("source_word"),
            (c["n"] + (words - 1)).alias("n_words"))).alias("spans")]
    return done.select(*named)


def _cut_documents(docs: DataFrame, words: int, anchor: int, identity: str, text: str,
                   keep_text: bool, family: Family) -> DataFrame:
    """Every document cut, with a digest of each path and of the words at its source."""
    paths = settled(compact_paths(
        repeated_runs(docs, words, anchor, identity, text, family)))
    spans = paths.groupBy("doc", "mark").agg(F.collect_list(
        F.struct("pos", "n", "src", "src_mark", "src_pos")).alias("spans"))
    asked = (paths.select("src", "src_mark", "src_pos", "n").distinct()
             .groupBy(F.col("src").alias("doc"), F.col("src_mark").alias("mark"))
             .agg(F.collect_list(F.struct(F.col("src_pos").alias("pos"), "n")).alias("asked")))
    work = spans.join(asked, ["doc", "mark"], "full_outer")
    body = document_text(text)
    texts = docs.select(F.col(identity).cast("long").alias("doc"), F.hash(body).alias("mark"),
                        body.cast("binary").alias("text"))
    # the same for a text's copies under one id; nulls never join
    joined = texts.join(work, ["doc", "mark"], "left").select("doc", "mark", "text", "spans",
                                                              "asked")
    schema = (f"doc long, n_words long, n_removed long, kept_sha256 string, "
              f"kept_text string, claims array<{_CLAIM}>, truths array<{_CLAIM}>")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("src", pa.int64()), ("src_mark", pa.int32()),
                                   ("src_pos", pa.int32()), ("n", pa.int32()),
                                   ("digest", pa.binary())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [_cut_row(r, words, keep_text)
                        for r in batch.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds,
                                                    strict=True)],
                    ["doc", "n_words", "n_removed", "kept_sha256", "kept_text", "claims",
                     "truths"])

    return settled(joined.mapInArrow(cut, schema))


def _cut_row(row: dict, words: int, keep_text: bool) -> tuple:
    found = row["text"].split()

    def digest(pos: int, n: int) -> bytes:
        return hashlib.blake2b(b" ".join(found[pos:pos + n + words - 1]),
                               digest_size=16).digest()

    gone = np.zeros(len(found), dtype=bool)
    claims = []
    for span in row["spans"] or ():
        gone[span["pos"]:span["pos"] + span["n"] + words - 1] = True
        claims.append({"src": span["src"], "src_mark": span["src_mark"],
                       "src_pos": span["src_pos"], "n": span["n"],
                       "digest": digest(span["pos"], span["n"])})
    truths = [{"src": row["doc"], "src_mark": row["mark"], "src_pos": a["pos"], "n": a["n"],
               "digest": digest(a["pos"], a["n"])} for a in row["asked"] or ()]
    kept = b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                     if gone.any() else found)
    return (row["doc"], len(found), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
            kept.decode("utf-8") if keep_text else None, claims, truths)


def _wrong_sources(done: DataFrame) -> bool:
    """Whether a path's words differ from those at its source."""
    key = ["src", "src_mark", "src_pos", "n"]
    claims = done.select(F.explode("claims").alias("c")).select("c.*").distinct()
    truths = done.select(F.explode("truths").alias("t")).select("t.*").distinct()
    wrong = claims.join(truths.withColumnRenamed("digest", "truth"), key, "left").filter(
        ~F.col("digest").eqNullSafe(F.col("truth")))
    return bool(wrong.head(1))
