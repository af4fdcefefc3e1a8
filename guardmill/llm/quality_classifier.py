"""A quality classifier by compression with dictionaries of good and bad text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from .columns import document_text, need_columns

#: Characters of a text that are compressed together, and of a piece that is learnt; short
#: pieces keep the dictionary's weight the same throughout long texts.
PIECE = 512
#: Pieces per label that its dictionary is made of: the bound of what is learnt. A piece is
#: learnt whole, so a dictionary has up to DICTIONARY_PIECES * PIECE characters.
DICTIONARY_PIECES = 1024
#: Longer pieces per label that calibrate, as much like whole texts as a bound allows.
CALIBRATION_PIECES = 3000
CALIBRATION_PIECE = 2048
LEVEL = 6


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of good and bad text and the calibration of their difference."""

    good: bytes
    bad: bytes
    level: int
    intercept: float
    slope: float

    def probability(self, differences: np.ndarray) -> np.ndarray:
        odds = self.intercept + self.slope * differences
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


class CompressionScorer:
    """Compresses texts against both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL, piece: int = PIECE):
        self._packers = [_packer(d, level) for d in (good, bad)]
        self._piece = piece

    def differences(self, texts: Iterable[str | None]) -> np.ndarray:
        """Per text the normalised difference (bad - good) / (bad + good) of the compressed
        sizes; 0 for a text without content."""
        return np.array([self._one(text or "") for text in texts], dtype=np.float64)

    def _one(self, text: str) -> float:
        good = bad = 0
        for at in range(0, len(text), self._piece):
            data = text[at:at + self._piece].encode("utf-8")
            good += len(self._packers[0].compress(data))
            bad += len(self._packers[1].compress(data))
        return (bad - good) / (bad + good) if good else 0.0


def _packer(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    shaped = zstandard.ZstdCompressionDict(dictionary,
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shaped.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=shaped, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


def held_out(identity: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 3, is 1.

    A null id is held out.
    """
    rest = F.crc32(identity.cast("string").cast("binary")) % 3 == 1
    return F.coalesce(rest, F.lit(True))


def training_pieces(docs: DataFrame, labels: DataFrame, identity: str = "doc_id",
                    text: str = "text", label: str = "quality",
                    pieces: tuple[int, int] | int = (DICTIONARY_PIECES,
                                                           CALIBRATION_PIECES),
                    piece: tuple[int, int] = (PIECE, CALIBRATION_PIECE)) -> DataFrame:
    """label, part, order, id, place, content: a bounded sample of labelled text.

    Up to `pieces` pieces of `piece` characters per label and part: part 0 for the
    dictionaries, part 1 for the calibration. The sample is the least by a hash of id and
    place, so it depends on the rows alone and every piece of every labelled text has the
    same chance. An id with different labels is left out. Of several texts with one id the
    longest is drawn from, of equally long ones the last in code point order.
    """
    need_columns(docs, identity, text)
    need_columns(labels, identity, label)
    pieces = (pieces, pieces) if isinstance(pieces, int) else pieces
    known = (labels.select(F.col(identity).alias("id"), F.col(label).cast("int")
                           .alias("label"))
             .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
             .filter(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label"),
                                F.max("label").alias("other"))
             .filter("label = other").select("id", "label"))
    sizes = docs.select(F.col(identity).alias("id"),
                        F.length(document_text(text)).alias("chars"))
    sized = sizes.filter("chars > 0").groupBy("id").agg(F.max("chars").alias("chars"))
    # places of pieces are chosen on sizes; only the chosen texts are then looked at
    parted = known.join(sized, "id").withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(2)))
    long = F.when(F.col("part") == 0, F.lit(piece[0])).otherwise(F.lit(piece[1]))
    listed = parted.select("id", "label", "part", "chars", long.alias("long"), F.explode(
        F.sequence(F.lit(0), F.floor((F.col("chars") - 1) / long))).alias("place"))
    order = F.xxhash64("id", "place", F.lit("draw"))
    drawn = [listed.filter((F.col("label") == a) & (F.col("part") == b))
             .withColumn("order", order).orderBy("order", "id", "place").limit(pieces[b])
             for a in (0, 1) for b in (0, 1)]
    chosen = drawn[0]
    for other in drawn[1:]:
        chosen = chosen.unionByName(other)
    chosen = settled(chosen)  # at most twice the sum of `pieces` rows
    wanted = chosen.groupBy("id", "chars", "long").agg(
        F.collect_set("place").alias("places"))
    body = document_text(text)
    texts = docs.select(F.col(identity).alias("id"), body.alias("text"),
                        F.length(body).alias("chars"))
    found = texts.join(F.broadcast(wanted), ["id", "chars"]).select(
        "id", F.explode(F.transform("places", lambda p: F.struct(
            p.alias("place"), F.substring(F.col("text"), (p * F.col("long") + 1).cast("int"),
                                          F.col("long")).alias("content"),
            F.sha2(F.col("text"), 256).alias("of")))).alias("p"))
    # all pieces of an id from one and the same of its longest texts
    cut = found.groupBy("id", F.col("p.place").alias("place")).agg(
        F.max_by("p.content", "p.of").alias("content"))
    return chosen.join(cut, ["id", "place"]).select(
        "label", "part", "order", "id", "place", "content")


def fit(rows: Sequence, level: int = LEVEL) -> CompressionModel:
    """Fits the model to collected rows of `training_pieces`.

    Part 0 is the dictionaries, whole pieces one after the other; part 1 calibrates: the
    difference is compared on text the dictionaries have not seen. Without text of both
    labels in either part every score is the prior alone.
    """
    ordered = sorted(rows, key=lambda r: (r["label"], r["part"], r["order"], r["id"],
                                          r["place"]))

    def contents(label: int, part: int) -> list[str]:
        return [r["content"] for r in ordered if r["label"] == label and r["part"] == part]

    good, bad = ("\n".join(contents(label, 0)).encode("utf-8") for label in (1, 0))
    counts = [len(contents(label, 1)) for label in (0, 1)]
    if not good or not bad or not all(counts):
        share = (len([r for r in ordered if r["label"] == 1]) + 1) / (len(ordered) + 2)
        return CompressionModel(good, bad, level, math.log(share / (1 - share)), 0.0)
    scorer = CompressionScorer(good, bad, level)
    found = scorer.differences(contents(0, 1) + contents(1, 1))
    target = np.repeat([0.0, 1.0], counts)
    # each label counts as much as the other, whatever the sample's shares
    weight = np.repeat([0.5 / counts[0], 0.5 / counts[1]], counts) * len(target)
    return CompressionModel(good, bad, level, *_logistic(found, target, weight))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one number by Newton's method, with a small ridge."""
    scale, center = max(float(x.std()), 1e-9), float(x.mean())
    z = np.column_stack([np.ones(len(x)), (x - center) / scale])
    ridge = np.diag([1e-6, 1e-2]) * len(x)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge @ beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] - beta[1] / scale * center), float(beta[1] / scale)


def score_documents(docs: DataFrame, model: CompressionModel, identity: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """identity, held_out, score, predicted per document; the whole text is compressed.

    Null and empty texts get the calibration's intercept. Repeated rows and ids score alike.
    No shuffle; other columns are not read.
    """
    need_columns(docs, identity, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    rows = docs.select(F.col(identity).alias("id"), held_out(F.col(identity))
                       .alias("held_out"), document_text(text).alias("text"))
    kind = docs.schema[identity].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = CompressionScorer(model.good, model.bad, model.level)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(2).slice(at, 256).to_pylist()
                found.append(model.probability(scorer.differences(texts)))
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))],
                ["id", "held_out", "score", "predicted"])

    scored = rows.mapInArrow(
        score, f"id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", identity)


def classify_documents(docs: DataFrame, labels: DataFrame, identity: str = "doc_id",
                       text: str = "text", label: str = "quality") -> DataFrame:
    """Learns from the labels that are not held out and scores every document.

    Columns as `score_documents`. Null and empty texts score alike, rows of one id by their
    own texts; a null id is scored and held out. An empty table gives no rows; without labels
    of both kinds every score is the prior. Other columns are not read.
    """
    model = fit(training_pieces(docs, labels, identity, text, label).collect())
    return score_documents(docs, model, identity, text)


def good_documents(docs: DataFrame, labels: DataFrame, identity: str = "doc_id",
                   text: str = "text", label: str = "quality",
                   threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches `threshold`, with all their columns, whatever these are
    called. No shuffle. Nulls, empty texts and repeated rows as in `classify_documents`: equal
    rows stay or go together; an empty table stays empty."""
    model = fit(training_pieces(docs, labels, identity, text, label).collect())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = CompressionScorer(model.good, model.bad, model.level)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores = model.probability(scorer.differences(part.column(place).to_pylist()))
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)
