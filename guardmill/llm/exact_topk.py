"""Exact top-k by inner product: MaxScore over posting lists, merged over shards.

A term is a dimension and a sign; its posting list holds the rows whose component has that
sign, in the order of their ids. A query's terms are its dimensions with the sign of its own
components, so postings only ever raise a score, and a term's bound is the query's component
times the largest one in the list. Terms whose bounds together stay below the k-th best score
are non-essential: a row in none of the other, essential lists can't be a result. Only the
essential lists are walked; what they bring up is probed in the other terms, highest bound
first, for as long as it is competitive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import LOWEST, Part, best_per_slot, blocked, largest, query_ids, usable_vectors

#: Rows that share one set of bounds, and terms probed at a time.
WINDOW = 2_048
PROBED = 8
SCHEMA = "query_id long, rank int, vec_id long, score long"


class Postings:
    """The posting lists of a shard."""

    def __init__(self, values: np.ndarray, window: int = WINDOW):
        self.values = values
        rows, dims = values.shape
        self.starts = np.arange(0, rows, window)
        self.ends = np.minimum(self.starts + window, rows)
        cuts = np.append(self.starts, rows)
        #: per sign and dimension: rows, components without sign, places of the windows
        self.lists = [[self._list(values[:, d], sign, cuts) for d in range(dims)]
                      for sign in (1, -1)]
        #: the largest component per window, sign and dimension
        self.most = np.zeros((len(self.starts), 2, dims), dtype=np.int64)
        for w, (start, end) in enumerate(zip(self.starts, self.ends, strict=True)):
            self.most[w, 0] = values[start:end].max(axis=0).clip(min=0)
            self.most[w, 1] = (-values[start:end]).max(axis=0).clip(min=0)

    @staticmethod
    def _list(column: np.ndarray, sign: int, cuts: np.ndarray) -> tuple:
        rows = np.flatnonzero(column * sign > 0)
        return rows, np.abs(column[rows]), np.searchsorted(rows, cuts)

    def best(self, query: np.ndarray, floor: int, k: int,
             own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best that are not below `floor`; `own` rows left out."""
        dims = np.flatnonzero(query)
        weights, signs = np.abs(query[dims]), (query[dims] < 0).astype(np.int64)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = floor
        for w in range(len(self.starts)):
            bounds = weights * self.most[w, signs, dims]
            order = np.argsort(bounds, kind="stable")
            below = np.cumsum(bounds[order])
            cut = int(np.searchsorted(below, limit))
            if cut == len(dims) and limit > 0:
                continue  # all terms together stay below the limit
            new, found = self._window(w, query, dims, weights, signs, bounds, order[:cut],
                                      order[cut:], limit)
            keep = ~own[new]
            rows, scores = np.append(rows, new[keep]), np.append(scores, found[keep])
            chosen = largest(scores, rows, k)
            rows, scores = rows[chosen], scores[chosen]
            if len(rows) == k:
                limit = max(limit, int(scores[-1]))
        return rows, scores

    def _window(self, w, query, dims, weights, signs, bounds, others, essential, limit):
        """Rows of a window that reach the limit, and their scores."""
        start, end = self.starts[w], self.ends[w]
        total = np.zeros(end - start, dtype=np.int64)
        for t in essential:
            listed, parts, places = self.lists[signs[t]][dims[t]]
            at = slice(places[w], places[w + 1])
            total[listed[at] - start] += weights[t] * parts[at]
        rest = int(bounds[others].sum())
        live = np.flatnonzero(total + rest >= limit)
        scores, live = total[live], live + start
        # components of the other sign under essential terms: they can only lower a score
        walked = dims[essential]
        lower = (self.values[np.ix_(live, walked)] * query[walked]).clip(max=0).sum(axis=1)
        live, scores = _competitive(live, scores + lower, rest, limit)
        falling = others[::-1]
        for at in range(0, len(falling), PROBED):
            some = falling[at:at + PROBED]
            rest -= int(bounds[some].sum())
            brought = self.values[np.ix_(live, dims[some])] @ query[dims[some]]
            live, scores = _competitive(live, scores + brought, rest, limit)
        return live, scores


def _competitive(rows, scores, rest, limit):
    keep = scores + rest >= limit
    return rows[keep], scores[keep]


def _search(shard: Part, block: Part, right: pa.Table, floors: np.ndarray, k: int) -> tuple:
    most = (int(np.abs(shard.values).max(initial=0)) * int(np.abs(block.values).max(initial=0))
            * max(1, shard.values.shape[1]))
    if most >= -LOWEST:
        raise OverflowError("an inner product is too large for 64 bits")
    postings = Postings(shard.values)
    pos, rows, scores = [], [], []
    for i, query in enumerate(block.values):
        own = shard.is_own(block.ids[i], block.known[i])
        found, reached = postings.best(query, int(floors[i, 0]), k, own)
        pos.append(np.full(len(found), i))
        rows.append(found)
        scores.append(reached)
    pos, rows, scores = (np.concatenate(x) for x in (pos, rows, scores))
    return pos, np.zeros(len(pos), dtype=np.int64), rows, scores


def nearest_rows(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product per query.

    `df` has vec_id and embedding; `is_query` picks the queries. Components become
    floor(scale * x). Rows with a null vector, or a null or non-finite component, take no
    part, neither as query nor as candidate. A vector that is shorter than others lacks the
    further terms, an empty one scores 0 everywhere. Rows of the query's id are its own and
    no candidates; a row without an id is a candidate, ranks behind equal scores and has a
    null vec_id, and is a query if `is_query` says so. A row where `is_query` is null is no
    query. Repeated rows count each for itself, so a query that stands twice is answered
    twice. Fewer than k candidates: all of them, also with scores below 0. An empty table, or
    one without queries, gives no rows. Other columns are not read.
    """
    chosen = df.withColumn("__asks", F.coalesce(is_query, F.lit(False)))
    rows = usable_vectors(chosen, "__asks")
    candidates = rows.select("vec_id", "embedding")
    queries = rows.filter("__asks").select("vec_id", "embedding")
    parts = blocked(candidates, queries, scale)
    if not parts.n_shards:
        return df.sparkSession.createDataFrame([], SCHEMA)
    found = best_per_slot(parts, _search, 1, k)
    return found.join(query_ids(parts.blocks), ["block", "pos"]).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
