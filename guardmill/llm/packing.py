"""Best-fit packing of documents into sequences by a grouping genetic algorithm."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from . import tokens
from .columns import document_text, need_columns

CAPACITY = 2048
#: Pieces that are packed together. Every block of pieces evolves on its own; what each
#: block leaves over is packed again across blocks.
BLOCK_PIECES = 4096
ISLANDS = 3
POPULATION = 4
GENERATIONS = 12
ROUNDS = 3
#: Share of a parent's bins, the fullest, that a crossover injects at most.
INJECTED = 0.5
TEXT_BYTES = 4 << 20

_PIECES = ("uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
_STATE = ("block long, island int, uids binary, lengths binary, people binary, bins int, "
          "bound int")
_PLACES = "uid long, sequence_id long, offset long"


# --- pieces ---------------------------------------------------------------------------


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of `n` ids: the first may be shorter, none is empty."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)] if n else []
    return [(s, (first if s == 0 else capacity)) for s in starts]


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0,
                    capacity: int = CAPACITY, identity: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32. No shuffle.

    `uid` counts within the scan's partition, so a task that is run again gives the same.
    """
    need_columns(docs, identity, text)
    rows = docs.select(F.col(identity).cast("long").alias("id"),
                       document_text(text).alias("text"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.load(tokenizer)
        uid = TaskContext.get().partitionId() << 36
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        for batch in batches:
            out: list[tuple] = []
            names = iter(batch.column(0).to_pylist())
            for texts in tokens.slices_of_bytes(batch.column(1), TEXT_BYTES):
                for ids in encoder.encode(texts):
                    name = next(names)
                    whole = np.concatenate([ids, tail]).astype("<u4")
                    for i, (start, n) in enumerate(cut_pieces(len(whole), capacity)):
                        crc = zlib.crc32(whole[start:start + n].tobytes())
                        out.append((uid, name, i, start, n, crc))
                        uid += 1
            yield _rows(out, _PIECES)

    return rows.mapInArrow(cut, _PIECES)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        [name for name, _ in fields])


# --- one block: best fit, bounds, crossover ---------------------------------------------


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[int],
             capacity: int = CAPACITY) -> None:
    """Puts the pieces in `order` each where it leaves the least room; extends `free`.

    `bins` (bin per piece) and `free` (room per bin) are changed in place. Bins are kept by
    their room, and one bit per room says which are there.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, room in enumerate(free):
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        left = room - n
        free[b] = left
        if left:
            by_room[left].append(b)
            rooms |= 1 << left


def least_bins(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A lower bound of the number of bins (Martello and Toth's L2)."""
    if not len(lengths):
        return 0
    ordered = np.sort(lengths)
    total = np.concatenate(([0], np.cumsum(ordered)))
    best = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(ordered, capacity // 2, side="right"))
    for k in np.unique(np.concatenate(([0], ordered[:half]))).tolist():
        # pieces over capacity - k share with none of k and more; others over a half take a
        # bin each, too; pieces of k up to a half fill what room these leave
        low = int(np.searchsorted(ordered, k, side="left"))
        huge = max(half, int(np.searchsorted(ordered, capacity - k, side="right")))
        room = (huge - half) * capacity - int(total[huge] - total[half])
        small = int(total[half] - total[low])
        extra = max(0, -(-(small - room) // capacity))
        best = max(best, len(ordered) - half + extra)
    return best


def fullness(lengths: np.ndarray, bins: np.ndarray, capacity: int = CAPACITY) -> float:
    """Mean square of the bins' fill: rises when room gathers in few bins."""
    fill = np.bincount(bins, weights=lengths)
    fill = fill[fill > 0]
    return float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def compact(bins: np.ndarray) -> np.ndarray:
    """Bins numbered from 0 without gaps."""
    return np.unique(bins, return_inverse=True)[1].astype(np.int32).reshape(-1)


def crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray,
              chance: np.random.Generator, capacity: int = CAPACITY) -> np.ndarray:
    """Injects whole well-filled bins of the giver into the taker.

    Bins of the taker that hold an injected piece are dissolved, which removes duplicates;
    the other pieces they held are displaced and find new places by best fit, longest first.
    """
    fill = np.bincount(giver, weights=lengths)
    ranked = np.argsort(-fill, kind="stable")
    few = max(1, int(len(ranked) * INJECTED * chance.random()))
    pool = ranked[:max(few, int(len(ranked) * INJECTED))]
    injected = np.isin(giver, chance.permutation(pool)[:few])
    hit = np.zeros(int(taker.max()) + 1, dtype=bool)
    hit[taker[injected]] = True
    displaced = hit[taker] & ~injected
    child = np.where(injected, giver + len(hit), taker).astype(np.int64)
    return refit(lengths, child, displaced, capacity)


def mutate(lengths: np.ndarray, person: np.ndarray, chance: np.random.Generator,
           capacity: int = CAPACITY) -> np.ndarray:
    """Dissolves the emptiest bins and a few others."""
    fill = np.bincount(person, weights=lengths)
    ranked = np.argsort(fill, kind="stable")
    few = max(1, min(len(ranked), 2 + len(ranked) // 50))
    gone = np.zeros(len(ranked), dtype=bool)
    gone[ranked[:few]] = True
    gone[chance.integers(0, len(ranked), few)] = True
    return refit(lengths, person.astype(np.int64), gone[person], capacity)


def refit(lengths: np.ndarray, bins: np.ndarray, displaced: np.ndarray,
          capacity: int) -> np.ndarray:
    out = np.empty(len(bins), dtype=np.int64)
    out[~displaced] = compact(bins[~displaced])
    free = (capacity - np.bincount(out[~displaced], weights=lengths[~displaced])).astype(
        np.int64).tolist()
    loose = np.flatnonzero(displaced)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    best_fit(lengths, order, out, free, capacity)
    return compact(out)


def first_people(lengths: np.ndarray, chance: np.random.Generator, island: int,
                 size: int = POPULATION, capacity: int = CAPACITY) -> list[np.ndarray]:
    """Best-fit packings: longest first, and with the order disturbed."""
    people = []
    for i in range(size):
        spread = 0.0 if island == 0 and i == 0 else 0.05 * (i + 1)
        key = lengths * (1 + spread * (chance.random(len(lengths)) - 0.5))
        bins, free = np.empty(len(lengths), dtype=np.int64), []
        best_fit(lengths, np.argsort(-key, kind="stable"), bins, free, capacity)
        people.append(compact(bins))
        if int(people[-1].max(initial=-1)) + 1 <= least_bins(lengths, capacity):
            break
    return people


def evolve(lengths: np.ndarray, people: list[np.ndarray], bound: int,
           chance: np.random.Generator, generations: int = GENERATIONS,
           size: int = POPULATION, capacity: int = CAPACITY) -> list[np.ndarray]:
    """The fittest after some generations, best first; ends at the lower bound."""
    def rank(person: np.ndarray) -> tuple[int, float]:
        return int(person.max()) + 1, -fullness(lengths, person, capacity)

    ranked = sorted(people, key=rank)
    for _ in range(generations):
        if int(ranked[0].max()) + 1 <= bound:
            break
        children = []
        for _ in range(max(1, size // 2)):
            one, two = chance.integers(0, len(ranked), 2)
            child = crossover(lengths, ranked[min(one, two)], ranked[max(one, two)], chance,
                              capacity)
            children += [child, mutate(lengths, child, chance, capacity)]
        ranked = sorted(ranked + children, key=rank)[:size]
    return ranked


# --- islands on Spark -------------------------------------------------------------------


def _pack(people: list[np.ndarray]) -> bytes:
    return np.stack(people).astype("<u2").tobytes()


def _unpack(people: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(people, "<u2").reshape(-1, n).astype(np.int64))


def _seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([p & 0xFFFFFFFF for p in parts])


def settle_blocks(items: DataFrame, islands: int = ISLANDS) -> DataFrame:
    """The first people of every island of every block; items are uid, length, block."""
    def start(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_numpy()
        lengths = table.column("length").to_numpy()
        order = np.lexsort((uids, -lengths))
        uids, lengths = uids[order], lengths[order]
        block = int(table.column("block")[0].as_py())
        bound = least_bins(lengths)
        rows = []
        for island in range(islands):
            people = first_people(lengths, _seed(block, island), island)
            bins = min(int(p.max()) + 1 for p in people)
            rows.append((block, island, uids.astype("<i8").tobytes(),
                         lengths.astype("<i4").tobytes(), _pack(people), bins, bound))
            if bins <= bound:  # no packing has fewer
                break
        return pa.Table.from_batches([_rows(rows, _STATE)])

    return settled(items.groupBy("block").applyInArrow(start, _STATE))


def migrate(state: DataFrame, islands: int, wave: int) -> DataFrame:
    """One wave: every island gets its neighbour's best and evolves on."""
    guests = state.select("block", ((F.col("island") + 1) % islands).cast("int")
                          .alias("island"), F.col("people").alias("guests"))

    def live(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                people = _unpack(r["people"], len(lengths))
                people += _unpack(r["guests"], len(lengths))[:1]  # the elite comes first
                ranked = evolve(lengths, people, r["bound"],
                                _seed(r["block"], r["island"], wave + 1))
                rows.append((r["block"], r["island"], r["uids"], r["lengths"],
                             _pack(ranked), int(ranked[0].max()) + 1, r["bound"]))
            yield _rows(rows, _STATE)

    return settled(state.join(guests, ["block", "island"]).mapInArrow(live, _STATE))


def best_of_blocks(state: DataFrame) -> DataFrame:
    """One row per block: the island with the fewest bins."""
    best = state.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("b")).select(
        "block", F.col("b.island").alias("island"))
    return state.join(best, ["block", "island"], "left_semi")


def _placed(best: DataFrame, level: int, strip: bool) -> DataFrame:
    """uid, sequence_id, offset; pieces of a block's emptiest bin have no place if `strip`."""
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                uids = np.frombuffer(r["uids"], "<i8")
                bins = _unpack(r["people"], len(lengths))[0]
                order = np.argsort(bins, kind="stable")
                sizes = lengths[order]
                before = np.cumsum(sizes) - sizes
                first = np.flatnonzero(np.diff(bins[order], prepend=-1))
                offset = before - np.repeat(before[first],
                                            np.diff(first, append=len(order)))
                fill = np.bincount(bins, weights=lengths)
                kept = bins[order] != (int(np.argmin(fill)) if strip else -1)
                name = (np.int64(level) << 56) + (np.int64(r["block"]) << 16) + bins[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[order]), pa.array(name, mask=~kept),
                     pa.array(offset, mask=~kept)], ["uid", "sequence_id", "offset"])

    return best.mapInArrow(place, _PLACES)


def pack_items(items: DataFrame, level: int = 1, block_pieces: int = BLOCK_PIECES,
               islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """uid, sequence_id, offset for items (uid, length) shorter than a sequence.

    Items are dealt to blocks of about `block_pieces` by a hash. Blocks that miss their
    lower bound go through waves of evolution and migration. Of every block the emptiest
    bin is dissolved and packed again with those of the other blocks, so cutting the input
    into blocks costs no bin per block.
    """
    count = items.count()
    blocks = max(1, -(-count // block_pieces))
    dealt = items.select("uid", "length", F.pmod(
        F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"))
    state = settle_blocks(dealt, islands)
    done = None
    for wave in range(rounds):
        closed = state.filter("bins <= bound").select("block").distinct()
        ready = best_of_blocks(state.join(closed, "block", "left_semi"))
        done = ready if done is None else done.unionByName(ready)
        state = state.join(closed, "block", "left_anti")
        if not state.head(1):
            break
        state = migrate(state, islands, wave)
    best = settled(done.unionByName(best_of_blocks(state)) if done is not None else state)
    if blocks == 1:
        return _placed(best, level, strip=False)
    places = settled(_placed(best, level, strip=True))
    left = places.filter("sequence_id IS NULL").select("uid").join(items, "uid")
    return places.filter("sequence_id IS NOT NULL").unionByName(
        pack_items(settled(left.select("uid", "length")), level + 1, block_pieces, islands,
                   rounds))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0,
                   identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized whole and end in `end_id`; those over the capacity are cut, the
    first piece may be shorter. Full pieces are sequences of their own, all others are
    packed. Null and empty texts have the end id alone; null and repeated ids are documents
    of their own; no rows give no rows; other columns are not read.
    """
    pieces = settled(document_pieces(docs, tokenizer, end_id, identity=identity, text=text))
    short = pieces.filter(F.col("length") < CAPACITY).select("uid", "length")
    places = pack_items(short)
    full = pieces.filter(F.col("length") >= CAPACITY).withColumns({
        "sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    return pieces.join(places, "uid").unionByName(full).drop("uid")
