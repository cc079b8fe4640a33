"""Best-fit packing of documents into sequences of fixed capacity, in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so equal pieces, and equal gaps, form runs: (size, first, count), where first is
a rank among equal pieces, or the number of a sequence. A round is one Spark job over the runs of all unplaced pieces and all gaps:

1. Range sort: pieces by length and gaps by room go to tasks by ranges of sizes, sorted, pieces before gaps of equal size.
2. Sweep: upwards through its range, a task keeps the pieces it has passed; each gap takes the largest of them, so that a piece's gap is
   the successor of its length among gaps that no larger piece claims. Where several pieces want one run of gaps, or several gaps one
   run of pieces, ranks decide: who comes first in the run takes the first.
3. Boundaries: what the ranges couldn't match among themselves is swept once more as a whole.
4. Update: matched gaps go back with the room they have left; gaps that no piece is small enough for are closed; for pieces that are
   larger than every gap, sequences open.

Rounds repeat until no piece is left (about a dozen). The runs' number depends on the capacity and not on the corpus; pieces
themselves move only when their places are looked up. The result needs as many sequences as best-fit decreasing one by one, give
or take three in a thousand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .util import crc_le32, lean, nameless, tokenizer_path, tune, written
from .wordcodec import codec

CAPACITY = 1024


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: the remainder first, then full ones."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


#: Kinds of rows of a round, in the order in which a sweep takes equal sizes.
PIECE, GAP, PLACED, NEXT = range(4)
#: A run of pieces (size: length, first: rank), of gaps (size: room, first: sequence) or of placed pieces (all columns); NEXT's first
#: is the number of the next sequence.
RUN = "kind int, size int, first long, count long, sequence long, offset int"
#: Ranges of sizes that are swept by themselves, and rounds after which something must be wrong.
RANGES, ROUNDS = 8, 1000


def sweep(runs: Iterable[tuple], capacity: int, whole: bool) -> list[tuple]:
    """The runs after a sweep; they come by size, then kind. whole: these are all sizes, so gaps can be closed and opened."""
    waiting: list[list[int]] = []
    out, widest, new = [], 0, None
    for kind, size, first, count, sequence, offset in runs:
        if kind == PIECE:
            waiting.append([size, first, count])
        elif kind == NEXT:
            new = first
        elif kind == PLACED:
            out.append((kind, size, first, count, sequence, offset))
        else:
            while count and waiting:
                length, rank, left = waiting[-1]
                each = size // length  # as long as a gap takes more of this length, it is the tightest
                gaps = min(count, left // each)
                n, gaps = (each, gaps) if gaps else (left, 1)
                out += [(PLACED, length, rank + j * gaps, gaps, first, capacity - size + j * length) for j in range(n)]
                if room := size - n * length:
                    out.append((GAP, room, first, gaps, 0, 0))
                    widest = max(widest, room)
                first, count = first + gaps, count - gaps
                waiting[-1][1:] = rank + n * gaps, left - n * gaps
                if left == n * gaps:
                    waiting.pop()
            if count and not whole:
                out.append((GAP, size, first, count, 0, 0))
    out += [(PIECE, *w, 0, 0) for w in waiting]
    if whole:
        homeless = [(length, count) for length, _, count in waiting if length > widest]
        n = sum(c for length, c in homeless if 2 * length > capacity) or -(-sum(length * c for length, c in homeless) // capacity)
        out += [(GAP, capacity, new, n, 0, 0)] * (n > 0) + [(NEXT, 0, new + n, 1, 0, 0)]
    elif new is not None:
        out.append((NEXT, 0, new, 1, 0, 0))
    return out


def best_fit_rounds(counts: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """Runs of placed pieces (kind PLACED): piece number r of its length (size), with first <= r < first + count, goes to sequence
    sequence + r - first at offset. counts: (length, n), each length (1 to capacity) once."""
    spark = counts.sparkSession

    def swept(whole: bool):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs = sweep((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), capacity, whole)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*runs)) or [()] * 6, TYPES)], NAMES)

        return run

    pieces = counts.select(F.lit(PIECE).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("count"), F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("offset"))
    now = written(pieces.unionByName(spark.createDataFrame([(NEXT, 0, 0, 1, 0, 0)], RUN)), "runs")
    placed = []
    for _ in range(ROUNDS):
        if now.where(F.col("kind") == PIECE).isEmpty():
            return reduce(DataFrame.unionByName, placed, now.where(F.col("kind") == PLACED))
        placed.append(now.where(F.col("kind") == PLACED))
        local = now.where(F.col("kind") != PLACED).repartitionByRange(ranges, "size").sortWithinPartitions("size", "kind", "first").mapInArrow(swept(False), RUN)
        now = written(local.repartition(1).sortWithinPartitions("size", "kind", "first").mapInArrow(swept(True), RUN), "runs")
    raise RuntimeError(f"pieces are left after {ROUNDS} rounds")


NAMES = [f.split()[0] for f in RUN.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in RUN.split(", ")]


class Placer:
    """Places of rows among their task's rows of equal length, from 0, batch by batch."""

    def __init__(self, capacity: int):
        self.capacity, self.seen = capacity, np.zeros(capacity + 1, np.int64)

    def place(self, lengths: np.ndarray) -> np.ndarray:
        if len(lengths) and (lengths.min() < 1 or lengths.max() > self.capacity):
            raise ValueError(f"lengths must be from 1 to {self.capacity}")
        order = np.argsort(lengths, kind="stable")
        ranked = lengths[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(ranked)])
        place = np.empty(len(lengths), np.int64)
        place[order] = np.arange(len(ranked)) - np.repeat(starts, sizes) + self.seen[ranked]
        self.seen[ranked[starts]] += sizes
        return place


def placed_rows(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with part, the task's number, and place, the row's place among the task's rows of its length."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, placer = TaskContext.get().partitionId(), Placer(capacity)
        for b in batches:
            if b.column(length).null_count:
                raise ValueError(f"lengths must be from 1 to {capacity}")
            lengths = b.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(placer.place(lengths))], [*b.schema.names, "part", "place"])

    return pieces.mapInArrow(run, StructType([*pieces.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())]))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a column length (1 to capacity).

    pieces is written once, with each row's place among its task's rows of that length; the rank of a row is that place plus the
    rows of earlier tasks (a window over one row per task and length). Only the runs of placed pieces reach the driver, as their
    lookup goes to all tasks: some thousands, whose number depends on the capacity. Lengths that are null or out of range
    raise an error, and so do a missing length and columns named sequence_id or offset (in any case); all other columns are carried along, whatever
    their names. Equal pieces are dealt by rank; repeated rows are pieces of their own. An empty table stays empty."""
    if clash := {c for c in pieces.columns if c.lower() in ("sequence_id", "offset")}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    if "length" not in pieces.columns:
        raise ValueError("pieces have no column length")
    tune(pieces.sparkSession)
    plain, names = nameless(pieces)
    length = names[pieces.columns.index("length")]
    return _assigned(placed_rows(plain, length, capacity), length, capacity).toDF(*pieces.columns, "sequence_id", "offset")


def _assigned(pieces: DataFrame, length: str, capacity: int) -> DataFrame:
    """Rows of placed_rows() with sequence_id and offset in place of part and place."""
    kept = written(pieces, "pieces")
    names = [c for c in kept.columns if c not in ("part", "place")]
    counts = kept.groupBy(length, "part").agg(F.count("*").alias("n"))
    bases = counts.select(length, "part", (F.sum("n").over(W.partitionBy(length).orderBy("part")) - F.col("n")).alias("base"))
    totals = written(kept.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n")), "lengths")
    runs = best_fit_rounds(totals, capacity).select("size", "first", "sequence", "offset").toPandas().to_numpy(np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    by_length = {int(k): runs[runs[:, 0] == k] for k in np.unique(runs[:, 0])}

    @lean
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("place").to_numpy() + b.column("base").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(lengths):
                own, r = lengths == k, by_length[int(k)]
                i = np.searchsorted(r[:, 1], rank[own], side="right") - 1
                seq[own], offset[own] = r[i, 2] + rank[own] - r[i, 1], r[i, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([*(f for f in kept.schema if f.name in names), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    ranked = kept.join(bases, [length, "part"]).select(*kept.columns, "base")
    return ranked.mapInArrow(assign, schema)


def pack_texts(df: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """pack() of token_pieces(), whose rows get their places in the pass that encodes them. options: of token_pieces()."""
    return _assigned(token_pieces(df, capacity=capacity, placed=True, **options), "length", capacity)


def token_pieces(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, placed: bool = False) -> DataFrame:
    """Every whole text as pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, and
    the ids themselves where with_ids, and part and place as of placed_rows() where placed (in the same pass: a second Python
    step in one stage would need workers of its own; they hold only while no row is taken out or added).

    Null texts count as empty: one piece that holds end_id alone. Null and repeated ids are documents
    of their own; other columns are not read."""
    path = tokenizer_path(tokenizer)
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, placer = codec(path, True), TaskContext.get().partitionId(), Placer(capacity)
        for b in batches:
            ids, off = tok.encode(b.column("text"))
            rows: list[tuple] = []
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                own, start = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)), 0
                for k, n in enumerate(cut(len(own), capacity)):
                    part = own[start : start + n]
                    rows.append((doc, k, start, n, crc_le32(part), part.astype(np.int32) if with_ids else None))
                    start += n
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)][: 6 if with_ids else 5]
            if placed:
                arrays += [pa.array(np.full(len(rows), task, np.int32)), pa.array(placer.place(np.array(cols[3], np.int64)))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = ["doc_id long", "piece int", "start long", "length long", "ids_crc32 long", *["ids array<int>"] * with_ids, *["part int", "place long"] * placed]
    names = [f.split()[0] for f in fields]
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, ", ".join(fields))
