"""Packing of documents into sequences of bounded length, in rounds of best fit.

A document becomes its token ids and an end id. Only a document longer than a sequence is cut,
into full pieces and a rest. Pieces are dealt over partitions; each partition places its pieces
by decreasing length into the fullest sequence that still has room. Sequences that are nearly
full leave; the others are items of the next round, with fewer partitions, and so on along a
tree. A task's share is bounded in every round: when too many underfull sequences remain for
the last task, that round keeps as many partitions as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, text_or_empty
from flowtusk.llm.tokens import encode_words, word_cache
from flowtusk.plans.storage import store

CAPACITY = 4096
END_ID = 1
#: A sequence with at most this many free places counts as full before the last round.
SLACK = 16
#: Items that a task packs at once.
TASK_ITEMS = 20_000
FAN_IN = 8
#: Text that a worker encodes at once.
SLICE_BYTES = 1_000_000

_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
               capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    Null text counts as empty; such a document has only the end id. A null doc_id stays null, and
    repeated rows give repeated pieces; ids may be of any type. Other columns are not read.
    """
    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", SLICE_BYTES):
            ids, offsets = encode_words(vocabulary, batch.column("text"))
            docs, pieces, starts, lengths, sums = [], [], [], [], []
            for row in range(batch.num_rows):
                own = np.append(ids[offsets[row]:offsets[row + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start:start + capacity]
                    docs.append(row), pieces.append(piece), starts.append(start), lengths.append(len(part))
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        word_cache(vocabulary).forget()  # the worker lives on, beside the tasks of other steps

    named = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return named.mapInArrow(cut, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, {_PIECES}")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by decreasing length, each into the fullest bin with room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    filled = np.zeros(capacity + 2, dtype=bool)
    bins, made = np.empty(len(lengths), dtype=np.int64), 0
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        free = size + int(filled[size:].argmax())
        if filled[free] and free <= capacity:
            bin_ = room[free].pop()
            filled[free] = bool(room[free])
        else:
            bin_, free, made = made, capacity, made + 1
        bins[item] = bin_
        left = free - size
        if left:
            room[left].append(bin_)
            filled[left] = True
    return bins


def _place(items: DataFrame, tasks: int, round_: int, capacity: int) -> DataFrame:
    """Best fit within each of `tasks` groups of items (id, size, ...): the group's rows with
    sequence_id, unique over rounds and groups, base (an item's place) and filled (the total)."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["size"].to_numpy()
        bins = best_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, np.diff(bins[order]) > 0]
        base = np.empty_like(before)
        base[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        frame["sequence_id"] = (round_ << 54) + (int(frame.pop("task").iloc[0]) << 24) + bins
        frame["base"] = base
        frame["filled"] = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return frame

    dealt = items.withColumn("task", F.pmod(F.xxhash64("id"), F.lit(tasks)))
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", sequence_id bigint, base bigint, filled bigint"
    return store(dealt.groupBy("task").applyInPandas(pack, schema), "packed")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, task_items: int = TASK_ITEMS,
                fan_in: int = FAN_IN) -> DataFrame:
    """Place pieces (as of `cut_pieces`) into sequences of at most `capacity` tokens.

    Adds sequence_id and offset, the place within the sequence, gapless from 0. Equal pieces are
    placed each. An empty table gives an empty table. Runs one job per round.
    """
    numbered = store(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") >= capacity
    columns = [*pieces.columns, "sequence_id", "offset"]
    zero = F.lit(0).cast("bigint")
    placed = numbered.filter(whole).select(
        *pieces.columns, (F.lit(1 << 62) + F.col("id")).alias("sequence_id"), zero.alias("offset"))
    rows = numbered.filter(~whole).withColumn("size", F.col("length"))
    count, tasks, round_ = rows.count(), None, 0
    full = F.col("filled") >= capacity - slack
    while count:
        least = -(-count // task_items)
        tasks = least if tasks is None else max(min(least, tasks), -(-tasks // fan_in))
        if round_ == 0:
            rows = _place(rows, tasks, round_, capacity).withColumn("offset", F.col("base"))
        else:  # the underfull sequences are the items
            bins = rows.groupBy(F.col("sequence_id").alias("id")).agg(F.first("filled").alias("size"))
            moved = _place(bins, tasks, round_, capacity).drop("size")
            rows = store(rows.drop("base", "filled").withColumnRenamed("sequence_id", "bin")
                         .join(moved.withColumnRenamed("id", "bin"), "bin").drop("bin")
                         .withColumn("offset", F.col("offset") + F.col("base")), "moved")
        rest = rows.filter(~full)
        before, count = count, rest.agg(F.count_distinct("sequence_id")).first()[0]
        # Done when one task has seen all that remained, or when next to nothing fits any more.
        if tasks == 1 or count >= 0.98 * before:
            return placed.unionByName(rows.select(columns))
        placed = placed.unionByName(rows.filter(full).select(columns))
        rows, round_ = rest, round_ + 1
    return placed


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, **options) -> DataFrame:
    """`cut_pieces` and `pack_pieces` in one: one row per piece with its place."""
    return pack_pieces(cut_pieces(docs, vocabulary, doc_id, text, capacity, end_id), capacity, **options)
