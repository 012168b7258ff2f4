"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six ASCII white-space characters, as a character class of regular expressions.
ASCII_SPACE = r"[\x20\x09-\x0D]"
ASCII_SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the corpus tables; the path may be a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def arrow_slices(batches: Iterable, text: str, size: int = 4_000_000) -> Iterator:
    """Cut Arrow batches so that one slice holds few long texts: memory stays bounded by `size` bytes plus one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def whole_runs(frames: Iterable[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The batches of a sorted partition, cut so that runs of equal `key` stay whole, and where
    runs begin (with the end of the last)."""
    def cut(frame: pd.DataFrame) -> np.ndarray:
        values = frame[key]
        return np.flatnonzero((values.iloc[1:].to_numpy() != values.iloc[:-1].to_numpy()).any(axis=1)) + 1

    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        begins = (held[-1][key].iloc[-1].to_numpy() != frame[key].iloc[0].to_numpy()).any() if held else False
        cuts = cut(frame)
        if not begins and not len(cuts):  # all of it belongs to the run before
            held.append(frame)
            continue
        last = int(cuts[-1]) if len(cuts) else 0
        ready = pd.concat([*held, frame.iloc[:last]], ignore_index=True)
        if len(ready):
            yield ready, np.array([0, *cut(ready), len(ready)])
        held = [frame.iloc[last:]]
    if held:
        ready = pd.concat(held, ignore_index=True)
        yield ready, np.array([0, *cut(ready), len(ready)])


def sorted_runs(frames: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal `key` of a sorted partition, across its batches."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        values = frame[key]
        cuts = np.flatnonzero((values.iloc[1:].to_numpy() != values.iloc[:-1].to_numpy()).any(axis=1)) + 1
        edges = [0, *cuts.tolist()]
        for begin, end in zip(edges, edges[1:], strict=False):
            yield frame.iloc[begin:end]
        held = frame.iloc[edges[-1]:]
    if held is not None and len(held):
        yield held
