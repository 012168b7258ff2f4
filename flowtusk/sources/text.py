"""Headerless delimited packet files, as a table or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtusk.functions.addresses import ip_from_saddr
from flowtusk.schema import MIN_FIELDS, PACKET_FIELDS


def _fields() -> Column:
    # Trailing empty fields do not count towards the number of fields.
    return F.split(F.regexp_replace("value", ",+$", ""), ",")


def valid_row(fields: Column) -> Column:
    """More than eleven fields."""
    return F.size(fields) > MIN_FIELDS


def parse_packet_lines(lines: DataFrame, strict: bool | str = True, addresses: str = "text") -> DataFrame:
    """Lines (column `value`) to packets; rows with too few fields are dropped.

    With `strict` a non-numeric value in a column that is used fails the query; `strict=False`
    makes it NULL, and `strict="drop"` drops the lines that `rejected_lines` lists, so that no
    flow key or time is NULL. `addresses="raw"` reads address numbers in file byte order, as the
    numeric writer leaves them. `pkt_id` is that of the lines, if they have one; else it follows line
    order within a file split in a table, and is a hash of the line in a stream.
    """
    if "pkt_id" in lines.columns:
        pkt_id = F.col("pkt_id")
    else:
        pkt_id = F.xxhash64("value") if lines.isStreaming else F.monotonically_increasing_id()
    if addresses not in ("text", "raw"):
        raise ValueError("addresses must be 'text' or 'raw'")
    f = F.col("f")
    split = lines.select(pkt_id.alias("pkt_id"), _fields().alias("f")).filter(_reason(f, addresses).isNull() if strict == "drop" else valid_row(f))
    strict = strict is True
    typed = []
    for at, (name, kind) in enumerate(PACKET_FIELDS):
        raw = F.get(F.col("f"), F.lit(at))
        if kind != "string":
            raw = raw.cast(kind) if strict else raw.try_cast(kind)
        elif addresses == "raw":
            raw = ip_from_saddr(raw.cast("bigint") if strict else raw.try_cast("bigint"))
        typed.append(raw.alias(name))
    return split.select("pkt_id", *typed)


def _reason(fields: Column, addresses: str = "text") -> Column:
    """Why a line is no packet, or NULL: too few fields, or a field that is there but no number."""
    names = {"ts_us": "time", "pkt_len": "length"}
    tests = [(at, name, "bigint" if kind == "string" else kind) for at, (name, kind) in enumerate(PACKET_FIELDS)
             if kind != "string" or addresses == "raw"]
    bad = F.array(*[F.get(fields, F.lit(at)).isNotNull() & F.get(fields, F.lit(at)).try_cast(kind).isNull()
                    for at, _, kind in tests])
    first = F.array_position(bad, True).cast("int") - 1  # -1 where none is bad
    labels = F.array(*[F.lit(f"bad {names.get(name, name)}") for _, name, _ in tests])
    return F.when(~valid_row(fields), F.lit("too few fields")).otherwise(F.get(labels, first))


def rejected_lines(lines: DataFrame, addresses: str = "text") -> DataFrame:
    """Lines that are too short or have a bad number in any field, with the first reason."""
    return (lines.select("value", _fields().alias("f"))
            .select("value", _reason(F.col("f"), addresses).alias("reason"))
            .filter(F.col("reason").isNotNull()))


def read_packets_csv(spark: SparkSession, path: str, strict: bool | str = True, addresses: str = "text") -> DataFrame:
    """Packets of delimited files."""
    return parse_packet_lines(spark.read.text(path), strict, addresses)


#: Bits of a line's place in its file, and of the file itself, in the ids of streamed lines.
PLACE_BITS, FILE_BITS = 33, 30


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines of files (a table or a stream) with `pkt_id`: the file's hash, then a number that grows with the line.

    A line's number is its place in its split, counted from the split's beginning, or from the byte behind it where the
    split is not the first: a line that begins right there belongs to the split before. As a line takes a byte at
    least, numbers of a file's lines differ and follow their order. Two of n files share a hash with a chance of n² / 2^31.
    """
    def number(batches) -> Iterator[pa.RecordBatch]:
        split, place = None, 0
        for batch in batches:
            files, begins = batch.column("file").to_numpy(), batch.column("begin").to_numpy()
            cuts = np.flatnonzero((files[1:] != files[:-1]) | (begins[1:] != begins[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if end > begin:
                    if split != (files[begin], begins[begin]):
                        split, place = (files[begin], begins[begin]), 0
                    first = begins[begin] + (begins[begin] > 0) + place
                    ids = (files[begin] << PLACE_BITS) | (first + np.arange(end - begin))
                    place += end - begin
                    yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("value").slice(begin, end - begin)], ["pkt_id", "value"])

    file = F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << FILE_BITS) - 1))
    placed = lines.select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    return placed.mapInArrow(number, "pkt_id bigint, value string")


def stream_packets_csv(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                       strict: bool = True, ids: str = "place") -> DataFrame:
    """The same rows as an unbounded input; `max_files_per_trigger` paces it.

    `ids="place"` numbers lines by file and place, so that equal lines differ and a repeated batch gives the
    same ids; `ids="hash"` is cheaper and takes a hash of the line, which equal lines share.
    """
    if ids not in ("place", "hash"):
        raise ValueError("ids must be 'place' or 'hash'")
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(path)
    return parse_packet_lines(number_lines(lines) if ids == "place" else lines, strict)


def stream_packets_parquet(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet packet files as an unbounded input."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
