"""libpcap capture files, read in byte ranges.

A capture has no index: only the length in each record's head says where the next one begins. Files
are cut into ranges all the same, so that a file of any size is read by many tasks:
1. each range guesses its first record: the first place from which a chain of heads is plausible;
   it walks on from there to the first record behind its end;
2. where the guess of a range is not the place at which the range before came out, the range is
   doubtful and walks again, from that place. The first range begins behind the file's head, so when
   no range is doubtful any more all are right; a file that does not settle is walked in one go;
3. the numbers of records of the ranges, one small row each, give each range the number of its
   first record, and the ranges are cut into records, again each by any task.

Python finds and cuts records; the header fields are decoded by built-in expressions. Files are read
through Arrow's file systems (local, S3, HDFS, ...), listed by Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtusk.functions.headers import decode_frames, ts_from_pcap
from flowtusk.plans.ordering import with_global_position
from flowtusk.plans.storage import store
from flowtusk.schema import PACKET_COLUMNS

# First four bytes of a capture file -> (byte order, fraction units per microsecond).
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
ETHERNET = 1
FILE_HEAD, RECORD_HEAD = 24, 16
# Link, tag, longest IP and longest TCP header: no field lies beyond.
HEADER_BYTES = 14 + 4 + 60 + 60
MAX_CAPTURED = 262_144

#: Bytes of a range, of one read, and how many heads in a row make a place plausible.
RANGE_BYTES, READ_BYTES, CHAIN = 64 << 20, 4 << 20, 8
#: Seconds that records may lie from the first one in a plausible head.
SPAN_S = 10 * 366 * 86_400
#: Rounds in which doubtful ranges walk again before a file is walked in one go.
ROUNDS = 3
MAX_TASKS = 10_000
_RECORD_BITS = 36

RECORD_SCHEMA = "path string, rec_no bigint, sec bigint, usec bigint, frame binary"
_RANGE = "path string, file_no bigint, size bigint, k bigint, begin bigint, end bigint"
_WALKED = f"{_RANGE}, entry bigint, exit bigint, records bigint"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))])


class _Capture:
    """One capture file of which parts are read."""

    def __init__(self, path: str, file: pa.NativeFile):
        self.path, self.file, self.size = path, file, file.size()
        head = file.read_at(min(FILE_HEAD, self.size), 0)
        if head[:4] not in MAGIC or len(head) < FILE_HEAD:
            raise ValueError(f"{path}: not a capture file")
        self.order, self.per_us = MAGIC[head[:4]]
        snaplen, link = struct.unpack_from(self.order + "II", head, 16)
        if link & 0xFFFF != ETHERNET:
            raise ValueError(f"{path}: link type {link} is not Ethernet")
        self.most = max(snaplen, MAX_CAPTURED)
        self.length = struct.Struct(self.order + "I").unpack_from

    @classmethod
    def open(cls, path: str) -> _Capture:
        files, name = fs.FileSystem.from_uri(path)
        return cls(path, files.open_input_file(name))

    def walk(self, at: int, end: int, sure: bool = True) -> Iterator[tuple[bytes, int, list[int]]]:
        """The records that begin in at..end, in portions: bytes, their place in the file, and where in
        them records begin; the last portion has none and lies where the walk came out. A walk that
        is not `sure` to begin at a record stops without that portion if a head makes no sense."""
        while at < end:
            data = self.file.read_at(min(READ_BYTES, self.size - at), at)
            places, place, captured = [], 0, 0
            while place < min(end - at, len(data) - RECORD_HEAD + 1):
                captured, = self.length(data, place + 8)
                if place + RECORD_HEAD + captured > len(data):
                    break
                places.append(place)
                place += RECORD_HEAD + captured
                captured = 0
            if not places:
                beyond = at + RECORD_HEAD + captured > self.size
                if beyond or captured > self.most and not sure:
                    if sure:
                        raise ValueError(f"{self.path}: truncated in the record at byte {at}")
                    return
                data, place, places = self.file.read_at(RECORD_HEAD + captured, at), RECORD_HEAD + captured, [0]
            yield data, at, places
            at += place
        yield b"", at, []

    def boundary(self, begin: int, end: int) -> int | None:
        """The first place in begin..end at which a record plausibly begins."""
        first = self.file.read_at(4, FILE_HEAD)
        start = self.length(first, 0)[0] if len(first) == 4 else 0
        step = min(READ_BYTES, 1 << 20)
        for at in range(begin, end, step):
            # Enough behind the step for a chain of usual records; a longer one counts as far as it is seen.
            data = np.frombuffer(self.file.read_at(min(step + (1 << 18), self.size - at), at), dtype=np.uint8)
            found = self._chained(data, min(step, end - at), start, at + len(data) == self.size)
            if found is not None:
                return at + found
        return None

    def _chained(self, data: np.ndarray, most: int, start: int, whole: bool) -> int | None:
        if len(data) < RECORD_HEAD:
            return None
        wide = data.astype(np.uint32)
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        word = sum(wide[i:len(wide) - 3 + i] << np.uint32(s) for i, s in enumerate(shifts)).astype(np.int64)
        n = len(data) - RECORD_HEAD + 1
        sec, fraction, captured, original = (word[4 * i:4 * i + n] for i in range(4))
        plausible = ((np.abs(sec - start) <= SPAN_S) & (fraction < 1_000_000 * self.per_us)
                     & (captured <= self.most) & (captured <= original))
        for first in np.flatnonzero(plausible[:most]).tolist():
            at = first
            for _ in range(CHAIN):
                at += RECORD_HEAD + int(captured[at])
                if at >= n or not plausible[at]:
                    break
            # Plausible to the end of what is seen; the last record must end where the file does.
            if at == len(data) or (at < n and plausible[at]) or (at >= n and not whole):
                return first
        return None

    def count(self, entry: int | None, end: int, sure: bool) -> tuple[int | None, int | None, int | None]:
        """entry, exit and number of records of a walk; all None if it stopped."""
        if entry is None:
            return None, None, None
        records, came_out = 0, None
        for data, at, places in self.walk(entry, end, sure):
            records += len(places)
            if not data:
                came_out = at
        return (entry, came_out, records) if came_out is not None else (None, None, None)

    def records(self, entry: int, end: int, first_no: int) -> Iterator[pa.RecordBatch]:
        """The records that begin in entry..end, numbered from `first_no`."""
        schema, head = _arrow(RECORD_SCHEMA), np.dtype(np.uint32).newbyteorder(self.order)
        for data, _, places in self.walk(entry, end):
            if not places:
                continue
            heads = np.array([np.frombuffer(data, head, 3, place) for place in places]).astype(np.int64)
            frames = [data[p + RECORD_HEAD:p + RECORD_HEAD + min(c, HEADER_BYTES)]
                      for p, c in zip(places, heads[:, 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.path] * len(places)), pa.array(np.arange(first_no, first_no + len(places))), pa.array(heads[:, 0]),
                 pa.array(heads[:, 1] // self.per_us), pa.array(frames, pa.binary())], schema=schema)
            first_no += len(places)


def capture_ranges(spark: SparkSession, glob: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of all files matching `glob`: path, file_no (in the order of paths), size, k, begin, end."""
    if range_bytes <= FILE_HEAD:
        raise ValueError(f"a range has more than {FILE_HEAD} bytes")
    listed = spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"))
    numbered = with_global_position(listed, ["path"], "file_no")
    last = F.expr(f"greatest(size - 1, 0) div {range_bytes}")
    ranges = numbered.select("path", "file_no", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    return store(ranges.selectExpr("path", "file_no", "size", "k", f"k * {range_bytes} AS begin",
                                   f"least((k + 1) * {range_bytes}, size) AS end"), "ranges")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges over tasks, about one per RANGE_BYTES. The number is given, as rows that are small stand
    for much to read."""
    rows, size = ranges.agg(F.count("*"), F.sum(F.col("end") - F.col("begin"))).first()
    tasks = max(min(rows, ranges.sparkSession.sparkContext.defaultParallelism), (size or 0) // RANGE_BYTES)
    return ranges.repartition(max(1, min(tasks, MAX_TASKS)), "file_no", "k")


def _walked(known: str | None):
    """Walk each range, from the place in column `known`, or else from a plausible one."""
    def walk(batches) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_WALKED)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                capture = _Capture.open(row["path"])
                sure = row["k"] == 0
                entry = FILE_HEAD if sure else row[known] if known else capture.boundary(row["begin"], row["end"])
                row["entry"], row["exit"], row["records"] = capture.count(entry, row["end"], sure)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return walk


def _in_one_go(batches) -> Iterator[pa.RecordBatch]:
    """All ranges of a file from a known record on, one after another."""
    schema = _arrow(_WALKED)
    for batch in batches:
        for row in batch.to_pylist():
            capture, entry, out = _Capture.open(row["path"]), row["known"], []
            for k in range(row["k"], -(-row["size"] // row["step"])):
                end = min((k + 1) * row["step"], row["size"])
                entry, came_out, records = capture.count(entry, end, True)
                out.append({**row, "k": k, "begin": k * row["step"], "end": end, "entry": entry, "exit": came_out, "records": records})
                entry = came_out
            yield pa.RecordBatch.from_pylist([{name: r[name] for name in schema.names} for r in out], schema)


def stitched_ranges(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges with entry (their first record's place) and first_no (its number in the file). Runs jobs."""
    along = Window.partitionBy("file_no").orderBy("k")
    state = store(_dealt(ranges).mapInArrow(_walked(None), _WALKED), "walked")
    before = F.lag("exit").over(along)
    is_known = F.coalesce(F.col("known") == F.col("entry"), F.lit(False)) | (F.col("k") == 0)
    for turn in range(ROUNDS + 1):
        checked = state.withColumn("known", before)
        doubtful = store(checked.filter(~is_known), "doubtful")
        if doubtful.isEmpty():
            break
        if turn == ROUNDS:
            first = doubtful.groupBy("file_no").agg(F.min("k").alias("k"))
            rest = doubtful.join(first, ["file_no", "k"]).withColumn("step", F.lit(range_bytes).cast("bigint"))
            again = store(_dealt(rest).mapInArrow(_in_one_go, _WALKED), "walked")
            early = state.join(first.withColumnRenamed("k", "from"), "file_no", "left").filter("from IS NULL OR k < from").drop("from")
            state = early.select(*again.columns).unionByName(again)
            break
        again = _dealt(doubtful.filter("known IS NOT NULL").select(*ranges.columns, "known"))
        again = again.mapInArrow(_walked("known"), _WALKED)
        kept = checked.filter(is_known | F.col("known").isNull()).select(*again.columns)
        state = store(kept.unionByName(again), "walked")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    return state.withColumn("first_no", F.coalesce(F.sum("records").over(earlier), F.lit(0)))


def _cut_ranges(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from _with_file(_Capture.open(row["path"]).records(row["entry"], row["end"], row["first_no"]), row["file_no"])


def _with_file(records: Iterator[pa.RecordBatch], file_no: int) -> Iterator[pa.RecordBatch]:
    for batch in records:
        numbers = pa.array(np.full(batch.num_rows, file_no, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "file_no"])


def _packets(records: DataFrame) -> DataFrame:
    stamped = records.select(
        F.shiftleft("file_no", _RECORD_BITS).bitwiseOR(F.col("rec_no")).alias("pkt_id"),
        ts_from_pcap("sec", "usec").alias("ts_us"), "frame")
    return decode_frames(stamped).select("pkt_id", *PACKET_COLUMNS)


def read_records_pcap(spark: SparkSession, glob: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the capture files matching `glob`: path, rec_no, sec, usec, frame (its first bytes), file_no.

    Files of any size; those without records give no rows. A file that is no Ethernet capture, or ends
    inside a record, fails the query. Runs jobs that read the files once; the result reads them again.
    """
    found = store(stitched_ranges(capture_ranges(spark, glob, range_bytes), range_bytes).filter("records > 0"), "stitched")
    return _dealt(found).mapInArrow(_cut_ranges, f"{RECORD_SCHEMA}, file_no bigint")


def read_packets_pcap(spark: SparkSession, glob: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """TCP packets of all capture files matching `glob`, as `read_records_pcap` reads them.

    `pkt_id` is the number of the file, in the order of paths, and of the record in it: files of the
    same names in the same folder give the same ids, whatever the ranges.
    """
    return _packets(read_records_pcap(spark, glob, range_bytes))


def _cut_content(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # contents are read where they lie, not copied
            path, content, file_no = (batch.column(c)[at] for c in ("path", "content", "file_no"))
            capture = _Capture(path.as_py(), pa.BufferReader(content.as_buffer()))
            yield from _with_file(capture.records(FILE_HEAD, capture.size, 0), file_no.as_py())


def packets_from_captures(captures: DataFrame) -> DataFrame:
    """TCP packets of captures that are rows (`path`, `content`), each cut by one task. Runs a job."""
    numbered = with_global_position(captures.select("path", "content"), ["path"], "file_no")
    return _packets(numbered.mapInArrow(_cut_content, f"{RECORD_SCHEMA}, file_no bigint"))


def to_tuple_dataset(packets: DataFrame, n: int = -1) -> DataFrame:
    """The packets of a capture: all of them for a negative `n`, else a preview of `n` rows."""
    return packets if n < 0 else packets.orderBy("ts_us", "pkt_id").limit(n)
