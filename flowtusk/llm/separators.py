"""Token counts of documents in flat token files, found by their separators alone.

The files are plain rows of little-endian ids without an index; a separator id ends each document.
Files are read in blocks, each by any task: one vectorised comparison gives a block's separators.
A scan over the blocks of a file, one row of five numbers each, then says how many separators came before
and where the last one was; joined back to the blocks this numbers the documents and completes those
that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, text_or_empty
from flowtusk.llm.tokens import rank_encoding
from flowtusk.plans.storage import store

#: Ids of a block.
BLOCK_IDS = 1 << 20
#: Bytes that a task reads of token files.
TASK_BYTES = 64 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, ranks: str, pattern: str, separator: int,
                      doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2") -> DataFrame:
    """Write the ids of every text, each followed by `separator`, as one flat file per task.

    `folder` must be shared by all executors. Returns where each document went: file, ordinal,
    doc_id. Null and empty texts are documents without ids. A task that runs again replaces its
    own file. Runs one job.
    """
    kind = docs.schema[doc_id].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks, pattern)
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        passing, ordinal = f"{root}/.{uuid.uuid4().hex}", 0
        with files.open_output_stream(passing) as out:
            for batch in arrow_slices(batches, "text"):
                for tokens in map(encoding.encode_ordinary, batch.column("text").to_pylist()):
                    out.write(np.array([*tokens, separator], dtype=dtype).tobytes())
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * rows), pa.array(range(ordinal, ordinal + rows), pa.int64()),
                     batch.column("doc_id")], ["file", "ordinal", "doc_id"])
                ordinal += rows
        if ordinal:
            files.move(passing, f"{root}/{name}")
        else:
            files.delete_file(passing)

    named = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return store(named.mapInArrow(write, f"file string, ordinal bigint, doc_id {kind.simpleString()}"), "documents")


def token_blocks(spark: SparkSession, folder: str, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of all files in `folder`: path, block, begin (an id's place in the file), ids.
    Only names and sizes are read here."""
    width = np.dtype(dtype).itemsize
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
              .select("path", F.expr(f"length div {width}").alias("total")).filter("total > 0"))
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(total - 1) div {block_ids}"))).alias("block")
    return (listed.select("path", "total", block)
            .selectExpr("path", "block", f"block * {block_ids} AS begin",
                        f"least({block_ids}, total - block * {block_ids}) AS ids")
            .repartition(_tasks(listed, width), "path", "block"))


def _tasks(listed: DataFrame, width: int) -> int:
    """How many tasks read the files: given as a number, as rows that are small stand for much to read."""
    total = listed.agg(F.sum("total")).first()[0] or 0
    return max(listed.sparkSession.sparkContext.defaultParallelism, min(total * width // TASK_BYTES, 10_000))


def scan_separators(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """Add `ends`, the places of the separators of each block."""
    width = np.dtype(dtype).itemsize

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                files, path = _open(row.path)
                with files.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(row.ids * width, row.begin * width), dtype=dtype)
                if len(ids) != row.ids:
                    raise OSError(f"{row.path} became shorter while it was read")
                yield pd.DataFrame([(*row, np.flatnonzero(ids == separator) + row.begin)],
                                   columns=[*frame.columns, "ends"])

    schema = "path string, block bigint, begin bigint, ids bigint, ends array<bigint>"
    return blocks.mapInPandas(scan, schema)


def documents_of(scanned: DataFrame) -> DataFrame:
    """Stitch the blocks: path, ordinal, start, n_tokens, ended; one row per document.

    Ids after the last separator of a file are a document that is not `ended`. A file that begins
    with a separator, or has two in a row, has empty documents. No files give no rows.
    """
    along = Window.partitionBy("path").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    slim = scanned.select("path", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last_end"))
    slim = slim.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("earlier"),
                       F.coalesce(F.last("last_end", True).over(before) + 1, F.lit(0).cast("bigint")).alias("start"),
                       F.lead("block").over(along).isNull().alias("final"))
    stitched = scanned.join(slim, ["path", "block"])
    # The starts of a block's documents: the stitched one, then after each separator but the last.
    starts = F.concat(F.array("start"), F.transform("ends", lambda end: end + 1))
    rows = stitched.select("path", "earlier", "final", F.col("begin") + F.col("ids"), "ends", starts.alias("starts"))
    rows = rows.toDF("path", "earlier", "final", "until", "ends", "starts")
    ended = rows.select("path", "earlier", F.posexplode(F.arrays_zip(
        F.slice("starts", F.lit(1), F.size("ends")).alias("start"), F.col("ends").alias("end"))).alias("at", "d"))
    ended = ended.select("path", (F.col("earlier") + F.col("at")).alias("ordinal"), "d.start",
                         (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    start = F.element_at("starts", -1)
    open_ = rows.filter(F.col("final") & (start < F.col("until"))).select(
        "path", (F.col("earlier") + F.size("ends")).alias("ordinal"), start.alias("start"),
        (F.col("until") - start).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_)


def count_tokens(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2",
                 block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token counts of all documents in the flat files of `folder` (see `documents_of`)."""
    scanned = store(scan_separators(token_blocks(spark, folder, dtype, block_ids), separator, dtype), "separators")
    return documents_of(scanned)
