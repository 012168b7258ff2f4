"""Byte-level BPE of whole texts, long ones in overlapping chunks, and back to bytes.

A text of more than `CHUNK` characters is cut into chunks; each also sees the next `OVERLAP`
characters. All chunks are split into pre-tokens independently. In the overlap of two neighbours
the splitting of the later chunk, which began anywhere, falls into step with that of the earlier:
the first position where both begin a pre-token. If white space begins there and none precedes,
it is a boundary in every context; otherwise it is one if the earlier chunk was in step itself.
The pieces between such positions are encoded independently. A chunk that is never in step (a
run of one kind of character) is joined to its predecessor and encoded with it as one piece. So
the ids are exact for every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, text_or_empty
from flowtusk.llm.tokens import rank_encoding
from flowtusk.plans.storage import store

CHUNK = 32_768
OVERLAP = 512


# Ids travel in Arrow batches: in pandas a null id would turn the ids beside it into floats.
def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns, after its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _cut(chunk: int, overlap: int):
    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            places = [(i, begin) for i, text in enumerate(texts) for begin in range(0, len(text), chunk)]
            which = pa.array([i for i, _ in places], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(which), batch.column("doc_id").take(which),
                 pa.array([begin // chunk for _, begin in places], pa.int32()),
                 pa.array([begin for _, begin in places], pa.int32()),
                 pa.array([texts[i][begin:begin + chunk + overlap] for i, begin in places], pa.string()),
                 pa.array([begin + chunk >= len(texts[i]) for i, begin in places], pa.bool_())],
                ["row", "doc_id", "chunk", "begin", "text", "last"])

    return cut


def _mark(pattern: str, chunk: int, overlap: int):
    """Pre-token starts in the overlap with the chunk before (heads) and with the next (tails);
    firm are those heads that are boundaries in every context."""
    def mark(batches) -> Iterator[pa.RecordBatch]:
        split, kind = regex.compile(pattern), pa.list_(pa.int32())
        for batch in arrow_slices(batches, "text"):
            heads, firm, tails = [], [], []
            for begin, text in zip(batch.column("begin").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = [m.start() for m in split.finditer(text)]
                inside = [s for s in starts if s < overlap]
                heads.append([s + begin for s in inside])
                firm.append([s + begin for s in inside if s and text[s] in " \n\t" and not text[s - 1].isspace()])
                tails.append([s + begin for s in starts if s >= chunk])
            yield _with(batch, heads=pa.array(heads, kind), firm=pa.array(firm, kind), tails=pa.array(tails, kind))

    return mark


def cut_pieces(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK,
               overlap: int = OVERLAP) -> DataFrame:
    """Pieces that can be encoded independently: row (one number per row of `docs`), doc_id,
    piece, single (the text has one piece only), text. Runs a job for the long texts."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                        text_or_empty(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    short = named.filter(F.length("text") <= chunk).select(
        "row", "doc_id", F.lit(0).alias("piece"), F.lit(True).alias("single"), "text")
    plain = f"row bigint, doc_id {kind}, chunk int, begin int, text string, last boolean"
    marked = (named.filter(F.length("text") > chunk).mapInArrow(_cut(chunk, overlap), plain)
              .repartition("row", "chunk")
              .mapInArrow(_mark(pattern, chunk, overlap), f"{plain}, heads array<int>, firm array<int>, tails array<int>"))
    chunks = store(marked, "chunks")

    in_text = Window.partitionBy("row").orderBy("chunk")
    so_far = in_text.rowsBetween(Window.unboundedPreceding, 0)
    common = lambda starts: F.array_min(F.array_intersect(starts, F.lag("tails").over(in_text)))
    steps = chunks.drop("text").withColumns({"firm_at": common("firm"), "loose_at": common("heads")})
    steps = steps.withColumn("misses", F.count_if((F.col("chunk") > 0) & F.col("loose_at").isNull()).over(so_far))
    # In step: everything since the last firm position (or the text's beginning) was.
    sure = F.last(F.when(F.col("firm_at").isNotNull() | (F.col("chunk") == 0), F.col("misses")), True).over(so_far)
    steps = steps.withColumn("begins", F.when(F.col("chunk") == 0, 0).otherwise(F.coalesce(
        "firm_at", F.when(sure == F.col("misses"), F.col("loose_at")))))
    steps = steps.withColumns({
        "piece": F.count("begins").over(so_far).cast("int") - 1,
        "own": F.coalesce("begins", "begin"),
        "until": F.when(F.col("last"), F.lit(None)).otherwise(
            F.coalesce(F.lead("begins").over(in_text), F.col("begin") + chunk))})
    parts = (chunks.select("row", "doc_id", "chunk", "begin", "text")
             .join(steps.select("row", "chunk", "piece", "own", "until"), ["row", "chunk"])
             .withColumn("text", F.expr("substring(text, own - begin + 1, coalesce(until, begin + length(text)) - own)")))
    long = (parts.groupBy("row", "piece").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
        .select("row", "doc_id", "piece", F.lit(False).alias("single"), F.array_join("parts.text", "").alias("text")))
    return short.unionByName(long)


def encode_pieces(pieces: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Replace `text` by `ids`, little-endian unsigned 32-bit integers."""
    def encode(batches) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks, pattern)
        for batch in arrow_slices(batches, "text", 1_000_000):
            ids = [np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes() for text in batch.column("text").to_pylist()]
            yield _with(batch.drop_columns(["text"]), ids=pa.array(ids, pa.binary()))

    return pieces.mapInArrow(encode, _schema(pieces, "text") + ", ids binary")


def decode_pieces(pieces: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Add `raw`, the bytes that the ids of a piece stand for."""
    def decode(batches) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks, pattern)
        for batch in arrow_slices(batches, "ids", 4_000_000):
            raw = [encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist()) for ids in batch.column("ids").to_pylist()]
            yield _with(batch, raw=pa.array(raw, pa.binary()))

    return pieces.mapInArrow(decode, _schema(pieces) + ", raw binary")


def _schema(df: DataFrame, *without: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes if name not in without)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                     chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of every text, one row per piece: row, doc_id, piece, single, ids.

    Null and empty texts have one piece without ids. Each row of `docs` is encoded, repeated or
    not; a null doc_id stays null; other columns are not read. No rows give no rows.
    """
    return encode_pieces(cut_pieces(docs, pattern, doc_id, text, chunk, overlap), ranks, pattern)


def _digests(docs: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays([docs, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digest_documents(pieces: DataFrame) -> DataFrame:
    """Per document of `decode_pieces`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The pieces of a long text come together in order and are hashed as they pass, so memory does
    not grow with the text.
    """
    kind_name = pieces.schema["doc_id"].dataType.simpleString()

    def digest(batches) -> Iterator[pa.RecordBatch]:
        row = doc = None
        count, ids_hash, raw_hash = 0, None, None
        for batch in batches:
            done, docs = [], batch.column("doc_id")
            columns = [batch.column(name).to_pylist() for name in ("row", "ids", "raw")]
            for i, (r, ids, raw) in enumerate(zip(*columns, strict=True)):
                if r != row:
                    if row is not None:
                        done.append((doc, count, ids_hash.hexdigest(), raw_hash.hexdigest()))
                    row, doc, count, ids_hash, raw_hash = r, docs[i], 0, hashlib.sha256(), hashlib.sha256()
                count += len(ids) // 4
                ids_hash.update(ids)
                raw_hash.update(raw)
            kind = docs.type
            yield _digests(pa.array([d[0].as_py() for d in done], kind), [d[1:] for d in done])
        if row is not None:
            yield _digests(pa.array([doc.as_py()], kind), [(count, ids_hash.hexdigest(), raw_hash.hexdigest())])

    result = f"doc_id {kind_name}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    gathered = pieces.filter(~F.col("single")).repartition("row").sortWithinPartitions("row", "piece")
    return pieces.filter("single").mapInArrow(digest, result).unionByName(gathered.mapInArrow(digest, result))


def digest_texts(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`digest_documents` of the encoded and decoded texts. A text of one piece is encoded, decoded
    and hashed in one task, so its ids never leave it; the pieces of longer ones come together."""
    pieces = cut_pieces(docs, pattern, doc_id, text, chunk, overlap)
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def whole(batches) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks, pattern)
        for batch in arrow_slices(batches, "text", 1_000_000):
            rows = []
            for source in batch.column("text").to_pylist():
                ids = encoding.encode_ordinary(source)
                rows.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                             hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()))
            yield _digests(batch.column("doc_id"), rows)

    result = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    long = encode_pieces(pieces.filter(~F.col("single")), ranks, pattern)
    return pieces.filter("single").mapInArrow(whole, result).unionByName(
        digest_documents(decode_pieces(long, ranks, pattern)))
