"""Alignment of the tokens of two vocabularies, by merging their ends along merge paths.

Both token rows of a text cover the same bytes. Merging the ascending ends of all A tokens with those of
all B tokens is a path through a grid; diagonals at equal distances cut it into pieces of equal
work, and one binary search per diagonal finds where the path crosses it. Each piece then merges its own
few A and B ends independently: it emits the overlaps of its tokens with their group, counted from
the piece's beginning, and how many groups end inside. A running sum of these counts stitches the pieces:
a group that crosses a boundary is the open one of the piece before.

A group lies between byte places where an A and a B token both end. All A-B pairs of a group are
links. How many documents hold a pair of ids is counted per chunk of documents first; the totals come back to
each chunk for its own pairs only, so what travels is pairs of chunks and not of tokens, and no
task holds more than a chunk.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, text_or_empty
from flowtusk.llm.tokens import _byte_symbols
from flowtusk.plans.storage import store

#: Ends (of A and B together) of one piece of a merge.
PIECE = 4096
#: A chunk is closed at so many different pairs of ids.
CHUNK_PAIRS = 400_000
#: ... or at so many bytes of text, so that chunks are alike in size.
CHUNK_BYTES = 64_000_000
#: Groups with more links are counted by their distinct ids.
_LARGE = 64
#: Pairs of a chunk in one row.
_BLOCK = 8192


#: Fixed value: how byte-level vocabularies split texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A byte-level vocabulary of the tokenizers library: ids of texts, and each id's bytes.

    Its merges are in the order of the ids, so the rank encoder gives the same ids (tested) in
    less time; special tokens are plain text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special, symbols = {token["id"] for token in spec["added_tokens"]}, _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if rank not in special}
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.encoding = tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


class Pieces:
    """A sentencepiece vocabulary: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [(i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size())]
        self.bytes_of = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()
                         for i, name in names]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class _Pair:
    """Both vocabularies of a worker: how texts are encoded, and what each id stands for."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.coders = ByteBpe(byte_bpe), Pieces(pieces)
        self.sizes = [np.array([len(b) for b in coder.bytes_of], dtype=np.int64) for coder in self.coders]
        self.wide = len(self.sizes[1])  # a pair of ids is one number, a * wide + b
        # An id with what follows it in a list of groups: the next id, the other side, the next group.
        self.written = [[f"{i}{mark}".encode() for i in range(len(sizes)) for mark in (",", sides)]
                        for sizes, sides in zip(self.sizes, "|;", strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all texts by each vocabulary, in a row, and where each text's begin (one more
        than texts). Empty texts, and those that some ids do not spell, have none."""
        rows, counts = ([], []), ([], [])
        for text in texts:
            ids = []
            if text:
                whole = (" " + text).encode("utf-8", "replace")
                ids = [self.coders[0].encode(" " + text), self.coders[1].encode(text)]
                if any(b"".join(map(c.bytes_of.__getitem__, i)) != whole for c, i in zip(self.coders, ids, strict=True)):
                    ids = []
            for side in (0, 1):
                own = ids[side] if ids else []
                rows[side].append(np.array(own, dtype=np.int64))
                counts[side].append(len(own))
        return ([np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in rows],
                [np.concatenate([[0], np.cumsum(side, dtype=np.int64)]) for side in counts])


@functools.lru_cache(maxsize=2)
def _vocabularies(byte_bpe: str, pieces: str) -> _Pair:
    return _Pair(byte_bpe, pieces)


def crossings(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending rows crosses each diagonal: how many of `a` and of `b`
    come before. Equal values: that of `a` comes first."""
    total = len(a) + len(b)
    diagonal = np.r_[np.arange(0, total, piece), total]
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # One more of `a` is before the diagonal if it is not above the b that would be left out.
        left = a[np.minimum(middle, max(len(a) - 1, 0))] <= b[np.clip(diagonal - middle - 1, 0, max(len(b) - 1, 0))]
        low, high = np.where(open_ & left, middle + 1, low), np.where(open_ & ~left, middle, high)
    return low, diagonal - low


def merge_groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of two rows of strictly ascending ends, and how many groups there are."""
    a_group, b_group = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    i, j = crossings(a, b, piece)
    closed = 0
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        local_a, local_b, ended = _merge_piece(a, b, i0, i1, j0, j1)
        a_group[i0:i1], b_group[j0:j1] = local_a + closed, local_b + closed
        closed += ended
    return a_group, b_group, closed


def _merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups of the tokens of one piece, counted from its beginning, and how many end inside. A
    group ends with the b of a common end; its a may be the last of the piece before."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    # The a that equals an own b is own, or the last before the piece: a comes first among equals.
    before = max(i0 - 1, 0)
    place = np.searchsorted(a[before:i1], own_b)
    common = own_b[a[before:i1][np.minimum(place, i1 - before - 1)] == own_b] if i1 > before else own_b[:0]
    return np.searchsorted(common, own_a), np.searchsorted(common, own_b), len(common)


class _Aligned:
    """Both token rows of a slice of texts, merged into groups."""

    def __init__(self, pair: _Pair, texts: list[str], piece: int = PIECE):
        self.pair = pair
        self.ids, self.begins = pair.encode(texts)
        # The texts lie behind one another; each one's last byte ends a group, so that none goes beyond it.
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(pair.sizes, self.ids, strict=True)]
        *self.group, self.n = merge_groups(*ends, piece)
        self.members = [np.bincount(group, minlength=self.n) for group in self.group]
        # How many groups lie before each text.
        self.texts = np.concatenate([self.group[0], [self.n]])[self.begins[0]]
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.texts))

    def per_text(self, amounts: np.ndarray) -> np.ndarray:
        """Sums of whole numbers per group, for each text."""
        return np.diff(np.concatenate([[0], np.cumsum(amounts)])[self.texts])

    def written(self) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        (a, b), (ga, gb), (na, nb) = self.ids, self.group, self.members
        before = [np.cumsum(n) - n for n in (na, nb)]
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = (np.arange(len(g)) == (start + n)[g] - 1 for g, start, n in zip((ga, gb), before, (na, nb), strict=True))
        names = self.pair.written
        codes[np.arange(len(a)) + before[1][ga]] = 2 * a + last_a
        codes[np.arange(len(b)) + (before[0] + na)[gb]] = 2 * b + last_b + len(names[0])
        name, both = (names[0] + names[1]).__getitem__ if len(codes) else None, self.begins[0] + self.begins[1]
        return [b"".join(map(name, codes[i:j].tolist()))[:-1] if j > i else b"" for i, j in zip(both[:-1], both[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text and pair of ids, by text: text, pair, number of links."""
        (a, b), (ga, gb), (na, nb) = self.ids, self.group, self.members
        starts, links = np.cumsum(nb) - nb, na * nb
        usual = links <= _LARGE
        own = np.flatnonzero(usual[ga])
        many = nb[ga[own]]
        left = np.repeat(own, many)
        right = np.repeat(starts[ga[own]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        texts, keys, times = [self.owner[ga[left]]], [a[left] * self.pair.wide + b[right]], [np.ones(len(left), dtype=np.int64)]
        a_starts = np.cumsum(na) - na
        for g in np.flatnonzero(~usual):
            x, times_x = np.unique(a[a_starts[g]:a_starts[g] + na[g]], return_counts=True)
            y, times_y = np.unique(b[starts[g]:starts[g] + nb[g]], return_counts=True)
            keys.append((x[:, None] * self.pair.wide + y[None]).ravel())
            times.append((times_x[:, None] * times_y[None]).ravel())
            texts.append(np.full(len(keys[-1]), self.owner[g]))
        text, key, times = (np.concatenate(parts) for parts in (texts, keys, times))
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        heads = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])][:len(key)])
        return text[heads], key[heads], np.add.reduceat(times[order], heads) if len(heads) else times


class _Chunk:
    """The different pairs of a chunk of documents, numbered in the order of their first slice, and how many documents have each."""

    def __init__(self):
        self.keys = self.numbers = np.zeros(0, dtype=np.int64)  # by key
        self.counts, self.bytes = np.zeros(0, dtype=np.int64), 0  # by number

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pairs, each of which is one document's."""
        seen, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.keys, seen)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == seen if len(self.keys) else np.zeros(len(seen), dtype=bool)
        numbers = np.empty(len(seen), dtype=np.int64)
        numbers[known] = self.numbers[place[known]]
        numbers[~known] = len(self.counts) + np.arange(int((~known).sum()))
        self.keys = np.insert(self.keys, place[~known], seen[~known])
        self.numbers = np.insert(self.numbers, place[~known], numbers[~known])
        self.counts = np.concatenate([self.counts, np.zeros(int((~known).sum()), dtype=np.int64)])
        self.counts[numbers] += times
        return numbers[inverse]

    def blocks(self) -> Iterator[tuple[list[int], list[int]]]:
        """Pairs and counts in the order of the numbers."""
        keys = np.empty_like(self.keys)
        keys[self.numbers] = self.keys
        for begin in range(0, len(keys), _BLOCK):
            yield keys[begin:begin + _BLOCK], self.counts[begin:begin + _BLOCK]


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8" if values.max(initial=0) >= 1 << 31 else "<i4").tobytes(), 1)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, dtype="<i8" if n and len(raw) == 8 * n else "<i4")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_pairs"]


def token_groups(docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, groups (decimal ids as `a1,a2|b1;a3|b2,b3`; empty without tokens). Nulls and odd
    texts as in `align_tokenizers`."""
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))

    def write(batches) -> Iterator[pa.RecordBatch]:
        pair = _vocabularies(byte_bpe, pieces)
        for batch in arrow_slices(batches, "text", 1_000_000):
            written = _Aligned(pair, batch.column("text").to_pylist()).written()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(written, pa.binary()).cast(pa.string())], ["doc_id", "groups"])

    return frame.mapInArrow(write, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, groups string")


def _align(byte_bpe: str, pieces: str, chunk_pairs: int, chunk_bytes: int, kind: pa.DataType):
    """Rows of documents and, when a chunk is full, rows of its pairs."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", kind), *[(c, pa.int64()) for c in _COUNTS], ("sha", pa.string()),
                        ("pairs", pa.binary()), ("times", pa.binary()), ("block", pa.int32()), ("keys", longs), ("counts", longs)])

    def align(batches) -> Iterator[pa.RecordBatch]:
        pair, chunk, number = _vocabularies(byte_bpe, pieces), _Chunk(), TaskContext.get().partitionId() << 32

        def closed() -> Iterator[pa.RecordBatch]:
            for k, (keys, counts) in enumerate(chunk.blocks()):
                yield pa.RecordBatch.from_pylist([{"chunk": number, "block": k, "keys": keys, "counts": counts}], schema)

        for batch in arrow_slices(batches, "text", 1_000_000):
            aligned = _Aligned(pair, batch.column("text").to_pylist())
            text, key, times = aligned.pairs()
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            numbers = chunk.add(key)
            cut = lambda values: [_packed(values[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]  # noqa: E731, B023
            written = aligned.written()
            columns = {
                "chunk": np.full(batch.num_rows, number), "doc_id": batch.column("doc_id"),
                "n_a": np.diff(aligned.begins[0]), "n_b": np.diff(aligned.begins[1]), "n_groups": np.diff(aligned.texts),
                "n_links": aligned.per_text(aligned.members[0] * aligned.members[1]), "n_pairs": np.diff(cuts),
                "sha": [hashlib.sha256(w).hexdigest() if w else "" for w in written],
                "pairs": cut(numbers), "times": cut(times)}
            yield pa.RecordBatch.from_arrays([
                columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type)
                if f.name in columns else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)
            chunk.bytes += batch.column("text").nbytes
            if len(chunk.keys) >= chunk_pairs or chunk.bytes >= chunk_bytes:
                yield from closed()
                chunk, number = _Chunk(), number + 1
        yield from closed()

    return align


def _add_up(batches) -> Iterator[pa.RecordBatch]:
    """A chunk's answers come first: total and best by the number of the pair; then its documents."""
    current, parts, table = None, [], None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("chunk", "block", "totals", "n_pairs", "pairs", "times")]
        for i, (chunk, block, totals, n, pairs, times) in enumerate(zip(*columns, strict=True)):
            if chunk != current:
                current, parts, table = chunk, [], None
            if block >= 0:
                parts.append(np.array(totals, dtype=np.int64))
                continue
            if table is None:
                table = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
            # The best of an id are marked by a negative sign.
            of, links = table[_unpacked(pairs, n)], _unpacked(times, n)
            out.append((i, int(links[of < 0].sum()), int((np.abs(of) * links).sum())))
        rows = batch.take(pa.array([i for i, _, _ in out], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*[rows.column(c) for c in ("doc_id", *_COUNTS[:-1])], pa.array([b for _, b, _ in out], pa.int64()),
             pa.array([c for _, _, c in out], pa.int64()), rows.column("sha")],
            ["doc_id", *_COUNTS[:-1], "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text",
                     chunk_pairs: int = CHUNK_PAIRS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A space and the text are encoded by the byte-level vocabulary (A), the text by the pieces (B, which
    add the space), without special tokens. A pair's count is the number of rows of `docs` that hold it
    linked; `n_best` counts the links whose pair has the highest count of its A id (ties included),
    `count_sum` adds the counts of all links. Null and empty texts, and those that the tokens do not
    spell, have no tokens: zeros and an empty digest. Repeated rows count as documents of their own and
    are repeated; rows with a null id too. Other columns are not read. No rows give no rows. Runs jobs.
    """
    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    kind = frame.schema["doc_id"].dataType
    schema = (f"chunk bigint, doc_id {kind.simpleString()}, {', '.join(f'{c} bigint' for c in _COUNTS)}, sha string, pairs binary, "
              "times binary, block int, keys array<bigint>, counts array<bigint>")
    from pyspark.sql.pandas.types import to_arrow_type
    stored = store(frame.mapInArrow(_align(byte_bpe, pieces, chunk_pairs, chunk_bytes, to_arrow_type(kind)), schema), "aligned")
    wide = _vocabularies(byte_bpe, pieces).wide

    held = stored.filter("block IS NOT NULL").select("chunk", "block", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "own"))
    held = held.select("chunk", "block", "at", F.col("own.keys").alias("key"), F.col("own.counts").alias("n"))
    totals = held.groupBy("key").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as the other vocabulary has ids.
    best = F.max("n").over(Window.partitionBy(F.expr(f"key div {wide}")))
    totals = totals.select("key", F.when(F.col("n") == best, -F.col("n")).otherwise(F.col("n")).alias("total"))
    answers = (held.join(totals, "key").groupBy("chunk", "block")
               .agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("rows"))
               .select("chunk", "block", F.col("rows.total").alias("totals")))
    rows = answers.unionByName(stored.filter("block IS NULL").drop("keys", "counts").withColumn("block", F.lit(-1)), allowMissingColumns=True)
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", F.col("block") < 0, "block")
    return rows.mapInArrow(_add_up, f"doc_id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                           "n_best bigint, count_sum bigint, groups_sha256 string")
