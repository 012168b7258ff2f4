"""Near-duplicate vectors by p-stable hashing, checked by exact cosine.

Unit vectors are projected on random directions and the projections quantised; the steps of K
projections together are a bucket. Vectors at a cosine of the threshold fall into the same step
with a known probability, so the number of tables for a wanted recall follows; K follows from the
number of vectors with a label, so that buckets of unrelated vectors stay small at any size.

Into the buckets go slim rows: an id and a sketch of signs. Only vectors whose sketch is near that
of another in the bucket come with their numbers and are compared exactly, in double precision.
A pair counts in the first bucket where both come, which needs no list of pairs: a vector's links
are counted per bucket and added.

Large buckets are cut into blocks, and pairs of blocks are compared by any task. No pair leaves a
task: only each vector's count and one link per vector, enough to connect what belongs together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.llm.common import sorted_runs, whole_runs
from flowtusk.llm.graph import components, connected
from flowtusk.plans.storage import store

THRESHOLD = 0.93
#: Least chance that a pair at the threshold shares a bucket, and steps of quantisation to choose from.
RECALL = 0.9999
STEPS = tuple(x / 10 for x in range(10, 31))
#: Unrelated vectors that a bucket may hold on average.
CROWD = 512.0
#: Signs of a sketch (64 a word), and the chance that those of a pair at the threshold differ in too many.
WORDS, SKETCH_LOSS = 3, 1e-6
#: Vectors compared at once; sketches compared at once; the share of vectors that large buckets show in.
BLOCK, SLIM_BLOCK, SAMPLE = 1024, 4096, 16
#: Large buckets that may be broadcast.
BROADCAST_PLACES = 1_000_000


def collision(distance: float, step: float) -> float:
    """Chance that vectors at this distance fall into the same step of one projection."""
    r = step / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(count: int, threshold: float = THRESHOLD) -> tuple[int, int, float]:
    """Projections of a bucket, number of tables and step for `count` vectors of a label: of all
    steps the one with fewest tables."""
    def tables(step: float) -> tuple[int, int, float]:
        near, far = collision(math.sqrt(2 - 2 * threshold), step), collision(math.sqrt(2), step)
        size = max(1, math.ceil(math.log(max(count, 1) / CROWD + 1) / -math.log(far)))
        return math.ceil(math.log(1 - RECALL) / math.log(1 - near ** size)), size, step

    number, size, step = min(map(tables, STEPS))
    return size, number, step


def sketch_limit(threshold: float = THRESHOLD) -> int:
    """Signs in which two sketches may differ: a pair at the threshold exceeds it with a chance of `SKETCH_LOSS`."""
    bits, turn = 64 * WORDS, math.acos(threshold) / math.pi
    beyond = 0.0
    for limit in range(bits, 0, -1):
        beyond += math.comb(bits, limit) * turn ** limit * (1 - turn) ** (bits - limit)
        if beyond > SKETCH_LOSS:
            return limit
    return 0


def usable_vectors(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, digest (128 bits), vector (as bytes) of the rows that can link at all."""
    values = F.col(vector)
    usable = (F.col(vec_id).isNotNull() & F.col(label).isNotNull() & values.isNotNull() & (F.size(values) > 0)
              & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
              & F.exists(values, lambda v: v != 0))
    width = _width(dict(table.dtypes)[vector])
    numbers = values if width == "<f4" else values.cast("array<double>")
    named = table.filter(usable).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), numbers.alias("vector"))
    kinds = dict(named.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("vector")
            raw = cells.flatten().to_numpy(zero_copy_only=False).astype(width).tobytes()
            ends = np.cumsum(pc.list_value_length(cells).to_numpy()) * np.dtype(width).itemsize
            rows = [raw[begin:end] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]
            digests = [hashlib.blake2b(row, digest_size=16).digest() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())],
                names=["vec_id", "label", "digest", "vector"])

    return named.mapInArrow(pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, digest binary, vector binary")


def _width(kind: str) -> str:
    return "<f4" if kind == "array<float>" else "<f8"


def _units(vectors: pd.Series, width: str) -> np.ndarray:
    """Unit vectors in double precision."""
    matrix = np.frombuffer(b"".join(vectors), dtype=width).reshape(len(vectors), -1).astype(np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # no overflow, whatever the size
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def signatures(units: np.ndarray, size: int, tables: int, step: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's bucket in each table, and its sketch; directions are the same on every machine."""
    count, dimensions = units.shape
    random = np.random.default_rng([seed, dimensions])
    lines, shifts = random.normal(size=(dimensions, tables * size)), random.uniform(0, step, tables * size)
    mix = np.random.default_rng(17).integers(1, 2 ** 62, size=size, dtype=np.int64) | 1
    steps = np.floor((units @ lines + shifts) / step).astype(np.int64)
    keys = (steps.reshape(count, tables, size) * mix).sum(axis=2)
    keys = (keys ^ (keys >> 29)) * 0x2545F4914F6CDD1D + dimensions
    planes = np.random.default_rng([seed + 1, dimensions]).normal(size=(dimensions, 64 * WORDS))
    return keys, np.packbits(units @ planes > 0, axis=1).view(np.int64)


_SKETCH = [f"sketch{i}" for i in range(WORDS)]


def _keyed(nodes: DataFrame, width: str, size: int, tables: int, step: float) -> DataFrame:
    """Add `keys`, the vector's bucket in each table, and its sketch."""
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby(frame["vector"].str.len()):
                for begin in range(0, len(same), BLOCK):
                    part = same.iloc[begin:begin + BLOCK]
                    keys, sketch = signatures(_units(part["vector"], width), size, tables, step)
                    yield part.assign(keys=list(keys), **dict(zip(_SKETCH, sketch.T, strict=True)))

    schema = ", ".join(f"{n} {t}" for n, t in nodes.dtypes) + ", keys array<bigint>, " + ", ".join(f"{n} bigint" for n in _SKETCH)
    return nodes.mapInPandas(hashed, schema)


def near_sketches(edges: np.ndarray, sketch: np.ndarray, limit: int, short: int = 64) -> np.ndarray:
    """Rows with another row of their run whose sketch differs in at most `limit` signs. Runs lie
    between `edges`; short ones are compared all at once, row i with row i + d for each d."""
    words, sizes = np.ascontiguousarray(sketch.T).view(np.uint64), np.diff(edges)
    near = np.zeros(sketch.shape[0], dtype=bool)
    for begin, end in zip(edges[:-1][sizes > short], edges[1:][sizes > short], strict=True):
        for top in range(begin, end, 256):
            own = np.arange(top, min(top + 256, end))
            apart = sum(np.bitwise_count(w[own, None] ^ w[None, top:end]) for w in words)
            found = apart <= limit
            found[np.arange(len(own)), np.arange(len(own))] = False
            near[own] |= found.any(axis=1)
            near[top:end] |= found.any(axis=0)
    stops = np.repeat(np.where(sizes > short, edges[:-1], edges[1:]), sizes)
    rows = np.arange(len(near))
    for shift in range(1, short):
        rows = rows[rows + shift < stops[rows]]
        if not len(rows):
            break
        hits = rows[sum(np.bitwise_count(w[rows] ^ w[rows + shift]) for w in words) <= limit]
        near[hits] = near[hits + shift] = True
    return near


def _met(rows: DataFrame, limit: int) -> DataFrame:
    """Of sorted runs of (place, pair): the rows that have a near sketch beside them."""
    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, edges in whole_runs(frames, ["place", "pair"]):
            near = near_sketches(edges, frame[_SKETCH].to_numpy(), limit)
            if near.any():
                yield frame.loc[near, ["node", "place"]]

    return rows.mapInPandas(meet, f"node {dict(rows.dtypes)['node']}, place bigint")


def _in_blocks(rows: DataFrame, crowded: DataFrame, spread: str) -> DataFrame:
    """Add `part` and `pair`: rows of a crowded place are dealt into parts and copied to all pairs
    of parts that hold theirs. `crowded`: place, parts."""
    crowds = crowded.count()
    if not crowds:
        return rows.withColumns({"part": F.lit(0), "pair": F.lit(0).cast("bigint")})
    crowded = F.broadcast(crowded) if crowds <= BROADCAST_PLACES else crowded
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(crowded, "place", "left").withColumn("part", F.pmod(F.xxhash64(spread), parts).cast("int"))
    # A row of part p meets every part: in the pairs (p, q) and (q, p).
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    pair = F.shiftleft(F.least("part", "other").cast("bigint"), 31) + F.greatest("part", "other")
    return rows.withColumn("pair", pair).drop("other")


def _crowded(counts: DataFrame, block: int, factor: int = 1) -> DataFrame:
    """place, parts of the places with more than two blocks."""
    return store(counts.filter(F.col("count") * factor > 2 * block).select(
        "place", F.ceil(F.col("count") * factor / block).cast("int").alias("parts")), "crowded")


def _compare(threshold: float, width: str):
    """Link counts and connecting links of sorted runs of (place, pair, label)."""
    def linked(run: pd.DataFrame) -> pd.DataFrame | None:
        sizes = run["vector"].str.len()
        if sizes.nunique() > 1:  # vectors of other lengths may share a hash value
            found = [linked(run[sizes == size]) for size in sizes.unique()]
            found = [x for x in found if x is not None]
            return pd.concat(found) if found else None
        units = _units(run["vector"], width)
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        low, high = divmod(int(run["pair"].iloc[0]), 1 << 31)
        if low != high:  # two parts: only pairs across
            side = run["part"].to_numpy() == low
            near &= side[:, None] != side[None]
        if not near.any():
            return None
        roots, first = connected(near), near.copy()
        meets = run["meets"].to_numpy()
        places, owners = np.concatenate(meets), np.repeat(np.arange(len(run)), [len(m) for m in meets])
        earlier = np.flatnonzero(places < run["place"].iloc[0])
        earlier = earlier[np.argsort(places[earlier], kind="stable")]
        for both in np.split(owners[earlier], np.flatnonzero(np.diff(places[earlier])) + 1):
            if len(both) > 1:  # these came together before
                first[np.ix_(both, both)] = False
        nodes = run["node"].to_numpy()
        out = pd.DataFrame({"node": nodes, "root": nodes[roots], "n_links": first @ run["copies"].to_numpy()})
        return out[near.any(axis=1)]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, rows = [], 0
        for run in sorted_runs(frames, ["place", "pair", "label"]):
            found = linked(run) if len(run) > 1 else None
            if found is not None:
                out.append(found)
                rows += len(found)
            if rows > 10_000:
                yield pd.concat(out)
                out, rows = [], 0
        if out:
            yield pd.concat(out)

    return compare


def link_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of near-duplicate vectors: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and their cosine is at least `threshold`. Null ids
    or labels, and vectors that are null, empty, zero or hold null or non-finite numbers, link
    with nothing, nor do vectors of different length. Equal vectors of a label are compared once
    and counted with their number. Repeated rows of an id and vector are one vector; every row is
    in the result. No rows give no rows. Runs jobs.
    """
    ids = table.select(F.col(vec_id).alias("vec_id"))
    kind, width = dict(ids.dtypes)["vec_id"], _width(dict(table.dtypes)[vector])
    usable = usable_vectors(table, vec_id, vector, label)
    members = store(usable.select("vec_id", "label", "digest").dropDuplicates(), "members")
    equal = members.groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    largest = members.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    size, tables, step = plan(largest, threshold)
    nodes = usable.select("label", "digest", "vector").dropDuplicates(["label", "digest"]).join(equal, ["label", "digest"])
    keyed = store(_keyed(nodes.select("node", "label", "copies", "vector"), width, size, tables, step), "keyed")
    # A bucket's place: its table and 48 bits of its hash. Places that coincide merge two buckets.
    places = keyed.select("node", "label", *_SKETCH, F.posexplode("keys").alias("tab", "key"))
    place = F.shiftleft(F.col("tab").cast("bigint"), 48) + F.xxhash64("label", "key").bitwiseAND(F.lit((1 << 48) - 1))
    slim = places.select(place.alias("place"), "node", *_SKETCH)
    # Large buckets show in a sample; one that did not would only be compared in one task.
    sample = keyed.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLE)) == 0).select(
        "label", F.posexplode("keys").alias("tab", "key")).groupBy(place.alias("place")).count()
    slim = _in_blocks(slim, _crowded(sample, SLIM_BLOCK, SAMPLE), "node").select("place", "pair", "node", *_SKETCH)
    slim = slim.repartition("place", "pair").sortWithinPartitions("place", "pair")
    met = store(_met(slim, sketch_limit(threshold)), "met")
    meets = met.groupBy("node").agg(F.collect_set("place").alias("meets"))
    rows = (keyed.select("node", "label", "copies", "vector").join(meets, "node")
            .select("*", F.explode("meets").alias("place")))
    rows = _in_blocks(rows, _crowded(met.distinct().groupBy("place").count(), BLOCK), "node")
    order = ["place", "pair", "label"]
    rows = rows.select(*order, "part", "node", "copies", "vector", "meets").repartition(*order).sortWithinPartitions(*order)
    found = store(rows.mapInPandas(_compare(threshold, width), f"node {kind}, root {kind}, n_links bigint"), "found")
    joined = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    # Equal vectors also link with each other.
    linked = (members.join(equal, ["label", "digest"]).select("vec_id", "node", "copies")
              .join(totals, "node", "left").join(joined, "node", "left")
              .groupBy("vec_id").agg(F.sum(F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                     F.min(F.coalesce("component", "node")).alias("component_id")))
    result = ids.join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
