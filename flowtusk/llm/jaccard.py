"""Jaccard join on word n-grams: subsets of small sets, inverted lists of large ones.

Every text becomes its set of distinct n-grams; equal sets are one node. Sets up to a boundary
enumerate their subsets of the size that a partner must share, so that sharing a key proves a
link. Larger sets go into inverted lists, each under its rarest n-grams only: sets that link must
meet in one of them. The boundary is the size up to which enumeration makes fewer rows than lists
and checks would; it is taken from the table's own lists.

Rarity comes from a sketch of all n-grams of fixed size (any common order gives the same links).
A list is not paired with itself. First each member is checked against one member of its list;
what is found connects most of a group. After that only members outside a list's largest component
are compared, and only with other components: in short lists as pairs, in long ones in blocks, of
which no pair leaves the task but one link per member. A sketch of 128 bits per set rejects pairs
that merely share a passage (a linked pair with a chance of at most SKETCH_LOSS, for any threshold);
all others are decided by the sets themselves. So a group of copies, however large, costs rows in proportion to its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.llm.common import arrow_slices, sorted_runs, text_or_empty
from flowtusk.llm.graph import components, connected
from flowtusk.plans.storage import delete_path, store

WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
SKETCH_BITS = 22
#: Sets up to this size are kept whole, so that the boundary may lie anywhere below.
SMALL = 24
#: What a check of a pair costs, in rows of a list.
CHECK_COST = 4.0
#: Ids up to this number are sent to every task; more are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Rows of two to four numbers that are sent to every task to be joined; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A list with more members outside its largest component is compared in blocks of so many members.
SHORT, BLOCK = 32, 1024
#: Chance that the sketch rejects a pair just at the threshold.
SKETCH_LOSS = 1e-15
#: Bits of the wide sketch, by which candidate pairs are checked before whole sets travel.
WIDE = 1024
#: N-grams whose cell counts more than this may fill a list of so many sets; they are counted first.
HOT = 50_000
_SLABS = 64


def _sent(stored: DataFrame) -> DataFrame:
    """A stored table for a join: sent to every task if it is small enough, so that the other side stays where it is."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def ngram_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams: words between ASCII white space, A-Z in lower case.
    Fewer words than `words` are one n-gram; no words, none."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, text.encode("utf-8", "replace").lower().split()), dtype=np.uint64)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    count = len(hashes) - size + 1
    mixed = np.full(count, size, dtype=np.uint64)
    for j in range(size):
        mixed = (mixed ^ hashes[j:j + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class Threshold:
    """intersection / union >= numerator / denominator, in whole numbers."""

    def __init__(self, numerator: int, denominator: int):
        self.num, self.den = numerator, denominator

    def overlap(self, a, b):
        """Least overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        """How many of a set's first elements are enough to meet any linked set."""
        return n - (-(-self.num * n // self.den)) + 1

    def sizes(self, n: int) -> range:
        """Sizes of sets that may link with one of size n."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subsets(self, n: int) -> list[tuple[int, int, int]]:
        """For each partner size: smaller size, larger size, size of the shared subset."""
        return [(min(n, m), max(n, m), self.overlap(n, m)) for m in self.sizes(n) if m and self.overlap(n, m) <= min(n, m)]


def sketch_difference(limit: Threshold, size: int = 128) -> int | None:
    """Bits of a sketch of `size` bits in which linked sets may differ. None if that reaches half of them, the
    mean of sets that share nothing: then the sketch rejects no pair worth its loss."""
    chance, tail = (1 - limit.num / limit.den) / 2, 0.0  # of one bit, for sets just at the threshold
    if not chance:
        return 0
    for bits in range(size, -1, -1):
        tail += exp(lgamma(size + 1) - lgamma(bits + 1) - lgamma(size - bits + 1) + bits * log(chance) + (size - bits) * log(1 - chance))
        if tail > SKETCH_LOSS:
            return bits if bits < size // 2 else None
    return 0


def _rarity(docs: DataFrame, words: int) -> np.ndarray:
    """How often n-grams of each hash cell occur in all sets; 2 ** SKETCH_BITS cells at any size."""
    cells = 1 << SKETCH_BITS
    slab = cells // _SLABS

    # Low bytes first, then the others, nearly all zero: half the size of whole numbers in a row.
    def packed(counts: np.ndarray) -> bytes:
        return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()

    # Arrow batches: only a slice of a batch becomes Python texts at once.
    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint32)
        for batch in arrow_slices(batches, "text", 1_000_000):
            sets = [ngram_set(text, words) for text in batch.column("text").to_pylist()]
            seen, times = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            total[seen.astype(np.int64)] += times.astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLABS), pa.int32()), pa.array(
                [packed(part) for part in total.reshape(_SLABS, slab)], pa.binary())], ["slab", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(slab, dtype=np.int64)
        for counts in frame["counts"]:
            total += unpacked(counts)
        return pd.DataFrame({"slab": frame["slab"].iloc[:1], "counts": [packed(np.minimum(total, 2 ** 31 - 1))]})

    parts = docs.select("text").mapInArrow(count, "slab int, counts binary").withColumn("branch", F.expr("spark_partition_id() div 64"))
    sums = parts.groupBy("slab", "branch").applyInPandas(add, "slab int, counts binary")
    rows = sums.groupBy("slab").applyInPandas(add, "slab int, counts binary").collect()  # _SLABS rows of fixed size
    total = np.zeros((_SLABS, slab), dtype=np.int32)
    for row in rows:
        total[row["slab"]] = unpacked(row["counts"])
    return total.ravel()


def _sketch(hashes: np.ndarray, bits: int = 128) -> np.ndarray:
    """One bit for each of `bits` classes of n-grams: a bit of the class's smallest hash."""
    shift, classes = np.uint64(64 - bits.bit_length() + 1), np.arange(bits, dtype=np.uint64)
    first = np.searchsorted(hashes, classes << shift)
    least = hashes[np.minimum(first, len(hashes) - 1)] if len(hashes) else np.zeros(bits, dtype=np.uint64)
    own = (first < len(hashes)) & ((least >> shift) == classes)
    return np.packbits(np.where(own, (least >> np.uint64(3)) & np.uint64(1), 0).astype(np.uint8))


def _signatures(docs: DataFrame, kind: str, words: int, limit: Threshold) -> DataFrame:
    """Per document: n, a fingerprint of the set, its rarest n-grams (all of a small set), how many of
    these are in no hot cell, the sketch and the wide sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(_rarity(docs, words))

    # Arrow batches: in pandas a null id would turn the ids beside it into floats.
    def sign(batches) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in arrow_slices(batches, "text", 1_000_000):
            rows = []
            for text in batch.column("text").to_pylist():
                hashes = ngram_set(text, words)
                n = len(hashes)
                counts = rarity[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((hashes, counts))[:n if n <= SMALL else limit.prefix(n)]
                mark = xxhash.xxh3_128_digest(hashes.tobytes())
                rows.append((n, mark, hashes[order].view(np.int64), int((counts[order] <= HOT).sum()),
                             *_sketch(hashes).view("<i8").tolist(), _sketch(hashes, WIDE).tobytes()))
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             ["doc_id", "n", "mark", "first", "cold", "s1", "s2", "wide"])

    return store(docs.mapInArrow(
        sign, f"doc_id {kind}, n int, mark binary, first array<bigint>, cold int, s1 bigint, s2 bigint, wide binary"), "signatures")


def _boundary(sizes: dict[int, int], list_length: float, limit: Threshold) -> int:
    """Up to which set size subsets cost no more rows than lists and checks."""
    best, saved, total = 0, 0.0, 0.0
    for n in range(1, SMALL * limit.num // limit.den + 1):
        subsets = sum(comb(n, size) for _, _, size in limit.subsets(n))
        lists = limit.prefix(n) * (1 + CHECK_COST * list_length)
        total += sizes.get(n, 0) * (lists - subsets)
        if total >= saved:
            best, saved = n, total
    return best


def _small_links(sets: DataFrame, kind: str, boundary: int, limit: Threshold) -> DataFrame:
    """Links of pairs whose smaller set has at most `boundary` elements. Two sets that share a
    subset of the size that their sizes call for are linked, so each key links all smaller with
    all larger ones: a star to the least of the other side says the same."""
    def enumerate_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(node, n, low, high, xxhash.xxh3_128_digest(np.array(sorted(chosen), dtype=np.int64).tobytes()))
                    for node, n, first in zip(frame["node"], frame["n"], frame["first"], strict=True)
                    for low, high, size in limit.subsets(n) if low <= boundary
                    for chosen in combinations(first, size)]
            yield pd.DataFrame(rows, columns=["node", "n", "low", "high", "subset"])

    reach = limit.den * boundary // limit.num
    keys = sets.filter((F.col("n") > 0) & (F.col("n") <= reach)).select("node", "n", "first").mapInPandas(
        enumerate_, f"node {kind}, n int, low int, high int, subset binary")
    least = lambda size: F.min(F.when(F.col("n") == F.col(size), F.col("node")))
    key = ["low", "high", "subset"]
    heads = keys.groupBy(key).agg(least("low").alias("least_low"), least("high").alias("least_high"), F.count("*").alias("c"))
    rows = keys.join(heads.filter("c > 1"), key)
    other = F.when(F.col("n") == F.col("low"), F.col("least_high")).otherwise(F.col("least_low"))
    return rows.select(F.col("node").alias("a"), other.alias("b")).filter("b IS NOT NULL AND a <> b").distinct()


def _sizes_allow(limit: Threshold, a: str, b: str):
    small, large = F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")
    return limit.den * small >= limit.num * large


def _places_allow(limit: Threshold, a: str, b: str):
    """Whether two members of a list can link, by sizes and the n-gram's places in their orders."""
    rest = F.least(F.col(f"n{a}") - F.col(f"at{a}"), F.col(f"n{b}") - F.col(f"at{b}"))
    needed = F.ceil(limit.num * (F.col(f"n{a}") + F.col(f"n{b}")) / (limit.num + limit.den))
    return _sizes_allow(limit, a, b) & (rest >= needed)


def _may_link(limit: Threshold, a: str, b: str):
    """Whether two sets can link, by sizes and sketches."""
    possible, allowed = _sizes_allow(limit, a, b), sketch_difference(limit)
    if allowed is None:
        return possible
    differing = sum(F.bit_count(F.col(f"{s}{a}").bitwiseXOR(F.col(f"{s}{b}"))) for s in ("s1", "s2"))
    return possible & (differing <= allowed)


def drop_path(stored: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        delete_path(stored.sparkSession, path)


class _Checker:
    """Exact comparisons of sets, built again from the texts of those documents that need it."""

    def __init__(self, docs: DataFrame, kind: str, words: int, limit: Threshold, wide: DataFrame):
        """`wide` has the wide sketch of each node."""
        self.docs, self.kind, self.words, self.limit, self.wide = docs, kind, words, limit, wide

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, grams (bytes of the sorted set) of the given nodes."""
        words = self.words

        def build(batches) -> Iterator[pa.RecordBatch]:
            for batch in arrow_slices(batches, "text", 1_000_000):
                grams = [ngram_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grams, pa.binary())], ["node", "grams"])

        wanted = store(nodes, "nodes")
        few = wanted.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("node"), "left_semi")
        return store(texts.mapInArrow(build, f"node {self.kind}, grams binary"), "sets")

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose wide sketches differ in few enough bits."""
        allowed = sketch_difference(self.limit, WIDE)
        if allowed is None:
            return pairs

        def near(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8) for c in ("wide_a", "wide_b"))
                differing = np.unpackbits(a ^ b).reshape(-1, WIDE).sum(axis=1)
                yield batch.filter(pa.array(differing <= allowed)).select(["a", "b"])

        both = (pairs.join(self.wide.toDF("a", "wide_a"), "a").join(self.wide.toDF("b", "wide_b"), "b"))
        return both.select("a", "b", "wide_a", "wide_b").mapInArrow(near, f"a {self.kind}, b {self.kind}")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        limit = self.limit

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # The rows of a `b` are neighbours, its own set in the first of them. No id is null: in
            # pandas that would turn the ids beside it into floats.
            held, own = None, None
            for frame in frames:
                found = []
                for a, b, own_set, grams in zip(frame["a"], frame["b"], frame["own"], frame["grams"], strict=True):
                    if own_set:
                        held, own = b, np.frombuffer(grams, dtype=np.uint64)
                    elif b == held:
                        other = np.frombuffer(grams, dtype=np.uint64)
                        both = np.concatenate([own, other])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        if common >= limit.overlap(len(own), len(other)):
                            found.append((a, b))
                yield pd.DataFrame(found, columns=["a", "b"])

        pairs = store(self._likely(pairs), "pairs")
        # A node with very many partners is dealt over several tasks, with its own set in each. Where a set is needed
        # is settled before the sets are read, so that each goes there in one step.
        salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
        partners = pairs.join(salts, "b").select(
            F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("own"))
        own = salts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                           F.lit(True).alias("own"))
        routes = store(partners.unionByName(own), "routes")
        sets = self.sets(routes.select("node").distinct())
        rows = sets.join(_sent(routes), "node").withColumnRenamed("node", "a")
        rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("own"), "a")
        found = store(rows.select("a", "b", "own", "grams").mapInPandas(compare, f"a {self.kind}, b {self.kind}"), "checked")
        drop_path(routes)
        drop_path(sets)
        drop_path(pairs)
        return found

    def links_in_blocks(self, members: DataFrame) -> DataFrame:
        """Links that connect what links within long lists (major, node): one per member and block."""
        limit, key = self.limit, ["major", "low", "high"]

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for run in sorted_runs(frames, key):
                side = (run["part"] == run["low"]).to_numpy()
                across = run["low"].iloc[0] != run["high"].iloc[0]
                grams = [np.frombuffer(g, dtype=np.uint64) for g in run["grams"]]
                near = _near(grams, side, ~side if across else side, limit)
                roots, nodes = connected(near), run["node"].to_numpy()
                linked = roots != np.arange(len(roots))
                yield pd.DataFrame({"a": nodes[linked], "b": nodes[roots[linked]]})

        counts = members.groupBy("major").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        rows = members.join(counts, "major").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("major", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node")
        sets = self.sets(members.select("node").distinct())
        rows = rows.join(sets, "node").repartition(*key).sortWithinPartitions(*key)
        found = store(rows.mapInPandas(compare, f"a {self.kind}, b {self.kind}"), "blocks")
        drop_path(sets)
        return found


def _near(grams: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, limit: Threshold) -> np.ndarray:
    """Which sets link, as a symmetric matrix; only pairs of a set in `rows` and one in `columns`."""
    sizes = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(grams)), sizes)
    _, place, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    # An n-gram of one set adds to no overlap; the others are counted a slice of columns at a time.
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[place]
    shared = np.zeros((int(rows.sum()), int(columns.sum())), dtype=np.float32)
    for begin in range(0, int(column.max(initial=-1)) + 1, 2048):
        inside = (column >= begin) & (column < begin + 2048)
        dense = np.zeros((len(grams), 2048), dtype=np.float32)
        dense[owner[inside], column[inside] - begin] = 1
        shared += dense[rows] @ dense[columns].T
    common = shared.astype(np.int64)
    near = np.zeros((len(grams), len(grams)), dtype=bool)
    near[np.ix_(rows, columns)] = limit.den * common >= limit.num * (sizes[rows][:, None] + sizes[columns][None] - common)
    near |= near.T
    np.fill_diagonal(near, False)
    return near


def _list_links(lists: DataFrame, boundary: int, limit: Threshold, checker: _Checker, known: DataFrame, traits: DataFrame) -> DataFrame:
    """Links `known`, and those that connect all sets larger than the boundary that link.

    `lists` has its rows by gram, each with the list's head. What travels per list row is gram, node and component only; `traits` (node, n, s1, s2) are joined to
    pairs and to members once each is there once.
    """
    def with_traits(rows: DataFrame, node: str, suffix: str) -> DataFrame:
        return rows.join(traits.toDF(node, *[f"{c}{suffix}" for c in ("n", "s1", "s2")]), node)

    members = lists.filter(F.col("n") > boundary)
    pairs = members.filter((F.col("n_head") > boundary) & (F.col("node") != F.col("head")) & _places_allow(limit, "", "_head"))
    pairs = pairs.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    # The head is the `b` of its pairs, so that its set is held once for all of them.
    pairs = with_traits(with_traits(pairs, "a", "_a"), "b", "_b").filter(_may_link(limit, "_a", "_b"))
    first = checker.links(pairs.select("a", "b"))
    links = known.unionByName(first)

    labels = store(components(links), "labels")
    labelled = members.join(_sent(labels), "node", "left").select("gram", "node", F.coalesce("component", "node").alias("part"), "hot")
    # Of each list its largest component; lists of one component are done with. Short lists meet in one place.
    columns, gram = ["gram", "node", "part", "major"], Window.partitionBy("gram")
    cold = labelled.filter("NOT hot").drop("hot").repartition("gram")
    cold = cold.withColumn("c", F.count("*").over(Window.partitionBy("gram", "part")))
    cold = cold.select("gram", "node", "part", F.max(F.struct("c", "part")).over(gram)["part"].alias("major"),
                       F.min("part").over(gram).alias("low"), F.max("part").over(gram).alias("high"))
    cold = cold.filter("low <> high").select(*columns)
    hot = labelled.filter("hot")
    sizes = hot.groupBy("gram", "part").agg(F.count("*").alias("c"))
    major = sizes.groupBy("gram").agg(F.max_by("part", F.struct("c", "part")).alias("major"), F.count("*").alias("parts")).filter("parts > 1")
    several = cold.unionByName(hot.join(major, "gram").select(*columns))
    # The lists of a group of copies have the same largest component: they are one list from here
    # on, so that no pair is met, and no set sent, once for each n-gram that the copies share.
    merged = store(several.select("major", "node", "part").distinct(), "merged")
    apart = merged.groupBy("major").agg(F.count_if(F.col("part") != F.col("major")).alias("outside"))
    marked = store(merged.join(apart, "major"), "marked")
    drop_path(merged)
    drop_path(labels)
    short = with_traits(marked.filter(F.col("outside") <= SHORT), "node", "")
    columns = ["node", "n", "s1", "s2", "part"]
    outside = short.filter("part <> major").select("major", *[F.col(c).alias(f"{c}_a") for c in columns])
    others = short.select("major", *[F.col(c).alias(f"{c}_b") for c in columns])
    rest = outside.join(others, "major").filter(
        (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("major")) | (F.col("node_a") < F.col("node_b")))
        & _may_link(limit, "_a", "_b"))
    second = checker.links(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    long = checker.links_in_blocks(marked.filter(F.col("outside") > SHORT).select("major", "node"))
    drop_path(marked)
    return links.unionByName(second).unionByName(long)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                       numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles (set size), component_id (smallest id reachable by links).

    Two texts link if the share of common n-grams in all of theirs is at least numerator /
    denominator. Null or empty texts, and texts without words, have no n-grams and link with
    nothing; nor do rows with a null id, whose component is null. Repeated rows are repeated in
    the result. An id should have one text; one with several may link by any of them.
    Other columns are not read. No rows give no rows. Runs jobs.
    """
    limit = Threshold(numerator, denominator)
    named = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = dict(named.dtypes)["doc_id"]
    signatures = _signatures(named, kind, words, limit)
    usable = signatures.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())

    # Equal sets are one node: the smallest id of them.
    same = store(usable.groupBy("n", "mark").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("c"))
                 .filter("c > 1").drop("c"), "same")
    members = store(usable.select("doc_id", "n", "mark").join(same, ["n", "mark"])
                    .select("doc_id", "node").distinct(), "members")
    # A copy's rows in lists would only repeat those of its node; left in are ids of several texts, or whose node has several.
    mark = F.xxhash64("n", "mark")
    mixed = store(usable.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
                  .filter("low <> high").select("doc_id", F.lit(True).alias("mixed")), "mixed")
    moved = store(members.filter("doc_id <> node").join(mixed, "doc_id", "left").join(mixed.toDF("node", "mixed_node"), "node", "left")
                  .select("doc_id", "node", F.expr("mixed IS NULL AND mixed_node IS NULL").alias("copy")), "moved")
    listed = usable.join(_sent(moved), "doc_id", "left").filter("copy IS NULL OR NOT copy")

    # Inverted lists of the rarest n-grams, those of two documents at least, each with a head to check its members
    # against: a set above any boundary if there is one, else the largest. N-grams in no hot cell have short lists,
    # so their rows travel once, to be counted and kept in one place; hot ones are counted first.
    grams = listed.select(F.coalesce("node", "doc_id").alias("node"), "n", "cold", F.posexplode("first").alias("at", "gram")).filter(
        F.expr(f"at < n - ceil({limit.num} * n / {limit.den}) + 1"))
    columns = ["gram", "node", F.expr("shiftleft(cast(n AS bigint), 32) | at").alias("place")]
    size = F.shiftright("place", 32)
    head = F.min(F.struct(F.greatest(F.lit(0), SMALL + 1 - size).alias("small"), F.xxhash64("node").alias("h"), "node", "place"))
    gram = Window.partitionBy("gram")
    cold = grams.filter("at < cold").select(*columns).repartition("gram").withColumn("c", F.count("*").over(gram)).filter("c > 1")
    cold = cold.withColumn("p", head.over(gram)).withColumn("hot", F.lit(False)).distinct()
    hot = grams.filter("at >= cold").select(*columns)
    several = hot.groupBy("gram").agg(F.count("*").alias("c"), head.alias("p")).filter("c > 1")
    hot = hot.join(several, "gram").withColumn("hot", F.lit(True)).distinct()
    number, at = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    lists = store(cold.unionByName(hot).select(
        "gram", "node", number("place").alias("n"), at("place").alias("at"), F.col("p.node").alias("head"),
        number("p.place").alias("n_head"), at("p.place").alias("at_head"), "c", "hot"), "lists")
    traits = usable.select(F.col("doc_id").alias("node"), "n", "s1", "s2").dropDuplicates(["node"])
    wide = usable.select(F.col("doc_id").alias("node"), "wide").dropDuplicates(["node"])

    sizes = {r["n"]: r["c"] for r in usable.filter(F.col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    # How long the lists of small sets are, which enumeration would spare them.
    mean = lists.filter(F.col("n") <= SMALL).agg(F.avg("c")).first()[0]
    boundary = _boundary(sizes, float(mean or 1), limit)

    nodes = usable.join(_sent(moved), "doc_id", "left_anti").withColumnRenamed("doc_id", "node")
    small = store(_small_links(nodes, kind, boundary, limit), "small")
    checker = _Checker(named, kind, words, limit, wide)
    links = _list_links(lists, boundary, limit, checker, small, traits)
    drop_path(lists)
    joined = components(links)
    result = (signatures.select("doc_id", "n").join(members, "doc_id", "left").withColumn("node", F.coalesce("node", "doc_id"))
              .join(joined, "node", "left"))
    return result.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                         F.coalesce("component", "node").alias("component_id"))
