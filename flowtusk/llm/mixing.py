"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target of words. A document is taken as often as its source's target asks for as
a whole, and once more with the probability that is left over. Who is taken once more is decided by
the cube method: the vector of probabilities moves through the null-space of the constraints, which
keep the number of documents and of words, until a probability is 0 or 1. Three documents leave one
direction to move in, so only two of a group stay undecided. Groups of bounded size are worked on
in parallel; what stays undecided in up to LEAVES groups makes a group of the next round, until one
group per source is left. Its largest documents are kept back: with the two undecided ones they
make the landing problem, small enough to try all roundings for the words nearest to the target.

Every document's place follows from a hash of its id, so that a rerun takes the same documents
whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtusk.llm.common import ASCII_SPACE
from flowtusk.plans.ordering import with_global_position
from flowtusk.plans.storage import store

#: Share of all words to take, weights of the sources in turn, and how often a document may be taken.
SHARE, WEIGHTS, REPEATS = 1.5, (5, 2, 1), 2
#: Documents of a first group; groups whose undecided documents make one group of the next round.
GROUP, LEAVES = 4096, 1024
#: Documents of a source that are left for the landing, with two that flew; share of the words it may miss.
LANDING, TOLERANCE = 12, 0.0005
_NEAR = 1e-9
_SALTS = 32


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{ASCII_SPACE[1:]}+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS,
                   repeats: int = REPEATS) -> DataFrame:
    """Per source of (source, size): place (in the order of code points, null last), source_size,
    documents, target. Targets share `share` of all sizes by `weights`, which repeat in the order of the sources;
    a source gets at most `repeats` times its size, and what is above goes to the others by weight.
    Runs jobs."""
    totals = store(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "sources")
    nth = totals.withColumn("last", F.col("source").isNull().cast("int"))
    nth = with_global_position(nth, ["last", "source"], "place").drop("last")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = nth.withColumns({"weight": turn, "most": F.col("source_size") * float(repeats)})
    level = _level(weighed, share)
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return weighed.select("source", "place", "source_size", "documents", target.alias("target"))


def _level(sources: DataFrame, share: float) -> float | None:
    """The level at which all min(most, weight * level) add up to the share. None: every source is
    full. Each step reshares what is above the full sources, so the level only rises."""
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            return None
        above = (wanted - row[0]) / row[1]
        if above <= level:
            return level
        level = above


def fly(chances: Sequence[float], sizes: Sequence[float], draws: Sequence[float]) -> tuple[list[float], list[int]]:
    """Move the chances until two documents at most are undecided; returns the chances and the undecided.

    The sum of the chances and that of chances times sizes stay as they are. `draws` has a random number
    in 0..1 per document; of the two ways to move each is as likely as keeps every chance its mean.
    """
    chances, held = list(chances), []
    for i in range(len(chances)):
        held.append(i)
        while held:
            held = [k for k in held if _NEAR < chances[k] < 1 - _NEAR]
            if len(held) == 3:
                a, b, c = (sizes[k] for k in held)
                way = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
            elif len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
                way = (1, -1)
            else:
                break
            moves = [(k, v) for k, v in zip(held, way, strict=True) if v]
            up = min((1 - chances[k]) / v if v > 0 else chances[k] / -v for k, v in moves)
            down = min(chances[k] / v if v > 0 else (1 - chances[k]) / -v for k, v in moves)
            step = up if draws[i] * (up + down) < down else -down
            for k, v in moves:
                chances[k] += step * v
    return [0.0 if c <= _NEAR else 1.0 if c >= 1 - _NEAR else c for c in chances], held


def land(chances: Sequence[float], sizes: Sequence[float], undecided: Sequence[int]) -> list[float]:
    """Round the undecided chances: of all ways to do so the one whose words stay within TOLERANCE of
    the group's or else nearest, then with the number of documents nearest to the sum of the chances."""
    chances, undecided = np.array(chances), np.array(undecided, dtype=np.int64)
    sizes, count = np.array(sizes, dtype=float), len(undecided)
    taken = (np.arange(1 << count)[:, None] >> np.arange(count)) & 1
    words = np.abs(taken @ sizes[undecided] - (chances * sizes)[undecided].sum())
    documents = np.abs(taken.sum(axis=1) - chances[undecided].sum())
    best = np.lexsort((words, documents, np.maximum(words, TOLERANCE * (chances * sizes).sum())))[0]
    chances[undecided] = taken[best]
    return chances.tolist()


def _flight(final: bool, turn: int):
    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        sizes, chances = (table.column(name).to_pylist() for name in ("size", "chance"))
        key = [turn, table.column("place")[0].as_py(), table.column("heap")[0].as_py()]
        draws = np.random.default_rng(key).random(len(sizes)).tolist()
        # In a place's last group the largest documents do not fly, so that the landing can choose among them.
        last = set(sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))[:LANDING]) if final else set()
        order = [k for k in range(len(sizes)) if k not in last]
        moved, undecided = fly([chances[k] for k in order], [sizes[k] for k in order], [draws[k] for k in order])
        for k, chance in zip(order, moved, strict=True):
            chances[k] = chance
        if final:
            undecided = [order[k] for k in undecided] + [k for k in sorted(last) if _NEAR < chances[k] < 1 - _NEAR]
            chances = [float(round(c)) for c in land(chances, sizes, undecided)]
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64()))

    return group


def balanced_sample(rows: DataFrame, order: Sequence[str], group: int = GROUP, leaves: int = LEAVES) -> DataFrame:
    """The rows of (place, size, chance, ...) with `chance` 0 or 1: taken with the given chance, so that per
    place the number and the sizes of the rows taken stay at their expected sums, but for what the
    landing misses. `order` fixes the rows' order within a place. Runs jobs."""
    placed = with_global_position(rows, ["place", *order], "position")
    last = placed.agg(F.max("position")).first()[0] or 0
    turn, span, rounds = 0, group, []
    current = placed
    while True:
        final = last < span
        # In the last round a place is one group, wherever its rows lie.
        heap = F.lit(0).cast("bigint") if final else F.expr(f"position div {span}")
        grouped = current.withColumn("heap", heap)
        current = store(grouped.groupBy("place", "heap").applyInArrow(_flight(final, turn), grouped.schema), "flight").drop("heap")
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        rounds.append(current.filter(~undecided))
        if final:
            break
        current, turn, span = current.filter(undecided), turn + 1, span * leaves
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out.drop("position")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE,
                weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per row of `docs`: doc_id, size (words), source, source_size, documents, target, times, taken (times * size).

    Sources in the order of code points, null last as a source of its own, weigh `weights` in turn
    and share `share` of all words; a target stops at `repeats` times its source's words. Null and
    empty texts have size 0; they count as documents. Rows with a null id are mixed like others; of
    rows equal in id and size any may be taken, which the result cannot tell. A rerun takes the
    same. Other columns are not read. No rows give no rows. Runs jobs.
    """
    sizes = store(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                              n_words(F.col(f"`{text}`")).alias("size")), "sizes")
    targets = store(source_targets(sizes, share, weights, repeats), "targets")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    targets = targets.withColumn("ratio", ratio).withColumn("times", F.floor(F.col("ratio") + _NEAR))
    targets = targets.withColumn("chance", F.greatest(F.col("ratio") - F.col("times"), F.lit(0.0)))
    # A source may hold most documents: its target is there once per salt.
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    joined = (sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(_SALTS)).cast("int"))
              .join(salted.withColumnsRenamed({"source": "of", "salt": "copy"}),
                    F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")))
              .select("doc_id", "size", "source", "place", "source_size", "documents", "target", "times", "chance",
                      F.xxhash64("doc_id").alias("turn")))
    taken = balanced_sample(joined, ["turn", "doc_id", "size"])
    times = (F.col("times") + F.col("chance").cast("bigint")).alias("times")
    return taken.select("doc_id", "size", "source", "source_size", "documents", "target", times,
                        (times * F.col("size")).alias("taken"))
