"""What the two text classifiers share: their sample, a small optimiser, scores as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Scores from here on count as label 1.
THRESHOLD = 0.3


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether a document's labels are kept from training."""
    column = doc_id if isinstance(doc_id, Column) else F.col(doc_id)
    return F.coalesce(F.crc32(column.cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, left_out: Column, per_class: int,
                    max_chars: int) -> tuple[list[str], np.ndarray]:
    """At most `per_class` texts of each label, of at most `max_chars` characters each.

    Rows are taken in the order of a hash of the id, so the sample is the same on every run. Only
    this bounded sample reaches the driver. Ids with null or contradicting labels are not used.
    """
    known = (labels.filter(~left_out).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
             .filter((F.col("low") == F.col("high")) & F.col("low").isin(0, 1)))
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("low") == y).select("doc_id", F.col("low").alias("y")).orderBy(order, "doc_id")
             .limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # At most 2 * per_class ids: small enough to send to every task.
    rows = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
            .orderBy(order, "doc_id").collect())
    return [row.text for row in rows], np.array([row.y for row in rows], dtype=np.float64)


class Adam:
    """Gradient steps with running moments, in place."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.steps = values, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in values.items()}
        self.second = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in gradients.items():
            a, b = self.first[k], self.second[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            scale = self.rate / (1 - 0.9 ** self.steps)
            self.values[k] -= scale * a / (np.sqrt(b / (1 - 0.99 ** self.steps)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_column(text: str | Column, model: dict, score: Callable[[dict, list[str]], np.ndarray], spark) -> Column:
    """A model's score of each text. The model has a fixed size, whatever the corpus."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(score(shared.value, batch.fillna("").tolist()), dtype=np.float64)

    return scored(text)
