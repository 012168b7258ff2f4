"""Quality classifier: a convolutional network over bytes, trained in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Filters run over every byte
position of a chunk and the maximum of each is kept; a small layer turns these into the chunk's
features. Mean and maximum over the chunks go into one logistic output. For scoring, the filters
are folded into two tables over pairs of bytes, so a position costs two look-ups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from flowtusk.llm import training
from flowtusk.llm.training import Adam, sigmoid

CHUNK, WIDTH = 256, 4
#: Neighbouring chunks share this many bytes.
OVERLAP = 32
DIMENSIONS, FILTERS, HIDDEN = 8, 24, 16
#: The sample: texts of each class, characters of a text.
PER_CLASS, MAX_CHARS = 1_200, 20_000
EPOCHS = 10
#: Of every so many texts of label 1 a beginning of so many characters is learned from as well.
CLIP_EVERY, CLIPPED = 6, (0, 120)
HELD_OUT = (5, 0)


def chunk_bytes(text: str) -> np.ndarray:
    """Rows of `CHUNK` bytes that cover the whole text; zeros fill the last. An empty text has one row."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros(count * step + OVERLAP, dtype=np.uint8)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def _taps(net: dict) -> list[np.ndarray]:
    """For each place in a filter: what each byte adds to each filter. The filling byte adds nothing."""
    taps = [(net["bytes"] @ net["filters"][j]).astype(np.float32) for j in range(WIDTH)]
    for tap in taps:
        tap[0] = 0
    return taps


def _pairs(taps: list[np.ndarray]) -> list[np.ndarray]:
    """The taps of two neighbouring bytes in one table of 65,536 rows."""
    return [(taps[j][:, None] + taps[j + 1][None]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]


def _responses(pairs: list[np.ndarray], chunks: np.ndarray) -> np.ndarray:
    codes = chunks[:, :-1].astype(np.int32) * 256 + chunks[:, 1:]
    values = pairs[0][codes[:, :CHUNK - WIDTH + 1]]
    values += pairs[1][codes[:, 2:]]
    return values


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> dict:
    """Fit the network; without texts of both labels every score is 0.5."""
    if len(set(y.tolist())) < 2:
        return {"empty": True}
    random = np.random.default_rng(seed)
    # Short texts are rare in a sample, so some of label 1 are also shown clipped.
    clipped = [texts[i][:int(random.integers(*CLIPPED))] for i in np.flatnonzero(y == 1)[::CLIP_EVERY]]
    texts, y = [*texts, *clipped], np.concatenate([y, np.ones(len(clipped))])
    net = {"bytes": random.normal(0, 1, (256, DIMENSIONS)), "filters": random.normal(0, 0.3, (WIDTH, DIMENSIONS, FILTERS)),
           "bias": np.zeros(FILTERS), "layer": random.normal(0, 0.3, (FILTERS, HIDDEN)), "inner": np.zeros(HIDDEN),
           "mean": random.normal(0, 0.1, HIDDEN), "peak": random.normal(0, 0.1, HIDDEN), "offset": np.zeros(1)}
    optimiser, weight = Adam(net, 0.01), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rows = [chunk_bytes(text) for text in texts]
    for _ in range(epochs):
        for batch in np.array_split(random.permutation(len(y)), max(1, len(y) // 48)):
            chunks = np.concatenate([rows[i] for i in batch])
            counts = np.array([len(rows[i]) for i in batch])
            starts = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(batch)), counts)
            values = _responses(_pairs(_taps(net)), chunks)
            at = values.argmax(axis=1)
            top = np.take_along_axis(values, at[:, None], axis=1)[:, 0] + net["bias"]
            pooled = np.maximum(top, 0)
            hidden = np.tanh(pooled @ net["layer"] + net["inner"])
            mean = np.add.reduceat(hidden, starts, axis=0) / counts[:, None]
            peak = np.maximum.reduceat(hidden, starts, axis=0)
            z = mean @ net["mean"] + peak @ net["peak"] + net["offset"][0]
            error = (sigmoid(z) - y[batch]) * weight[batch] / len(batch)
            at_peak = hidden == peak[owner]
            at_peak = at_peak / np.add.reduceat(at_peak, starts, axis=0)[owner]
            down = error[owner, None] * (net["mean"] / counts[owner, None] + net["peak"] * at_peak) * (1 - hidden ** 2)
            gradients = {"mean": error @ mean, "peak": error @ peak, "offset": np.array([error.sum()]),
                         "layer": pooled.T @ down, "inner": down.sum(axis=0)}
            flow = (down @ net["layer"].T) * (top > 0)
            gradients["bias"] = flow.sum(axis=0)
            gradients["bytes"], gradients["filters"] = np.zeros((256, DIMENSIONS)), np.empty_like(net["filters"])
            which = np.arange(len(chunks))[:, None]
            for j in range(WIDTH):
                seen = chunks[which, at + j].astype(np.int64)
                flows = np.where(seen > 0, flow, 0)
                by_byte = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), flows.ravel(), 256 * FILTERS)
                by_byte = by_byte.reshape(256, FILTERS)
                gradients["filters"][j] = net["bytes"].T @ by_byte
                gradients["bytes"] += by_byte @ net["filters"][j].T
            for k in ("bytes", "filters", "layer", "mean", "peak"):
                gradients[k] += 1e-4 * net[k]
            optimiser.step(gradients)
    return {"pairs": _pairs(_taps(net))} | {k: net[k].astype(np.float32) for k in ("bias", "layer", "inner", "mean", "peak")} | {
        "offset": float(net["offset"][0])}


def _chunk_features(model: dict, chunks: np.ndarray) -> np.ndarray:
    pooled = np.maximum(_responses(model["pairs"], chunks).max(axis=1) + model["bias"], 0)
    return np.tanh(pooled @ model["layer"] + model["inner"])


def score_texts(model: dict, texts: list[str], block: int = 512) -> np.ndarray:
    """Scores of whole texts; `block` chunks are held at a time, whatever their texts' length."""
    if model.get("empty"):
        return np.full(len(texts), 0.5)
    totals = np.zeros((len(texts), HIDDEN))
    peaks = np.full((len(texts), HIDDEN), -np.inf)
    counts = np.zeros(len(texts))
    held, owners, rows = [], [], 0

    def flush() -> None:
        hidden, sizes = _chunk_features(model, np.concatenate(held)), [len(h) for h in held]
        starts, who = np.cumsum(sizes) - sizes, np.array(owners)
        # A text's chunks of one flush are neighbours, so each text occurs once here.
        totals[who] += np.add.reduceat(hidden, starts, axis=0)
        peaks[who] = np.maximum(peaks[who], np.maximum.reduceat(hidden, starts, axis=0))
        counts[who] += sizes

    for i, text in enumerate(texts):
        chunks = chunk_bytes(text)
        for begin in range(0, len(chunks), block):
            part = chunks[begin:begin + block]
            if held and rows + len(part) > block:
                flush()
                held, owners, rows = [], [], 0
            held.append(part)
            owners.append(i)
            rows += len(part)
    if held:
        flush()
    z = (totals / counts[:, None]) @ model["mean"] + peaks @ model["peak"] + model["offset"]
    return sigmoid(z) if len(texts) else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> dict:
    """A model for labels.quality, learned from the rows of `labels` that are not held out. Without texts of
    both labels nothing is known: every text then scores 0.5, which counts as good, so that nothing is lost."""
    texts, y = training.labelled_sample(docs, labels, "quality", training.held_out("doc_id", *HELD_OUT), per_class, max_chars)
    return train(texts, y)


def quality(text: str | Column, model: dict, spark) -> Column:
    """The score of a text, from 0 to 1, higher for better. Null counts as empty."""
    return training.score_column(text, model, score_texts, spark)
