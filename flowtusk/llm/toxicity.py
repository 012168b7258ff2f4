"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word is embedded as the sum of three hashed vectors: of the word and of its first four and five
characters, so that inflected forms share what they begin with. Filters of widths 1, 2 and 3 run
over the whole text; the maximum of each over all positions goes into a logistic output. All
embeddings and filters start from random values and are learned from the sample.

A threshold is calibrated for each language, which is guessed from the text's own function words;
scores are shifted so that every language's threshold is the common one.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame

from flowtusk.llm import training
from flowtusk.llm.training import THRESHOLD, Adam, sigmoid

BUCKETS = 1 << 14
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMENSIONS = 6
#: The sample: texts of each class, and characters of a text.
PER_CLASS, MAX_CHARS = 2_000, 20_000
EPOCHS = 4
#: Least steps of 64 texts, for small samples; spread of the random start.
STEPS = 60
EMBEDDING_SPREAD, FILTER_SPREAD = 0.1, 0.3
HELD_OUT = (4, 2)

#: Function words that tell four languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it as was with be by on are this at or from".split(),
    "fr": "le les et est dans pour par sur avec des du une qui pas au ne que il elle aux".split(),
    "es": "el los las y del con por para una se su lo al es no como más pero sus la".split(),
    "de": "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch des".split(),
}

_PUNCTUATION = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()),
                               b" " * sum(not chr(c).isalnum() for c in range(128)))
_PARTS = 3
_FILTERS = FILTERS * len(WIDTHS)


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def _hashes(words: list[bytes], salt: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) * np.uint32(2 * salt + 1)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' parts, one row per word, texts one after another with empty words
    between; the texts' starts; whole-word hashes. Bucket 0 is the empty word."""
    rows, starts, at = [], np.empty(len(texts) + 1, dtype=np.int64), 0
    for i, text in enumerate(texts):
        starts[i] = at
        words = _words(text)
        rows += words
        rows += [b""] * (max(WIDTHS) - 1 or 1)
        at = len(rows)
    starts[-1] = at
    whole = _hashes(rows, 0)
    parts = np.empty((len(rows), _PARTS), dtype=np.int32)
    for k, hashes in enumerate((whole, _hashes([w[:4] for w in rows], 1), _hashes([w[:5] for w in rows], 2))):
        parts[:, k] = np.where(hashes == 0, 0, 1 + (hashes >> np.uint32(8)) % np.uint32(BUCKETS - 1))
    return parts, starts, whole


def _language_table() -> np.ndarray:
    """By the low 16 bits of a word's hash: 1 for each language that the word points to."""
    table = np.zeros((1 << 16, len(LANGUAGE_WORDS)), dtype=np.int8)
    for k, words in enumerate(LANGUAGE_WORDS.values()):
        for word in words:
            table[zlib.crc32(word.encode()) & 0xFFFF, k] = 1
    return table


def languages(whole: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The language with most function words, the first on a tie or without any."""
    hits = np.concatenate([np.zeros((1, table.shape[1]), dtype=np.int64),
                           np.cumsum(table[whole & np.uint32(0xFFFF)], axis=0, dtype=np.int64)])
    return np.argmax(hits[starts[1:]] - hits[starts[:-1]], axis=1)


def _tables(net: dict) -> np.ndarray:
    """What each bucket adds to each filter tap: parts x buckets x taps; the empty word adds nothing."""
    taps = np.concatenate([net["filters"][w][j] for w in WIDTHS for j in range(w)], axis=1)
    tables = np.einsum("kbd,dc->kbc", net["embeddings"], taps).astype(np.float32)
    tables[:, 0] = 0
    return tables


def _pooled(tables: np.ndarray, bias: np.ndarray, parts: np.ndarray, starts: np.ndarray, where: bool = False,
            block: int = 32_768):
    """Maximum of each filter over each text, never below 0, block by block; with `where`, also
    the position of each maximum (-1: none above 0)."""
    texts, reach = len(starts) - 1, max(WIDTHS) - 1
    best = np.zeros((texts, FILTERS * len(WIDTHS)), dtype=np.float32)
    place = np.full(best.shape, -1, dtype=np.int64)
    for begin in range(0, len(parts), block):
        some = parts[begin:begin + block + reach]
        taps = tables[0][some[:, 0]]
        for k in range(1, _PARTS):
            taps += tables[k][some[:, k]]
        rows = min(block, len(parts) - begin)
        taps = np.concatenate([taps, np.zeros((reach, taps.shape[1]), dtype=np.float32)])
        out, column = [], 0
        for w in WIDTHS:
            total = taps[:rows, column:column + FILTERS].copy()
            for j in range(1, w):
                total += taps[j:rows + j, column + j * FILTERS:column + (j + 1) * FILTERS]
            out.append(total)
            column += w * FILTERS
        values = np.concatenate(out, axis=1) + bias
        values[some[:rows, 0] == 0] = 0  # from an empty word on a filter would reach into the next text
        first = np.searchsorted(starts, begin, side="right") - 1
        last = np.searchsorted(starts, begin + rows, side="left")
        cuts = np.maximum(starts[first:last] - begin, 0)
        found = np.maximum.reduceat(values, cuts, axis=0)
        if where:
            for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], rows], strict=True)):
                at = values[a:b].argmax(axis=0)
                better = found[i] > best[first + i]
                place[first + i, better] = begin + a + at[better]
        best[first:last] = np.maximum(best[first:last], found)
    return (best, place) if where else best


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Fit the network and the thresholds; without texts of both labels every score is 0.5
    (`fit` makes it 0)."""
    if len(set(y.tolist())) < 2:
        return {"empty": True}
    random = np.random.default_rng(seed)
    parts, starts, whole = hashed_words(texts)
    embeddings = random.normal(0, EMBEDDING_SPREAD, (_PARTS, BUCKETS, DIMENSIONS))
    filters = {w: random.normal(0, FILTER_SPREAD, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    net = {"embeddings": embeddings, "filters": filters}
    # Of four filters three begin as signs of label 1, one as a sign against it.
    values = {"bias": np.full(_FILTERS, -0.1), "head": np.resize([0.5, 0.5, 0.5, -0.5], _FILTERS), "offset": np.full(1, -1.0)}
    values |= {"embeddings": embeddings} | {f"filter{w}": filters[w] for w in WIDTHS}
    optimiser, weight = Adam(values, 0.01), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    lengths = np.diff(starts)
    batches = max(1, len(y) // 64)
    for _ in range(max(epochs, -(-STEPS // batches))):
        order = random.permutation(len(y))
        for batch in np.array_split(order, batches):
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            own = np.concatenate([[0], np.cumsum(lengths[batch])])
            local = parts[rows]
            best, place = _pooled(_tables(net), values["bias"].astype(np.float32), local, own, where=True)
            error = (sigmoid(best @ values["head"] + values["offset"][0]) - y[batch]) * weight[batch] / len(batch)
            gradients = {"head": error @ best + 1e-4 * values["head"], "offset": np.array([error.sum()])}
            down = np.outer(error, values["head"]) * (place >= 0)
            gradients["bias"] = down.sum(axis=0)
            gradients["embeddings"] = 1e-6 * embeddings
            for i, w in enumerate(WIDTHS):
                text, filter_ = np.nonzero(down[:, i * FILTERS:(i + 1) * FILTERS])
                at, flow = place[text, i * FILTERS + filter_], down[text, i * FILTERS + filter_]
                grown = 1e-5 * filters[w]
                for j in range(w):
                    words = local[np.minimum(at + j, len(local) - 1)]
                    vectors = sum(embeddings[k][words[:, k]] for k in range(_PARTS))
                    np.add.at(grown[j].T, filter_, flow[:, None] * vectors)
                    back = flow[:, None] * filters[w][j].T[filter_]
                    for k in range(_PARTS):
                        np.add.at(gradients["embeddings"][k], words[:, k], back)
                gradients[f"filter{w}"] = grown
            gradients["embeddings"][:, 0] = 0
            optimiser.step(gradients)
    model = {"tables": _tables(net), "bias": values["bias"].astype(np.float32), "head": values["head"],
             "offset": float(values["offset"][0]), "languages": _language_table()}
    model["shifts"] = _calibrate(_logits(model, parts, starts), y, languages(whole, starts, model["languages"]))
    return model


def _logits(model: dict, parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _pooled(model["tables"], model["bias"], parts, starts) @ model["head"] + model["offset"]


def _calibrate(z: np.ndarray, y: np.ndarray, language: np.ndarray) -> np.ndarray:
    """For each language, what to add to a logit so that its best threshold becomes the common
    one: in the widest gap among the cuts with fewest errors on the sample. A language with few
    texts of a label takes the threshold over all."""
    def best_cut(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z)
        z, y = z[order], y[order]
        # A cut after i texts: errors are label 1 at or below it and label 0 above.
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
        fewest = np.flatnonzero(errors == errors.min())
        i = fewest[np.argmax(edges[fewest + 1] - edges[fewest])]
        return float((edges[i] + edges[i + 1]) / 2)

    wanted = np.log(THRESHOLD / (1 - THRESHOLD))
    common = best_cut(z, y)
    shifts = np.full(len(LANGUAGE_WORDS), wanted - common)
    for k in range(len(LANGUAGE_WORDS)):
        own = language == k
        if min(y[own].sum(), (1 - y[own]).sum()) >= 20:
            shifts[k] = wanted - best_cut(z[own], y[own])
    return shifts


def score_texts(model: dict, texts: list[str], chars: int = 1_000_000) -> np.ndarray:
    """Scores of whole texts, a bounded number of characters (or one text) at a time."""
    if model.get("empty"):
        return np.full(len(texts), model.get("score", 0.5))
    scores, begin = [], 0
    while begin < len(texts):
        end, held = begin + 1, len(texts[begin])
        while end < len(texts) and held + len(texts[end]) <= chars:
            held += len(texts[end])
            end += 1
        parts, starts, whole = hashed_words(texts[begin:end])
        scores.append(sigmoid(_logits(model, parts, starts) + model["shifts"][languages(whole, starts, model["languages"])]))
        begin = end
    return np.concatenate(scores) if scores else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> dict:
    """A model for labels.toxic, learned from the rows of `labels` that are not held out. Without
    texts of both labels nothing tells toxic ones apart: then every score is 0."""
    texts, y = training.labelled_sample(docs, labels, "toxic", training.held_out("doc_id", *HELD_OUT), per_class, max_chars)
    model = train(texts, y)
    return model | {"score": 0.0} if model.get("empty") else model


def toxicity(text: str | Column, model: dict, spark) -> Column:
    """The score of a text, from 0 to 1: toxic from `THRESHOLD` on. Null counts as empty."""
    return training.score_column(text, model, score_texts, spark)
