"""Token ids of texts by the public vocabularies, as little-endian unsigned 32-bit bytes.

A tokenizer that drops white space treats a text as a row of words that never influence each other,
so the ids of a word can be kept: a worker holds a bounded dictionary of recent words and only
encodes new ones.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values, patterns of the Arrow library: white space (Unicode property White_Space), and the
#: control characters that only the library's quicker splitting takes for white space.
_SPACES = "[\\t-\\r\x85\\p{Z}]+"
_SEPARATORS = "[\\x1c-\\x1f]"
CACHE_PIECES = 100_000
CACHED_CHARS = 48


def bare_pieces(texts: pa.Array) -> pa.Array:
    """Each text's words without the white space."""
    if pc.any(pc.match_substring_regex(texts, _SEPARATORS)).as_py():
        return pc.split_pattern_regex(texts, _SPACES)
    return pc.utf8_split_whitespace(texts)


class PieceCache:
    """Ids of pieces; at most `limit` pieces are held, long ones never."""

    def __init__(self, split, encode, limit: int = CACHE_PIECES):
        self.split, self.encode, self.limit, self.known = split, encode, limit, {"": b""}

    def forget(self) -> None:
        """Give the memory of the held pieces back."""
        self.known = {"": b""}

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids begin (one more entry than texts)."""
        if len(self.known) > self.limit:
            self.forget()
        lists = self.split(texts)
        coded = lists.flatten().dictionary_encode()
        pieces, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.known
        fresh = [p for p in pieces if p not in known]
        passing = {}
        for piece, ids in zip(fresh, self.encode(fresh) if fresh else [], strict=True):
            (known if len(piece) <= CACHED_CHARS else passing)[piece] = ids
        found = [passing[p] if p in passing else known[p] for p in pieces] if passing else [known[p] for p in pieces]
        table = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = table[np.repeat(starts[which] - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def _bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    """A byte-level encoding from a file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of `ids` between successive positions `ends`."""
    flat, ends = ids.tobytes(), (ends * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


#: Pieces of these characters take the short way of `_word_encoder`; all others go to the library itself.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]+")
_END = "\x01"
#: Fixed value: how the vocabulary's file splits texts; then the same for plain characters, and lines.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+|\n")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _word_encoder(path: str):
    """Encode words by a vocabulary with word ends.

    The library spends most of its time on set-up for each word. Plain words are therefore merged
    by the rank encoder on the same vocabulary, a word's end being one extra byte; ranks are the
    order of the merges, so the ids are the same (tested against the library).
    """
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    suffix, symbols, ranks = spec["model"]["end_of_word_suffix"], _byte_symbols(), {}
    special = {token["content"] for token in spec["added_tokens"]}
    for token, rank in spec["model"]["vocab"].items():
        if token not in special:
            ended = token.endswith(suffix)
            name = bytes(symbols[c] for c in token.removesuffix(suffix))
            ranks[name + _END.encode() * ended] = rank
    merger = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
    if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _WORD_PATTERN:
        raise ValueError(f"{path} splits texts by another pattern")
    line = ranks[b"\n" + _END.encode()]

    def encode(pieces: list[str]) -> list[bytes]:
        plain = [p for p in pieces if _PLAIN.fullmatch(p)]
        text = unicodedata.normalize("NFC", "\n".join(plain) + "\n").lower()
        ids = np.array(merger.encode_ordinary(_END.join(_PLAIN_PARTS.findall(text)) + _END), dtype="<u4")
        lines = np.flatnonzero(ids == line)
        cuts = _cut(np.delete(ids, lines), lines - np.arange(len(lines))) if plain else []
        found = dict(zip(plain, cuts, strict=True))
        rest = [p for p in pieces if p not in found]
        for p, out in zip(rest, library.encode_batch(rest, add_special_tokens=False), strict=True):
            found[p] = _bytes(out.ids)
        return [found[p] for p in pieces]

    return encode


@functools.lru_cache(maxsize=4)
def word_cache(path: str) -> PieceCache:
    """The worker's cache for a vocabulary with word ends."""
    return PieceCache(bare_pieces, _word_encoder(path))


@functools.lru_cache(maxsize=4)
def _added_tokens(path: str) -> str:
    """A pattern that finds the vocabulary's added tokens."""
    with open(path, encoding="utf-8") as file:
        return "|".join(re.escape(token["content"]) for token in json.load(file)["added_tokens"])


@functools.lru_cache(maxsize=4)
def _library(path: str):
    """The library with its defaults; loaded only where a text holds an added token."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_words(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As `PieceCache.encode_texts`, but texts that hold an added token go to the library as they
    are: there, such a token has an id of its own."""
    ids, ends = word_cache(path).encode_texts(texts)
    pattern = _added_tokens(path)
    special = np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)) if pattern else []
    if not len(special):
        return ids, ends
    parts = np.split(ids, ends[1:-1])
    for i in special:
        parts[i] = np.array(_library(path).encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=ids.dtype)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(part) for part in parts])])
