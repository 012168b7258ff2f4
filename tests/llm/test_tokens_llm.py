"""Token counts, byte BPE and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowtusk.llm import bpe, packing, queries, separators, tokens
from flowtusk.plans.storage import new_path

ODD = ["", "   ", "a", " a\x00b  \x1c c　 d \xa0 x y Σας ΣΑΣ \n", "'sé_12 ²x é ́a a\x01b <|endoftext|> 𝔘 中文 don't İx",
       " x" * 3000, "字" * 5000, "\n" * 4000, "a" * 5000, "word " * 900 + "!?" * 2000 + " don't 12 " * 300]


@pytest.fixture(scope="module")
def encoding():
    return tokens.rank_encoding(queries.RANKS, public_tokenizers.PATTERN)


@pytest.fixture
def docs(spark):
    rows = [(i, text, 1, "x") for i, text in enumerate(ODD)] + [(50, None, 2, "y"), (3, ODD[3], 1, "x"), (None, "no id", 1, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, piece int, ids string")


def test_word_ids_are_the_library_s(spark):
    library = Tokenizer.from_file(queries.WORDS)
    library.encode_special_tokens = True
    random.seed(5)
    names = [t.replace("</w>", "") for t in library.get_vocab()]
    letters = "abcdefghijklmnopqrstuvwxyzABCéèüßñ0123456789'.,!-#%&ÀŒſİıµªº¼²"
    texts = [*ODD, " ".join(names), *["".join(random.choice(letters) for _ in range(random.randint(1, 30))) for _ in range(3000)]]
    ids, ends = tokens.word_cache(queries.WORDS).encode_texts(pa.array(texts))
    for i, expected in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i]:ends[i + 1]].tolist() == expected.ids, texts[i][:50]


def test_added_tokens_have_their_own_ids(spark):
    library = Tokenizer.from_file(queries.WORDS)
    texts = [*ODD, "a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "plain", "<|ENDOFTEXT|>"]
    ids, ends = tokens.encode_words(queries.WORDS, pa.array(texts))
    for i, expected in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i]:ends[i + 1]].tolist() == expected.ids, texts[i][:50]
    row = packing.cut_pieces(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string"), queries.WORDS).first()
    assert row.length == 4 and row.ids_crc32 == zlib.crc32(np.array([320, 49407, 321, 1], dtype="<u4").tobytes())


def test_cache_stays_bounded():
    cache = tokens.PieceCache(tokens.bare_pieces, lambda words: [len(w).to_bytes(4, "little") for w in words], limit=10)
    for k in range(5):
        ids, ends = cache.encode_texts(pa.array([" ".join(f"w{k}{i}" for i in range(20)), "", "z" * 100]))
        assert ids.tolist()[-1] == 100 and ends.tolist()[1:3] == [20, 20]
        assert len(cache.known) <= 31 and "z" * 100 not in cache.known


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (400, 40), (150, 5)])
def test_bpe_of_odd_texts(spark, docs, encoding, chunk, overlap):
    pieces = bpe.encode_documents(docs, queries.RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    found = bpe.digest_documents(bpe.decode_pieces(pieces, queries.RANKS, public_tokenizers.PATTERN)).collect()
    expected = []
    for row in docs.collect():
        raw = (row.text or "").encode()
        ids = np.array(encoding.encode_ordinary(row.text or ""), dtype="<u4")
        expected.append((row.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    at_once = bpe.digest_texts(docs, queries.RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    assert sorted(map(tuple, at_once), key=order) == sorted(expected, key=order)


def test_bpe_query(spark, folder, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.op3_byte_bpe(spark, folder).collect()
    assert {r.doc_id for r in found} == set(texts)
    for row in found:
        ids = np.array(encoding.encode_ordinary(texts[row.doc_id]), dtype="<u4")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_keeps_large_ids_beside_a_null(spark, encoding):
    first = (1 << 62) + 1
    texts = {None: "no id", first: "a b", first + 2: "word " * 50, first + 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    pieces = bpe.encode_documents(docs, queries.RANKS, public_tokenizers.PATTERN, chunk=100)
    expected = {i: len(encoding.encode_ordinary(t)) for i, t in texts.items()}
    for found in (bpe.digest_documents(bpe.decode_pieces(pieces, queries.RANKS, public_tokenizers.PATTERN)),
                  bpe.digest_texts(docs, queries.RANKS, public_tokenizers.PATTERN, chunk=100)):
        assert {r.doc_id: r.n_tokens for r in found.collect()} == expected


def test_bpe_of_no_rows(spark, docs):
    none = bpe.encode_documents(docs.limit(0), queries.RANKS, public_tokenizers.PATTERN)
    assert bpe.digest_documents(bpe.decode_pieces(none, queries.RANKS, public_tokenizers.PATTERN)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_separators_across_blocks(spark, tmp_path, block):
    files = {"a.bin": [9, 1, 2, 9, 9, 3], "b.bin": [1, 2, 3, 4], "c.bin": [9], "d.bin": [], "e.bin": [5, 5, 5, 5, 5, 5, 5, 9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    found = separators.count_tokens(spark, str(tmp_path), 9, block_ids=block).collect()
    rows = sorted((r.path[-5:], r.ordinal, r.start, r.n_tokens, r.ended) for r in found)
    assert rows == [("a.bin", 0, 0, 0, True), ("a.bin", 1, 1, 2, True), ("a.bin", 2, 4, 0, True), ("a.bin", 3, 5, 1, False),
                    ("b.bin", 0, 0, 4, False), ("c.bin", 0, 0, 0, True), ("e.bin", 0, 0, 7, True)]


def test_token_files_of_odd_texts(spark, docs, encoding):
    target = new_path(spark, "test-files")
    placed = separators.write_token_files(docs, target, queries.RANKS, public_tokenizers.PATTERN, queries.SEPARATOR)
    found = separators.count_tokens(spark, target, queries.SEPARATOR, block_ids=500).collect()
    counts = {(r.path.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in found}
    own = sorted((r.doc_id is None, r.doc_id, counts[r.file, r.ordinal]) for r in placed.collect())
    assert own == sorted((r.doc_id is None, r.doc_id, len(encoding.encode_ordinary(r.text or ""))) for r in docs.collect())


def test_token_counts_query(spark, folder, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, folder).collect()}
    assert found == {i: len(encoding.encode_ordinary(t)) for i, t in texts.items()}


def _assert_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, folder):
    library = Tokenizer.from_file(queries.WORDS)
    expected, total = set(), 0
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array([*library.encode(row.text, add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        expected |= {(row.doc_id, n, start, len(ids[start:start + 4096]), zlib.crc32(ids[start:start + 4096].tobytes()))
                     for n, start in enumerate(range(0, len(ids), 4096))}
    rows = queries.op10_best_fit_packing(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    assert _assert_packed(rows, 4096) <= -(-total // 4096) + 1


def test_packing_of_odd_texts(spark, docs):
    rows = packing.pack_documents(docs, queries.WORDS, capacity=64, slack=2).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in rows if r.doc_id == 50) == 1
    assert len([r for r in rows if r.doc_id == 3]) % 2 == 0  # both of the repeated rows
    _assert_packed(rows, 64)
    assert packing.pack_documents(docs.limit(0), queries.WORDS).count() == 0


@pytest.mark.parametrize("sizes", [[2100] * 300, [1] * 300, [4096] * 5, [3000] * 100 + [1000] * 100 + [96] * 100])
def test_packing_in_rounds(spark, sizes):
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)],
                                   "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    rows = packing.pack_pieces(pieces, task_items=40, fan_in=2).collect()
    assert len(rows) == len(sizes)
    bins = _assert_packed(rows, 4096)
    if sizes[0] == 3000:
        assert bins <= 105  # 100 would be the least
    if sizes[0] == 1:
        assert bins == 1


def test_packing_gives_its_words_back(spark):
    """Workers outlive their tasks and serve other steps: they keep no words of a task that ended."""
    words = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "concat('own', id, ' word', id) AS text")
    packing.cut_pieces(words, queries.WORDS).collect()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"known": [len(tokens.word_cache(queries.WORDS).known)]})

    assert {row.known for row in words.mapInArrow(held, "known bigint").collect()} == {1}


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins[0] == bins[2] and bins[1] == bins[3] == bins[4]
