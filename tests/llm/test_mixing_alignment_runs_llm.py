"""Mixing, tokenizer alignment and periodic runs against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowtusk.llm import alignment, mixing, queries, runs
from flowtusk.llm.common import read_table

SPACES = " \t\n\x0b\x0c\r"
TEXTS = ["", "   ", "a", " a\x00b  \x1c c　 d \xa0 x▁y <0x41> <s>", "'sé_12 ²x <|endoftext|> \U0001d518 中文 don't",
         "0" * 900 + " 00 000", "ab" * 500, "字" * 300, "\n" * 200, "x y " * 50 + "z", "word\t" * 40, "a\x0bb\x0cc\x1cd\x85e"]
COLUMNS = "doc_id bigint, text string, source string, size int, chance double, row int, runs int, chunk string, position int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, text, f"s{i % 3}", 1, 2.0, 3, 4, "c", 5) for i, text in enumerate(TEXTS)]
    rows += [(50, None, None, 1, 2.0, 3, 4, "c", 5), (1 << 62, TEXTS[4], "s0", 1, 2.0, 3, 4, "c", 5), (None, "no id at all", "s1", 1, 2.0, 3, 4, "c", 5),
             (3, TEXTS[3], "s0", 1, 2.0, 3, 4, "c", 5)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture
def nothing(odd):
    return odd.filter("false")


def words_of(text):
    word, words = "", []
    for c in (text or "") + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    return words


# -- periodic runs ---------------------------------------------------------------------------------------------

def runs_by_force(words, least=6, exponent=4):
    codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0)
    found = {}
    for q in range(1, len(codes) // exponent + 1):
        same = np.r_[False, codes[q:] == codes[:-q], False]
        starts, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s + q >= max(least, exponent * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_force(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 3)])
def test_catchers_for_any_slabs(least, exponent):
    random.seed(least)
    for trial in range(400):
        n, kinds = random.randint(0, 90), random.choice([1, 2, 3, 6, 20])
        x = [random.randrange(kinds) for _ in range(n)]
        if n and random.random() < 0.6:
            a = random.randrange(n)
            p = 1 + random.randrange(max(1, (n - a) // 3))
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        catchers = runs.SquareCatchers(least, exponent)
        i = 0
        while i < n:
            slab = random.randint(1, 40) if trial % 2 else n
            catchers.append(np.array(x[i:i + slab]))
            i += slab
        assert list(map(tuple, catchers.runs().tolist())) == runs_by_force(x, least, exponent), x


def test_equal_fingerprints_are_compared():
    """Words whose fingerprints all agree: only the comparison of words can tell them apart."""
    catchers = runs.SquareCatchers(6, 4)
    x = [1, 2] * 9 + [3, 4, 5, 6] + [7, 7, 7, 7, 7, 7, 8] + list(range(20, 60))
    catchers.append(np.array(x))
    catchers.sums[:], catchers.caught = 0, {}
    for level in (1, 2, 4, 8):
        catchers._catch(level, 0)
    assert list(map(tuple, catchers.runs().tolist())) == runs_by_force(x)


def test_one_word_many_times():
    catchers = runs.SquareCatchers()
    catchers.append(np.zeros(200_000, dtype=np.int64))
    assert catchers.runs().tolist() == [[0, 200_000, 1]]


def test_runs_of_odd_rows(spark, odd, nothing):
    got = runs.find_runs(odd).collect()
    assert len(got) == len(TEXTS) + 4 and set(got[0].asDict()) == {c.split()[0] for c in COLUMNS.split(", ")} | {"n_words", "collapsed"}
    for row in got:
        words = words_of(row.text)
        found = runs_by_force(words)
        assert row.n_words == len(words) and [tuple(r) for r in row.runs] == found, row.text
        assert row.collapsed == collapsed_by_force(words, found)
    assert runs.find_runs(nothing).count() == 0


def test_runs_query(spark, folder):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, folder).collect()}
    with_runs = 0
    for row in read_table(spark, folder, "documents").collect():
        words, h = words_of(row.text), zlib.crc32(str(row.doc_id).encode())
        n = len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found, out = runs_by_force(words), got[row.doc_id]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert (out.n_runs, out.start, out.length, out.period) == (len(found), *best)
        assert out.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert out.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert out.collapsed_sha256 == hashlib.sha256(collapsed_by_force(words, found).encode()).hexdigest()
        with_runs += bool(found)
    assert len(got) == 200 and with_runs > 10


# -- alignment -------------------------------------------------------------------------------------------------

def groups_by_force(text, a, b):
    """Groups as lists of ids, by both libraries; none if their tokens do not spell the text."""
    if not text:
        return []
    whole = (" " + text).encode()
    symbols = {s: bytes([x]) for s, x in alignment._byte_symbols().items()}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [b"".join(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    groups, left, at_a, at_b = [([], [])], list(zip(ids_b, bytes_b, strict=True)), 0, 0
    for i, token in zip(ids_a, bytes_a, strict=True):
        groups[-1][0].append(i)
        at_a += len(token)
        while left and at_b + len(left[0][1]) <= at_a:
            j, piece = left.pop(0)
            groups[-1][1].append(j)
            at_b += len(piece)
        if at_a == at_b:
            groups.append(([], []))
        elif left:
            continue
    return groups[:-1]


def expected(texts):
    a, b = Tokenizer.from_file(queries.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    a.encode_special_tokens = True
    # An A token that ends inside a B token, and the reverse, stay in the open group.
    every = [groups_by_force(t, a, b) for t in texts]
    links = [Counter((x, y) for xs, ys in groups for x in xs for y in ys) for groups in every]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, own in zip(every, links, strict=True):
        written = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(own.values()),
                    sum(n for (x, y), n in own.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out


@pytest.mark.parametrize("piece", [1, 2, 7, 4096])
def test_merge_paths(piece):
    rng = np.random.default_rng(piece)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.r_[rng.choice(np.arange(1, n + 1), int(rng.integers(0, n + 1))), n]) for _ in "ab")
        i, j = alignment.crossings(a, b, piece)
        assert (np.diff(i + j)[:-1] == piece).all() and (i[-1], j[-1]) == (len(a), len(b))
        common = np.intersect1d(a, b)
        of_a, of_b, count = alignment.merge_groups(a, b, piece)
        assert count == len(common)
        assert (of_a == np.searchsorted(common, a)).all() and (of_b == np.searchsorted(common, b)).all()


@pytest.mark.parametrize("chunk_pairs,chunk_bytes", [(400_000, 1 << 26), (10, 1 << 26), (400_000, 10)])
def test_alignment_of_odd_rows(spark, odd, nothing, chunk_pairs, chunk_bytes):
    docs = odd.repartition(2)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(zip([r.doc_id or -1 for r in rows], *zip(*expected([r.text for r in rows]), strict=True), strict=True))
    got = alignment.align_tokenizers(docs, queries.BYTE_BPE, queries.PIECES, chunk_pairs=chunk_pairs, chunk_bytes=chunk_bytes).collect()
    assert sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert alignment.align_tokenizers(nothing, queries.BYTE_BPE, queries.PIECES).count() == 0


def test_token_groups_are_the_digested_ones(spark, odd):
    written = {r.doc_id: r.groups for r in alignment.token_groups(odd, queries.BYTE_BPE, queries.PIECES).collect()}
    for row in alignment.align_tokenizers(odd, queries.BYTE_BPE, queries.PIECES).collect():
        groups = written[row.doc_id]
        assert row.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert row.n_groups == (groups.count(";") + 1 if groups else 0)
    assert written[50] == "" and written[2].count("|") == 1


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    pair = alignment._vocabularies(queries.BYTE_BPE, queries.PIECES)
    texts = [t for t in TEXTS if t]
    usual = alignment._Aligned(pair, texts).pairs()
    monkeypatch.setattr(alignment, "_LARGE", 0)
    assert all((x == y).all() for x, y in zip(usual, alignment._Aligned(pair, texts).pairs(), strict=True))


def test_alignment_query(spark, folder):
    rows = read_table(spark, folder, "documents").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], expected([r.text for r in rows]), strict=True))
    got = queries.op12_tokenizer_alignment(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id]


# -- mixing ----------------------------------------------------------------------------------------------------

def targets_by_force(sizes, share=1.5, weights=(5, 2, 1), repeats=2):
    """The excess of full sources is dealt again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] >= repeats * sizes[s]}
        if not full:
            return target | {s: each * weight[s] for s in open_}
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_query(spark, folder):
    docs = {r.doc_id: r for r in read_table(spark, folder, "documents").collect()}
    got = queries.op11_mix_sources(spark, folder).collect()
    assert len(got) == len(docs)
    sizes, most, taken, target = Counter(), Counter(), Counter(), {}
    for r in got:
        source = docs[r.doc_id].source
        assert r.size == len(words_of(docs[r.doc_id].text)) and r.taken in (0, r.size, 2 * r.size)
        sizes[source] += r.size
        taken[source] += r.taken
        most[source] = max(most[source], r.size)
        target[source] = r.target
    want = targets_by_force(sizes)
    for source, size in sizes.items():
        assert target[source] == pytest.approx(want[source]) and all(r.source_size == sizes[docs[r.doc_id].source] for r in got)
        assert abs(taken[source] - want[source]) <= max(0.01 * want[source], 2)
    again = queries.op11_mix_sources(spark, folder).repartition(3).collect()
    assert sorted(got) == sorted(again)


def test_targets_of_few_and_full_sources(spark):
    for sizes, share in (({"b": 10, "a": 1, None: 5, "é": 100, "z": 0}, 1.5), ({"a": 7}, 1.5), ({"a": 3, "b": 4}, 3.0), ({"a": 0}, 1.5)):
        frame = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        got = {r.source: r.target for r in mixing.source_targets(frame, share).collect()}
        want = targets_by_force(sizes, share)
        assert got == {s: pytest.approx(want.get(s, 2 * sizes[s])) for s in sizes}


def test_mixing_of_odd_rows(spark, odd, nothing):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(TEXTS) + 4
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert all(r.taken == r.times * r.size <= 2 * r.size for r in got)
    assert mixing.mix_sources(nothing).count() == 0


@pytest.mark.parametrize("group,leaves", [(4096, 1024), (16, 4), (8, 2)])
def test_sample_is_balanced_in_rounds(spark, group, leaves):
    random.seed(group)
    rows = [(i % 2 if i < 400 else 0, int(random.lognormvariate(5, 1)), 0.3 if i % 2 and i < 400 else 0.7, i) for i in range(1500)]
    frame = spark.createDataFrame(rows, "place bigint, size bigint, chance double, id bigint")
    got = mixing.balanced_sample(frame, ["id"], group, leaves).collect()
    assert len(got) == len(rows) and {r.chance for r in got} == {0.0, 1.0}
    for place in (0, 1):
        wanted = sum(c * s for p, s, c, _ in rows if p == place)
        taken = sum(r.size for r in got if r.place == place and r.chance)
        # Small groups leave few documents to choose among at the landing.
        assert abs(taken - wanted) <= (0.002 * wanted + 2 if group == 4096 else max(s for _, s, _, _ in rows))
        assert abs(sum(c for p, _, c, _ in rows if p == place) - sum(r.chance for r in got if r.place == place)) <= 8


def test_flight_keeps_sums_and_means():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 50, 40).tolist()
    means = np.zeros(40)
    for _ in range(2000):
        moved, undecided = mixing.fly([0.3] * 40, sizes, rng.random(40).tolist())
        assert len(undecided) <= 2 and sum(moved) == pytest.approx(12)
        assert sum(c * s for c, s in zip(moved, sizes, strict=True)) == pytest.approx(0.3 * sum(sizes))
        means += moved
    assert np.abs(means / 2000 - 0.3).max() < 0.06
