"""Near-duplicate operators and the components they share, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from flowtusk.llm import jaccard, queries, vectors
from flowtusk.llm.common import whole_runs
from flowtusk.llm.graph import components


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def grams(text, words):
    found = (text or "").encode().lower().split()
    if 0 < len(found) < words:
        return {tuple(found)}
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)}


def brute_force(texts, words, num, den):
    sets, places, links = {i: grams(t, words) for i, t in texts.items()}, defaultdict(set), []
    for i, own in sets.items():
        for g in own:
            places[g].add(i)
    for i, own in sets.items():
        common = defaultdict(int)
        for g in own:
            for j in places[g]:
                common[j] += j < i
        links += [(i, j) for j, n in common.items() if n and den * n >= num * (len(own) + len(sets[j]) - n)]
    roots = roots_of(sets, links)
    return {i: (len(sets[i]), roots[i]) for i in sets}


def variants(count, seed=3):
    random.seed(seed)
    bases = [[random.choice("abcdefghij") + str(random.randint(0, 40)) for _ in range(n)]
             for n in [2, 3, 4, 5, 6, 8, 9, 10, 12, 14, 15, 17, 20, 23, 30, 60] * 6]
    texts = {}
    for i in range(count):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            at = random.randrange(len(words)) if words else 0
            words[at:at + random.randrange(2)] = [random.choice("xyz") + str(random.randint(0, 3))] * random.randrange(2)
        texts[i] = " ".join(words)
    return texts | {90_001: None, 90_002: "", 90_003: " \n\t"}


@pytest.mark.parametrize("words, num, short, block", [(4, 85, 32, 1024), (2, 80, 2, 30)])
def test_jaccard_equals_brute_force(spark, monkeypatch, words, num, short, block):
    monkeypatch.setattr(jaccard, "HOT", 0 if words == 2 else jaccard.HOT)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = variants(1200)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in texts.items()], "doc_id bigint, text string, n int, node string")
    found = {r.doc_id: (r.n_shingles, r.component_id)
             for r in jaccard.jaccard_components(docs.repartition(3), words=words, numerator=num).collect()}
    assert found == brute_force(texts, words, num, 100)


def test_jaccard_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, folder).collect()}
    assert found == brute_force(texts, 4, 85, 100)


def test_jaccard_of_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B C d E"), (4, long), (5, long + " x"), (6, "É b"), (7, "é b")]
    schema = "doc_id bigint, text string"
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in
                    jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (4, 5000, 4), (5, 5001, 4), (6, 1, 6), (7, 1, 7)], key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0


def test_jaccard_keeps_large_ids(spark):
    texts = {(1 << 62) + 2 * i + 1: t for i, t in enumerate(variants(300).values())}
    rows = [*texts.items(), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == brute_force(texts, 4, 85, 100) | {None: (3, None)}


def test_jaccard_rows_travel_once(spark, monkeypatch):
    """List rows go to their n-gram and sets to their comparison in one shuffle, also when Spark broadcasts nothing by itself."""
    plans, stored = defaultdict(list), jaccard.store

    def store(rows, name):
        plans[name].append(rows._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
        return stored(rows, name)

    monkeypatch.setattr(jaccard, "store", store)
    texts = variants(400)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == brute_force(texts, 4, 85, 100)
    assert not any(f"hashpartitioning({c}" in plan for c in ("doc_id", "node") for plan in plans["lists"])
    assert [plan.count("Exchange hashpartitioning") for plan in plans["checked"]] == [1, 1]


def test_jaccard_without_broadcasts_and_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    texts = variants(400)
    docs = spark.createDataFrame([*texts.items(), *list(texts.items())[::3]], "doc_id bigint, text string").repartition(3)
    rows = jaccard.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_force(texts, 4, 85, 100)


def test_sketch_loses_no_links_at_low_thresholds(spark):
    allowed = [jaccard.sketch_difference(jaccard.Threshold(num, 100)) for num in (100, 85, 80, 50, 40)]
    assert allowed[0] == 0 and 30 < allowed[1] <= 40 < allowed[2] < 64 and allowed[3:] == [None, None]
    texts = {}
    for i in range(30):  # pairs of 1,000 words, 580 of them common: a similarity of 0.408
        for k in (0, 1):
            texts[2 * i + k] = " ".join([f"c{i}_{j}" for j in range(580)] + [f"o{i}_{k}_{j}" for j in range(420)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words=1, numerator=40).collect()}
    assert found == {i: (1000, i - i % 2) for i in texts}


def test_boundary_follows_the_costs():
    limit = jaccard.Threshold(85, 100)
    assert jaccard._boundary({n: 10 for n in range(1, 25)}, 1, limit) < jaccard._boundary({n: 10 for n in range(1, 25)}, 500, limit)
    assert limit.overlap(12, 14) == 12 and limit.prefix(20) == 4


def test_components_of_a_path_and_a_star(spark):
    random.seed(1)
    path = list(range(200))
    random.shuffle(path)
    links = list(zip(path, path[1:])) + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 3), (7, None), (2000, 2001), (2001, 2000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for link in links for n in link if n is not None}
    expected = roots_of(nodes, [link for link in links if None not in link])
    assert found == {n: r for n, r in expected.items() if n not in (5000,)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def linked(rows):
    ids = sorted({i for i, *_ in rows if i is not None})
    usable = {i: (label, np.array(v, dtype=float)) for i, v, label in rows if i is not None and label is not None and v
              and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    links = [(a, b) for a in usable for b in usable if a < b and usable[a][0] == usable[b][0]
             and len(usable[a][1]) == len(usable[b][1])
             and usable[a][1] @ usable[b][1] / np.linalg.norm(usable[a][1]) / np.linalg.norm(usable[b][1]) >= 0.93]
    degree = {i: sum(i in link for link in links) for i in ids}
    roots = roots_of(ids, links)
    return {i: (degree[i], roots[i], roots[i] == i) for i in ids}


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SLIM_BLOCK", 4 * block)
    random_ = np.random.default_rng(2)
    bases = random_.normal(size=(30, 16))
    rows = [(i, (bases[k] + 0.12 * random_.normal(size=16)).astype(np.float32).tolist(), int(k) % 4)
            for i, k in enumerate(random_.integers(0, 30, 500))]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(60)]  # equal vectors
    rows += [(2000, None, 1), (2001, rows[1][1], None), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] * 16, 1),
             (2005, [float("inf")] * 16, 1), (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1), (2009, [1e38] * 16, 1), (2010, [1e-30] * 16, 1)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, node int")
    found = vectors.link_vectors(table.repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == linked(rows) and len(found) == len(rows)


def test_vectors_query_and_odd_rows(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = queries.op2_embedding_near_dedup(spark, folder).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == linked(rows)
    schema = "vec_id bigint, embedding array<double>, label int"
    odd = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], schema)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.link_vectors(odd).collect()), key=str) == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None)], key=str)
    assert vectors.link_vectors(odd.limit(0)).count() == 0


def test_vector_tables_reach_the_recall():
    for count in (10, 1000, 10 ** 9):
        size, tables, step = vectors.plan(count)
        assert 1 - (1 - vectors.collision((2 - 2 * 0.93) ** 0.5, step) ** size) ** tables >= vectors.RECALL


@pytest.mark.parametrize("count", [500, 5_000, 100_000])
def test_measured_recall_just_above_the_threshold(count):
    """20,000 pairs at a cosine of 0.9301: share of a bucket and near sketches, by the plan for `count` vectors."""
    random_ = np.random.default_rng(count)
    one, other = random_.normal(size=(2, 20_000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    (keys, sketch), (keys2, sketch2) = (vectors.signatures(v, *vectors.plan(count))
                                        for v in (one, 0.9301 * one + (1 - 0.9301 ** 2) ** 0.5 * other))
    near = np.bitwise_count((sketch ^ sketch2).view(np.uint64)).sum(axis=1) <= vectors.sketch_limit()
    assert ((keys == keys2).any(axis=1) & near).mean() >= 0.9997


def test_near_sketches_equal_all_comparisons():
    random_ = np.random.default_rng(4)
    sizes = [1, 2, 70, 1, 63, 64, 65, 300, 5]
    edges = np.cumsum([0, *sizes])
    sketch = random_.integers(-2 ** 63, 2 ** 63 - 1, (edges[-1], vectors.WORDS), dtype=np.int64)
    for i in range(0, len(sketch) - 1, 7):
        sketch[i + 1] = sketch[i] ^ 5
    expected = np.zeros(len(sketch), dtype=bool)
    for begin, end in zip(edges, edges[1:], strict=False):
        for i in range(begin, end):
            expected[i] = any(i != j and np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)).sum() <= 40 for j in range(begin, end))
    assert (vectors.near_sketches(edges, sketch, 40) == expected).all()


def test_whole_runs_across_batches():
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    for size in (1, 2, 3, 4, 11):
        frames = [pd.DataFrame({"k": keys[i:i + size], "l": 0}) for i in range(0, len(keys), size)]
        runs = [frame["k"].iloc[a:b].tolist() for frame, edges in whole_runs(iter(frames), ["k", "l"])
                for a, b in zip(edges, edges[1:], strict=False)]
        assert runs == [[1, 1], [2] * 5, [3], [4, 4], [5]]
