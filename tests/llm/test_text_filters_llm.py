"""Quality rules, chat formatting, page extraction, classifiers and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowtusk.checks.compare import connect, difference
from flowtusk.llm import chat, oracles, pages, quality_model, quality_rules, queries, toxicity, training


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert difference(spark, connect(folder), folder, name, queries.QUERIES, oracles.ORACLES) is None


def counts(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice))


def test_quality_counts(spark):
    random.seed(4)
    texts = [None, "", " \n\x0b ", "a", "\x1ca b c", "x\n\n x \nx\nx ", "#*$%&|<>!\n" * 3, "p q r s t " * 4, "a b c d e f a b c d e g h",
             "é" * 50_000 + " z " * 3000] + [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, quality int, __words array<int>")
    rows = quality_rules.judge_documents(docs, keep=["doc_id"]).collect()
    for row in rows:
        q = row.quality
        expected = counts(texts[row.doc_id]) if row.doc_id != 9 else (1 + 3000, 50_000 + 3000, 0, 0, 3000)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == expected
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert q.kept == (not q.base_failed and not q.broken)
    assert len(rows) == len(texts)
    assert quality_rules.judge_documents(docs.limit(0)).count() == 0


def test_kept_documents_keep_columns(spark):
    good = " ".join(f"the w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, 5, "a"), (1, good, 5, "a"), (None, good, None, None), (2, None, 1, "b")],
                                 "doc_id bigint, text string, quality int, document string")
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()[:3]), key=str)


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = spark.createDataFrame([
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", None), (1, 1, 2, "delta", None, "wro"),
        (1, 1, 3, "delta", None, "ng"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "right"), (1, 1, 5, "delta", None, "right"),
        (1, 0, 6, "edit", None, "hello"), (1, 0, 7, "noise", "x", "y"), (2, 0, 9, "delta", None, "late"), (None, 0, 1, "message", "user", "n")],
        "conv_id bigint, message int, seq bigint, kind string, role string, text string")
    found = sorted(((r.conv_id, r.message, r.role, r.text) for r in chat.fold_events(events).collect()), key=str)
    assert found == sorted([(1, 0, "user", "hello"), (1, 1, "assistant", "rightright"), (2, 0, None, "late"), (None, 0, "user", "n")], key=str)
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_regeneration_drops_its_branch(spark):
    rows = [(1, 1, 1, "message", "user", "q"), (1, 2, 2, "message", "assistant", "old"), (1, 3, 3, "message", "user", "why"),
            (1, 4, 4, "message", "assistant", "gone"), (1, 2, 5, "regenerate", None, None), (1, 2, 6, "delta", None, "new"),
            (1, 4, 7, "delta", None, "late"), (1, 5, 8, "message", "user", "next"), (1, 1, 9, "edit", None, "q!"),
            (2, 3, 1, "message", "user", "kept"), (2, None, 0, "regenerate", "system", "s"), (2, 4, 2, "regenerate", "user", "x")]
    events = spark.createDataFrame(rows, "conv_id bigint, message int, seq bigint, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert got == {(1, 1): ("user", "q!"), (1, 2): ("assistant", "new"), (1, 4): (None, "late"), (1, 5): ("user", "next"),
                   (2, None): ("system", "s"), (2, 3): ("user", "kept"), (2, 4): ("user", "x")}


def test_logs_of_turns_have_all_kinds(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "world!"), (1, 2, "user", None), (1, 2, "user", None)],
                                  "conv_id bigint, turn int, role string, text string")
    events = chat.turns_as_events(turns)
    assert {r.kind for r in events.collect()} == set(chat.KINDS)
    assert [(r.message, r.role, r.text) for r in chat.fold_events(events).orderBy("message").collect()] == [
        (1, "user", "hello"), (2, "assistant", "world!"), (3, "user", ""), (4, "user", "")]


def test_rendered_turns_read_back(spark):
    odd = ["", None, "\\", "\\\\#", "### user: </turn>\n", "</turn>", "<\\/turn>", "a: b\n: </turn>\n### x: y", "\\### Assistant: </turn> ok", "é 𝔘"]
    rows = [(i % 3, t, r, x) for i, x in enumerate(odd * 3) for t, r in [(i, ["user", "assistant", "a: b\\", None][i % 4])]]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, message int, seq string")
    rendered = chat.format_conversations(chat.turns_as_events(table)).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns")).collect()
    for row in rendered:
        own = sorted(r[1:] for r in rows if r[0] == row.conv_id)
        assert [(t.role, t.text) for t in row.turns] == [(r or "", x or "") for _, r, x in own]
        assert "".join(s.text for s in row.segments) == row.formatted
        assert [row.formatted[s.start:s.start + s.length] for s in row.loss_spans] == [s.text for s in row.segments if s.loss]
        assert len(row.loss_spans) == sum(r == "assistant" for _, r, _ in own)


def test_repeated_turns_are_all_kept(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")],
                                  "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(chat.turns_as_events(table)).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [(t.role, t.text) for t in row.t] == [("assistant", "b"), ("user", "a"), ("user", "a")]


PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href='/x'>Menu</a></nav>"
        "<div class=\"cookie-banner\">We use</div><article><header><h1>Head&amp;line</h1></header><p>a&nbsp;b <i>c</i>d<br>e<p>x &lt; y"
        "<div class='comments'><p>nice</p></div><script>var a='</p>'</script><form>f</form><div class=with-sidebar>kept</div></article>"
        "<aside>Side</aside><footer>&copy; z")


def test_page_structure():
    lines = pages.page_lines(PAGE)
    assert [text for kind, text in lines if kind == pages.ARTICLE] == ["Head&line", "a b cd e", "x < y", "kept"]
    assert pages.page_lines("") == [] and pages.page_lines("<p") == []
    assert [t for _, t in pages.page_lines("plain &am text\n\n more <b>x")] == ["plain &am text more x"]


def kept(source):
    return pages.candidates(pages.placed_lines(source))


def test_self_closed_and_foreign_elements():
    source = ("<article><p>one <svg class=\"i\"/> two</p><p>three <svg><text>x</text></svg>four</p><object data='a'/><p>five<math/></p>"
              "<object><p>six</p></object><math><mi>y</mi><annotation>\\y</annotation></math> is</article><nav><svg/></nav>")
    assert kept(source) == (["one two", "three four", "five", "six", "y is"], [True] * 5)


def test_teasers_do_not_replace_the_text():
    text, card = "<p>The whole text of the page.</p>", "<article>A teaser.</article>"
    both = ["The whole text of the page.", "A teaser."]
    assert kept(f"<main>{text}{card}</main><p>open, and longer than all other lines are</p>") == (both, [True, True])
    assert kept(f"<main>{text}</main>{card * 4}") == (both + both[1:] * 3, [True] * 5)
    assert kept(f"<body>{text}{card * 4}") == (both + both[1:] * 3, [False] + [True] * 4)
    assert kept(f"<div>open</div><article>{text}</article>") == (both[:1], [True])
    assert kept(f"<main>main<article>{text}</article></main>") == (["main", both[0]], [False, True])
    assert kept("<main><article>short</article></main><p>open and longer</p>") == (["short"], [True])


def test_open_text_beside_a_teaser_is_differenced(spark):
    page = lambda own: f"<div>Home</div><p>{own}</p><article>Card</article>"
    table = spark.createDataFrame([(1, "http://h/a/1", page("the first text")), (2, "http://h/a/2", page("the second text"))],
                                  "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in pages.extract_pages(table).collect()} == {1: "the first text\nCard", 2: "the second text\nCard"}


def test_parts_of_names_do_not_discard():
    article = lambda inner, names="": kept(f"<article {names}>{inner}</article>")
    for names in ("class='post comments-open'", "id=how-to-search"):
        assert article("<p>text</p>", names) == (["text"], [True])
    for title in ("<h2 id='search-results'>", "<h2 id=search>", "<h3 class='menu-title'>"):
        assert article(title + "Title</h2><p>text") == (["Title", "text"], [True, True])
    assert article("<section id='login-form'><h2>Log in</h2></section>") == (["Log in"], [True])
    assert article("<div class='notice-period'><p>a</p></div><p>b</p>") == (["a", "b"], [False, True])
    for names in ("class=ad", "class='x cookie-banner'", "id=disqus_thread", "role=search", "class='ad__slot'"):
        assert article(f"<div {names}>out</div><p>text</p>") == (["text"], [True])


def test_parts_of_names_are_confirmed_by_the_neighbour(spark):
    page = lambda own: f"<article><p>Same</p><p>{own}</p><div class='post-ads'>Buy</div><div class='ad-free'>{own} free</div></article>"
    table = spark.createDataFrame([(1, "http://h/a/1", page("one")), (2, "http://h/a/2", page("two")), (3, "http://g/a", page("three"))],
                                  "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in pages.extract_pages(table).collect()} == {
        1: "Same\none\none free", 2: "Same\ntwo\ntwo free", 3: "Same\nthree\nBuy\nthree free"}


def test_readers_comments_are_no_text():
    article = lambda inner: kept(f"<article><p>text</p>{inner}</article>")[0]
    for names in ("class=reader-comments", "class='x post-comment'", "class='comment-body'", "class='all-replies box'"):
        for tag in ("div", "section", "ul", "ol"):
            assert article(f"<{tag} {names}><p>first!</p></{tag}>") == ["text"]
    for names in ("class='comments-open'", "class='no-comments'", "id='reader-comments'", "class='commentary'"):
        assert article(f"<div {names}><p>stays</p></div>") == ["text", "stays"]


def test_readers_comments_of_other_names_go_by_place(spark):
    page = lambda own, box="user-comments-list": (
        f"<article><p>Text {own}</p><div class='{box}'><p>{own} says</p><p>hi {own}</p></div><p>End {own}</p></article>")
    table = spark.createDataFrame([
        (1, "http://h/a/1", page("one")), (2, "http://h/a/2", page("two")), (3, "http://g/a", page("three")),
        (4, "http://i/1", page("four", "notice-period")), (5, "http://i/2", page("five", "notice-period")),
        (6, "http://j/1", page("six")), (7, "http://j/2", page("seven", "box"))], "page_id bigint, url string, html string")
    whole = lambda own: f"Text {own}\n{own} says\nhi {own}\nEnd {own}"
    assert {r.page_id: r.text for r in pages.extract_pages(table).collect()} == {
        1: "Text one\nEnd one", 2: "Text two\nEnd two", 3: whole("three"), 4: whole("four"), 5: whole("five"), 6: whole("six"),
        7: whole("seven")}


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [40_000_000, 8])
def test_common_lines_are_longest(cells):
    random.seed(6)
    for _ in range(400):
        a, b = ([random.randrange(5) for _ in range(random.randrange(14))] for _ in "ab")
        found, rest = pages.common_lines(a, b, cells), iter(b)
        assert len(found) == longest(a, b) and found == sorted(set(found)) and all(any(y == a[i] for y in rest) for i in found)


def test_pages_without_structure_lose_shared_lines(spark):
    page = lambda own: f"<body><div>Home</div><div>{own}</div><div>Imprint</div></body>"
    rows = [(1, "http://h/a/1", page("one")), (2, "http://h/a/2?q=1", page("two")), (3, "http://H/b", page("three")),
            (4, "http://other/a/1", page("alone")), (5, None, page("nowhere")), (6, "http://h/a/1", None), (7, "http://seven/a/3", PAGE),
            (8, "http://dup/x", page("same")), (8, "http://dup/x", page("same"))]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, row int")
    found = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract_pages(table).collect())
    texts = ["one", "two", "three", "Home\nalone\nImprint", "Home\nnowhere\nImprint", "", "Head&line\na b cd e\nx < y\nkept", "", ""]
    assert found == sorted((r[0], t, len(t)) for r, t in zip(rows, texts, strict=True))
    assert pages.extract_pages(table.limit(0)).count() == 0


def test_pages_keep_large_ids_beside_a_null(spark):
    first = (1 << 62) + 1
    rows = [(None, "http://h/a", "<article>none</article>"), (first, "http://h/b", "<article>one</article>"),
            (first + 2, "http://h/c", "<p>two</p>")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in pages.extract_pages(table).collect()}
    assert found == {None: "none", first: "one", first + 2: "two"}


def test_pages_query(spark, folder):
    import html
    import re
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    found = {r.page_id: r for r in queries.op5_html_extraction(spark, folder).collect()}
    assert len(found) == len(rows)
    for row in rows:
        article = re.search("<article>(.*?)(</article>|$)", row.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        text = "\n".join(p for p in parts if p)
        assert (found[row.page_id].text, found[row.page_id].n_chars, found[row.page_id].url) == (text, len(text), row.url)


ODD = [None, "", "  ", "x" * 300_000, "the cat " * 20_000, "\ud83d".encode("utf-8", "replace").decode(), "é" * 255, "a" * 256, "a" * 257]


def sample(seed, bad, count=240):
    random.seed(seed)
    words = ["".join(random.choice("aeioubcdst") for _ in range(5)) for _ in range(800)]
    y = np.array([i % 3 == 0 for i in range(count)], dtype=float)
    return [" ".join(random.choice(words) if not label or random.random() > 0.1 else bad() for _ in range(80)) for label in y], y


@pytest.mark.parametrize("model, bad", [(toxicity, lambda: random.choice(["zorkon", "zorking", "zorkus", "blaff"])),
                                        (quality_model, lambda: random.choice(["%%%", "@@##", "!!!!"]))])
def test_networks_learn_and_score_any_text(spark, model, bad):
    texts, y = sample(1, bad)
    net = model.train(texts, y)
    fresh, labels = sample(2, bad)
    assert ((model.score_texts(net, fresh) >= 0.3) == labels).mean() > 0.95
    score = model.toxicity if model is toxicity else model.quality
    table = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ODD)], "doc_id bigint, text string, score double")
    rows = table.select("doc_id", score("text", net, spark).alias("s")).collect()
    alone = model.score_texts(net, [t or "" for t in ODD])
    assert len(rows) == len(ODD) and all(0 <= r.s <= 1 and abs(r.s - alone[r.doc_id]) < 1e-6 for r in rows)
    assert len(model.score_texts(net, [])) == 0
    assert set(model.score_texts(model.train(texts[:5], np.zeros(5)), ["a", ""])) == {0.5}


def test_toxicity_scores_do_not_depend_on_neighbours():
    texts, y = sample(1, lambda: random.choice(["zorkon", "zorking"]))
    net = toxicity.train(texts, y, epochs=1)
    some = ["", "zorkon", "", "zorkon zorking", "a b", "", "zorking a"]
    together = toxicity.score_texts(net, some + some[::-1])
    alone = np.concatenate([toxicity.score_texts(net, [t]) for t in some])
    assert np.abs(together - np.concatenate([alone, alone[::-1]])).max() < 1e-6


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        data = bytes(1 + i % 250 for i in range(n)).decode("latin-1").encode("latin-1")
        rows = quality_model.chunk_bytes(data.decode("ascii", "ignore"))
        text = data.decode("ascii", "ignore").encode()
        step = quality_model.CHUNK - quality_model.OVERLAP
        joined = b"".join(r[:step].tobytes() for r in rows[:-1]) + rows[-1].tobytes()
        assert joined.rstrip(b"\0") == text.rstrip(b"\0")


def test_sample_is_bounded_and_leaves_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}" if i % 7 else None) for i in range(200)] + [(3, "t3")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 0), (None, 1)], "doc_id bigint, toxic int")
    texts, y = training.labelled_sample(docs, labels, "toxic", training.held_out("doc_id", 4, 2), 20, 100)
    ids = [int(t[1:]) for t in texts]
    assert 0 < len(ids) <= 40 and len(set(ids)) == len(ids) and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert [i % 2 for i in ids] == y.tolist() and 5 not in ids and all(i % 7 for i in ids)
    assert training.labelled_sample(docs, labels.limit(0), "toxic", training.held_out("doc_id", 4, 2), 20, 100)[0] == []


@pytest.mark.parametrize("name, modulus, remainder, label", [("op8_quality_classifier", 5, 0, "quality"), ("op9_toxicity", 4, 2, "toxic")])
def test_classifier_queries(spark, name, modulus, remainder, label):
    larger = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r[label] is not None]
    assert np.mean([r.predicted == r[label] for r in held]) >= 0.95


@pytest.mark.parametrize("labels", [[], [(i, 0) for i in range(9)], [(i, 1) for i in range(9)], [(99, 1), (0, 0), (1, 0)]])
def test_nothing_is_toxic_without_both_labels(spark, tmp_path, labels):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)] + [(None, None)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 10
    assert {(r.score, r.predicted) for r in queries.op9_toxicity(spark, str(tmp_path)).collect()} == {(0.0, 0)}


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("own"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    columns, kept = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        assert after.columns == columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.count() <= kept.count() and after.join(kept, columns, "left_anti").count() == 0
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in packed.collect()}


def test_near_duplicate_stage_of_odd_rows(spark, folder):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long), (1, long + " x"), (1, long + " x"), (None, long), (None, None), (4, None), (5, ""), (6, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], *rows[3:]], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), folder).count() == 0
    wide = docs.selectExpr("doc_id", "text", "1 AS __rows", "2 AS count", "3 AS row", "4 AS component_id", "5 AS node", "6 AS n")
    got = corpus_pipeline.drop_near_duplicates(spark, wide, folder)
    assert got.columns == wide.columns and got.count() == len(kept)


def test_near_duplicates_leave_the_rows_in_place(spark):
    """Rows with their texts are joined where they are, also when Spark broadcasts nothing by itself."""
    texts = [(i, " ".join(f"w{i // 2}_{j}" for j in range(30))) for i in range(20)] + [(None, "w0_1"), (4, "another text")]
    docs, before = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, *range(0, 20, 2)], key=str)
