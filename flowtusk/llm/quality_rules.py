"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Every metric is a column expression over one text, so a document costs one pass of its task and no
shuffle. Intermediate arrays are columns of their own; expressions over elements only look at the
element and its neighbours by index, so the cost grows with n log n at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtusk.llm.common import ASCII_SPACE, ASCII_SPACES, text_or_empty

WINDOW = 5

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his are this at from or have an they which one you "
    "all her she there would their le la les de des du un une et en est que qui dans pour par sur avec au ce il pas "
    "ne se el los las del y una con su lo al es no como der die das und den von zu mit sich auf ist im dem nicht ein "
    "eine als auch").split()

#: Fixed value: the characters that count as symbols.
SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """`metric` must lie in low..high (None: open) for texts of at least `least` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The thresholds. Clean prose keeps far from all of them in every language tested.
RULES = (
    Rule("word length", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop words", "stop_word_ratio", low=0.03, least=50),
    Rule("repeated lines", "dup_line_ratio", high=0.5),
    Rule("bullet lines", "bullet_line_ratio", high=0.9, least=50),
    Rule("ellipsis lines", "ellipsis_line_ratio", high=0.5, least=50),
)


def _count(array: str, test) -> Column:
    return F.size(F.filter(array, test)).cast("bigint")


def base_counts(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """`keep` columns and __-prefixed counts of each text."""
    spaced = F.btrim(F.col("__text"), F.lit(ASCII_SPACES))
    words = F.when(F.length(spaced) == 0, F.array().cast("array<string>")).otherwise(
        F.split(spaced, ASCII_SPACE + "+"))
    frame = docs.select(*keep, text_or_empty(text).alias("__text"))
    frame = frame.select("*", words.alias("__words"), F.filter(
        F.split("__text", "\n"), lambda line: F.length(F.btrim(line, F.lit(ASCII_SPACES))) > 0).alias("__lines"))
    frame = frame.withColumn("__hashes", F.transform("__words", lambda word: F.xxhash64(word)))
    hashes = F.col("__hashes")
    windows = F.when(F.size(hashes) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])))
    frame = frame.select(
        *keep, "__words", "__lines",
        F.length(F.regexp_replace("__text", SYMBOLS, "")).cast("bigint").alias("__n_symbols"), windows.alias("__windows"))
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    # Only texts with a repeated window sort theirs: equal ones come together.
    ranked = F.when(repeated, F.sort_array(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    frame = frame.withColumn("__ranked", ranked).drop("__windows")
    rank = F.col("__ranked")
    beside = F.zip_with(
        rank, F.concat(F.array(F.lit(None).cast("bigint")), rank["w"]),
        lambda a, b: F.struct(a["w"].alias("w"), a["i"].alias("i"), b.alias("before")))
    beside = F.slice(beside, F.lit(1), F.size(rank))
    frame = frame.withColumn("__beside", F.when(rank.isNotNull(), beside)).drop("__ranked")
    near = F.col("__beside")
    # A window is repeated if it equals the one before or the one after in this order.
    pairs = F.zip_with(near, F.slice(near, F.lit(2), F.size(near)), lambda a, b: F.when(
        (a["w"] == a["before"]) | (a["w"] == b["w"]), a["i"]))
    frame = frame.withColumn("__starts", F.when(
        near.isNotNull(), F.sort_array(F.filter(pairs, lambda p: p.isNotNull())))).drop("__beside")
    starts = F.col("__starts")
    # A window covers the words up to the next repeated window, WINDOW at most.
    covered = F.aggregate(
        F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))),
                   lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda a, b: a + b)
    stop = [F.lit(w) for w in STOP_WORDS]
    return frame.select(
        *keep, F.size("__words").cast("bigint").alias("__n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("__word_chars"), "__n_symbols",
        F.size("__lines").cast("bigint").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("__n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("__n_repeat_words"),
        _count("__words", lambda w: F.lower(w).isin(*stop)).alias("__n_stop_words"),
        _count("__lines", lambda line: line.rlike(r"^\s*[-*•]")).alias("__n_bullet_lines"),
        _count("__lines", lambda line: line.rlike(r"(\.\.\.|…)\s*$")).alias("__n_ellipsis_lines"))


#: Each metric is one count per other; 0 where there is nothing to count.
METRICS = {
    "mean_word_chars": ("__word_chars", "__n_words"),
    "symbols_per_word": ("__n_symbols", "__n_words"),
    "stop_word_ratio": ("__n_stop_words", "__n_words"),
    "dup_line_ratio": ("__n_dup_lines", "__n_lines"),
    "bullet_line_ratio": ("__n_bullet_lines", "__n_lines"),
    "ellipsis_line_ratio": ("__n_ellipsis_lines", "__n_lines"),
}


def broken_rules(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a text breaks, over the columns of `base_counts`."""
    def broken(rule: Rule) -> Column:
        part, whole = METRICS[rule.metric]
        metric = F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (metric < rule.low)
        if rule.high is not None:
            outside = outside | (metric > rule.high)
        return F.when(outside & (F.col("__n_words") >= rule.least), F.lit(rule.name))

    return F.array_compact(F.array(*[broken(rule) for rule in rules]))


def judge_documents(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None,
                    rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts, broken rules and verdict of every text.

    Keeps the columns `keep` (all by default) and adds the struct `quality`: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, broken (names of rules), kept. A null
    text counts as empty and fails the base rule. Rows are judged one by one, so repeated rows and
    rows without id are no special case; a column `quality` of the input is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "quality"]
    # What is kept travels as one column, so none of its names can clash with those used here.
    kept = F.struct(*[docs[c] for c in keep]) if keep else F.lit(0)
    counts = base_counts(docs.select(docs[text].alias("__source"), kept.alias("__kept")), "__source", ["__kept"])
    base_failed = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))
    broken = broken_rules(rules)
    return counts.select(*[F.col("__kept")[c].alias(c) for c in keep], F.struct(
        F.col("__n_words").alias("n_words"), F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"), F.col("__n_dup_lines").alias("n_dup_lines"),
        F.col("__n_repeat_words").alias("n_repeat_words"), base_failed.alias("base_failed"), broken.alias("broken"),
        (~base_failed & (F.size(broken) == 0)).alias("kept")).alias("quality"))


def kept_documents(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs`, with its columns, whose text keeps the base rule and all others."""
    whole = docs.select(docs[text].alias("__source"), F.struct(*[docs[c] for c in docs.columns]).alias("document"))
    judged = judge_documents(whole, "__source", ["document"], rules)
    # A row number in the condition keeps the optimizer from pushing it down: it would repeat every
    # intermediate array inside the expressions over its elements.
    numbered = judged.withColumn("__row", F.monotonically_increasing_id())
    return numbered.filter(F.col("quality.kept") & (F.col("__row") >= 0)).select("document.*")
