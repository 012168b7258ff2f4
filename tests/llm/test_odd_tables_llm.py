"""Every text query on empty tables, and on tables with columns that clash with the operators' own."""

import pytest

import __spark_entry__
from flowtusk.llm.queries import QUERIES

TABLES = ["documents", "embeddings", "pages", "labels", "conversations"]
CLASHES = ("row chunk piece place position n node part keys counts block size chance target gram at cold wide c p count "
           "__rows __text __words words runs collapsed text_ doc path host lines marks message events kind seq").split()


@pytest.fixture(scope="module")
def folders(spark, folder, tmp_path_factory):
    """The first rows of every table as they are, with clashing columns, and without rows."""
    root, out = tmp_path_factory.mktemp("odd"), {}
    for kind in ("plain", "wide", "empty"):
        out[kind] = str(root / kind)
        for name in TABLES:
            table = spark.read.parquet(f"{folder}/{name}.parquet").limit(40).coalesce(1)
            if kind == "wide":
                table = table.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES if c not in table.columns])
            elif kind == "empty":
                table = table.filter("false")
            table.write.parquet(f"{out[kind]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_queries_on_wide_and_empty_tables(spark, folders, name):
    run = __spark_entry__.queries()[name]
    empty = run(spark, folders["empty"])
    assert empty.count() == (1 if name == "op7_chat_formatting" else 0)
    if name in ("op1_token_counts", "op5_html_extraction", "pipeline", "op7_chat_formatting", "op10_best_fit_packing", "op13_periodic_runs"):
        plain, wide = run(spark, folders["plain"]), run(spark, folders["wide"])
        assert wide.columns == plain.columns and wide.count() == plain.count() > 0
    else:
        assert run(spark, folders["wide"]).columns == empty.columns
