import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtusk.operators import statistics as st


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 900).astype(str), "x": np.round(rng.gamma(2, 3, 900), 1),
                          "y": rng.integers(0, 9, 900).astype(float)})
    frame["z"] = frame.x * 2 - frame.y
    frame.loc[:299, "x"] = 4.0  # a third of all rows share one value
    return frame, spark.createDataFrame(frame).cache()


def test_moments(data):
    pdf, df = data
    row = st.sample_moments(df, "x").first()
    centred = pdf.x - pdf.x.mean()
    assert row["mean"] == pytest.approx(pdf.x.mean()) and row.variance == pytest.approx(pdf.x.var())
    assert row.skewness == pytest.approx((centred**3).mean() / pdf.x.var(ddof=0) ** 1.5)
    assert row.kurtosis == pytest.approx((centred**4).mean() / pdf.x.var(ddof=0) ** 2 - 3)
    assert st.sample_adev(df, "x").first().adev == pytest.approx(centred.abs().mean())
    grouped = {r.g: r.adev for r in st.sample_adev(df, "x", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert grouped[g] == pytest.approx((part.x - part.x.mean()).abs().mean())


def test_constant_and_single_rows(spark):
    one = spark.createDataFrame([(3.0, 4.0)], "x double, y double")
    row = st.sample_moments(one, "x").first()
    assert (row["mean"], row.variance, row.skewness, row.kurtosis) == (3.0, 0.0, 0.0, 0.0)
    assert st.cov2(one, "x", "y").first().cov == 0 and st.pearson_corr2(one, "x", "y").first().corr == 0
    assert st.spearman_corr2(one, "x", "y").first().corr == 0
    same = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "x double, y double")
    assert st.sample_skewness(same, "x").first().skewness == 0
    assert st.sample_kurtosis(same, "x").first().kurtosis == 0
    assert st.pearson_corr2(same, "x", "y").first().corr == 0


PERCENTILES = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]


def test_percentiles(data):
    pdf, df = data
    row = st.sample_percentile(df, "x", PERCENTILES).first()
    assert list(row) == pytest.approx(list(np.quantile(pdf.x, PERCENTILES)))
    for r in st.sample_percentile(df, "x", PERCENTILES, ["g"]).collect():
        assert list(r)[1:] == pytest.approx(list(np.quantile(pdf[pdf.g == r.g].x, PERCENTILES)))
    assert st.sample_median(df, "y").first().median == pdf.y.median()
    with pytest.raises(ValueError):
        st.sample_percentile(df, "x", [1.5])


def test_percentiles_skip_nulls_and_take_one_row(spark):
    df = spark.createDataFrame([(None,), (7.0,)], "x double")
    assert list(st.sample_percentile(df, "x", [0.0, 0.5, 1.0]).first()) == [7.0, 7.0, 7.0]


def test_correlations(data):
    pdf, df = data
    assert st.cov2(df, "x", "z").first().cov == pytest.approx(pdf.x.cov(pdf.z))
    assert st.pearson_corr2(df, "x", "z").first().corr == pytest.approx(pdf.x.corr(pdf.z))
    want = pdf.x.rank().corr(pdf.z.rank())
    assert st.spearman_corr2(df, "x", "z").first().corr == pytest.approx(want)


@pytest.mark.parametrize("function,method", [(st.cov_matrix, None), (st.pearson_matrix, "pearson"),
                                             (st.spearman_matrix, "spearman")])
def test_matrices(data, function, method):
    pdf, df = data
    names = ["x", "y", "z"]
    ranked = pdf[names].rank() if method == "spearman" else pdf[names]
    want = ranked.cov() if method is None else ranked.corr()
    got = {(r.i, r.j): r.v for r in function(df, names).collect()}
    assert len(got) == 9
    for key, value in got.items():
        assert value == pytest.approx(want.loc[key])
    assert {(r.i, r.j) for r in function(df, ["x"], ["y", "z"]).collect()} == {("x", "y"), ("x", "z")}


def test_row_ranks(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, 5.0, 9.0), (2, 1.0, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, d double")
    rows = {r.id: list(r)[1:] for r in st.rank_data(df, ["a", "b", "c", "d"]).collect()}
    assert rows == {1: [1.5, 0.0, 1.5, 3.0], 2: [1.5] * 4}
    centred = {r.id: list(r)[1:] for r in st.rank_data(df, ["a", "b", "c", "d"], centered=True).collect()}
    assert all(sum(v) == 0 for v in centred.values())
    packed = df.select("id", F.array("a", "b", "c", "d").alias("v"))
    assert {r.id: r.v for r in st.rank_array(packed, "v").collect()} == rows
    assert {r.id: r.v for r in st.rank_array(packed, "v", centered=True).collect()} == centred


def test_row_ranks_leave_nulls_out(spark):
    df = spark.createDataFrame([(3.0, None, 1.0), (None, None, None)], "a double, b double, c double")
    assert [tuple(r) for r in st.rank_data(df, ["a", "b", "c"]).collect()] == [(1.0, None, 0.0), (None, None, None)]
    assert tuple(st.rank_data(df, ["a", "b", "c"], centered=True).first()) == (0.5, None, -0.5)
    packed = df.select(F.array("a", "b", "c").alias("v"))
    assert st.rank_array(packed, "v").first().v == [1.0, None, 0.0]
    assert st.rank_array(packed, "v", centered=True).first().v == [0.5, None, -0.5]


def test_nan_stays_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (4.0, 7.0)], "x double, y double")
    row = st.sample_moments(df, "x").first()
    assert all(np.isnan(v) for v in row)
    assert np.isnan(st.cov2(df, "x", "y").first().cov) and np.isnan(st.pearson_corr2(df, "x", "y").first().corr)
    matrix = {(r.i, r.j): r.v for r in st.cov_matrix(df, ["x", "y"]).collect()}
    assert np.isnan(matrix["x", "y"]) and not np.isnan(matrix["y", "y"])


def test_rank_matrix_uses_complete_rows_and_few_jobs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (2.0, None, 1.0), (3.0, 1.0, 4.0), (4.0, 5.0, 6.0)], "x double, y double, z double")
    pdf = df.toPandas().dropna()
    got = {(r.i, r.j): r.v for r in st.spearman_matrix(df, ["x", "y", "z"]).collect()}
    want = pdf.rank().corr()
    assert all(v == pytest.approx(want.loc[k]) for k, v in got.items())


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2)], "x double, n bigint")
    row = st.sample_percentile(df, "x", [0.0, 0.5, 0.9, 1.0], weight="n").first()
    assert list(row) == pytest.approx(list(np.quantile([1, 1, 1, 5, 9, 9], [0.0, 0.5, 0.9, 1.0])))


@pytest.mark.parametrize("limit, ranged", [(0, True), (40, True), (1_000_000, False)])
def test_matrix_ranks_by_counts_or_by_sorting(spark, monkeypatch, limit, ranged):
    rows = [(float(i % 7), float(i * 37 % 101), float("nan") if i % 50 == 0 else float(i % 3)) for i in range(200)] + [(None, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    want = sorted(map(tuple, st.column_ranks(table, ["a", "b", "c"]).collect()))
    monkeypatch.setattr(st, "BROADCAST_RANKS", limit)
    ranks = st.column_ranks(table, ["a", "b", "c"])
    assert sorted(map(tuple, ranks.collect())) == want and len(want) == 196  # no null, no NaN
    assert min(r[0] for r in want) == (len([r for r in rows if r[0] == 0.0 and r[2] == r[2]]) - 1) / 2
    # Without columns of many values no row is shuffled.
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert ("__turn" in plan or "turn" in plan) == ranged
