"""Split plans, ordinary plans and pandas give the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import ordered as o
from rosterlake.operators import panel


def make(seed, n=400):
    """A panel in which one key holds a third of all rows, with nulls and ties."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 12, n))
    return pd.DataFrame({
        "k": key, "t": rng.integers(0, 60, n), "id": np.arange(n),
        "v": np.where(rng.random(n) < 0.2, np.nan, rng.normal(10, 3, n).round(2)),
    })


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for i in a:
        for x, y in zip(a[i], b[i]):
            assert (x is None) == (y is None or y != y), (i, a[i], b[i])
            if x is not None:
                assert x == pytest.approx(y, abs=1e-9), (i, a[i], b[i])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("is_hot", [False, True])
def test_form_matches_pandas(spark, seed, is_hot):
    pdf = make(seed)
    want = pdf.sort_values(["k", "t", "id"])
    grouped = want.groupby("k")["v"]
    want["ma"] = grouped.transform(lambda x: x.shift(1).rolling(5, min_periods=1).mean())
    want["lag"] = grouped.shift(1)
    got = panel.form(spark_frame(spark, pdf), ["k"], ["t", "id"], ["v"], hot=is_hot)
    close(by_id(got, "v_ma5", "v_lag1"), {r.id: (r.ma, r.lag) for r in want.itertuples()})


@pytest.mark.parametrize("is_hot", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_numbered_and_running(spark, is_hot, keys):
    pdf = make(3)
    want = pdf.sort_values([*keys, "t", "id"])
    grouped = want.groupby(keys) if keys else want.groupby(lambda _: 0)
    want["no"] = grouped.cumcount() + 1
    want["top"] = grouped["v"].transform(lambda x: x.cummax().ffill())
    df = spark_frame(spark, pdf)
    got = o.numbered(df, keys, ["t", "id"], "no", hot=is_hot)
    assert by_id(got, "no") == {r.id: (r.no,) for r in want.itertuples()}
    got = o.running(df, keys, ["t", "id"], {"top": ("max", F.col("v"))}, hot=is_hot)
    close(by_id(got, "top"), {r.id: (r.top,) for r in want.itertuples()})


def test_hot_group_is_found(spark, hot):
    df = spark_frame(spark, make(4))
    assert o.is_hot(df, ["k"]) and o.is_hot(df, ["k"], "id")
    plan = o.numbered(df, ["k"], ["t", "id"])._jdf.queryExecution().toString()
    assert "_piece" in plan or "Scan ExistingRDD" in plan


def test_percentiles_equal_numpy(spark, hot):
    pdf = make(5).dropna()
    got = {r["k"]: (r["a"], r["b"]) for r in o.percentiles(spark_frame(spark, pdf), ["k"], "v", {"a": 0.1, "b": 0.5}).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(tuple(np.percentile(g["v"], [10, 50])))


def test_percentile_of_1_2_4_8(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    assert o.percentiles(df, [], "v", {"p": 0.1}).first()["p"] == pytest.approx(1.3)


def test_collect_parts_keeps_every_row(spark, hot):
    df = spark_frame(spark, make(6))
    parts = o.collect_parts(df, ["k"], ["t", "id"], F.col("id"), "ids", part_rows=7)
    assert parts.agg(F.max(F.size("ids"))).first()[0] <= 7
    rows = parts.orderBy("k", "part_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r["k"], []).extend(r["ids"])
    want = {k: list(g["id"]) for k, g in make(6).sort_values(["k", "t", "id"]).groupby("k")}
    assert got == want


def test_top_rows_limits_before_the_shuffle(spark):
    plan = o.first_row(spark_frame(spark, make(7)), ["k"], ["t", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Final")


def test_bounded_scan_is_the_sequential_fold(spark):
    from rosterlake.operators import ledger

    rng = np.random.default_rng(8)
    n = 1500
    pdf = pd.DataFrame({
        "m": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 9, n)), "gameweek": np.arange(n),
        "transfers": rng.integers(0, 4, n), "chip": rng.choice(["", "wildcard", "free_hit"], n, p=[0.9, 0.05, 0.05]),
    })
    got = {r["gameweek"]: (r["free_transfers_before"], r["free_transfers_after"])
           for r in ledger.free_transfers(spark.createDataFrame(pdf), ["m"], topups={700: 4}).collect()}
    for _, g in pdf.groupby("m"):
        free = 1
        for r in g.itertuples():
            before = free
            if r.chip not in ("wildcard", "free_hit"):
                free = min(5, max(0, free - min(r.transfers, free)) + 1)
            if r.gameweek + 1 == 700:
                free = min(5, max(free, 4))
            assert got[r.gameweek] == (before, free)


def test_distinct_sizes_are_estimated_for_large_groups_alone(spark, hot, monkeypatch):
    rows = [(t, f, p) for t in range(5) for f in range(2) for p in range(1)] + [(None, f, p) for f in range(2) for p in range(4)]
    df = spark.createDataFrame(rows, "team int, fixture int, player int")
    counted = []

    def estimated(column, real=F.approx_count_distinct):
        counted.append(column)
        return real(column)

    monkeypatch.setattr(F, "approx_count_distinct", estimated)
    assert not o.is_hot(df.filter("team is not null"), ["team"], "fixture") and not counted
    assert not o.is_hot(df, ["team"], "fixture") and counted  # eight rows, but two matches
    assert o.is_hot(df, ["team"], "player")  # four players
