"""Steps that must stay spread out, narrow and exact on large tables; the tables here are made by the tests."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake import session
from rosterlake.catalog import form, frames, squads
from rosterlake.operators import mentions, squad as sq
from rosterlake.plans import features, ml

OWNED = "problem_id int, player_id long, element_type int, team_id int, now_cost_millions double, expected_points double, sale_value double"


@pytest.fixture
def tables(spark, tmp_path):
    parts, lines, orders = 800, 4_000, 1_000
    spark.range(parts).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 20 + 1).alias("p_brand"),
        (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") * 7 % 1000 / 10.0).alias("p_retailprice"),
    ).write.parquet(f"{tmp_path}/part.parquet")
    i = F.col("id")
    spark.range(lines).select(
        (i / 4).cast("long").alias("l_orderkey"), (i * 13 % parts).alias("l_partkey"), (i * 7 % 11).alias("l_suppkey"), (i % 4).cast("int").alias("l_linenumber"),
        (i % 17 + 1).cast("double").alias("l_quantity"), (i * 31 % 9_000 * 10.0).alias("l_extendedprice"), F.element_at(F.array(F.lit("A"), F.lit("N")), (i % 2 + 1).cast("int")).alias("l_returnflag"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(orders).select(
        i.alias("o_orderkey"), F.date_add(F.lit("1996-01-01").cast("date"), (i % 700).cast("int")).cast("timestamp_ntz").alias("o_orderdate")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_newcomers_of_many_squads_are_spread_over_tasks(spark, tables):
    owned = spark.range(400).select(F.col("id").alias("problem_id"), F.explode(F.array(*[F.lit(p) for p in (1, 2, 3, 4)])).alias("element_type"))
    found = squads.newcomers(spark, tables, owned).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 1
    sizes = found.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("ids"))
    assert sizes.select("n", "ids").distinct().count() == 1 and sizes.count() == 400


def test_swaps_are_searched_for_once(spark):
    rows, pid = [], 0
    for position, n in ((1, 2), (2, 5), (3, 5), (4, 3)):
        for _ in range(n):
            pid += 1
            rows.append((0, pid, position, pid % 8, 5.0, 1.0 + pid / 10, 5.0))
    owned = spark.createDataFrame(rows, OWNED)
    extra = spark.createDataFrame([(0, 100 + k, k % 4 + 1, 20 + k, 4.0 + k % 3, 2.0 + k) for k in range(12)], OWNED.removesuffix(", sale_value double"))
    banks = spark.createDataFrame([(0, 1.5), (7, 1.0)], "problem_id int, bank double")
    out = sq.sweep_swaps(owned, extra, banks, [0.0, 0.3], 2, 1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    got = {(r.problem_id, r.swap_no): r for r in out.collect()}
    assert set(got) == {(0, 1), (0, 2), (7, None)} and got[7, None].status == "none found"
    first, second = got[0, 1], got[0, 2]
    assert first.price_level == second.price_level and (first.out_id, first.in_id) != (second.out_id, second.in_id)
    assert first.net_gain == second.net_gain == pytest.approx(first.delta + second.delta - 4)
    assert first.in_price + second.in_price - first.sale_value - second.sale_value <= 1.5


def test_folds_do_not_shuffle_the_rows(spark):
    rows = spark.range(200_000).select("id", (F.col("id") % 9).alias("period"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        placed = ml.with_fold(rows, ["period"], 2)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r.period, r.fold) for r in placed.select("period", "fold").distinct().collect()} == {(p, 0 if p < 3 else p // 3) for p in range(9)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_matches_are_dealt_by_the_number_of_lines(spark, tables, monkeypatch):
    before = {tuple(r) for r in form.team_form_dedup(spark, tables).collect()}
    monkeypatch.setattr(form, "LINES_A_TASK", 100)
    assert form.match_sides(spark, tables).rdd.getNumPartitions() == 40
    assert {tuple(r) for r in form.team_form_dedup(spark, tables).collect()} == before and before


def test_checksums_equal_the_sums_of_decimals(spark):
    values = [0.0, 0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, -0.1234575, 1 / 3, -2 / 3, 4_000.0000005, -4_000.5, 123_456_789.1234565, None, 1e-9, 90.0, 2.675]
    df = spark.createDataFrame([(v, None, k) for k, v in enumerate(values)], "a double, b double, c int")
    want = df.agg(*[F.sum(F.round(F.col(c).cast("double"), 6).cast("decimal(20,6)")).cast("double").alias(c) for c in "abc"]).first()
    got = {r.name: r.total for r in frames.checksums(df, ["a", "b", "c"]).collect()}
    assert got == {"n_rows": 15.0, "a": round(want.a, 6), "b": None, "c": 105.0}
    plan = frames.checksums(df, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "4.0E9" in plan  # the decimal is left to values of 4,000 and more, and to halves


def swaps_by_hand(owned, pool, bank, prices, max_swaps, free):
    """All pairs of one squad, as the SQL lists them: (price, [(out, in)]) or nothing."""
    best = None
    clubs = [r[3] for r in owned]
    for price in prices:
        pairs = sorted(
            (-((i[5] - price * i[4]) - (o[5] - price * o[6])), o[1], i[1], o[3], i[3], i[5] - o[5], i[4] - o[6])
            for o in owned for i in pool if o[2] == i[2] and i[1] not in {r[1] for r in owned}
        )
        taken = []
        for _ in range(max_swaps):
            for p in pairs:
                count = clubs.count(p[4]) + sum(t[4] == p[4] for t in taken) - sum(t[3] == p[4] for t in taken) - (p[3] == p[4])
                if p[0] < 0 and count < 3 and not any(t[1] == p[1] or t[2] == p[2] for t in taken):
                    taken.append(p)
                    break
        for k in range(1, len(taken) + 1):
            net = round(sum(t[5] for t in taken[:k]) - 4 * max(0, k - free), 9)
            if sum(t[6] for t in taken[:k]) <= bank + 1e-6 and net > 0 and (best is None or (-net, k, price) < best[0]):
                best = (-net, k, price), [(t[1], t[2]) for t in taken[:k]]
    return best and (best[0][2], best[1])


@pytest.mark.parametrize("clubs, max_swaps", [(4, 2), (6, 3), (30, 2)])
def test_swaps_reach_everyone_in_a_shared_pool(spark, clubs, max_swaps):
    quota, prices, n = {1: 2, 2: 5, 3: 5, 4: 3}, [0.0, 0.3, 0.8], 12
    position = [p for p, q in quota.items() for _ in range(q * n)]
    pool = [(0, k, p, k * 7 % 11 % clubs, 4.0 + k * 13 % 37 / 10, k * 29 % 23 / 2) for k, p in enumerate(position)]
    squads_ = {s: [(s, *r[1:], r[4] - 0.1) for p, q in quota.items() for r in [x for x in pool if x[2] == p][s * q : (s + 1) * q]] for s in range(n)}
    owned = spark.createDataFrame([r for rows in squads_.values() for r in rows], OWNED)
    schema = OWNED.removesuffix(", sale_value double")
    shared = spark.createDataFrame(pool, schema).drop("problem_id")
    banks = spark.createDataFrame([(s, 1.5) for s in squads_], "problem_id int, bank double")
    each = shared.crossJoin(banks.select("problem_id"))
    want = {s: swaps_by_hand(rows, pool, 1.5, prices, max_swaps, 1) for s, rows in squads_.items()}
    assert any(want.values())
    for candidates in (shared, each):
        got = {}
        for r in sorted(sq.sweep_swaps(owned, candidates, banks, prices, max_swaps, 1).collect(), key=lambda r: (r.problem_id, r.swap_no or 0)):
            got[r.problem_id] = (r.price_level, [*(got.get(r.problem_id) or (0, []))[1], (r.out_id, r.in_id)]) if r.swap_no else None
        assert got == want


def test_swaps_take_a_part_behind_the_best_of_its_price(spark, tmp_path):
    """Every part costs the same, and the twelve best of each position are of a club that fills the first squad."""
    parts, lines = [], []
    for position in (1, 2, 3, 4):
        for k in range(40):
            pid = position * 100 + k
            club, points = (1 if k == 0 else 10 + pid, 1.0) if k < 5 else (1, 8.0) if k < 17 else (pid, 5.0 if k == 30 else 0.5)
            parts.append((pid, f"part {pid}", f"Brand#{club}", position - 1, 100.0))
            lines.append((pid, 1, points * 10_000, "N", 1.0))
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_extendedprice double, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = squads.swap_sweep(spark, str(tmp_path))
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString()  # squads and newcomers share one pass over the lines
    first = sorted((r.swap_no, r.out_id, r.in_id, r.status) for r in out.filter("problem_id = 0").collect())
    assert first == [(1, 100, 130, "selected"), (2, 200, 205, "selected")]  # the first swap makes room for one of the club's best


def test_a_panel_laid_out_by_player_is_not_shuffled_for_training(spark):
    stats = "minutes double, total_points double, goals_scored double, saves double, expected_goals string, value double"
    rows = []
    for k in range(240):
        player, round_, home = k % 12, k // 12 % 10 + 1, k % 2 == 0
        fixture = None if k % 37 == 0 else round_ * 10 + k % 3
        rows.append((
            player, "2024-25" if k < 120 else "2025-26", round_, fixture, f"2025-08-{round_:02d}T15:00:00Z", home, None if k % 29 == 0 else k % 5, None if k % 23 == 0 else (k + 1) % 5,
            k % 4, k % 3, float(k % 91), None if k % 7 == 0 else float(k % 13), float(-(k % 3)), 127.0 + k % 2, f"0.{k % 9}", k % 60 + 0.5,
        ))
    hist = spark.createDataFrame([*rows, *rows[5:9]], "player_id long, season_name string, round int, fixture int, kickoff_time string, was_home boolean, team int, opponent_team int, "
                                 f"team_h_score int, team_a_score int, {stats}")
    elements = spark.createDataFrame([(p, p % 5, p % 4 + 1) for p in range(12)], "player_id long, team_id int, element_type int")
    frames = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for pieces in (None, 3):
            prepared = features.laid_out(features.prepare_history(hist, elements, pieces=pieces), pieces)
            with session.fewer_keys(spark):
                frame = features.training_frame(prepared, 9, pieces=pieces)
                plan = frame._jdf.queryExecution().executedPlan().toString()
                dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(player_id" in x and "ENSURE_REQUIREMENTS" in x]
                assert bool(dealt) == (pieces is None)
                frames.append(sorted((tuple(r) for r in frame.collect()), key=repr))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert frames[0] == frames[1] and len(frames[0]) > 100


def test_grams_are_counted_in_little_memory(monkeypatch):
    """How many texts hold a gram, in the same memory for a batch of any size; cuts anywhere count the same."""
    rng = np.random.default_rng(5)
    texts = ["".join("abc "[k] for k in rng.integers(0, 4, n)) for n in (0, 3, 40, 5, 0, 700, 12, 12, 1, 90)]
    raw, offsets = mentions._flat(pa.array(texts))
    everything = np.full(mentions.BITS // 8, 255, dtype=np.uint8)
    want = {}
    for t in texts:
        for length in (2, 6):
            for gram in {t[k : k + length] for k in range(len(t) - length + 1)}:
                want[gram] = want.get(gram, 0) + 1
    for stretch, counts in ((16, 8), (64, 1000), (1 << 18, 1 << 19)):
        monkeypatch.setattr(mentions, "STRETCH", stretch)
        monkeypatch.setattr(mentions, "COUNTS", counts)
        gram, n = mentions._merged([*mentions._held(raw, offsets, [2, 6], everything)])
        assert len(gram) == len(want) and sorted(n) == sorted(want.values()) and n.sum() == sum(want.values())
    monkeypatch.undo()
    words = rng.integers(97, 123, 1 << 23).astype(np.uint8)
    ends = np.arange(0, len(words) + 1, 2048)
    tracemalloc.start()
    try:
        assert sum(n.sum() for _, n in mentions._held(words, ends, [2], everything)) > 1 << 20
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
