"""Squads, line-ups, transfers and ledgers."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rosterlake.constants import FORMATIONS, SQUAD_QUOTA
from rosterlake.functions import numbers, text
from rosterlake.functions.players import risk_issues, role_label
from rosterlake.operators import joins, ledger, mentions as module, quality, squad as sq
from rosterlake.operators.mentions import mentions

POOL = "problem_id int, player_id long, element_type int, team_id int, now_cost_millions double, expected_points double"


def pool(seed=1, per_position=(3, 7, 8, 5), problem=0, clubs=8):
    rng = random.Random(seed)
    rows, pid = [], 0
    for pos, n in enumerate(per_position, 1):
        for _ in range(n):
            pid += 1
            rows.append((problem, pid, pos, pid % clubs, round(rng.uniform(4, 12), 1), round(rng.uniform(0, 9), 2)))
    return rows


def fifteen(seed):
    rows = pool(seed, tuple(SQUAD_QUOTA.values()))
    return rows


def test_best_lineup_is_exact(spark):
    rows = [(s, *r[1:]) for s in range(4) for r in fifteen(s)]
    df = spark.createDataFrame(rows, POOL.replace("problem_id", "squad_id"))
    got = {r["squad_id"]: r["xi_points"] for r in sq.best_lineup(df, ["squad_id"]).collect()}
    for s in range(4):
        points = {p: sorted((r[5] for r in fifteen(s) if r[2] == p), reverse=True) for p in SQUAD_QUOTA}
        want = max(sum(sum(points[p][: f[p - 1]]) for p in SQUAD_QUOTA) for f in FORMATIONS)
        assert got[s] == pytest.approx(want)
    lineup = sq.best_lineup(df, ["squad_id"]).filter("squad_id = 0 and starting = 0").orderBy("bench_order").collect()
    assert [r["bench_order"] for r in lineup] == [1, 2, 3, 4] and lineup[-1]["element_type"] == 1


def test_incomplete_squad_has_no_lineup(spark):
    df = spark.createDataFrame(fifteen(1)[:-1], POOL)
    assert sq.best_lineup(df, ["problem_id"]).count() == 0


OUTCOME = ("lineup_id int, player_id long, element_type int, starting int, bench_order int, captain int, vice_captain int, "
           "chip string, hit_cost double, played boolean, points double")


def lineup(absent, chip=None, hit=0.0, bench=(4, 3, 2, 1)):
    xi = [1] + [2] * 4 + [3] * 4 + [4] * 2
    rows = [(1, i + 1, p, 1, None, int(i + 1 == 5), int(i + 1 == 6), chip, hit, (i + 1) not in absent, 2.0) for i, p in enumerate(xi)]
    rows += [(1, 12 + i, p, 0, i + 1, 0, 0, chip, hit, (12 + i) not in absent, 2.0) for i, p in enumerate(bench)]
    return rows


def test_absent_captain_and_starter_are_replaced(spark):
    df = spark.createDataFrame(lineup({5, 8}), OUTCOME)
    row = sq.score_outcomes(df, ["lineup_id"]).first()
    assert row["total_points"] == 24.0 and row["substitutions"] == 2


def test_keeper_hits_and_chips(spark):
    score = lambda rows: sq.score_outcomes(spark.createDataFrame(rows, OUTCOME), ["lineup_id"]).first()["total_points"]
    assert score(lineup({1})) == 24.0
    assert score(lineup({1, 15})) == 22.0
    assert score(lineup(set(), hit=4.0)) == 20.0
    assert score(lineup(set(), chip="bench_boost")) == 32.0
    assert score(lineup(set(), chip="triple_captain")) == 26.0


def brute(rows):
    """The rule in its plain form: all subsets of the playing bench, largest first."""
    starters, bench = [r for r in rows if r[3]], sorted((r for r in rows if not r[3]), key=lambda r: r[4])
    on = [r for r in starters if r[9]]
    missing = 11 - len(on)
    if not any(r[2] == 1 for r in on):
        keeper = [r for r in bench if r[2] == 1 and r[9]][:1]
        on, missing = on + keeper, missing - len(keeper)
    subs = [r for r in bench if r[2] != 1 and r[9]]
    chosen = []
    for size in range(min(missing, len(subs)), 0, -1):
        valid = []
        for c in combinations(subs, size):
            n = [sum(r[2] == p for r in on + list(c)) for p in (1, 2, 3, 4)]
            if n[0] == 1 and n[1] >= 3 and n[2] >= 2 and n[3] >= 1 and sum(n) <= 11:
                valid.append(c)
        if valid:
            chosen = list(valid[0])
            break
    total = sum(r[10] for r in on + chosen)
    leader = next((r for r in rows if r[5] and r[9]), None) or next((r for r in rows if r[6] and r[9]), None)
    return total + (leader[10] if leader else 0.0)


def test_scores_match_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(120):
        formation = rng.choice(FORMATIONS)
        xi = [p for p, n in zip((1, 2, 3, 4), formation) for _ in range(n)]
        rest = [p for p in SQUAD_QUOTA for _ in range(SQUAD_QUOTA[p] - formation[p - 1])]
        outfield = [p for p in rest if p != 1]
        rng.shuffle(outfield)
        mine = [(i, k + 1, p, int(k < 11), None if k < 11 else k - 10, int(k == 4), int(k == 6), None, 0.0,
                 rng.random() < 0.6, float(rng.randint(0, 12))) for k, p in enumerate(xi + outfield + [1])]
        rows, want[i] = rows + mine, brute(mine)
    got = {r["lineup_id"]: r["total_points"] for r in sq.score_outcomes(spark.createDataFrame(rows, OUTCOME), ["lineup_id"]).collect()}
    assert got == want


def test_price_sweep_is_legal_and_below_its_bound(spark):
    rows = pool(3, (12, 28, 32, 20), clubs=20)
    cand = spark.createDataFrame(rows, POOL)
    budgets = spark.createDataFrame([(0, 105.0)], "problem_id int, budget double")
    prices = [0.0, 0.2, 0.4, 0.6, 1.0]
    picked = sq.price_sweep(cand, budgets, prices)
    assert picked.count() and sq.legality(picked, ["problem_id", "price_level"], 105.0).filter("not legal").count() == 0
    best = sq.select_squad(cand, budgets, prices).first()
    assert best["gap"] >= -1e-9 and best["squad_cost"] <= 105.0


def test_sweep_swaps_stay_legal(spark):
    owned = spark.createDataFrame([r for r in pool(4, tuple(SQUAD_QUOTA.values()))], POOL).withColumn("sale_value", F.col("now_cost_millions") - 0.1)
    extra = spark.createDataFrame([(0, 100 + i, i % 4 + 1, 20 + i, 6.0, 9.5) for i in range(8)], POOL)
    banks = spark.createDataFrame([(0, 2.0)], "problem_id int, bank double")
    swaps = sq.sweep_swaps(owned, extra, banks, [0.0, 0.3], 2, 1).collect()
    assert 1 <= len(swaps) <= 2 and all(s["delta"] > 0 for s in swaps)
    assert sum(s["in_price"] - s["sale_value"] for s in swaps) <= 2.0 + 1e-6


def test_sweep_swaps_take_several_newcomers_of_a_club(spark):
    rows = pool(4, tuple(SQUAD_QUOTA.values()))
    owned = spark.createDataFrame([(*r[:3], 50 + i, *r[4:]) for i, r in enumerate(rows)], POOL).withColumn("sale_value", F.lit(6.0))
    extra = spark.createDataFrame([(0, 100 + i, p, 7, 6.0, 90.0 - i) for i, p in enumerate([3, 3, 2, 4])] + [(0, 200, 1, 8, 6.0, 70.0)], POOL)
    banks = spark.createDataFrame([(0, 9.0)], "problem_id int, bank double")
    came = {s["in_id"] for s in sq.sweep_swaps(owned, extra, banks, [0.0], 4, 4).collect()}
    assert len(came) == 4 and 200 in came and len(came & {100, 101, 102, 103}) == 3


def test_problems_without_a_squad_have_a_status(spark):
    cand = spark.createDataFrame(pool(3, (12, 28, 32, 20), clubs=20), POOL)
    budgets = spark.createDataFrame([(0, 105.0), (1, 105.0)], "problem_id int, budget double")
    best = sq.select_squad(cand, budgets, [0.0, 0.2, 0.4, 0.6, 1.0])
    assert {r.problem_id: r.status for r in best.collect()} == {0: "selected", 1: "none found"}


def test_sale_value_halves_gains(spark):
    df = spark.createDataFrame([(55, 59), (55, 50), (55, 56)], "b int, c int")
    assert [r[0] for r in df.select(numbers.sale_value("b", "c")).collect()] == [57, 50, 55]


def test_swap_order_pays_its_way(spark):
    pairs = spark.createDataFrame([(1, 1, 10, 20, 40, 60), (1, 2, 11, 21, 80, 60)],
                                  "manager_id int, pair_no int, out_id long, in_id long, sale_tenths long, price_tenths long")
    banks = spark.createDataFrame([(1, 0)], "manager_id int, bank_tenths int")
    rows = {r["pair_no"]: (r["step"], r["bank_after_tenths"]) for r in ledger.swap_order(pairs, banks, ["manager_id"]).collect()}
    assert rows == {2: (1, 0), 1: (2, 0)}
    stuck = ledger.swap_order(pairs.filter("pair_no = 1"), banks, ["manager_id"]).first()
    assert stuck["step"] is None


def test_pairs_by_rank_with_leftovers(spark):
    schema = "element_type int, player_id long, expected_points double"
    outs = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 3, 5.0)], schema)
    ins = spark.createDataFrame([(1, 11, 9.0), (3, 12, 7.0), (3, 13, 8.0)], schema)
    rows = joins.pair_by_rank(outs, ins, "element_type", "player_id", "expected_points").orderBy("pair_no").collect()
    assert [(r["pass"], r["out_id"], r["in_id"]) for r in rows] == [(1, 2, 11), (2, 1, 13), (2, 3, 12)]
    assert joins.pair_by_rank(outs, ins, "element_type", "player_id", "expected_points", limit=1).count() == 1


def test_round_counts(spark):
    df = spark.createDataFrame([("16:5, 30:3",), ("GW16 gets five",), ("",)], "t string")
    got = [r[0] for r in df.select(text.parse_round_counts("t")).collect()]
    assert got == [{16: 5, 30: 3}, None, {}]
    assert text.round_count_errors(df, "t").count() == 1


def test_summary_rules(spark):
    schema = "squad_id int, player_id long, starting int, bench int, captain int, expected_points double, now_cost_millions double"
    df = spark.createDataFrame([(1, 1, 1, 0, 1, 5.0, 6.0), (1, 2, 1, 0, 0, 3.0, 5.0), (1, 3, 0, 1, 0, 2.0, 4.0),
                                (2, 1, 0, 0, 0, 5.0, 6.0), (2, 2, 0, 0, 0, 3.0, 5.0), (3, 1, 1, 0, 0, 5.0, 6.0), (3, 2, 0, 1, 1, 3.0, 5.0)], schema)
    rows = {r["squad_id"]: r for r in sq.summarise(df, ["squad_id"]).collect()}
    assert rows[1]["total_expected_points_with_captain"] == 13.0 and rows[1]["bench_expected_points"] == 2.0
    assert rows[2]["expected_points_without_captain"] == 8.0 and rows[2]["bench_cost"] == 0.0
    assert rows[3]["captain_ok"] is False
    with pytest.raises(ValueError):
        quality.raise_if_any(sq.summarise(df, ["squad_id"]).filter("not captain_ok"), "captain must start")


def test_risks_and_roles(spark):
    row = spark.range(1).select(
        risk_issues(F.lit("D"), F.lit(75.0), F.lit("Low")).alias("r"), role_label(F.lit(2), F.lit(True), F.lit(False)).alias("l")
    ).first()
    assert row["r"] == ["status=d", "chance_next_round=75%", "low_model_confidence"] and row["l"] == "Starter x2 C"


def test_coverage_finds_the_missing_round(spark):
    df = spark.createDataFrame([("2025-26", r) for r in range(1, 38)], "season_name string, round int")
    assert [tuple(r) for r in quality.missing_periods(df, "season_name", "round").collect()] == [("2025-26", 38)]


def test_mentions_agree_with_brute_force(spark):
    rng = random.Random(2)
    words = ["an", "anna", "bo", "bob", "o'neil", "van", "dijk", "de"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(12)).replace("bo ", "Bo\n")) for i in range(60)]
    names = [("Van Dijk",), ("an",), ("bob de",), ("De  ",), ("nna van",), ("o'neil an",)]
    df = spark.createDataFrame(texts, "id int, body string")
    want = sorted((i, n) for i, t in texts for (n,) in names if n.lower() in t.lower())
    got = mentions(df, spark.createDataFrame(names, "name string"), "id", "body", "name")
    assert sorted(map(tuple, got.collect())) == want


def test_mentions_over_cuts_scripts_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(module, "STRETCH", 7)
    rows = [("a", "Zoë Ångström met O'Neil"), ("b", None), ("c", ""), ("d", "水野 太郎 and 水"), ("e", "xx" * 40 + "ab"), ("a", "again zoë ångström"), (None, "Ab")]
    names = [("ZOË ångström",), ("水野 太郎",), ("水",), ("ab",), ("",), ("  ",), (None,), ("x" * 81,), ("x" * 80 + "ab",), ("nowhere at all",), ("zoë ångström",)]
    df = spark.createDataFrame(rows, "id string, body string")
    got = mentions(df.repartition(3), spark.createDataFrame(names, "name string"), "id", "body", "name")
    want = {(i, n) for i, t in rows for (n,) in names if n and n.strip() and n.lower() in (t or "").lower()}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert mentions(df, spark.createDataFrame([], "name string"), "id", "body", "name").collect() == []
    assert mentions(df.limit(0), spark.createDataFrame(names, "name string"), "id", "body", "name").collect() == []


def test_mentions_of_names_that_share_a_common_word(spark):
    """The rarest gram leads, so 2,000 names "the thing N" don't meet every text that holds "the"."""
    names = [(f"the thing x{i}",) for i in range(2_000)]
    texts = [(i, f"over the thing y{i} the end" if i % 50 else f"and The Thing x{i} is") for i in range(400)]
    df = spark.createDataFrame(texts, "id long, body string")
    got = mentions(df, spark.createDataFrame(names, "name string"), "id", "body", "name")
    assert sorted((r.id, r.name) for r in got.collect()) == sorted((i, n) for i, b in texts for (n,) in names if n in b.lower())


def test_pairs_of_many_squads_with_limit_and_without_a_position(spark):
    schema = "squad long, pos int, player_id long, ep double"
    outs = spark.createDataFrame([(1, 1, 10, 1.0), (1, 1, 11, 2.0), (1, None, 12, 0.5), (2, 2, 20, 1.0)], schema)
    ins = spark.createDataFrame([(1, 1, 30, 5.0), (1, 2, 31, 4.0), (1, 2, 32, 9.0), (2, 1, 40, 3.0)], schema)
    got = joins.pair_by_rank(outs, ins, "pos", "player_id", "ep", squad=["squad"]).orderBy("squad", "pair_no").collect()
    assert [(r.squad, r.pair_no, r["pass"], r.out_id, r.in_id) for r in got] == [(1, 1, 1, 10, 30), (1, 2, 2, 12, 32), (1, 3, 2, 11, 31), (2, 1, 2, 20, 40)]
    assert joins.pair_by_rank(outs, ins, "pos", "player_id", "ep", limit=1, squad=["squad"]).count() == 2


def test_analysis_record_of_every_squad(spark):
    from rosterlake.plans.analysis import analysis_context

    schema = "squad_id int, player_id long, element_type int, team_id int, now_cost_millions double, expected_points double"
    rows = [(k, *r[1:]) for k in (1, 2) for r in pool(20 + k, tuple(SQUAD_QUOTA.values()), k)] + [(3, 900, 1, 1, 5.0, 2.0)]
    squads = spark.createDataFrame(rows, schema).withColumns({
        "player_id": F.col("squad_id") * 1000 + F.col("player_id"), "full_name": F.lit("x"), "starting": F.lit(None).cast("int"), "bench": F.lit(None).cast("int"), "captain": F.lit(0),
        "status": F.when(F.col("squad_id") == 2, "i").otherwise("a"),
    })
    forecasts = squads.select("player_id", F.explode(F.array(F.lit(4), F.lit(6))).alias("gameweek"), "expected_points")
    pairs = spark.createDataFrame([(1, 5.0, 50, 60), (1, 1.0, 40, 40)], "squad_id int, delta double, out_sale_tenths int, in_price_tenths int")
    optimum = spark.createDataFrame([(1, 200.0, [1001, 7])], "squad_id int, objective double, players array<long>")
    got = {r.squad_id: r.context for r in analysis_context(squads, forecasts, squads, [4, 5, 6], pairs, optimum).collect()}
    assert set(got) == {1, 2, 3}
    one, two, three = got[1], got[2], got[3]
    assert tuple(one.analysis_scope) == (4, [4, 6], [5]) == tuple(three.analysis_scope)
    assert len(one.user_squad.players) == 15 and len(one.captaincy_options) == 3 and len(one.horizon_top_targets) == 10
    assert (one.transfer_plan.transfers, one.transfer_plan.net_gain) == (2, 2.0) and two.transfer_plan is None
    assert one.optimal_comparison.optimal_points == 200.0 and one.optimal_comparison.shared == 1 and one.optimal_comparison.points_gap > 0 and two.optimal_comparison is None
    assert len(one.lineup_advice.starting) == 11 and len(one.lineup_advice.bench) == 4 and three.lineup_advice is None
    assert one.risk_flags == [] and len(two.risk_flags) == 15 and two.risk_flags[0].issues == ["status=i"]
    totals = {r[0] * 1000 + r[1]: 2 * r[5] for r in rows}
    assert [t.player_id for t in one.horizon_top_targets] == sorted(totals, key=lambda i: (-totals[i], i))[:10]
