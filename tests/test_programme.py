"""The dynamic programme against listing every squad."""

import random
from itertools import combinations, product

import numpy as np
import pytest

from rosterlake.constants import FORMATIONS, MAX_PER_CLUB, SQUAD_QUOTA
from rosterlake.operators import programme

POOL = "problem_id int, player_id long, element_type int, team_id int, now_cost_millions double, expected_points double"


def pool(seed, sizes, clubs, problem=0):
    rng = random.Random(seed)
    rows, n = [], 0
    for p, size in zip(SQUAD_QUOTA, sizes):
        for _ in range(size):
            rows.append((problem, problem * 1_000 + n, p, rng.randint(1, clubs), rng.randint(40, 100) / 10, float(rng.randint(0, 40)) / 4))
            n += 1
    return rows


def value(squad):
    best = None
    for formation in FORMATIONS:
        eleven, rest = [], []
        for p, n in zip(SQUAD_QUOTA, formation):
            points = sorted((r[5] for r in squad if r[2] == p), reverse=True)
            eleven, rest = eleven + points[:n], rest + points[n:]
        total = sum(eleven) + max(eleven) + 0.25 * sum(rest)
        best = total if best is None or total > best else best
    return best


def listed(rows, budget, owned=(), most_new=15, free=0):
    """The best value of all legal squads, or None."""
    mine, best = {r[1] for r in owned}, None
    price = {r[1]: round(r[4] * 10) for r in rows} | {r[1]: round(r[6] * 10) for r in owned}
    limit = round(budget * 10) + sum(price[i] for i in mine)
    everyone = [r for r in rows if r[1] not in mine] + [r[:6] for r in owned]
    for parts in product(*[combinations([r for r in everyone if r[2] == p], q) for p, q in SQUAD_QUOTA.items()]):
        squad = [r for part in parts for r in part]
        new = sum(r[1] not in mine for r in squad)
        clubs = [r[3] for r in squad]
        if sum(price[r[1]] for r in squad) > limit or (owned and new > most_new) or max(map(clubs.count, clubs)) > MAX_PER_CLUB:
            continue
        total = value(squad) - (4.0 * max(0, new - free) if owned else 0.0)
        best = total if best is None or total > best else best
    return best


def best_of(spark, rows, budgets, **kw):
    found = programme.best_squads(spark.createDataFrame(rows, POOL), spark.createDataFrame(budgets, "problem_id int, budget double"), **kw)
    return {r.problem_id: r for r in found.collect()}


def test_small_pools_equal_listing(spark):
    pools = {k: pool(k, (3, 6, 6, 4), 3 + k % 5, k) for k in range(40)}
    budgets = {k: 88.0 + 3 * (k % 9) for k in pools}
    found = best_of(spark, [r for rows in pools.values() for r in rows], list(budgets.items()))
    want = {k: listed(rows, budgets[k]) for k, rows in pools.items()}
    assert {k: None if v is None else pytest.approx(v) for k, v in want.items()} == {k: r.objective for k, r in found.items()}
    assert {r.status for r in found.values()} == {"best", "none"}
    for k, r in found.items():
        assert (r.status == "none") == (want[k] is None)
        if r.status == "best":
            squad = [x for x in pools[k] if x[1] in r.players]
            assert value(squad) == pytest.approx(r.objective) and r.gap == pytest.approx(0)
            assert r.squad_cost == pytest.approx(sum(x[4] for x in squad)) and r.squad_cost <= budgets[k] + 1e-9
            assert r.squad_points == pytest.approx(sum(x[5] for x in squad)) and len(squad) == 15


def test_transfers_equal_listing(spark):
    owned, rows, want, banks = [], [], {}, []
    for k in range(12):
        mine = [(*r[:3], 10 + i % 6, *r[4:], r[4] - 0.1) for i, r in enumerate(pool(50 + k, tuple(SQUAD_QUOTA.values()), 4, k))]
        others = [(r[0], r[1] + 500, r[2], 10 + r[3], *r[4:]) for r in pool(80 + k, (1, 2, 2, 1), 6, k)]
        owned, rows, banks = owned + mine, rows + others + [r[:6] for r in mine], banks + [(k, 0.5 * (k % 4))]
        want[k] = listed(others, 0.5 * (k % 4), mine, 2, 1)
    mine = spark.createDataFrame(owned, POOL + ", sale_value double")
    found = best_of(spark, rows, banks, owned=mine, max_transfers=2, free_transfers=1)
    assert {k: r.objective for k, r in found.items()} == {k: None if v is None else pytest.approx(v) for k, v in want.items()}
    assert max(r.newcomers for r in found.values() if r.objective is not None) <= 2


def test_a_large_pool_is_pruned_to_its_prices(spark):
    rows = pool(7, (300, 900, 900, 500), 20)
    docs = spark.createDataFrame(rows, POOL)
    found = best_of(spark, rows, [(0, 100.0)])[0]
    assert found.status == "best" and len(found.players) == 15 and found.squad_cost <= 100.0 + 1e-9
    kept = programme.prune(docs, "problem_id").toArrow()
    assert kept.num_rows <= 61 * 4 * 27
    chosen = [r for r in rows if r[1] in found.players]
    assert max(sum(r[3] == c for r in chosen) for c in range(21)) <= MAX_PER_CLUB


def test_a_club_that_holds_the_best_players(spark):
    rows = [(*r[:3], 1 if i % 3 else 2 + i // 3 % 9, r[4], r[5] + (5.0 if i % 3 else 0.0)) for i, r in enumerate(pool(9, (8, 20, 20, 12), 9))]
    found = best_of(spark, rows, [(0, 100.0)])[0]
    assert found.status in ("best", "selected") and found.gap >= -1e-9
    assert sum(r[3] == 1 for r in rows if r[1] in found.players) <= MAX_PER_CLUB


def test_splits_end_with_a_gap(spark):
    rows = [(*r[:3], 1 + i % 6, *r[4:]) for i, r in enumerate(pool(9, (6, 14, 14, 9), 9))]
    exact, cut = (best_of(spark, rows, [(0, 100.0)], splits=n)[0] for n in (20_000, 0))
    assert exact.status == "best"
    assert cut.status in ("selected", "none found", "best") and (cut.bound is None or cut.bound >= exact.objective - 1e-6)


def test_every_problem_has_a_row(spark):
    rows = pool(3, (3, 6, 6, 4), 9) + [(1, 9_001, 1, 1, 5.0, 2.0), (0, 9_002, 1, 1, None, 2.0), (0, 9_003, None, 1, 4.0, 2.0), (0, 9_004, 2, None, 4.0, None)]
    found = best_of(spark, rows, [(0, 130.0), (1, 100.0), (2, 100.0), (3, None)])
    assert {k: r.status for k, r in found.items()} == {0: "best", 1: "none", 2: "none", 3: "none"}
    assert best_of(spark, [], []) == {}


def small_pool(seed: int, newcomers: int) -> programme.Pool:
    rng = np.random.default_rng(seed)
    position = np.repeat([1, 2, 3, 4], [2, 5, 5, 3])
    position = np.concatenate((position, position))
    new = np.repeat([0, newcomers], 15)
    points = np.round(rng.uniform(1, 9, 30), 6)
    order = np.lexsort((np.arange(30), -points, position))
    pool = programme.Pool(np.arange(30), position, rng.integers(0, 7, 30), rng.integers(40, 140, 30), points, new)
    return pool.take(order)


@pytest.mark.parametrize("seed", range(6))
def test_small_problems_are_listed(monkeypatch, seed):
    pool = small_pool(seed, 1)
    fee = lambda n: 4.0 * max(0, n - 1)
    budget = int(pool.price[pool.new == 0].sum()) + 15
    by_price = programme.solve(pool, budget, 2, fee, listed=0)

    def never(*_):
        raise AssertionError("two transfers of fifteen players give some 1,600 squads at most")

    monkeypatch.setattr(programme, "relaxed", never)
    value, squad, bound, proven = programme.solve(pool, budget, 2, fee)
    assert proven and by_price[3] and (value is None) == (by_price[0] is None)
    if value is not None:
        assert value == pytest.approx(by_price[0]) and set(squad) == set(by_price[1]) and bound == value


@pytest.mark.parametrize("seed", range(3))
def test_listed_positions_agree_with_the_count_by_price(monkeypatch, seed):
    pool = small_pool(seed, 0)
    budget = int(pool.price[:15].sum())
    listed = programme.solve(pool, budget, 15, lambda n: 0.0)
    monkeypatch.setattr(programme, "CHOICES", -1)
    by_price = programme.solve(pool, budget, 15, lambda n: 0.0)
    assert listed[3] and by_price[3] and listed[0] == pytest.approx(by_price[0]) and set(listed[1]) == set(by_price[1])
