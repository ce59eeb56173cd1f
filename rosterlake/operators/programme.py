"""Budgeted selection that finds the best squad there is (L2R): a dynamic programme over price in tenths, per problem.

Spark prunes and groups, one task solves one problem, and any number of problems are solved side by side. Before the
grouping a position keeps, of each price and club, the three best, and of each price as many as could ever be used, so what a
task gets is bounded by the number of prices, not by the candidates. Inside a problem, a candidate is dropped when enough
clubs offer a cheaper or equal one with as many points; that never costs the best squad.

A position's candidates are taken in falling order of points, so that the first ones chosen are its starters: the programme
keeps, for each number of chosen players, of newcomers and each price, the best value. Positions are joined over all
formations and captains. The club limit is left out of the programme: prices on clubs (Lagrange multipliers) move the bound
down and give first squads, then problems in which a club has too many are split by leaving one of four of its players out,
best bound first, until the bound is reached. Where a problem has no more than ``LISTED`` squads, they are all listed instead.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import BENCH_WEIGHT, FORMATIONS, MAX_PER_CLUB, SQUAD_QUOTA, SQUAD_SIZE, TRANSFER_HIT_COST
from rosterlake.operators.ordered import top_rows

# the solver travels with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Problems split off at most before the best squad so far is returned with its distance from the bound.
SPLITS = 200
#: Positions with at most so many choices of their quota have them listed, instead of counted up price by price.
CHOICES = 1_000
#: Problems with at most so many squads are solved by listing them.
LISTED = 20_000
_ROUNDS = 30
_EPS = 1e-9
_FULL_CLUBS = (SQUAD_SIZE - 1) // MAX_PER_CLUB


def prune(candidates: DataFrame, problem: str) -> DataFrame:
    """The candidates that can be in a best squad, as far as one price level tells: three of a club, and of these so many
    that one from a club with a free place is left whoever else is chosen."""
    price = F.ceil(F.round(F.col("now_cost_millions") * 10, 6)).cast("int")
    sound = candidates.filter(
        F.col("expected_points").isNotNull() & F.col("now_cost_millions").isNotNull() & F.col("element_type").isin(*SQUAD_QUOTA)
    ).withColumns({"_price": price, "_club": F.coalesce(F.col("team_id").cast("long"), F.lit(-1))})
    level = [problem, "element_type", "_price"]
    of_club = top_rows(sound, [*level, "_club"], ["-expected_points", "player_id"], MAX_PER_CLUB)
    return top_rows(of_club, level, ["-expected_points", "player_id"], MAX_PER_CLUB * (max(SQUAD_QUOTA.values()) + _FULL_CLUBS))


@dataclass
class Pool:
    """A problem's candidates, by position in falling order of points."""

    id: np.ndarray
    position: np.ndarray
    club: np.ndarray
    price: np.ndarray
    points: np.ndarray
    new: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> "Pool":
        columns = [np.asarray(rows[c]) for c in ("player_id", "element_type", "_club", "_price", "expected_points", "_new")]
        order = np.lexsort((columns[0], -columns[4], columns[1]))
        pool = cls(*(c[order] for c in columns))
        return pool.take(pool._needed())

    def take(self, mask: np.ndarray) -> "Pool":
        return Pool(*(getattr(self, f)[mask] for f in ("id", "position", "club", "price", "points", "new")))

    def _needed(self) -> np.ndarray:
        """False where so many clubs have a player of the position with as many points for no more money that one can always
        take the place. Owned players stay, as only they cost no transfer."""
        keep = np.ones(len(self.id), dtype=bool)
        for p, quota in SQUAD_QUOTA.items():
            at = np.flatnonzero((self.position == p) & (self.new > 0)) if self.new.any() else np.flatnonzero(self.position == p)
            for k, i in enumerate(at):  # those before it have as many points
                better = at[:k][self.price[at[:k]] <= self.price[i]]
                keep[i] = len(np.unique(self.club[better])) < quota + _FULL_CLUBS
        return keep


@functools.lru_cache(maxsize=256)
def _choices(n: int, quota: int) -> np.ndarray:
    """All choices of ``quota`` out of n, those without the last ones first."""
    rows = np.array(sorted(itertools.combinations(range(n), quota), key=lambda c: c[::-1]), dtype=np.int64)
    return rows.reshape(len(rows), quota)


class Position:
    """The best value of every choice of a position's quota, by newcomers (axis 0), variant and most money spent (last axis).
    A variant is (starters, whether the captain is among them); the k-th best of a choice counts ``weights[k]`` times."""

    def __init__(self, pool: Pool, at: np.ndarray, quota: int, starters: Sequence[int], budget: int, most_new: int, charge: np.ndarray):
        self.pool, self.at, self.quota = pool, at, quota
        self.variants = [(n, captain) for n in starters for captain in (False, True)]
        weights = np.array([[1.0] * n + [BENCH_WEIGHT] * (quota - n) for n, _ in self.variants])
        weights[:, 0] += [captain for _, captain in self.variants]
        self.rows = _choices(len(at), quota) if math.comb(len(at), quota) <= CHOICES and np.isfinite(pool.points[at]).all() else None
        if self.rows is not None:
            self._list(weights, budget, most_new, charge)
            return
        held = np.full((quota + 1, most_new + 1, len(self.variants), budget + 1), -np.inf)
        held[0, 0] = 0.0
        self.taken = np.zeros((len(at), *held.shape), dtype=bool)
        for row, i in enumerate(at):
            price, n = int(pool.price[i]), int(pool.new[i])
            if price > budget:
                continue
            for k in range(quota - 1, -1, -1):
                gain = weights[:, k] * pool.points[i] - charge[i]
                made = held[k, : most_new + 1 - n, :, : budget + 1 - price] + gain[:, None]
                old = held[k + 1, n:, :, price:]
                better = made > old + _EPS
                np.copyto(old, made, where=better)
                self.taken[row, k + 1, n:, :, price:] = better
        self.best = held[quota]

    def _list(self, weights: np.ndarray, budget: int, most_new: int, charge: np.ndarray) -> None:
        players = self.at[self.rows]
        self.cost, self.new = self.pool.price[players].sum(axis=1), self.pool.new[players].sum(axis=1)
        self.gain = self.pool.points[players] @ weights.T - charge[players].sum(axis=1)[:, None]
        self.best = np.full((most_new + 1, len(weights), budget + 1), -np.inf)
        for n in range(most_new + 1):
            rising = np.flatnonzero(self.new == n)
            rising = rising[np.argsort(self.cost[rising], kind="stable")]
            upto = np.vstack((np.full(len(weights), -np.inf), np.maximum.accumulate(self.gain[rising], axis=0)))
            self.best[n] = upto.T[:, np.searchsorted(self.cost[rising], np.arange(budget + 1), side="right")]

    def values(self, starters: int, captain: bool) -> np.ndarray:
        return self.best[:, self.variants.index((starters, captain))]

    def picks(self, starters: int, captain: bool, new: int, money: int) -> list[int]:
        out, k, v = [], self.quota, self.variants.index((starters, captain))
        if self.rows is not None:
            open_to = (self.new == new) & (self.cost <= money)
            row = np.flatnonzero(open_to & (self.gain[:, v] >= self.best[new, v, money] - _EPS))[0]
            return self.at[self.rows[row]][::-1].tolist()
        for row in range(len(self.at) - 1, -1, -1):
            if k and self.taken[row, k, new, v, money]:
                i = int(self.at[row])
                out.append(i)
                k, new, money = k - 1, new - int(self.pool.new[i]), money - int(self.pool.price[i])
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best sum of both for every number of newcomers and most money spent: each step of one over the whole of the other."""
    out = np.full(a.shape, -np.inf)
    for s in range(len(a)):
        steps = np.flatnonzero(a[s] > np.concatenate(([-np.inf], a[s][:-1])))
        for t in range(len(b) - s):
            into, other = out[s + t], b[t]
            for c in steps:
                np.maximum(into[c:], a[s, c] + other[: len(other) - c], out=into[c:])
    return out


def _split(a: np.ndarray, b: np.ndarray, new: int, money: int) -> tuple[int, int]:
    """Newcomers and money that the first of two joined tables gets."""
    sums = np.stack([a[s, : money + 1] + b[new - s, money::-1] for s in range(new + 1)])
    return divmod(int(sums.argmax()), money + 1)


def relaxed(pool: Pool, usable: np.ndarray, budget: int, most_new: int, fee, charge: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The best squad without the club limit, each player charged ``charge``; none if there is none within budget."""
    budget = min(budget, int(pool.price.sum()))
    if budget < 0:
        return None
    most_new = min(most_new, int(pool.new.sum()))
    tables = {
        p: Position(pool, np.flatnonzero((pool.position == p) & usable), quota, sorted({f[k] for f in FORMATIONS}), budget, most_new, charge)
        for k, (p, quota) in enumerate(SQUAD_QUOTA.items())
    }
    known: dict[tuple, np.ndarray] = {}

    def pair(p: int, q: int, n: int, m: int, captain: int) -> np.ndarray:
        key = (p, q, n, m, captain if captain in (p, q) else 0)
        if key not in known:
            known[key] = _joined(tables[p].values(n, captain == p), tables[q].values(m, captain == q))
        return known[key]

    top = None
    for formation in FORMATIONS:
        gk, df, md, fw = formation
        for captain in SQUAD_QUOTA:
            ends, middle = pair(1, 4, gk, fw, captain), pair(2, 3, df, md, captain)
            for new in range(most_new + 1):
                value = max(float((ends[s] + middle[new - s, ::-1]).max()) for s in range(new + 1)) - fee(new)
                if value > -np.inf and (top is None or value > top[0] + _EPS):
                    top = value, formation, captain, new
    if top is None:
        return None
    value, (gk, df, md, fw), captain, new = top
    squad: list[int] = []
    s, c = _split(pair(1, 4, gk, fw, captain), pair(2, 3, df, md, captain), new, budget)
    for p, q, n, m, t, money in ((1, 4, gk, fw, s, c), (2, 3, df, md, new - s, budget - c)):
        x, y = tables[p].values(n, captain == p), tables[q].values(m, captain == q)
        u, spent = _split(x, y, t, money)
        squad += tables[p].picks(n, captain == p, u, spent) + tables[q].picks(m, captain == q, t - u, money - spent)
    return value, np.array(squad)


def value_of(pool: Pool, squad: np.ndarray) -> tuple[float, int]:
    """Points of the best eleven, of its captain again, and a part of the bench's, with the formation's number."""
    by_position = {p: np.sort(pool.points[squad[pool.position[squad] == p]])[::-1] for p in SQUAD_QUOTA}
    options = []
    for number, formation in enumerate(FORMATIONS, 1):
        eleven = np.concatenate([by_position[p][:n] for p, n in zip(SQUAD_QUOTA, formation)])
        rest = np.concatenate([by_position[p][n:] for p, n in zip(SQUAD_QUOTA, formation)])
        options.append((float(eleven.sum() + eleven.max() + BENCH_WEIGHT * rest.sum()), -number))
    value, number = max(options)
    return value, -number


def _crossed(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Every choice of the first with every choice of the second, by their newcomers."""
    out: list[list[np.ndarray]] = [[] for _ in a]
    for s, x in enumerate(a):
        for t, y in enumerate(b[: len(a) - s]):
            if len(x) and len(y):
                out[s + t].append(np.hstack((np.repeat(x, len(y), axis=0), np.tile(y, (len(x), 1)))))
    width = a[0].shape[1] + b[0].shape[1]
    return [np.vstack(rows) if rows else np.empty((0, width), dtype=np.int64) for rows in out]


def squads_of(pool: Pool, most_new: int, limit: int) -> list[np.ndarray] | None:
    """All choices that fill the quota, by their newcomers, a position's players in falling order of points; none if there
    are more than ``limit``."""
    old, new = ([np.flatnonzero((pool.position == p) & (pool.new == n)) for p in SQUAD_QUOTA] for n in (0, 1))
    most_new = min(most_new, int(pool.new.sum()))
    ways = np.ones(1)
    for quota, a, b in zip(SQUAD_QUOTA.values(), old, new):
        of_position = [float(math.comb(len(b), s) * math.comb(len(a), quota - s)) for s in range(min(quota, most_new) + 1)]
        ways = np.convolve(ways, of_position)[: most_new + 1]
        if ways.sum() > limit:
            return None
    made = None
    for quota, a, b in zip(SQUAD_QUOTA.values(), old, new):
        choices = []
        for s in range(most_new + 1):
            rows = [x + y for x in itertools.combinations(a.tolist(), quota - s) for y in itertools.combinations(b.tolist(), s)] if s <= quota else []
            choices.append(np.sort(np.array(rows, dtype=np.int64).reshape(len(rows), quota), axis=1))
        made = choices if made is None else _crossed(made, choices)
    return made


def best_listed(pool: Pool, squads: list[np.ndarray], budget: int, fee) -> tuple[float, np.ndarray] | None:
    """The best of these squads within budget and club limit."""
    best = None
    for new, rows in enumerate(squads):
        rows = rows[pool.price[rows].sum(axis=1) <= budget]
        clubs = np.sort(pool.club[rows], axis=1)
        rows = rows[(clubs[:, MAX_PER_CLUB:] != clubs[:, :-MAX_PER_CLUB]).all(axis=1)]
        if not len(rows):
            continue
        points = np.split(pool.points[rows], np.cumsum(list(SQUAD_QUOTA.values()))[:-1], axis=1)
        upto = [np.cumsum(p, axis=1) for p in points]
        eleven = np.max([sum(u[:, n - 1] for u, n in zip(upto, f)) for f in FORMATIONS], axis=0)
        captain = np.max([p[:, 0] for p in points], axis=0)
        values = eleven + captain + BENCH_WEIGHT * (sum(u[:, -1] for u in upto) - eleven) - fee(new)
        top = int(values.argmax())
        if best is None or values[top] > best[0] + _EPS:
            best = float(values[top]), rows[top]
    return best


def solve(pool: Pool, budget: int, most_new: int, fee, splits: int = SPLITS, listed: int = LISTED) -> tuple[float | None, np.ndarray | None, float | None, bool]:
    """(value, squad, bound, proven). Without a squad the first two are missing; proven says that there is none."""
    squads = squads_of(pool, most_new, listed) if np.isfinite(pool.points).all() and budget >= 0 and most_new >= 0 else None
    if squads is not None:
        found = best_listed(pool, squads, budget, fee)
        return (*found, found[0], True) if found else (None, None, None, True)
    clubs, of = np.unique(pool.club, return_inverse=True)
    everyone, free = np.ones(len(pool.id), dtype=bool), np.zeros(len(clubs))
    of_all, of_owned = (np.minimum(np.bincount(of[mask], minlength=1), MAX_PER_CLUB).sum() for mask in (everyone, pool.new == 0))
    if of_all < SQUAD_SIZE or of_owned < SQUAD_SIZE - most_new:  # too few places in the clubs, or too many players to sell
        return None, None, None, True
    best: tuple[float, np.ndarray] | None = None

    def over(squad: np.ndarray) -> np.ndarray:
        return np.bincount(of[squad], minlength=len(clubs)) - MAX_PER_CLUB

    def offered(squad: np.ndarray) -> bool:
        """Whether the squad is legal; if so it may be the best one so far."""
        nonlocal best
        if (over(squad) > 0).any():
            return False
        value = value_of(pool, squad)[0] - fee(int(pool.new[squad].sum()))
        if best is None or value > best[0] + _EPS:
            best = value, squad
        return True

    def bounded(usable: np.ndarray, prices: np.ndarray) -> tuple[float, np.ndarray] | None:
        found = relaxed(pool, usable, budget, most_new, fee, prices[of])
        return found and (found[0] + MAX_PER_CLUB * float(prices.sum()), found[1])

    def repaired(squad: np.ndarray, usable: np.ndarray, prices: np.ndarray) -> None:
        """Legal squads near one that is not: clubs with too many keep their three best of it and no others."""
        usable = usable.copy()
        while (excess := over(squad)).max() > 0:
            for club in np.flatnonzero(excess > 0):
                mine = squad[of[squad] == club]
                usable &= of != club
                usable[mine[np.argsort(-pool.points[mine], kind="stable")][:MAX_PER_CLUB]] = True
            found = bounded(usable, prices)
            if found is None:
                return
            squad = found[1]
        offered(squad)

    def priced(usable: np.ndarray, prices: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray] | None:
        """The lowest bound met, the prices on clubs that give it and the squad that they give."""
        low, scale = None, 1.0
        for _ in range(rounds):
            found = bounded(usable, prices)
            if found is None:
                return None
            if low is None or found[0] < low[0] - _EPS:
                low = found[0], found[1], prices
            else:
                scale /= 2
            excess = over(found[1])
            if not offered(found[1]):
                repaired(found[1], usable, prices)
            step = np.where((excess > 0) | (prices > 0), excess, 0)
            if not step.any() or (best and low[0] <= best[0] + _EPS):
                break
            gap = max(found[0] - best[0], 0.0) if best else 0.05 * max(abs(found[0]), 1.0)
            prices = np.maximum(0.0, prices + scale * gap / float((step * step).sum()) * step)
        return low

    first = priced(everyone, free, _ROUNDS)
    if first is None:
        return None, None, None, True
    waiting, seen, n = [(-first[0], 0, frozenset(), first[1], first[2])], {frozenset()}, 0
    while waiting and -waiting[0][0] > (best[0] if best else -np.inf) + _EPS:
        bound, _, out, squad, prices = heapq.heappop(waiting)
        usable = everyone.copy()
        usable[list(out)] = False
        if (over(squad) <= 0).all():  # legal, yet prices on clubs with free places keep the bound up
            found = bounded(usable, free)
            if -found[0] >= bound and offered(found[1]):
                continue
            squad, bound = found[1], max(bound, -found[0])
            if offered(squad):
                continue
        if n >= splits:
            return (*(best or (None, None)), -bound, False)
        worst = int(over(squad).argmax())
        for i in squad[of[squad] == worst][: MAX_PER_CLUB + 1]:  # every legal squad does without one of these
            rest = out | {int(i)}
            if rest in seen:
                continue
            seen.add(rest)
            n += 1
            without = usable.copy()
            without[i] = False
            got = priced(without, prices, 3)
            if got:
                heapq.heappush(waiting, (max(bound, -got[0]), n, rest, got[1], got[2]))
    return (*best, best[0], True) if best else (None, None, None, True)


RESULT = "status string, objective double, bound double, gap double, squad_points double, squad_cost double, newcomers int, formation_no int, players array<long>"
_ARROW = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]


def best_squads(
    candidates: DataFrame, budgets: DataFrame, problem: str = "problem_id", owned: DataFrame | None = None, max_transfers: int | None = None,
    free_transfers: int = 0, hit: float = TRANSFER_HIT_COST, splits: int = SPLITS,
) -> DataFrame:
    """One row for each row of ``budgets`` (``problem``, budget in millions): the squad that has the most points in its best
    eleven, its captain's again and a quarter of its bench's, under quota, club limit and budget.

    ``status``: 'best' (no better squad exists), 'selected' (stopped after ``splits``; ``gap`` is the distance from the bound),
    'none' (no such squad exists), 'none found'. ``players`` are the ids, by position. Ties are broken by the solver.

    With ``owned`` (``problem``, the candidates' columns and sale_value) the squad is reached from an owned one: owned players
    cost their sale value, the budget is the bank plus all sale values, at most ``max_transfers`` players are new, and each
    beyond ``free_transfers`` costs ``hit`` points, which the objective has lost.

    Prices count in tenths, other prices are rounded up. Candidates without points, price or position take no part; those
    without a club form one. A candidate may stand in one row of a problem only.
    """
    columns = [problem, "player_id", "element_type", "_club", "_price", "expected_points"]
    pool = prune(candidates, problem) if owned is None else prune(candidates.join(owned.select(problem, "player_id"), [problem, "player_id"], "left_anti"), problem)
    pool = pool.select(*columns, F.lit(0 if owned is None else 1).alias("_new"))
    asked = budgets.select(problem, F.floor(F.round(F.col("budget") * 10, 6)).cast("long").alias("_budget"))
    if owned is not None:
        worth = F.floor(F.round(F.col("sale_value") * 10, 6)).cast("int")
        kept = owned.withColumns({"_price": worth, "_club": F.coalesce(F.col("team_id").cast("long"), F.lit(-1)), "_new": F.lit(0)})
        pool = pool.unionByName(kept.select(*columns, "_new"))
        sales = kept.groupBy(problem).agg(F.sum("_price").alias("_sales"))
        asked = asked.join(sales, problem, "left").select(problem, (F.col("_budget") + F.coalesce("_sales", F.lit(0))).alias("_budget"))
    typed = [F.col("player_id").cast("long"), F.col("element_type").cast("int"), F.col("_club"), F.col("_price"), F.col("expected_points").cast("double"), F.col("_new")]
    most_new = SQUAD_SIZE if max_transfers is None else max_transfers
    kind = asked.schema[problem].dataType

    paid = hit if owned is not None else 0.0

    def fee(newcomers: int) -> float:
        return paid * max(0, newcomers - free_transfers)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        known = Pool.of(right)
        for budget in left["_budget"].to_pylist():
            value, squad, bound, proven = solve(known, budget, most_new, fee, splits) if budget is not None and right.num_rows else (None, None, None, True)
            if squad is None:
                rows.append(("none" if proven else "none found", None, bound, None, None, None, None, None, []))
                continue
            squad = squad[np.lexsort((known.id[squad], known.position[squad]))]
            points, price, new = known.points[squad].sum(), known.price[squad].sum(), known.new[squad].sum()
            rows.append(("best" if proven else "selected", value, bound, bound - value, float(points), price / 10.0, int(new), value_of(known, squad)[1], known.id[squad].tolist()))
        return pa.table([left["_problem"], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW)]], names=[problem, *[f.split()[0] for f in RESULT.split(", ")]])

    return asked.withColumnRenamed(problem, "_problem").groupBy("_problem").cogroup(pool.select(problem, *typed).groupBy(problem)).applyInArrow(run, f"{problem} {kind.simpleString()}, {RESULT}").filter(
        F.col("status").isNotNull()
    )
