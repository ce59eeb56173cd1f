"""Position-aligned swaps of whole squads, in numpy: for each price of money the pair of highest value that fits, then the next (L2R).

What a squad can take is ranked the same for every squad: by points less price times cost. Only few rows of that ranking can
ever be reached, whatever a squad owns; :func:`useful` keeps these, and no others matter.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import MAX_PER_CLUB, SQUAD_SIZE
from rosterlake.operators.ordered import top_rows

# the search travels with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Squads whose pairs are valued at a time.
SQUADS = 512
FIELDS = {"player_id": "long", "team_id": "string", "element_type": "string", "expected_points": "double", "price": "double"}
FOUND = "price_level double, swap_no int, out_id long, in_id long, delta double, sale_value double, in_price double, net_gain double"
NO_ID = -(2**63)


def useful(pool: DataFrame, keys: Sequence[str], prices: Sequence[float], max_swaps: int) -> DataFrame:
    """The rows of a pool that a search for ``max_swaps`` swaps can reach, for each number of a price, without loss for any squad.

    Before the last swap a squad has at most ``SQUAD_SIZE // MAX_PER_CLUB + max_swaps - 1`` full clubs. Of a club at most the squad's
    own players and those taken before are passed over to reach the next; of a position these and all rows of the full clubs. Ids
    count once in a club, by the row of the highest score.
    """
    per_club = SQUAD_SIZE + max_swaps
    per_position = per_club * (SQUAD_SIZE // MAX_PER_CLUB + max_swaps - 1) + SQUAD_SIZE + max_swaps
    ep, cost = F.col("expected_points").cast("double"), F.col("now_cost_millions").cast("double")
    score = [ep - F.lit(float(p)) * cost for p in prices]
    of_price = F.array(*[
        F.max(F.when(s.isNotNull(), F.struct(s.alias("score"), (-ep).alias("less"), (-cost).alias("cheap")))) for s in score
    ])
    each = pool.filter(F.col("element_type").isNotNull()).groupBy(*keys, "element_type", "team_id", "player_id").agg(of_price.alias("_best"))
    ranked = each.select(*keys, "element_type", "team_id", "player_id", F.posexplode("_best").alias("price_no", "_b")).filter(F.col("_b").isNotNull()).select(
        *keys, "element_type", "team_id", "player_id", "price_no", F.col("_b.score").alias("_score"),
        (-F.col("_b.less")).alias("expected_points"), (-F.col("_b.cheap")).alias("now_cost_millions"),
    )
    order = ["-_score", "player_id", "team_id"]
    of_club = top_rows(ranked, [*keys, "price_no", "element_type", "team_id"], order, per_club)
    return top_rows(of_club, [*keys, "price_no", "element_type"], order, per_position).drop("_score")


def as_rows(df: DataFrame, price: str, keys: Sequence[str], price_no: str | None = None) -> DataFrame:
    """Owned players (without a price's number) or newcomers, in the columns that the search reads."""
    renamed = df.withColumn("price", F.col(price))
    no = F.col(price_no) if price_no else F.lit(-1)
    return renamed.select(*keys, no.cast("int").alias("price_no"), *[F.col(c).cast(t).alias(c) for c, t in FIELDS.items()])


def collected(pool: DataFrame) -> pa.StructArray:
    """A shared pool that :func:`useful` has cut down, each price's rows by id. Its size depends on the number of prices and
    positions alone."""
    rows = as_rows(pool, "now_cost_millions", [], "price_no").orderBy("price_no", "player_id", "team_id").toArrow()
    return rows.combine_chunks().to_struct_array().combine_chunks() if rows.num_rows else pa.StructArray.from_arrays([c.combine_chunks() for c in rows.columns], rows.column_names)


def _numbers(rows: pa.StructArray) -> dict[str, np.ndarray]:
    def floats(name: str) -> np.ndarray:
        return rows.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    return {
        "no": rows.field("price_no").to_numpy(zero_copy_only=False), "id": rows.field("player_id").fill_null(NO_ID).to_numpy(zero_copy_only=False),
        "ep": floats("expected_points"), "price": floats("price"),
    }


def _codes(values: pa.Array, null: int | None = None) -> np.ndarray:
    """Equal values get equal numbers; null is one of the values, or gets the number given."""
    codes = values.dictionary_encode("encode")
    out = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return out if null is None else np.where(values.is_null().to_numpy(zero_copy_only=False), null, out)


def _first_fitting(own: dict, pool: dict, at: dict, counts: np.ndarray, taken: list[dict]) -> dict:
    """For each squad the pair of highest value that fits after those taken; ties go to the lower ids. Value 0: there is none."""
    size = len(counts)
    squads = np.arange(size)
    best = {"value": np.zeros(size), "out": np.zeros(size, dtype=np.int64), "in": np.zeros(size, dtype=np.int64)}
    out_id, in_id = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for places, real, hold in at.values():
        club, new = pool["club"][hold], pool["id"][hold]
        ids, clubs = np.take_along_axis(own["id"], places, 1), np.take_along_axis(own["club"], places, 1)
        held, free = counts[:, club], ~own["has"][:, pool["no_of_id"][hold]]
        stays = real.copy()
        for t in taken:
            held = held + (t["in_club"][:, None] == club) - (t["out_club"][:, None] == club)
            free &= t["in_id"][:, None] != new
            stays &= t["out_id"][:, None] != ids
        value = pool["score"][hold] - np.take_along_axis(own["score"], places, 1)[:, :, None]
        fits = free[:, None, :] & stays[:, :, None] & (held[:, None, :] < MAX_PER_CLUB + (clubs[:, :, None] == club))
        value = np.where(fits & (value > 0), value, 0.0).reshape(size, -1)
        pair = value.argmax(axis=1)  # the first of the highest: both sides come by id
        top, o, i = value[squads, pair], places[squads, pair // len(hold)], hold[pair % len(hold)]
        o_id, i_id = own["id"][squads, o], pool["id"][i]
        tie = (top == best["value"]) & (top > 0) & ((o_id < out_id) | ((o_id == out_id) & (i_id < in_id)))
        better = (top > best["value"]) | tie
        best = {"value": np.where(better, top, best["value"]), "out": np.where(better, o, best["out"]), "in": np.where(better, i, best["in"])}
        out_id, in_id = np.where(better, o_id, out_id), np.where(better, i_id, in_id)
    return best


def _chosen(own: dict, pool: dict, bank: np.ndarray, prices: Sequence[float], max_swaps: int, free: int, hit: float) -> list[np.ndarray]:
    """(squad, columns of FOUND) of the best number of swaps at the best price, for squads that share a pool."""
    size = len(bank)
    squads, width = np.arange(size), int(max(own["club"].max(initial=0), pool["club"].max(initial=0))) + 1
    counts = np.bincount((squads[:, None] * width + own["club"]).ravel(), minlength=size * width).reshape(size, width)
    ids, pool["no_of_id"] = np.unique(pool["id"], return_inverse=True)
    place = np.minimum(np.searchsorted(ids, own["id"]), len(ids) - 1)
    squad, player = np.nonzero(ids[place] == own["id"])
    own["has"] = np.zeros((size, len(ids)), dtype=bool)
    own["has"][squad, place[squad, player]] = True
    best_net, best_swaps, best_price = np.full(size, -np.inf), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    kept = {c: np.zeros((size, max_swaps), dtype=t) for c, t in (("out_id", np.int64), ("in_id", np.int64), ("delta", float), ("sale", float), ("cost", float))}
    net_gain = np.zeros(size)
    for no, price in enumerate(prices):
        here = np.flatnonzero(pool["no"] == no)
        own["score"], pool["score"] = own["ep"] - price * own["price"], pool["ep"] - price * pool["price"]
        at = {}
        for p in np.unique(pool["position"][here]):
            of = own["position"] == p
            if of.any():
                places = np.argsort(~of, axis=1, kind="stable")[:, : of.sum(axis=1).max()]
                at[p] = places, np.take_along_axis(of, places, 1), here[pool["position"][here] == p]
        taken, gain, spent, going = [], np.zeros(size), np.zeros(size), np.ones(size, dtype=bool)
        option = np.full(size, -np.inf), np.zeros(size, dtype=np.int64), np.zeros(size)
        for swap in range(1, max_swaps + 1):
            pair = _first_fitting(own, pool, at, counts, taken)
            going &= pair["value"] > 0
            if not going.any():
                break
            o, i = pair["out"], pair["in"]
            taken.append({
                "out_id": own["id"][squads, o], "in_id": pool["id"][i], "out_club": own["club"][squads, o], "in_club": pool["club"][i],
                "delta": pool["ep"][i] - own["ep"][squads, o], "sale": own["price"][squads, o], "cost": pool["price"][i],
            })
            gain, spent = gain + taken[-1]["delta"], spent + (taken[-1]["cost"] - taken[-1]["sale"])
            net = gain - hit * max(0, swap - free)
            better = going & (spent <= bank + 1e-6) & (net > 0) & (np.round(net, 9) > option[0])
            option = np.where(better, np.round(net, 9), option[0]), np.where(better, swap, option[1]), np.where(better, net, option[2])
        better = (option[1] > 0) & ((option[0] > best_net) | ((option[0] == best_net) & (option[1] < best_swaps)))
        best_net, best_swaps = np.where(better, option[0], best_net), np.where(better, option[1], best_swaps)
        best_price, net_gain = np.where(better, no, best_price), np.where(better, option[2], net_gain)
        for k, t in enumerate(taken):
            for c, column in kept.items():
                column[better, k] = t[c][better]
    of, k = np.nonzero(np.arange(max_swaps) < best_swaps[:, None])
    return [
        of, np.array(prices, dtype=float)[best_price[of]], (k + 1).astype(np.int32), kept["out_id"][of, k], kept["in_id"][of, k],
        kept["delta"][of, k], kept["sale"][of, k], kept["cost"][of, k], net_gain[of],
    ]


def searcher(
    problem: str, prices: Sequence[float], max_swaps: int, free: int, hit: float, shared: Callable[[], pa.StructArray] | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The search over (problem, bank, rows): ``rows`` holds a squad's own players and, unless all squads share one pool, its newcomers."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def found(problems: pa.Array, bank: np.ndarray, own: pa.StructArray, pool: pa.StructArray) -> pa.RecordBatch:
        both = [pa.chunked_array([own.field(c), pool.field(c)]).combine_chunks() for c in ("team_id", "element_type")]
        club, position = _codes(both[0]), _codes(both[1], null=-1)
        mine = {k: v.reshape(-1, SQUAD_SIZE) for k, v in {**_numbers(own), "club": club[: len(own)], "position": position[: len(own)]}.items()}
        with np.errstate(invalid="ignore"):
            of, *columns = _chosen(mine, {**_numbers(pool), "club": club[len(own) :], "position": position[len(own) :]}, bank, prices, max_swaps, free, hit)
        return pa.RecordBatch.from_arrays([problems.take(pa.array(of)), *map(pa.array, columns)], names=[problem, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared() if shared else None
        for batch in batches:
            bank = batch["bank"].cast(pa.float64()).to_numpy(zero_copy_only=False)
            step = SQUADS if shared else 1
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                rows = part["rows"].flatten()
                if not shared:
                    is_own = rows.field("price_no").to_numpy(zero_copy_only=False) < 0
                    own, pool = rows.filter(pa.array(is_own)), rows.filter(pa.array(~is_own))
                else:
                    own, pool = rows, common
                if len(pool):
                    yield found(part[problem], bank[begin : begin + step], own, pool)

    return run
