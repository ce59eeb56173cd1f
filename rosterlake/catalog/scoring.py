"""Scoring, blending, residuals and state on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.catalog.base import PARTS, ROUNDS, orders_panel, part_rounds, part_scores, query, r6, rounded, table
from rosterlake.constants import BASE_STATS, CORRELATION_THRESHOLD, MIN_VARIANCE
from rosterlake.plans import features, ml, scoring, state
from rosterlake.session import with_setting
from rosterlake.sources.history import read_history, write_history
from rosterlake.streaming.sinks import scratch

_MODELS = PARTS + """,
long as (select player_id, element_type, team_id, confidence_score, m as model, round(expected_points * (1 + m * 0.1) - case when m = 2 then 6 else 0 end, 9) as raw,
    case when player_id % 9 = 0 and m = 1 then null else round(expected_points * (1 + m * 0.1) - case when m = 2 then 6 else 0 end + 0.25, 9) end as ep,
    start_probability as p from part_scores, generate_series(0, 2) g(m)),
ens as (select player_id, coalesce(avg(raw), 0.0) as raw, greatest(0.0, avg(ep)) as ep, greatest(0.0, least(1.0, max(p))) as p,
    coalesce(stddev_pop(ep), 0.0) as sd, count(ep) as n, max(confidence_score) as cs from long group by 1)"""


def model_rows(spark, sf):
    p = part_scores(spark, sf).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    raw = F.round(F.col("expected_points") * (F.col("m") * 0.1 + 1) - F.when(F.col("m") == 2, 6).otherwise(0), 9)
    return p.select(
        "player_id", "element_type", "team_id", F.col("m").alias("model"), raw.alias("expected_points_raw"),
        F.when(~((F.col("player_id") % 9 == 0) & (F.col("m") == 1)), F.round(raw + 0.25, 9)).alias("expected_points"),
        F.col("start_probability").alias("p_start"), F.col("start_probability").alias("p_appear"),
    )


@query("ensemble_mean", f"""with {_MODELS}
select player_id, round(raw, 6) as expected_points_raw, round(ep, 6) as expected_points, round(p, 6) as start_probability, round(sd, 6) as model_std, n as model_count from ens""")
def ensemble_mean(spark, sf):
    out = scoring.ensemble(model_rows(spark, sf), ["player_id"])
    return rounded(out, "expected_points_raw", "expected_points", "start_probability", "model_std").select(
        "player_id", "expected_points_raw", "expected_points", "start_probability", "model_std", "model_count"
    )


@query("blend", f"""with {PARTS},
b as (select player_id, expected_points as m, case when player_id % 3 = 0 then null else greatest(0.0, confidence_score / 10.0 - 5) end as o from part_scores)
select player_id, m as model_expected_points, case when o is null then 0.0 else 0.35 end as official_ep_blend_weight,
  round(greatest(0.0, case when o is null then m else 0.65 * m + 0.35 * o end), 6) as expected_points from b""")
def blend(spark, sf):
    p = part_scores(spark, sf).withColumn(
        "official_ep_next", F.when(F.col("player_id") % 3 != 0, (F.col("confidence_score") / 10.0 - 5).cast("string"))
    )
    out = scoring.blend_outside(p)
    return rounded(out, "expected_points").select("player_id", "model_expected_points", "official_ep_blend_weight", "expected_points")


@query("confidence_bands", f"""with {_MODELS},
x as (select *, case when player_id % 5 = 0 then null else player_id % 4 / 3.0 end as rel, case when player_id % 7 = 0 then null else player_id % 5 / 4.0 end as av, player_id % 3 / 2.0 as st from ens),
c as (select *, greatest(0.0, least(1.0, 0.35 * coalesce(rel, 1.0) + 0.25 * coalesce(av, st, 1.0) + 0.25 / (1 + sd) + 0.15 * least(1.0, abs(p - 0.5) * 2))) as conf from x),
s as (select *, greatest(0.05, sd + (1 - conf) * (0.40 + 0.20 * ep) + case when n <= 1 then 0.35 else 0 end) as sigma from c)
select player_id, round(sd, 6) as expected_points_std, round(conf * 100, 6) as confidence_score,
  case when round_even(conf * 100, 1) <= 49.9 then 'Low' when round_even(conf * 100, 1) <= 74.9 then 'Medium' else 'High' end as confidence_level,
  round(greatest(0.0, ep - 1.2815515655446004 * sigma), 6) as expected_points_lower_80, round(ep + 1.2815515655446004 * sigma, 6) as expected_points_upper_80 from s""")
def confidence_bands(spark, sf):
    pid = F.col("player_id")
    ens = scoring.ensemble(model_rows(spark, sf), ["player_id"]).withColumns(
        {
            "reliability_weight": F.when(pid % 5 != 0, pid % 4 / 3.0),
            "availability_next_round": F.when(pid % 7 != 0, pid % 5 / 4.0),
            "status_availability": pid % 3 / 2.0,
        }
    )
    cols = ["expected_points_std", "confidence_score", "expected_points_lower_80", "expected_points_upper_80"]
    return rounded(scoring.add_confidence(ens, exact=True), *cols).select("player_id", *cols, "confidence_level")


@query("expected_value", f"""with {PARTS},
v as (select player_id, start_probability as ps, start_probability * 0.5 + 0.3 as pa, expected_points as h, case when element_type = 2 then null else 1 + element_type * 0.25 end as cm,
  player_id % 3 / 2.0 as av, player_id % 11 * 0.1 - 0.5 as b from part_scores)
select player_id, round(greatest(pa, ps), 9) as p_appear,
  round((ps * h + greatest(0.0, greatest(pa, ps) - ps) * coalesce(cm, 1.0)) * av, 9) as expected_points_raw,
  round(greatest(0.0, (ps * h + greatest(0.0, greatest(pa, ps) - ps) * coalesce(cm, 1.0)) * av + b * ps * av), 9) as expected_points from v""")
def expected_value(spark, sf):
    p = part_scores(spark, sf)
    pid, pos, ps = F.col("player_id"), F.col("element_type"), F.col("start_probability")
    made = scoring.expected_value(
        ps, ps * 0.5 + 0.3, F.col("expected_points"), F.when(pos != 2, pos * 0.25 + 1), pid % 3 / 2.0, pid % 11 * 0.1 - 0.5
    )
    return p.select("player_id", *[F.round(c, 9).alias(n) for n, c in made.items()])


@query("published_scores", f"""with {PARTS},
who as (select player_id, element_type, case when player_id % 7 <> 0 then player_id % 5 / 4.0 end as nxt, case when player_id % 4 = 0 then 0.5 end as this, player_id % 3 / 2.0 as status,
  player_id % 6 as matches, case when player_id % 3 <> 0 then confidence_score / 10.0 - 5 end as outside, start_probability as p, expected_points as h from part_scores),
pb as (select s_suppkey as player_id, round(s_acctbal / 10000.0, 6) as pb from supplier),
qb as (select element_type, count(*) % 7 / 10.0 - 0.3 as qb, case when element_type <> 2 then 1 + element_type * 0.25 end as cameo from part_scores group by 1),
m as (select w.*, m, p * (1 - m * 0.1) as ps, p * 0.5 + 0.3 as pa, h * (1 + m * 0.1) as pts, coalesce(pb, 0) + coalesce(qb, 0) as bias, cameo,
    greatest(0.0, least(1.0, coalesce(nxt, this, status, 1.0))) as av from who w cross join generate_series(0, 2) g(m) left join pb using (player_id) left join qb using (element_type)
  where not (player_id % 9 = 0 and m = 1)),
e as (select *, (ps * pts + greatest(0.0, least(1.0, greatest(pa, ps) - ps)) * coalesce(cameo, 1.0)) * av as raw, greatest(pa, ps) as appear from m),
x as (select player_id, avg(raw) as raw, greatest(0.0, avg(greatest(0.0, raw + bias * ps * av))) as ep, greatest(0.0, least(1.0, avg(ps))) as start, greatest(0.0, least(1.0, avg(appear))) as appear,
    coalesce(stddev_pop(greatest(0.0, raw + bias * ps * av)), 0.0) as sd, count(*) as n from e group by 1),
b as (select x.*, w.*, x.ep as model_ep, greatest(0.0, case when outside is null then ep else 0.65 * ep + 0.35 * greatest(0.0, outside) end) as blended, least(1.0, matches / 3.0) as rel from x join who w using (player_id)),
c as (select *, greatest(0.0, least(1.0, 0.35 * rel + 0.25 * greatest(0.0, least(1.0, coalesce(nxt, status, 1.0))) + 0.25 / (1 + sd) + 0.15 * least(1.0, abs(start - 0.5) * 2))) as conf from b),
s as (select *, greatest(0.05, sd + (1 - conf) * (0.40 + 0.20 * blended) + case when n <= 1 then 0.35 else 0 end) as sigma from c)
select player_id, round(raw + 3.7e-10, 6) as expected_points_raw, round(model_ep + 3.7e-10, 6) as model_expected_points, round(blended + 3.7e-10, 6) as expected_points, round(start + 3.7e-10, 6) as start_probability, round(appear + 3.7e-10, 6) as appearance_probability,
  round(sd + 3.7e-10, 6) as expected_points_std, n as model_count, round(conf * 100 + 3.7e-10, 6) as confidence_score,
  round(greatest(0.0, blended - 1.2815515655446004 * sigma) + 3.7e-10, 6) as expected_points_lower_80, round(blended + 1.2815515655446004 * sigma + 3.7e-10, 6) as expected_points_upper_80 from s""")
def published_scores(spark, sf):
    """From the outputs of three models, with gaps, to points with bias, cameo, blend and bands, for every part."""
    p = part_scores(spark, sf)
    pid, ps, m = F.col("player_id"), F.col("start_probability"), F.col("m")
    who = p.select(
        "player_id", "element_type", F.when(pid % 7 != 0, pid % 5 / 4.0).alias("availability_next_round"), F.when(pid % 4 == 0, 0.5).alias("availability_this_round"),
        (pid % 3 / 2.0).alias("status_availability"), (pid % 6).alias("history_match_count"), F.when(pid % 3 != 0, F.col("confidence_score") / 10.0 - 5).alias("official_ep_next"),
    )
    scores = p.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter(~((pid % 9 == 0) & (m == 1))).select(
        "player_id", m.alias("model"), (ps * (1 - m * 0.1)).alias("p_start"), (ps * 0.5 + 0.3).alias("p_appear"), (F.col("expected_points") * (1 + m * 0.1)).alias("points_hat")
    )
    of_player = table(spark, sf, "supplier").select(F.lit("player").alias("kind"), F.col("s_suppkey").cast("string").alias("key"), F.round(F.col("s_acctbal") / 10000.0, 6).alias("bias"))
    of_position = p.groupBy("element_type").agg((F.count(F.lit(1)) % 7 / 10.0 - 0.3).alias("bias"))
    biases = of_player.unionByName(of_position.select(F.lit("position").alias("kind"), F.col("element_type").cast("string").alias("key"), "bias"))
    cameo = of_position.select("element_type", F.when(F.col("element_type") != 2, F.col("element_type") * 0.25 + 1).alias("cameo_points"))
    cols = ["expected_points_raw", "model_expected_points", "expected_points", "start_probability", "appearance_probability", "expected_points_std", "confidence_score", "expected_points_lower_80", "expected_points_upper_80"]
    out = scoring.publish(scores, who, biases, cameo, exact=True)
    # a nudge before rounding: exact halves at the sixth place would fall either way
    return out.select("player_id", *[F.round(F.col(c) + 3.7e-10, 6).alias(c) for c in cols], "model_count")


@query("residuals", f"""with {PARTS}, {ROUNDS}
select r.player_id, p.element_type, round(p.start_probability * p.expected_points + greatest(0.0, 0.8 - p.start_probability) * 1.5, 9) as predicted_points,
  round(r.expected_points - (p.start_probability * p.expected_points + greatest(0.0, 0.8 - p.start_probability) * 1.5), 9) as residual, 3 as gw
from part_rounds r join part_scores p on p.player_id = r.player_id where r.gameweek = 3""")
def residuals(spark, sf):
    p = part_scores(spark, sf)
    actual = part_rounds(spark, sf).select("player_id", F.col("gameweek").alias("round"), F.col("expected_points").alias("total_points"))
    scored = p.select(
        "player_id", F.col("start_probability").alias("p_start"), F.lit(0.8).alias("p_appear"), F.col("expected_points").alias("points_hat")
    )
    cameo = p.select("element_type").distinct().withColumn("cameo_points", F.lit(1.5))
    out = state.residuals(actual, scored, p.select("player_id", "element_type"), cameo, 3)
    return out.withColumns({c: F.round(c, 9) for c in ("predicted_points", "residual")})


@query("ema_bias_replay", """
with recursive e as (select event_type as kind_key, cast(user_id as varchar) as u, day(ts) as gw, round(value - 10, 6) as residual from events),
k as (select 'player' as kind, u as key, gw, avg(residual) as m from e group by 1, 2, 3 union all select 'position', kind_key, gw, avg(residual) from e group by 1, 2, 3),
n as (select *, row_number() over (partition by kind, key order by gw) as i from k),
f as (select kind, key, i, gw, 0.15 * m as bias from n where i = 1
  union all select n.kind, n.key, n.i, n.gw, 0.85 * f.bias + 0.15 * n.m from f join n on n.kind = f.kind and n.key = f.key and n.i = f.i + 1)
select kind, key, round(bias, 6) as bias, gw as last_gw, i as rounds from f qualify row_number() over (partition by kind, key order by i desc) = 1""")
def ema_bias_replay(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("player_id"), F.col("event_type").alias("element_type"),
        F.dayofmonth("ts").alias("gw"), F.round(F.col("value") - 10, 6).alias("residual"),
    )
    return rounded(state.replay_state(e, ["gw"], []), "bias")


@query("ema_update", """
with e as (select cast(user_id as varchar) as u, event_type as t, day(ts) as gw, round(value - 10, 6) as residual from events),
m as (select 'player' as kind, u as key, gw, avg(residual) as m from e group by 1, 2, 3 union all select 'position', t, gw, avg(residual) from e group by 1, 2, 3),
r as (select kind, key, sum(0.15 * power(0.85, n - 1) * m) as b from (
  select *, row_number() over (partition by kind, key order by gw desc) as n from m where gw < (select max(gw) from m)) group by 1, 2),
o as (select coalesce(r.kind, c.kind) as kind, coalesce(r.key, c.key) as key, coalesce(r.b, c.b) as b
  from r full join (select 'player' as kind, cast(c_custkey as varchar) as key, round(c_acctbal / 10000.0, 6) as b from customer) c on r.kind = c.kind and r.key = c.key),
l as (select * from m where gw = (select max(gw) from m))
select coalesce(o.kind, l.kind) as kind, coalesce(o.key, l.key) as key, round(case when l.m is null then b else 0.85 * coalesce(b, 0) + 0.15 * l.m end, 9) as bias,
  (select max(gw) from m) as last_gw from o full join l on o.kind = l.kind and o.key = l.key""")
def ema_update(spark, sf):
    """The last day's residuals folded into the state that all earlier days have left; customers without events bring one of their own."""
    e = table(spark, sf, "events").select(
        F.lit("2025-26").alias("season_name"), F.col("user_id").alias("player_id"), F.col("event_type").alias("element_type"),
        F.dayofmonth("ts").alias("gw"), F.round(F.col("value") - 10, 6).alias("residual"),
    )
    last = e.agg(F.max("gw")).scalar()
    replayed = state.replay_state(e.filter(F.col("gw") < last)).drop("rounds")
    opening = table(spark, sf, "customer").select(
        F.lit("2025-26").alias("season_name"), F.lit("player").alias("kind"), F.col("c_custkey").cast("string").alias("key"),
        F.round(F.col("c_acctbal") / 10000.0, 6).alias("bias"), F.lit(0).alias("last_gw"),
    )
    old = replayed.unionByName(opening.join(replayed, ["season_name", "kind", "key"], "left_anti"))
    out = state.update_state(old, e.filter(F.col("gw") == last), "2025-26")
    return out.select("kind", "key", F.round("bias", 9).alias("bias"), "last_gw")


_LABELLED = "select d.doc_id, quality as label, case when n_chars % 5 < 3 then 1 else 0 end as prediction, cast(n_chars as double) / 1000 as y from documents d join labels l on l.doc_id = d.doc_id"


def labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        "doc_id", F.col("quality").alias("label"), F.when(F.col("n_chars") % 5 < 3, 1).otherwise(0).alias("prediction"),
        (F.col("n_chars") / 1000).alias("y"), "toxic",
    )


@query("balanced_accuracy", f"""with s as ({_LABELLED})
select round(avg(r), 6) as balanced_accuracy from (select label, avg(case when label = prediction then 1.0 else 0.0 end) as r from s group by 1)""")
def balanced_accuracy(spark, sf):
    return rounded(ml.balanced_accuracy(labelled_docs(spark, sf)), "balanced_accuracy")


@query("mae", f"with s as ({_LABELLED}) select round(avg(abs(y - prediction)), 6) as mae from s")
def mae(spark, sf):
    return rounded(ml.mean_absolute_error(labelled_docs(spark, sf), "y"), "mae")


_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_twice", "l_const"]


def line_features(spark, sf):
    return table(spark, sf, "lineitem").withColumns(
        {"l_twice": F.col("l_quantity") * 2 + F.col("l_tax"), "l_const": F.lit(7.0)}
    )


_LINES = "with l as (select *, l_quantity * 2 + l_tax as l_twice, 7.0::double as l_const from lineitem)"


@query("feature_screen_stats", _LINES + ", s as (" + " union all ".join(
    f"select '{c}' as feature, count({c}) as n, var_pop({c}) as v, corr({c}, l_quantity) as c from l" for c in _FEATS[1:-1]
) + """) select feature, n, cast(floor(log10(v)) as integer) as magnitude, round(v / pow(10, floor(log10(v))), 8) as variance,
  cast(v > 1e-6 as integer) as varies, round(c, 6) as corr_with_first from s""")
def feature_screen_stats(spark, sf):
    """Nine significant digits of each variance: more would show the order of summation."""
    l = line_features(spark, sf)
    stats = ml.screen_statistics(l, _FEATS[1:-1])
    first = l.agg(*[F.corr(c, "l_quantity").alias(c) for c in _FEATS[1:-1]]).unpivot([], _FEATS[1:-1], "feature", "_corr")
    magnitude = F.floor(F.log10("variance"))
    return stats.join(first, "feature").select(
        "feature", "n", magnitude.cast("int").alias("magnitude"), F.round(F.col("variance") / F.pow(F.lit(10.0), magnitude), 8).alias("variance"),
        (F.col("variance") > 1e-6).cast("int").alias("varies"), r6("_corr").alias("corr_with_first"),
    )


_KEPT = " union all ".join(
    f"select '{c}' as kept from l having var_pop({c}) > {MIN_VARIANCE}" + "".join(
        f" and coalesce(abs(case when var_pop({e}) > {MIN_VARIANCE} then corr({e}, {c}) end), 0) <= {CORRELATION_THRESHOLD}" for e in _FEATS[:j]
    )
    for j, c in enumerate(_FEATS)
)


@query("feature_screen", f"{_LINES} {_KEPT}")
def feature_screen(spark, sf):
    """Kept features of the fitted screen: the constant and the doubled column go."""
    model = ml.FeatureScreen(inputCols=_FEATS).fit(line_features(spark, sf))
    kept = model.getOrDefault(model.keptCols)
    l = line_features(spark, sf).agg(*[F.count(c).alias(c) for c in kept])
    return l.unpivot([], kept, "kept", "n").select("kept")


def training_rows(spark, sf):
    """Customer orders as matches: form before the order, 'starts' when the order is large."""
    from rosterlake.operators.panel import form, prior_count

    o = orders_panel(spark, sf).withColumns({"round": F.month("o_orderdate"), "lines": F.substring("o_orderpriority", 1, 1).cast("double")})
    rolled = form(o, ["o_custkey", "season"], ["o_orderdate", "o_orderkey"], ["o_totalprice", "lines"], (3, 5))
    counted = prior_count(rolled, ["o_custkey", "season"], ["o_orderdate", "o_orderkey"], 1).filter("enough_prev")
    return counted.select(
        "o_orderkey", "season", "round", (F.col("o_totalprice") > 250000).cast("int").alias("starts"),
        (F.col("o_totalprice") > 50000).cast("int").alias("appears"), F.col("o_totalprice").alias("total_points"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in rolled.columns if c.endswith(("_ma3", "_ma5", "_lag1"))], "prev_matches",
    )


_MODEL_FEATURES = ["o_totalprice_ma3", "o_totalprice_ma5", "lines_ma3", "lines_ma5", "o_totalprice_lag1", "lines_lag1", "prev_matches"]


@query("gbt_fit_score")
def gbt_fit_score(spark, sf):
    """Boosted classifiers and regressor fitted on the orders and applied to every row."""
    rows = stored_rows(spark, training_rows(spark, sf), "training")
    small = ml.Candidate(
        "gbt", lambda p: ml.GBTClassifier(maxDepth=3, maxIter=5, seed=42), lambda p: ml.GBTRegressor(maxDepth=3, maxIter=5, seed=42)
    )
    fitted = ml.train_all(rows, _MODEL_FEATURES, [small], ["season", "round"], tries=0, folds=2)
    return ml.model_scores(rows, fitted, ["o_orderkey"])


@query("fit_score_coverage", """
select o_orderkey, 'gbt' as model, 1 as probabilities, 1 as has_points
from (select o_orderkey, row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) as rn from orders) where rn > 1""")
def fit_score_coverage(spark, sf):
    """What does not depend on the fitted trees: every row with an earlier match is scored once, with probabilities and points."""
    inside = F.col("p_start").between(0.0, 1.0) & F.col("p_appear").between(0.0, 1.0)
    return gbt_fit_score(spark, sf).select("o_orderkey", "model", inside.cast("int").alias("probabilities"), F.col("points_hat").isNotNull().cast("int").alias("has_points"))


_PANEL_FOLDS = """
with o as (select o_orderkey, year(o_orderdate) as season, month(o_orderdate) as round, row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) as rn from orders),
p as (select season, round, row_number() over (order by season, round) - 1 as i, count(*) over () as n from (select distinct season, round from o where rn > 1))
"""


@query("neural_folds", f"""{_PANEL_FOLDS}
select o_orderkey, cast((i - (n - 2 * (n // 3))) // greatest(n // 3, 1) + 1 as integer) as fold, 1 as predicted from o join p using (season, round) where rn > 1 and i >= n - 2 * (n // 3)""")
def neural_folds(spark, sf):
    """Standardised features into a neural classifier on resampled classes, fold after fold: every row of a test fold is predicted once."""
    rows = stored_rows(spark, training_rows(spark, sf), "training")
    found = ml.fold_predictions(rows, ml.neural(hidden=(8,), maxIter=20), "classifier", _MODEL_FEATURES, "starts", ["season", "round"], folds=2)
    return found.select("o_orderkey", "fold", F.col("prediction").isin(0.0, 1.0).cast("int").alias("predicted"))


@query("stored_model", f"""{_PANEL_FOLDS} select o_orderkey, 1 as same from o where rn > 1""")
def stored_model(spark, sf):
    """Models written to shared storage and read again give every row the prediction that they gave before."""
    rows = stored_rows(spark, training_rows(spark, sf), "training")
    small = ml.Candidate("gbt", lambda p: ml.GBTClassifier(maxDepth=3, maxIter=3, seed=42), None)
    fitted = ml.search(rows, small, "classifier", _MODEL_FEATURES, "starts", ["season", "round"], tune=False, folds=1)
    path = scratch(spark, "models")
    ml.save_models([fitted], path)
    again = ml.load_model(path, "gbt", "starts")
    before = fitted.model.transform(rows).select("o_orderkey", F.col("prediction").alias("before"))
    return before.join(again.transform(rows).select("o_orderkey", "prediction"), "o_orderkey").select(
        "o_orderkey", (F.col("before") == F.col("prediction")).cast("int").alias("same")
    )


@query("top_features")
def top_features(spark, sf):
    """The features that weigh most in the boosted start model of the orders."""
    rows = stored_rows(spark, training_rows(spark, sf), "training")
    small = ml.Candidate("gbt", lambda p: ml.GBTClassifier(maxDepth=3, maxIter=5, seed=42), None)
    fitted = ml.search(rows, small, "classifier", _MODEL_FEATURES, "starts", ["season", "round"], tune=False, folds=1)
    return spark.createDataFrame(ml.feature_importance(fitted.model, 5), "feature string, importance double")


@query("tuned_selection")
def tuned_selection(spark, sf):
    """Two candidate families, seeded draws, forward folds; the metric table of the selection."""
    docs = labelled_docs(spark, sf).drop("prediction").withColumns(
        {"period": (F.col("doc_id") % 20).cast("int"), "half": F.col("y") * 0.5 + F.col("doc_id") % 3, "third": F.col("doc_id") % 7}
    )
    spaces = [
        ml.Candidate("gbt", lambda p: ml.GBTClassifier(**{"maxIter": 3, "seed": 42, **p}), None, {"maxDepth": [2, 3]}),
        ml.Candidate("random_forest", lambda p: ml.RandomForestClassifier(**{"numTrees": 5, "seed": 42, **p}), None, {"maxDepth": [3, 5]}),
    ]
    fitted = [ml.search(docs, c, "classifier", ["y", "half", "third"], "label", ["period"], folds=2, tries=2) for c in spaces]
    best = ml.select_best(fitted, "label")
    rows = [(s["model"], s["mean"], s["std"], s["folds"], s["model"] == best.candidate) for s in ml.selection_summary(fitted)]
    return spark.createDataFrame(rows, "model string, mean double, std double, folds int, chosen boolean")


# --- as-of backfill, target frame ------------------------------------------------------------------------

@query("as_of_backfill", """
with o as (select *, year(o_orderdate) as season, month(o_orderdate) as round from orders),
t as (select distinct o_custkey, season, g.r as target_period from o, generate_series(1, 12) g(r)),
b as (select t.o_custkey, t.season, t.target_period, o_totalprice, row_number() over (partition by t.o_custkey, t.season, t.target_period order by o_orderdate desc, o_orderkey desc) as rn
  from t join o on o.o_custkey = t.o_custkey and o.season = t.season and o.round < t.target_period)
select o_custkey, season, cast(target_period as integer) as target_period, round(avg(o_totalprice), 6) as o_totalprice_ma5, max(case when rn = 1 then o_totalprice end) as o_totalprice_lag1
from b where rn <= 5 group by 1, 2, 3""")
def as_of_backfill(spark, sf):
    o = orders_panel(spark, sf).withColumn("round", F.month("o_orderdate"))
    out = features.as_of_form(o, ["o_custkey", "season"], ["o_orderdate", "o_orderkey"], ["o_totalprice"], "round", 1, 12)
    return rounded(out, "o_totalprice_ma5")


@query("horizon_periods", """
select o_custkey, next_round, case when next_round > 38 then '' else (select string_agg(cast(r as varchar), ',' order by r) from generate_series(next_round, least(38, next_round + 4)) g(r)) end as rounds
from (select o_custkey, max(week(o_orderdate)) - 11 as next_round from orders group by 1)""")
def horizon_periods(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max(F.weekofyear("o_orderdate")) - 11).alias("next_round"))
    return o.select(
        "o_custkey", "next_round",
        F.array_join(F.transform(state.refresh_rounds(F.col("next_round"), 5), lambda x: x.cast("string")), ",").alias("rounds"),
    )


@query("period_price", f"""with {PARTS}
select p.player_id, coalesce(v / 10.0, now_cost_millions) as now_cost_millions from part_scores p left join (
  select l_partkey, arg_max(cast(l_quantity as integer) + 40, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as v from lineitem
  where year(l_shipdate) = 2001 and month(l_shipdate) = 5 group by 1) on l_partkey = p.player_id""")
def period_price(spark, sf):
    l = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("player_id"), F.date_format("l_shipdate", "yyyy").alias("season_name"), F.month("l_shipdate").alias("round"),
        F.year("l_shipdate").alias("season_sort"), F.col("l_shipdate").alias("kickoff_sort"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("fixture"), (F.col("l_quantity").cast("int") + 40).alias("value"),
    )
    prices = features.entry_prices(l, 5, "2001")
    p = part_scores(spark, sf).select("player_id", "now_cost_millions")
    return p.join(prices, "player_id", "left").select(
        "player_id", F.coalesce("_entry_price", "now_cost_millions").alias("now_cost_millions")
    )


@query("forecast_gate", f"""with {PARTS}
select player_id, 1 as gate, confidence_score as official_ep_next from part_scores
union all select player_id, 0, null from part_scores""")
def forecast_gate(spark, sf):
    p = part_scores(spark, sf).select("player_id", F.col("confidence_score").alias("official_ep_next"))
    opened = features.gate_forecast(p, 7, 7).withColumn("gate", F.lit(1))
    closed = features.gate_forecast(p, 8, 7).withColumn("gate", F.lit(0))
    return opened.unionByName(closed)


_FILLED = ("total_points", "minutes", "goals_scored", "assists", "expected_goals", "expected_assists", "value")


def domain_tables(spark, sf):
    """The driver tables in the shape of the domain: players = parts, clubs = suppliers,
    matches = orders between the two clubs of their lines, rounds = months, seasons = years."""
    from rosterlake.catalog.relations import fixtures
    from rosterlake.functions.seasons import season_code

    fx = fixtures(spark, sf).withColumn("event", F.coalesce("event", F.lit(6)))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    l = table(spark, sf, "lineitem")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(fx, F.col("id") == F.col("l_orderkey"))
    home = F.col("l_suppkey") == F.col("team_h")
    cents = F.round("o_totalprice").cast("long")
    hist = rows.groupBy("l_partkey", "id", "o_orderdate", "team_h", "team_a", "team_h_difficulty", "team_a_difficulty", "event", "o_totalprice").agg(
        F.max(home.cast("int")).alias("_home"), F.sum("l_quantity").alias("q"), F.max("l_linenumber").alias("ln"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax")
    ).select(
        F.col("l_partkey").alias("player_id"), F.col("id").alias("fixture"), F.col("event").alias("round"),
        season_code(F.year("o_orderdate")).alias("season_name"), F.col("o_orderdate").cast("string").alias("kickoff_time"),
        (F.col("_home") == 1).alias("was_home"), F.when(F.col("_home") == 1, F.col("team_h")).otherwise(F.col("team_a")).alias("team"),
        F.when(F.col("_home") == 1, F.col("team_a")).otherwise(F.col("team_h")).alias("opponent_team"),
        (cents % 4).cast("int").alias("team_h_score"), (cents % 3).cast("int").alias("team_a_score"),
        F.when(F.col("_home") == 1, F.col("team_h_difficulty")).otherwise(F.col("team_a_difficulty")).alias("fixture_difficulty"),
        (F.col("q") % 91).alias("minutes"), (F.col("q") % 13).alias("total_points"), (F.col("ln") % 3).alias("goals_scored"), (F.col("ln") % 2).alias("assists"),
        F.col("disc").cast("string").alias("expected_goals"), F.col("tax").cast("string").alias("expected_assists"), (F.col("q") % 60 + 40).alias("value"),
        *[
            (F.pmod(F.col("q") * (k + 3) + F.col("ln") * (k + 1), F.lit(k + 2.0))).alias(stat)
            for k, stat in enumerate(s for s in BASE_STATS if s not in _FILLED)
        ],
    )
    p = part_scores(spark, sf)
    elements = p.select("player_id", "full_name", (F.col("player_id") % 100).alias("team_id"), "element_type", "now_cost_millions")
    teams = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"))
    return hist, elements, teams, fx


def stored(spark, hist):
    """The panel as the table it is in production: several plans read it, none rebuilds it."""
    path = scratch(spark, "history")
    # as many tasks as the lines need: their joins and their aggregation hold several times what was shuffled
    with with_setting(spark, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1000"), with_setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m"):
        write_history(hist, path)
    return read_history(spark, path)


def stored_rows(spark, rows, name):
    path = scratch(spark, name)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
