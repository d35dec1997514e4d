"""Queries for forecast evaluation."""

from pyspark.sql import functions as F

from quaymetrics.core import ordered
from quaymetrics.operators import evaluation as EV
from quaymetrics.operators import forecasts as FC
from quaymetrics.operators import sampling as S
from quaymetrics.operators import windows as W
from quaymetrics.registry import cte, query

# Monthly totals; forecasts are made when the month ends and checked 40 days later, so the
# previous target is not yet known. Every seventh month is published late.
cte(
    "series_rows",
    """
select o_orderpriority as series_id, cast(date_trunc('month', o_orderdate) as date) as period, round(sum(o_totalprice), 2) as y,
       cast(cast(date_trunc('month', o_orderdate) as date) + interval 1 month as timestamp) as origin,
       cast(cast(date_trunc('month', o_orderdate) as date) + interval 1 month as timestamp) + case when month(date_trunc('month', o_orderdate)) % 7 = 0 then 150 else 40 end * interval 1 day as release
from orders group by o_orderpriority, date_trunc('month', o_orderdate)
""",
)
cte("lagged_rows", "select *, lag(y, 2) over (partition by series_id order by period) as x, row_number() over (partition by series_id order by period) - 1 as idx from series_rows")


def series_rows(v):
    period = F.trunc(F.col("o_orderdate").cast("date"), "month")
    base = v.orders.groupBy(F.col("o_orderpriority").alias("series_id"), period.alias("period")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("y")
    )
    origin = F.add_months("period", 1).cast("timestamp_ntz")
    late = F.when(F.month("period") % 7 == 0, F.expr("interval 150 days")).otherwise(
        F.expr("interval 40 days")
    )
    lag = F.lag("y", 2).over(ordered(["series_id"], "period"))
    return base.withColumns({"origin": origin, "release": origin + late, "x": lag})


MIN = 18
cte(
    "fold_rows",
    f"""
select t.series_id, t.period, t.idx, t.y, t.x, count(j.idx) as n_train, t.idx - count(j.idx) as n_excluded, max(j.idx) as last_train_idx, avg(j.y) as mean_y, arg_max(j.y, j.idx) as last_y,
       regr_slope(j.y, j.x) as slope, regr_intercept(j.y, j.x) as icept
from lagged_rows t left join lagged_rows j on j.series_id = t.series_id and j.idx < t.idx and j.release <= t.origin
group by t.series_id, t.period, t.idx, t.y, t.x having t.idx >= {MIN} and count(j.idx) >= {MIN}
""",
)


@query(
    "B01_folds",
    "select series_id, period, row_number() over (partition by series_id order by idx) - 1 as fold, n_train, n_excluded, last_train_idx from fold_rows",
)
def _(v):
    f = EV.folds(series_rows(v), min_train=MIN)
    return f.select("series_id", "period", "fold", "n_train", "n_excluded", "last_train_idx")


@query(
    "B02_baseline_forecasts",
    """
with f as (select *, row_number() over (partition by series_id order by idx) - 1 as fold from fold_rows)
select series_id, period, fold, n_train, 'historical_mean' as model_id, y as actual, mean_y as prediction from f
union all select series_id, period, fold, n_train, 'no_change', y, last_y from f
union all select series_id, period, fold, n_train, 'ar1', y, icept + slope * x from f
""",
    "actual:2 prediction:1",
)
def _(v):
    return EV.baseline_forecasts(series_rows(v), min_train=MIN)


def model_rows(v):
    w = ordered(["series_id"], "period")
    return series_rows(v).withColumns(
        {
            "lag3": F.lag("y", 3).over(w),
            "lag12": F.lag("y", 12).over(w),
            "month": F.month("period").cast("double"),
        }
    )


GRID = {"bridge_ols": [0.0], "elastic_net": [0.05, 0.5], "boosted_trees": [0.1, 0.3]}


@query("B03_model_forecasts")
def _(v):
    features = ["x", "lag3", "lag12", "month"]
    return FC.model_forecasts(model_rows(v), features, GRID, min_train=MIN, relative_penalty=True)


# One regressor has a closed form: the fold's median for missing values, then slope and intercept.
cte("lag12_rows", "select *, lag(y, 12) over (partition by series_id order by period) as lag12 from lagged_rows")
cte("lag12_pairs", "select t.series_id, t.period, t.y, t.lag12 as xt, j.y as yj, j.lag12 as xj from lag12_rows t join lag12_rows j on j.series_id = t.series_id and j.idx < t.idx and j.release <= t.origin")
cte("lag12_medians", f"select series_id, period, count(*) as n_train, coalesce(median(xj), 0) as mid from lag12_pairs group by 1, 2 having count(*) >= {MIN}")
LAG12 = """
from (select p.*, n_train, coalesce(xt, mid) as a, coalesce(xj, mid) as b from lag12_pairs p join lag12_medians m using (series_id, period)) s
group by series_id, period, n_train, y, a
"""


@query(
    "B03_bridge_one_regressor",
    f"select series_id, period, n_train, y as actual, case when var_pop(b) > 1e-6 then regr_intercept(yj, b) + regr_slope(yj, b) * a else avg(yj) end as prediction {LAG12}",
    "actual:2 prediction:1",
)
def _(v):
    f = FC.model_forecasts(model_rows(v), ["lag12"], {"bridge_ols": [0.0]}, min_train=MIN)
    return f.select("series_id", "period", "n_train", "actual", "prediction")


@query(
    "B03_elastic_net_one_regressor",
    f"""
with m as (select series_id, period, n_train, y, a, avg(yj) as my, avg(b) as mb, stddev_pop(yj) as sy, stddev_pop(b) as sb, coalesce(corr(yj, b), 0) as r {LAG12})
select series_id, period, n_train, y as actual, case when sb > 1e-3 then my + sy * sign(r) * greatest(abs(r) - 0.25, 0) / 1.25 * (a - mb) / sb else my end as prediction from m
""",
    "actual:2 prediction:1",
)
def _(v):
    grid = {"elastic_net": [0.5]}
    f = FC.model_forecasts(model_rows(v), ["lag12"], grid, min_train=MIN, relative_penalty=True)
    return f.select("series_id", "period", "n_train", "actual", "prediction")


cte(
    "blocked",
    """
select *, case when r <= 12 then 'final_evaluation' when r <= 36 then 'tuning_validation' else 'model_development' end as evaluation_block
from (select *, dense_rank() over (order by period desc) as r from forecasts) s
""",
)


@query(
    "B04_tune",
    """
with s as (select series_id, model_id, sqrt(avg(case when evaluation_block = 'tuning_validation' then power(prediction - actual, 2) end)) as validation_rmse,
  sqrt(avg(case when evaluation_block = 'final_evaluation' then power(prediction - actual, 2) end)) as final_rmse, count(*) filter (where evaluation_block = 'tuning_validation') as n_validation,
  count(*) filter (where evaluation_block = 'final_evaluation') as n_final from blocked group by 1, 2)
select series_id, model_id, validation_rmse, final_rmse, n_validation, n_final from (select *, row_number() over (partition by series_id order by validation_rmse, model_id) as rn from s) r where rn = 1
""",
    "validation_rmse:2 final_rmse:2",
)
def _(v):
    blocks = S.period_blocks(v.forecasts, "period", 24, 12)
    return EV.tune(blocks, ["series_id"], ["model_id"])


METRICS = (
    "count(*) as n_obs, sqrt(avg(power(prediction - actual, 2))) as rmse, avg(abs(prediction - actual)) as mae, avg(prediction - actual) as bias, "
    "avg(cast(sign(actual - ref) = sign(prediction - ref) as double)) as directional_accuracy"
)
cte("referenced", "select *, lag(actual) over (partition by series_id, model_id order by period) as ref0, 200000000.0::double as ref, year(period) as regime from forecasts")


@query(
    "B05_metrics",
    f"select series_id, model_id, {METRICS} from referenced group by 1, 2",
    "rmse:2 mae:2 bias:2 directional_accuracy",
)
def _(v):
    rows = v.forecasts.withColumn("ref", F.lit(200000000.0))
    return EV.metrics(rows, ["series_id", "model_id"], "ref")


@query(
    "B05_metrics_by_regime",
    f"select model_id, regime, {METRICS} from referenced group by 1, 2",
    "rmse:2 mae:2 bias:2 directional_accuracy",
)
def _(v):
    rows = v.forecasts.withColumns({"ref": F.lit(200000000.0), "regime": F.year("period")})
    return EV.metrics(rows, ["model_id", "regime"], "ref")


@query(
    "W07_rank_models",
    """
select *, dense_rank() over (partition by series_id order by rmse) as rank from (
  select series_id, model_id, sqrt(avg(power(prediction - actual, 2))) as rmse from forecasts group by 1, 2) m
""",
    "rmse:2",
)
def _(v):
    m = EV.metrics(v.forecasts, ["series_id", "model_id"]).select("series_id", "model_id", "rmse")
    return W.rank_models(m, ["series_id"], "rmse")


cte(
    "timed_forecasts",
    """
select *, cast(period + interval 1 month as timestamp) as origin, cast(period + interval 1 month as timestamp) + interval 40 day as release from forecasts
""",
)


def timed(v):
    origin = F.add_months("period", 1).cast("timestamp_ntz")
    return v.forecasts.withColumns({"origin": origin, "release": origin + F.expr("interval 40 days")})


cte(
    "bands",
    """
select a.series_id, a.model_id, a.period, a.actual, a.prediction, count(b.period) as n_residuals,
       case when count(b.period) >= 10 then a.prediction + quantile_cont(b.actual - b.prediction, 0.05) end as lower,
       case when count(b.period) >= 10 then a.prediction + quantile_cont(b.actual - b.prediction, 0.95) end as upper
from timed_forecasts a left join timed_forecasts b on a.series_id = b.series_id and a.model_id = b.model_id and b.period < a.period and b.release <= a.origin group by a.series_id, a.model_id, a.period, a.actual, a.prediction
""",
)


@query("B06_residual_intervals", "select * from bands", "actual:2 prediction:1 lower:1 upper:1")
def _(v):
    return EV.residual_intervals(timed(v), ["series_id", "model_id"]).drop("origin", "release")


@query(
    "B05_interval_metrics",
    f"""
select model_id, {METRICS.replace("ref)", "0)")}, count(case when lower is not null and upper is not null then 1 end) as n_intervals,
       avg(case when lower is not null then cast(actual between lower and upper as double) end) as interval_coverage, avg(upper - lower) as mean_interval_width
from bands group by 1
""",
    "rmse:2 mae:2 bias:2 directional_accuracy interval_coverage mean_interval_width:1",
)
def _(v):
    return EV.metrics(EV.residual_intervals(timed(v), ["series_id", "model_id"]), ["model_id"])


@query(
    "B07_diebold_mariano",
    """
with d as (select a.series_id, a.model_id, a.period, power(a.actual - a.prediction, 2) - power(a.actual - b.prediction, 2) as d from forecasts a
  join forecasts b on a.series_id = b.series_id and a.period = b.period and b.model_id = 'historical_mean' where a.model_id <> 'historical_mean'),
c as (select *, d - avg(d) over (partition by series_id, model_id) as c from d),
l as (select *, lag(c, 1) over w as c1, lag(c, 2) over w as c2 from c window w as (partition by series_id, model_id order by period)),
g as (select series_id, model_id, count(*) as n, avg(d) as m, sum(c * c) / count(*) + 2 * (2 / 3.0::double) * sum(c * c1) / count(*) + 2 * (1 / 3.0::double) * sum(c * c2) / count(*) as v from l group by 1, 2)
select series_id, model_id, n as n_obs, m / 1e9 as mean_loss_differential, m / sqrt(v / n) * sqrt((n + 1 - 6 + 6 / n::double) / n) as statistic, n >= 20 and v > 0 as valid, cast(null as varchar) as reason from g
""",
    "mean_loss_differential:1 statistic",
)
def _(v):
    out = EV.diebold_mariano(v.forecasts, "historical_mean", ["series_id"], horizon=3)
    # The loss is in squared currency; it is shown in billions.
    scaled = F.col("mean_loss_differential") / 1e9
    return out.withColumn("mean_loss_differential", scaled).drop("p_value")


@query("B07_diebold_mariano_p")
def _(v):
    return EV.diebold_mariano(v.forecasts, "historical_mean", ["series_id"], horizon=3)


@query(
    "B08_stability",
    """
with a as (select series_id, model_id, period, prediction, actual from forecasts), b as (select series_id, model_id, period, prediction * case when model_id = 'lag1' then 1.1::double else 0.9::double end as prediction from forecasts),
j as (select a.series_id, a.model_id, a.prediction as p, b.prediction as q, actual from a join b using (series_id, model_id, period)),
g as (select series_id, model_id, count(*) as n_matched, corr(p, q) as prediction_correlation, avg(abs(q - p)) as mean_absolute_change, sqrt(avg(power(p - actual, 2))) as rmse_first, sqrt(avg(power(q - actual, 2))) as rmse_second from j group by 1, 2),
r as (select *, dense_rank() over (partition by series_id order by rmse_first) as rank_first, dense_rank() over (partition by series_id order by rmse_second) as rank_second from g)
select *, rank_second - rank_first as rank_change from r
""",
    "prediction_correlation mean_absolute_change:2 rmse_first:2 rmse_second:2",
)
def _(v):
    shift = F.when(F.col("model_id") == "lag1", 1.1).otherwise(0.9)
    real = v.forecasts.withColumn("data_mode", F.lit("vintage_aware"))
    revised = v.forecasts.withColumns(
        {"data_mode": F.lit("revised"), "prediction": F.col("prediction") * shift}
    )
    return EV.stability(
        real.unionByName(revised), "data_mode", "vintage_aware", "revised", ["series_id"], "period"
    )
