"""Daily series, folds, baselines, backtests and ensembles."""

from pyspark.sql import functions as F

from paneltide.operators import charts, ensemble
from paneltide.operators import forecast as op
from paneltide.operators.solvers import ETS, SARIMA
from paneltide.plans.bindings import PANEL
from paneltide.plans.catalog.base import gated, query, sql
from paneltide.session import materialized

SERIES = PANEL.but(keys=("region_name", "condition_text"))
_K = "region_name, condition_text"
_KO = "region_name:s condition_text:s"

DAILY = f"""d as (select {_K}, cast(last_updated as date) as day, avg(temperature_celsius) as y from gated group by all),
spine as (select {_K}, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d group by {_K}),
daily as (select s.*, d.y from spine s left join d using ({_K}, day))"""
FOLDS = f"""{DAILY}, days as (select day, row_number() over (order by day) - 1 as i, count(*) over () as n
  from (select distinct day from d)),
folds as (select k as fold, (select day from days where i = cast(round_even(59 + k * (m.n - 1 - 7 - 59) / 3.0, 0) as bigint)) as cutoff
  from (select max(n) as n from days) m, range(4) t(k))"""
SETS = f"""{FOLDS}, tr as (select {_K}, fold, cutoff, day, y, row_number() over w as i, count(*) over (partition by {_K}, fold) as n
  from daily join folds on day <= cutoff where y is not null
  window w as (partition by {_K}, fold order by day)),
train as (select * from tr where n >= 9),
st as (select {_K}, fold, cutoff, max(n) as n, arg_max(y, day) as last_y, arg_min(y, day) as first_y,
  max(day) as last_day, avg(y) as mean_y from train group by all),
steps as (select *, unnest(range(1, 8)) as h from st)"""
PATHS = f"""{SETS}, doy as (select {_K}, fold, dayofyear(day) as doy, avg(y) as y from train group by all),
paths as (select 'naive' as model, {_K}, fold, cutoff, h, last_y as yhat from steps
  union all select 'drift', {_K}, fold, cutoff, h, last_y + (last_y - first_y) / (n - 1) * h from steps
  union all select 'seasonal_naive', s.region_name, s.condition_text, s.fold, s.cutoff, h, t.y
    from steps s join train t on s.region_name = t.region_name and s.condition_text = t.condition_text
      and s.fold = t.fold and t.i = s.n - 7 + 1 + (h - 1) % 7
  union all select 'climatology', s.region_name, s.condition_text, s.fold, s.cutoff, h, coalesce(c.y, mean_y)
    from steps s left join doy c on s.region_name = c.region_name and s.condition_text = c.condition_text
      and s.fold = c.fold and c.doy = dayofyear(s.last_day + cast(h as int)))"""
SCORED = f"""{PATHS}, pairs as (select p.*, a.y from paths p left join daily a on p.region_name = a.region_name
    and p.condition_text = a.condition_text and a.day = p.cutoff + cast(p.h as int)),
sc as (select {_K}, fold, avg(abs(y - y7)) as scale from (select {_K}, fold, y,
    lag(y, 7) over (partition by {_K}, fold order by day) as y7 from train) group by all),
metrics as (select model, {_K}, fold, cutoff, avg(abs(y - yhat)) as mae, sqrt(avg((y - yhat) ** 2)) as rmse,
  100 * avg(case when y is null then null when abs(y) + abs(yhat) = 0 then 0 else 2 * abs(y - yhat) / (abs(y) + abs(yhat)) end) as smape,
  100 * avg(case when abs(y) >= 1 then abs((y - yhat) / y) end) as mape,
  count_if(abs(y) >= 1) < count(y) * 0.8 as mape_unreliable, count(y) as n,
  avg(abs(y - yhat)) / any_value(nullif(scale, 0)) as mase
  from pairs left join sc using ({_K}, fold) group by all having count(y) > 0),
summary as (select model, avg(mae) as mae, avg(rmse) as rmse, avg(smape) as smape, avg(mase) as mase,
  stddev_samp(mase) as mase_std, sum(n) as n_obs from metrics group by model)"""


_MEANS = SERIES.but(time="day", value="y")


def daily_means(spark, sf):
    """``(*keys, day, y)`` over the rows of each day, written once: what needs days reads these, not the rows."""
    rows = gated(spark, sf, *SERIES.keys, SERIES.value)
    by_day = rows.groupBy(*SERIES.keys, F.to_date(SERIES.time).alias("day"))
    return materialized(by_day.agg(F.avg(SERIES.value).alias("y")))


def daily(spark, sf):
    return op.daily_series(daily_means(spark, sf), _MEANS)


def folds(spark, sf, **options):
    return op.make_time_folds(gated(spark, sf, SERIES.value), SERIES.time, **options)


def daily_and_folds(spark, sf):
    """Both from one pass over the rows: every day with rows has a mean, if only a null one."""
    means = daily_means(spark, sf)
    return op.daily_series(means, _MEANS), op.make_time_folds(means, "day")


@query("daily_series", sql(DAILY, f"{_KO} day:d y:f", "daily"))
def daily_series(spark, sf):
    return daily(spark, sf)


@query("time_folds", sql(FOLDS, "fold:i cutoff:d", "folds"))
def time_folds(spark, sf):
    return op.folds_frame(spark, folds(spark, sf)).select("fold", "cutoff")


@query(
    "rolling_folds",
    sql(
        FOLDS + """, r as (select fold, cutoff, (select day from days d2 where d2.i = greatest(0,
  (select i from days d3 where d3.day = cutoff) - 90 + 1)) as train_start from folds)""",
        "fold:i cutoff:d train_start:d",
        "r",
    ),
)
def rolling_folds(spark, sf):
    made = folds(spark, sf, scheme="rolling", window_days=90)
    return op.folds_frame(spark, made).select("fold", "cutoff", "train_start")


@query("baseline_forecasts", sql(PATHS, f"model:s {_KO} fold:i cutoff:d h:i yhat:f", "paths"))
def baseline_forecasts(spark, sf):
    sets = op.training_sets(*daily_and_folds(spark, sf), SERIES)
    return op.forecasts(sets, op.BASELINES, SERIES).drop("date")


TREND = f"""{SETS}, centre as (select {_K}, fold, (i - 1) % 7 as p, avg(i - 1) as t, avg(y) as my from train group by all),
line as (select t.region_name, t.condition_text, t.fold, sum((t.i - 1 - c.t) * (t.y - c.my)) / sum((t.i - 1 - c.t) ** 2) as slope
  from train t join centre c on t.region_name = c.region_name and t.condition_text = c.condition_text
    and t.fold = c.fold and (t.i - 1) % 7 = c.p group by all),
trended as (select s.region_name, s.condition_text, s.fold, s.cutoff, s.h,
    case when s.n >= 16 then c.my + slope * (s.n + s.h - 1 - c.t) else b.y end as yhat
  from steps s join line using ({_K}, fold)
  join centre c on s.region_name = c.region_name and s.condition_text = c.condition_text and s.fold = c.fold and c.p = (s.n + s.h - 1) % 7
  join train b on s.region_name = b.region_name and s.condition_text = b.condition_text and s.fold = b.fold and b.i = s.n - 7 + 1 + (s.h - 1) % 7)"""


@query("trend_week_forecasts", sql(TREND, f"{_KO} fold:i cutoff:d h:i yhat:f", "trended"))
def trend_week_forecasts(spark, sf):
    sets = op.training_sets(*daily_and_folds(spark, sf), SERIES)
    return op.forecasts(sets, {"trend_week": op.trend_week}, SERIES).drop("date", "model")


_METRICS = "mae:f rmse:f smape:f mape:f mape_unreliable:b n:i mase:f"


@query(
    "backtest_baselines", sql(SCORED, f"model:s {_KO} fold:i cutoff:d {_METRICS}", "metrics")
)
def backtest_baselines(spark, sf):
    series, made = daily_and_folds(spark, sf)
    return op.backtest_series(series, op.BASELINES, made, SERIES)


_SUMMARY = "model:s mae:f rmse:f smape:f mase:f mase_std:f n_obs:i"


@query("model_summary", sql(SCORED, _SUMMARY, "summary"))
def model_summary(spark, sf):
    return op.summarize(backtest_baselines(spark, sf))


@query("backtest_fitted")
def backtest_fitted(spark, sf):
    """Exponential smoothing, seasonal ARMA and trend plus week next to the baselines."""
    models = op.default_models(with_trend_week=True)
    series, made = daily_and_folds(spark, sf)
    return op.summarize(op.backtest_series(series, models, made, SERIES))


@query("smoothing_forecasts")
def smoothing_forecasts(spark, sf):
    models = {"damped_smoothing": op.fitted(ETS), "seasonal_arma": op.fitted(SARIMA), "trend_week": op.trend_week}
    return op.forecasts(op.last_training_sets(daily(spark, sf), SERIES), models, SERIES)


@query(
    "leakage_report",
    sql(
        SETS + """, r as (select count(*) as n_sets, count_if(last_day > cutoff) as n_leaking,
  max(last_day - cutoff) as max_days_past_cutoff from st)""",
        "n_sets:i n_leaking:i max_days_past_cutoff:i",
        "r",
    ),
)
def leakage_report(spark, sf):
    return op.leakage_report(op.training_sets(*daily_and_folds(spark, sf), SERIES))


@query(
    "model_ranking",
    sql(
        SCORED + """, r as (select model, mase, coalesce(mase < 1, false) as beats_baseline,
  row_number() over (order by mase nulls last, model) as "rank" from summary)""",
        'model:s mase:f beats_baseline:b rank:i',
        "r",
    ),
)
def model_ranking(spark, sf):
    return charts.model_ranking(model_summary(spark, sf))


WEIGHTS = f"""{SCORED}, k as (select model, 1 / mae as w, coalesce(mase <= 1, false) as ok from summary where mae > 0),
weights as (select model, w / sum(w) over () as weight from k where ok or not (select bool_or(ok) from k))"""


@query("inverse_error_weights", sql(WEIGHTS, "model:s weight:f", "weights"))
def inverse_error_weights(spark, sf):
    return ensemble.inverse_error_weights(model_summary(spark, sf), drop_above=1.0)


@query(
    "weighted_blend",
    sql(
        WEIGHTS + f""", r as (select {_K}, fold, h, sum(weight * yhat) / sum(weight) as yhat
  from paths join weights using (model) where yhat is not null group by all)""",
        f"{_KO} fold:i h:i yhat:f",
        "r",
    ),
)
def weighted_blend(spark, sf):
    made = op.forecasts(
        op.training_sets(*daily_and_folds(spark, sf), SERIES), op.BASELINES, SERIES
    )
    weights = ensemble.inverse_error_weights(model_summary(spark, sf), drop_above=1.0)
    return ensemble.blend(made, weights, [*SERIES.keys, "fold", "h"])


def ungated(alpha):
    return f"""{SCORED}, k as (select model, (1 / mae) ** {alpha} as w from summary where mae > 0),
weights as (select model, w / sum(w) over () as weight from k)"""


@query("inverse_error_weights_all", sql(ungated(1), "model:s weight:f", "weights"))
def inverse_error_weights_all(spark, sf):
    return ensemble.inverse_error_weights(model_summary(spark, sf))


@query("inverse_error_weights_squared", sql(ungated(2), "model:s weight:f", "weights"))
def inverse_error_weights_squared(spark, sf):
    return ensemble.inverse_error_weights(model_summary(spark, sf), alpha=2.0)


_LOOSE = 1.25


@query(
    "inverse_error_weights_loose",
    sql(WEIGHTS.replace("mase <= 1,", f"mase <= {_LOOSE},"), "model:s weight:f", "weights"),
)
def inverse_error_weights_loose(spark, sf):
    return ensemble.inverse_error_weights(model_summary(spark, sf), drop_above=_LOOSE)


@query(
    "weighted_blend_all",
    sql(
        ungated(2) + f""", r as (select {_K}, fold, h, sum(weight * yhat) / sum(weight) as yhat
  from paths join weights using (model) where yhat is not null group by all)""",
        f"{_KO} fold:i h:i yhat:f",
        "r",
    ),
)
def weighted_blend_all(spark, sf):
    """A blend in which every baseline has a share."""
    made = op.forecasts(
        op.training_sets(*daily_and_folds(spark, sf), SERIES), op.BASELINES, SERIES
    )
    return ensemble.blend(made, inverse_error_weights_squared(spark, sf), [*SERIES.keys, "fold", "h"])


_FINAL = (
    WEIGHTS
    + f""", ft as (select {_K}, day, y, row_number() over (partition by {_K} order by day) as i,
  count(*) over (partition by {_K}) as n from daily where y is not null),
fs as (select {_K}, max(n) as n, arg_max(y, day) as last_y, arg_min(y, day) as first_y, max(day) as last_day,
  avg(y) as mean_y from ft where n >= 9 group by all),
fh as (select *, unnest(range(1, 8)) as h from fs),
fd as (select {_K}, dayofyear(day) as doy, avg(y) as y from ft group by all),
fp as (select 'naive' as model, {_K}, last_day, h, last_y as yhat from fh
  union all select 'drift', {_K}, last_day, h, last_y + (last_y - first_y) / (n - 1) * h from fh
  union all select 'seasonal_naive', s.region_name, s.condition_text, s.last_day, h, t.y
    from fh s join ft t on s.region_name = t.region_name and s.condition_text = t.condition_text and t.i = s.n - 6 + (h - 1) % 7
  union all select 'climatology', s.region_name, s.condition_text, s.last_day, h, coalesce(c.y, mean_y)
    from fh s left join fd c on s.region_name = c.region_name and s.condition_text = c.condition_text
      and c.doy = dayofyear(s.last_day + cast(h as int))),
r as (select {_K}, last_day + cast(h as int) as date, h as horizon_day, round_even(round(sum(weight * yhat) / sum(weight), 9) * 100, 0) / 100
  as forecast_temperature_celsius, 'inverse_error_ensemble' as model from fp join weights using (model) group by all)"""
)


@query(
    "final_forecasts",
    sql(_FINAL, f"{_KO} date:d horizon_day:i forecast_temperature_celsius:f model:s", "r"),
)
def final_forecasts(spark, sf):
    return ensemble.final_forecasts(
        daily(spark, sf), model_summary(spark, sf), SERIES, models=dict(op.BASELINES)
    )


@query("final_forecasts_smoothed")
def final_forecasts_smoothed(spark, sf):
    """The full roster, exponential smoothing included."""
    return ensemble.final_forecasts(daily(spark, sf), backtest_fitted(spark, sf), SERIES)


_MODELS = ["naive", "drift", "climatology"]
MATRIX = f"""{SCORED}, wide as (select {_K}, cutoff + cast(h as int) as date, any_value(y) as y,
  {", ".join(f"max(yhat) filter (model = '{m}') as {m}" for m in _MODELS)} from pairs
  where model in ('naive', 'drift', 'climatology') group by all)"""


def oof(spark, sf):
    series, cuts = daily_and_folds(spark, sf)
    sets = op.training_sets(series, cuts, SERIES)
    made = op.forecasts(sets, {m: op.BASELINES[m] for m in _MODELS}, SERIES)
    actual = series.select(*SERIES.keys, F.col("day").alias("date"), "y")
    return made.join(actual, [*SERIES.keys, "date"], "left")


@query(
    "oof_matrix",
    sql(MATRIX, f"{_KO} date:d y:f " + " ".join(f"{m}:f" for m in _MODELS), "wide"),
)
def oof_matrix(spark, sf):
    return ensemble.oof_matrix(oof(spark, sf), _MODELS, [*SERIES.keys, "date"])


_NAMES = [*_MODELS, "y"]
_GRAM = ", ".join(
    [f"sum({c}) as s{i}" for i, c in enumerate(_NAMES)]
    + [f"sum({_NAMES[i]} * {_NAMES[j]}) as p{i}_{j}" for i in range(4) for j in range(i, 4)]
)
_GRAM_OUT = "n:i " + " ".join(
    [f"s{i}:f" for i in range(4)] + [f"p{i}_{j}:f" for i in range(4) for j in range(i, 4)]
)


@query(
    "stacker_gram",
    sql(f"{MATRIX}, r as (select count(*) as n, {_GRAM} from wide where y is not null)", _GRAM_OUT, "r"),
)
def stacker_gram(spark, sf):
    return ensemble.gram_sums(oof_matrix(spark, sf), _MODELS)


@query("stacked_forecast")
def stacked_forecast(spark, sf):
    matrix = oof_matrix(spark, sf)
    weights = ensemble.fit_stacker(matrix, _MODELS)
    return matrix.withColumn("stacked", ensemble.predict_stacker(weights))


_PAIR = ["naive", "climatology"]
# With two models the non-negative fit is the plain one, or else the better single model with a positive slope.
_STACKED = f"""{MATRIX}, m as (select count(*) as n, avg(naive) as ma, avg(climatology) as mb, avg(y) as my,
  sum(naive * naive) - count(*) * avg(naive) * avg(naive) as aa,
  sum(climatology * climatology) - count(*) * avg(climatology) * avg(climatology) as bb,
  sum(naive * climatology) - count(*) * avg(naive) * avg(climatology) as ab,
  sum(naive * y) - count(*) * avg(naive) * avg(y) as ay,
  sum(climatology * y) - count(*) * avg(climatology) * avg(y) as b_y
  from wide where y is not null and naive is not null and climatology is not null),
u as (select *, (bb * ay - ab * b_y) / (aa * bb - ab * ab) as ua, (aa * b_y - ab * ay) / (aa * bb - ab * ab) as ub,
  case when ay > 0 then ay * ay / aa else 0 end as ga, case when b_y > 0 then b_y * b_y / bb else 0 end as gb from m),
w as (select ma, mb, my,
  case when ua >= 0 and ub >= 0 then ua when ga > 0 and ga >= gb then ay / aa else 0 end as wa,
  case when ua >= 0 and ub >= 0 then ub when gb > 0 and gb > ga then b_y / bb else 0 end as wb from u),
r as (select wide.*, wa * naive + wb * climatology + (my - wa * ma - wb * mb) as stacked from wide, w)"""


@query(
    "stacked_pair",
    sql(_STACKED, f"{_KO} date:d y:f naive:f climatology:f stacked:f", "r"),
)
def stacked_pair(spark, sf):
    """The non-negative stack of two baselines over their out-of-fold forecasts."""
    matrix = ensemble.oof_matrix(
        oof(spark, sf).where(F.col("model").isin(_PAIR)), _PAIR, [*SERIES.keys, "date"]
    )
    matrix = materialized(matrix)  # read for the weights and for the rows
    weights = ensemble.fit_stacker(matrix, _PAIR)
    return matrix.withColumn("stacked", ensemble.predict_stacker(weights))
