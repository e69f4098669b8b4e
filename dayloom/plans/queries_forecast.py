"""Catalogue: forecasts, accuracy, back-tests, recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators import pinball, smoothing, stacking
from dayloom.operators.accuracy import accuracy
from dayloom.operators.splits import time_split
from dayloom.plans import features, forecast, recipes, standins
from dayloom.plans.catalog import query, rounded
from dayloom.plans.queries_features import RETURNS_SQL, known_returns, returns
from dayloom.plans.queries_panel import calendar_rows
from dayloom.plans.queries_tables import HOLIDAYS, regressors
from dayloom.plans.standins import CUT, Tables
from dayloom.session import materialise, shared_path


def cut() -> Column:
    """The day at which queries stand whose regressors must be known ahead."""
    return F.lit(CUT).cast("date")


# All other queries stand at the newest day.
FULL_SQL = RETURNS_SQL + """,
known AS (SELECT * FROM returns)"""
LAST = "(SELECT MAX(ds) FROM known)"


def written_returns(t: Tables) -> DataFrame:
    """The returns for queries that read them several times: the panel behind them is worked out once."""
    return materialise(returns(t), "returns")


def newest_states(t: Tables, history: DataFrame, back: Sequence[int] = ()) -> DataFrame:
    """States at the newest day, and ``back`` days before it, from one run over the history."""
    return forecast.states_at(history, standins.newest_day(t), [0, *back], series_rows=calendar_rows(t))


def at_newest(t: Tables, states: DataFrame) -> DataFrame:
    return states.where(F.col("ds") == standins.newest_day(t))


NAIVE_SQL = (
    FULL_SQL
    + f""",
steps AS (SELECT UNNEST(range(1, 29)) AS h),
naive AS (
  SELECT k.entity_id, CAST({LAST} + CAST(h AS INTEGER) AS DATE) AS ds, CAST(h AS INTEGER) AS h, k.ret AS yhat
  FROM steps JOIN known k ON k.ds = CAST({LAST} - 6 + CAST((h - 1) % 7 AS INTEGER) AS DATE)
)"""
)


def _naive(t: Tables, states: DataFrame) -> DataFrame:
    return forecast.paths(at_newest(t, states), models=(forecast.BASELINE,))


@query("naive_forecast", f"WITH {NAIVE_SQL} SELECT entity_id, ds, h, ROUND(yhat, 9) + 0.0 AS yhat FROM naive")
def naive_forecast(t: Tables) -> DataFrame:
    """Seasonal-naive forecast, 28 days ahead for every series."""
    return rounded(_naive(t, newest_states(t, returns(t))).select("entity_id", "ds", "h", "yhat"), "yhat", digits=9)


@query(
    "accuracy",
    f"""
WITH {FULL_SQL},
pred AS (
  SELECT 'lag_1' AS model, entity_id, CAST(ds + INTERVAL 1 DAY AS DATE) AS ds, ret AS yhat FROM known UNION ALL
  SELECT 'lag_7', entity_id, CAST(ds + INTERVAL 7 DAY AS DATE), ret FROM known)
SELECT model, entity_id, ROUND(sqrt(AVG(pow(k.ret - yhat, 2))), 9) AS rmse, ROUND(AVG(abs(k.ret - yhat)), 9) AS mae,
       ROUND(pow(corr(k.ret, yhat), 2), 6) AS rsq, COUNT(*) AS n
FROM known k JOIN pred USING (entity_id, ds) GROUP BY ALL
""",
)
def accuracy_query(t: Tables) -> DataFrame:
    """Error measures of two naive models per entity."""
    known = returns(t)
    lagged = known.select(
        "entity_id",
        F.explode(
            F.array(
                F.struct(F.lit("lag_1").alias("model"), F.date_add("ds", 1).alias("ds")),
                F.struct(F.lit("lag_7").alias("model"), F.date_add("ds", 7).alias("ds")),
            )
        ).alias("p"),
        F.col("ret").alias("yhat"),
    ).select("entity_id", "p.model", "p.ds", "yhat")
    tested = known.withColumnRenamed("ret", "y").join(lagged, ["entity_id", "ds"])
    return rounded(rounded(accuracy(tested, ["model", "entity_id"]), "rmse", "mae", digits=9), "rsq")


_CANDIDATES_SQL = """
  SELECT s.entity_id, s.ds AS cut, CAST(h AS INTEGER) AS h, CAST(s.ds + CAST(h AS INTEGER) AS DATE) AS ds, m.model,
         CASE m.model WHEN 'seasonal_naive' THEN k.ret WHEN 'last' THEN s.last
              WHEN 'drift' THEN s.last + h * (s.last - s.first) / greatest(s.n - 1, 1)
              WHEN 'mean_30' THEN s.mean_30 ELSE COALESCE(s.ema_30, s.mean_30) END AS yhat
  FROM state s, steps, (SELECT UNNEST(['seasonal_naive', 'last', 'drift', 'mean_30', 'ema_30']) AS model) m,
       known k
  WHERE k.entity_id = s.entity_id AND k.ds = CAST(s.ds - 6 + CAST((h - 1) % 7 AS INTEGER) AS DATE)"""
_A30 = "(2.0::DOUBLE / 31)"
STATE_SQL = (
    FULL_SQL
    + f""",
steps AS (SELECT UNNEST(range(1, 29)) AS h),
numbered_returns AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY ds) AS rn FROM known),
state AS MATERIALIZED (
  SELECT entity_id, ds, ret AS last, FIRST_VALUE(ret) OVER w AS first, rn AS n,
         AVG(ret) OVER (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean_30,
         CASE WHEN rn >= 30 THEN pow(1 - {_A30}, rn - 30) * SUM(CASE WHEN rn <= 30 THEN ret / 30
              ELSE {_A30} * ret * pow(1 - {_A30}, 30 - rn) END) OVER w END AS ema_30
  FROM numbered_returns WINDOW w AS (PARTITION BY entity_id ORDER BY ds)
),
candidates AS ({_CANDIDATES_SQL}
    AND ({LAST} - s.ds) % 28 = 0 AND {LAST} - s.ds BETWEEN 0 AND 364
),
tested AS MATERIALIZED (
  SELECT c.*, CAST(({LAST} - cut) / 28 AS INTEGER) AS slice, k.ret AS y
  FROM candidates c JOIN known k USING (entity_id, ds) WHERE cut < {LAST}
)"""
)


def _backtest(t: Tables, history: DataFrame, windows: int = forecast.WINDOWS, models: Sequence[str] = forecast.MODELS, states: DataFrame | None = None) -> DataFrame:
    return forecast.backtest(history, standins.newest_day(t), windows=windows, series_rows=calendar_rows(t), models=models, state=states)


@query(
    "forecast_fan",
    f"""
WITH {STATE_SQL},
width AS (SELECT quantile_cont(abs(y - yhat), 0.95) AS width FROM tested WHERE slice = 1 AND model = 'seasonal_naive'),
rep AS (
  SELECT entity_id, ds, ret AS value, ret AS lo, ret AS hi, 'actual' AS key FROM known UNION ALL
  SELECT entity_id, ds, yhat, yhat - width, yhat + width, 'prediction' FROM candidates, width
  WHERE model = 'seasonal_naive' AND cut = {LAST})
SELECT entity_id, ds, key,
       {", ".join(f"ROUND(CASE WHEN COUNT({c}) OVER w = 30 THEN CAST(product({c} + 1) OVER w AS DOUBLE) ^ (365.0 / 30) - 1 END, 6) + 0.0 AS {n}" for c, n in (('value', 'value'), ('lo', 'conf_lo'), ('hi', 'conf_hi')))}
FROM rep WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
""",
)
def forecast_fan(t: Tables) -> DataFrame:
    """Thirty-day annualised return over actual values, forecast and the bounds of its held-out errors."""
    history = written_returns(t)
    states = materialise(newest_states(t, history, [forecast.HORIZON]), "states")
    held_out = _backtest(t, history, windows=1, models=(forecast.BASELINE,), states=states)
    predicted = forecast.interval_forecast(_naive(t, states), held_out).select("entity_id", "ds", F.col("yhat").alias("value"), "conf_lo", "conf_hi")
    reported = forecast.report(history.withColumnRenamed("ret", "value"), predicted, "SEASONAL_NAIVE")
    out = forecast.fan(reported).select("entity_id", "ds", "key", "value", "conf_lo", "conf_hi")
    return rounded(out, "value", "conf_lo", "conf_hi")


def _tested(t: Tables, history: DataFrame | None = None) -> DataFrame:
    return materialise(_backtest(t, written_returns(t) if history is None else history), "backtest")


@query(
    "backtest_accuracy",
    f"WITH {STATE_SQL} SELECT model, slice, ROUND(sqrt(AVG(pow(y - yhat, 2))), 9) AS rmse, ROUND(AVG(abs(y - yhat)), 9) AS mae, COUNT(*) AS n "
    "FROM tested GROUP BY ALL",
)
def backtest_accuracy(t: Tables) -> DataFrame:
    """Errors of every candidate in each of thirteen rolling-origin slices."""
    out = accuracy(_backtest(t, written_returns(t)), ["model", "slice"]).select("model", "slice", "rmse", "mae", "n")
    return rounded(out, "rmse", "mae", digits=9)


@query(
    "leaderboard",
    f"""
WITH {STATE_SQL},
best AS (SELECT model, sqrt(AVG(pow(y - yhat, 2))) AS rmse FROM tested GROUP BY model ORDER BY rmse, model LIMIT 3),
weighted AS (SELECT model, (1 / rmse) / (SELECT SUM(1 / rmse) FROM best) AS weight FROM best),
joint AS (SELECT 'ensemble' AS model, y, SUM(yhat * weight) AS yhat FROM tested JOIN weighted USING (model) GROUP BY entity_id, slice, h, ds, y),
board AS (
  SELECT model, sqrt(AVG(pow(y - yhat, 2))) AS rmse, AVG(abs(y - yhat)) AS mae, pow(corr(y, yhat), 2) AS rsq, COUNT(*) AS n
  FROM (SELECT model, y, yhat FROM tested UNION ALL SELECT model, y, yhat FROM joint) GROUP BY model)
SELECT model, ROUND(rmse, 9) AS rmse, ROUND(mae, 9) AS mae, ROUND(rsq, 6) AS rsq, n, CAST(DENSE_RANK() OVER (ORDER BY rmse) AS INTEGER) AS rank
FROM board
""",
)
def leaderboard(t: Tables) -> DataFrame:
    """Thirteen-window back-test of all candidates and their weighted ensemble."""
    tested = _tested(t)
    board = forecast.leaderboard(forecast.with_ensemble(tested, accuracy(tested)))
    return rounded(rounded(board, "rmse", "mae", digits=9), "rsq")


_PAIRS = [(a, b) for i, a in enumerate([*forecast.MODELS, "y"]) for b in [*forecast.MODELS, "y"][i:]]


@query(
    "stacking_products",
    f"""
WITH {STATE_SQL},
wide AS (SELECT entity_id, slice, h, MAX(y) AS y, {", ".join(f"MAX(yhat) FILTER (WHERE model = '{m}') AS {m}" for m in forecast.MODELS)}
         FROM tested GROUP BY entity_id, slice, h),
whole AS MATERIALIZED (SELECT * FROM wide WHERE {" AND ".join(f"{m} IS NOT NULL" for m in [*forecast.MODELS, "y"])})
{" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(1e6 * SUM({a} * {b}), 6) + 0.0 AS s FROM whole" for a, b in _PAIRS)}
""",
)
def stacking_products(t: Tables) -> DataFrame:
    """Sums of products (times a million) of every two candidates' held-out predictions, and of each with the truth."""
    sums = stacking.products(_tested(t), ["entity_id", "slice", "h"], forecast.MODELS)
    return rounded(sums.withColumn("s", F.col("s") * 1e6), "s")


def _all_tested(t: Tables) -> DataFrame:
    """Held-out predictions of the window candidates, error-trend-season smoothing and Theta over all slices."""
    history = written_returns(t)
    cuts = [forecast.HORIZON * k for k in range(1, forecast.WINDOWS + 1)]
    made = smoothing.candidates(history, cuts, forecast.HORIZON)
    actual = history.select("entity_id", "ds", F.col("ret").alias("y"))
    slices = (F.datediff(standins.newest_day(t), F.col("cut")) / forecast.HORIZON).cast("int")
    more = made.withColumn("slice", slices).join(actual, ["entity_id", "ds"])
    plain = _backtest(t, history)
    return materialise(plain.unionByName(more.select(*plain.columns)), "tested")


@query("stacked_leaderboard")
def stacked_leaderboard(t: Tables) -> DataFrame:
    """Back-test of all candidates, per-series smoothing and Theta among them, and their stack.

    Weights are non-negative least squares over the older twelve slices; the board is of the newest slice, which they have not seen.
    """
    tested = _all_tested(t)
    models = (*forecast.MODELS, "ets", "theta")
    keys = ["entity_id", "slice", "h"]
    chosen = stacking.weights(tested.where("slice > 1"), keys, models)
    newest = tested.where("slice = 1")
    board = forecast.leaderboard(newest.unionByName(stacking.stacked(newest, keys, chosen)))
    shares = t.spark.createDataFrame(list(chosen.items()), "model string, weight double")
    return board.join(F.broadcast(shares), "model", "left")


@query("smoothing_forecast")
def smoothing_forecast(t: Tables) -> DataFrame:
    """Smoothing and Theta 28 days ahead of the newest day, with the parameters each series chose."""
    return smoothing.candidates(returns(t), [0], forecast.HORIZON)


@query(
    "quantile_forecast",
    f"""
WITH {STATE_SQL},
best AS (SELECT model FROM (SELECT model, sqrt(AVG(pow(y - yhat, 2))) AS r FROM tested GROUP BY model) ORDER BY r, model LIMIT 1),
spread AS (SELECT h, {", ".join(f"quantile_cont(y - yhat, {p}) AS {q}" for q, p in forecast.LEVELS.items())}
           FROM tested SEMI JOIN best USING (model) GROUP BY h)
SELECT entity_id, ds, h, model, ROUND(yhat, 9) + 0.0 AS mean, {", ".join(f"ROUND(yhat + {q}, 9) + 0.0 AS {q}" for q in forecast.LEVELS)}
FROM candidates SEMI JOIN best USING (model) JOIN spread USING (h) WHERE cut = {LAST}
""",
)
def quantile_forecast(t: Tables) -> DataFrame:
    """Best candidate 28 days ahead with four quantiles from back-test errors."""
    history = written_returns(t)
    out = forecast.quantile_forecast(history, standins.newest_day(t), _tested(t, history), series_rows=calendar_rows(t))
    return rounded(out, "mean", *forecast.LEVELS, digits=9)


@query(
    "interval_forecast",
    f"""
WITH {STATE_SQL},
width AS (SELECT model, quantile_cont(abs(y - yhat), 0.95) AS width FROM tested WHERE slice = 1 GROUP BY model)
SELECT entity_id, cut, h, ds, model, ROUND(yhat, 9) + 0.0 AS yhat, ROUND(yhat - width, 9) + 0.0 AS conf_lo, ROUND(yhat + width, 9) + 0.0 AS conf_hi
FROM candidates JOIN width USING (model) WHERE cut = {LAST}
""",
)
def interval_forecast(t: Tables) -> DataFrame:
    """Every candidate 28 days ahead with an interval from held-out errors."""
    history = written_returns(t)
    states = materialise(newest_states(t, history, [forecast.HORIZON]), "states")
    out = forecast.interval_forecast(forecast.paths(at_newest(t, states)), _backtest(t, history, windows=1, states=states))
    return rounded(out, "yhat", "conf_lo", "conf_hi", digits=9)


def covariate_frame(t: Tables) -> DataFrame:
    """The quantile frame on regressor calendars without gaps, which reach over the horizon."""
    filled = {n: r if n == "monthly" else features.filled_calendar(r, forecast.HORIZON) for n, r in regressors(t).items()}
    return features.quantile_frame(materialise(known_returns(t), "known_returns"), filled, HOLIDAYS, train_until=F.date_sub(cut(), 28))


def quantile_rows(t: Tables) -> DataFrame:
    return _held_out_rows(t, covariate_frame(t))


def _held_out_rows(t: Tables, frame: DataFrame) -> DataFrame:
    rows = forecast.covariate_rows(frame, cut(), forecast.ABLATION["full"], series_rows=calendar_rows(t))
    return materialise(rows, "covariates")


@query("covariate_ablation")
def covariate_ablation(t: Tables) -> DataFrame:
    """Hold-out error of five covariate sets, one global boosted model each."""
    return forecast.ablation(quantile_rows(t))


@query("covariate_forecast")
def covariate_forecast(t: Tables) -> DataFrame:
    """Global model with known future covariates, predicted beyond the history."""
    frame = covariate_frame(t)
    model = forecast.fit_covariates(_held_out_rows(t, frame), forecast.ABLATION["full"])
    return model.transform(_covariates_ahead(t, frame)).select("entity_id", "ds", "h", "yhat")


def _covariates_ahead(t: Tables, frame: DataFrame) -> DataFrame:
    """State features and known covariates of the days beyond the history."""
    names = forecast.ABLATION["full"]
    ahead = frame.where("ret IS NULL")
    features.missing_covariates(ahead, names)
    state = forecast.states_at(frame.where("ret IS NOT NULL"), cut(), [0], series_rows=calendar_rows(t))
    steps = state.select("*", F.explode(F.sequence(F.lit(1), F.lit(forecast.HORIZON))).alias("h"))
    cols = forecast.candidate_columns(F.col("h"))
    flat = steps.select("entity_id", "h", F.date_add("ds", F.col("h")).alias("ds"), *[cols[c].alias(c) for c in forecast.STATE_FEATURES])
    return flat.join(ahead.select("entity_id", "ds", *names), ["entity_id", "ds"])


QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


def _quantile_columns() -> list[str]:
    return ["h", *forecast.STATE_FEATURES, *forecast.ABLATION["full"]]


@query("quantile_coverage")
def quantile_coverage(t: Tables) -> DataFrame:
    """Shares of held-out values below, and at most at, each fitted quantile: fitted on the older slices with known covariates, judged on the newest."""
    rows = quantile_rows(t)
    model = pinball.fit(rows.where("slice > 1"), _quantile_columns(), "y", list(QUANTILES.values()))
    held = model.predict(rows.where("slice = 1 and y is not null"), list(QUANTILES))
    # most days repeat the value of the day before, so many returns are 0: a level in that mass lies between the two shares
    y = F.round("y", 6)
    below = {q: F.avg((y < F.round(q, 6)).cast("double")) for q in QUANTILES}
    at_most = {q: F.avg((y <= F.round(q, 6)).cast("double")) for q in QUANTILES}
    rows = F.array(*[F.struct(F.lit(q).alias("level"), F.lit(v).alias("wanted"), below[q].alias("below"), at_most[q].alias("at_most"), F.count(F.lit(1)).alias("n")) for q, v in QUANTILES.items()])
    return held.agg(rows.alias("rows")).select(F.explode("rows").alias("p")).select("p.*")


@query("quantile_regression")
def quantile_regression(t: Tables) -> DataFrame:
    """Five fitted quantiles of every series 28 days ahead, with covariates known ahead; levels never cross."""
    frame = covariate_frame(t)
    model = pinball.fit(_held_out_rows(t, frame), _quantile_columns(), "y", list(QUANTILES.values()))
    return model.predict(_covariates_ahead(t, frame), list(QUANTILES)).select("entity_id", "ds", "h", *QUANTILES)


def recipe_rows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature rows of train, test and future; what is not a function of the day is written once for all recipes."""
    frame = materialise(features.recipe_frame(known_returns(t), regressors(t)), "recipe_frame")
    history = frame.where("ret IS NOT NULL")
    train, _ = time_split(history, 30, last=cut())
    full = recipes.feature_frame(frame, train)
    known = full.where("ret IS NOT NULL")
    edge = F.date_sub(cut(), 30)
    return known.where(F.col("ds") <= edge), known.where(F.col("ds") > edge), full.where("ret IS NULL")


@query("recipe_grid")
def recipe_grid(t: Tables) -> DataFrame:
    """Sixteen feature recipes fitted on the train rows and compared on the test rows."""
    train, test, _ = recipe_rows(t)
    return accuracy(recipes.recipe_table(recipes.fit_recipes(train), train, test))


@query("model_search")
def model_search(t: Tables) -> DataFrame:
    """Ten-fold search over penalties for all sixteen recipes, each recipe's best compared on the test rows.

    16 recipes x 22 penalties x 10 folds and 16 refits, from one pass over the train rows.
    """
    train, test, _ = recipe_rows(t)
    return accuracy(recipes.recipe_table(recipes.linear_search(train).models, train, test))


@query("tree_search")
def tree_search(t: Tables) -> DataFrame:
    """Forest and boosted trees with ten folds on the recipe of all regressors, compared on the test rows (22 fits)."""
    train, test, _ = recipe_rows(t)
    trees, scores = recipes.tree_search(train, recipes.RECIPES[12])
    held = t.spark.createDataFrame(scores, "model string, cv_rmse double")
    return accuracy(recipes.model_table(trees, test)).join(F.broadcast(held), "model")


@query("model_scores")
def model_scores(t: Tables) -> DataFrame:
    """Cross-validated error of every recipe and penalty."""
    train, _, _ = recipe_rows(t)
    return t.spark.createDataFrame(recipes.linear_search(train).table, "recipe string, penalty double, absolute_share double, rmse double")


@query("recursive_forecast")
def recursive_forecast(t: Tables) -> DataFrame:
    """Thirty steps ahead with the lagged mean recomputed from earlier predictions."""
    train, test, _ = recipe_rows(t)
    recipe = recipes.RECIPES[13]
    model = recipes.fit_recipe(train, recipe)
    out = recipes.recursive_forecast(model, recipe, train, test)
    return out.join(test.select("entity_id", "ds", F.col("ret").alias("y")), ["entity_id", "ds"])


@query("refit_forecast")
def refit_forecast(t: Tables) -> DataFrame:
    """Base and full recursive recipe refitted on all history, future rows predicted."""
    train, test, future = recipe_rows(t)
    history = train.unionByName(test)
    base, rich = recipes.RECIPES[0], recipes.RECIPES[11]
    plain = recipes.predict(recipes.fit_recipe(history, base), future, "base").select("model", "entity_id", "ds", "yhat")
    model = recipes.fit_recipe(history, rich)
    ahead = recipes.recursive_forecast(model, rich, history, future)
    return plain.unionByName(ahead.withColumn("model", F.lit("all_regressors_ma7")))


@query("model_roundtrip")
def model_roundtrip(t: Tables) -> DataFrame:
    """A fitted pipeline saved, loaded, and both used on the test rows."""
    train, test, _ = recipe_rows(t)
    model = recipes.fit_recipe(train, recipes.RECIPES[12])
    path = shared_path(t.spark, "model")
    recipes.save_model(model, path)
    before = recipes.predict(model, test, "saved").select("entity_id", "ds", F.col("yhat").alias("saved"))
    after = recipes.predict(recipes.load_model(path), test, "loaded").select("entity_id", "ds", F.col("yhat").alias("loaded"))
    return before.join(after, ["entity_id", "ds"])
