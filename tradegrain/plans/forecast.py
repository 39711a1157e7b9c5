"""Monthly revenue forecasts for many series at once.

Each series is one row holding its ordered monthly values (a bounded window of months). Smoothing
runs as a fold over that array inside the row, so series spread over the cluster with no Python code.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradegrain import fixed
from tradegrain.functions.numeric import as_double, percent, ratio, round_even
from tradegrain.functions.temporal import month_start
from tradegrain.operators.grouping import join_groups

HORIZON = 6
HOLDOUT = 4
MIN_MONTHS = 12

# Parameter grid of the damped trend: level, trend and damping weights.
GRID = list(
    product(
        [a / 10 for a in range(1, 10)],
        [b / 10 for b in range(1, 6)],
        [p / 100 for p in (80, 85, 90, 95, 98)],
    )
)
_GRID_POINT = "named_struct('alpha', {}D, 'beta', {}D, 'phi', {}D)"


def monthly(
    master: DataFrame,
    by: list[str],
    first: str = fixed.FORECAST_FIRST_MONTH,
    last: str = fixed.FORECAST_LAST_MONTH,
) -> DataFrame:
    """Revenue and distinct orders per month (and series key), inside the month window."""
    start = month_start(F.col("order_purchase_timestamp"))
    low, high = (F.to_date(F.lit(f"{m}-01")).cast("timestamp_ntz") for m in (first, last))
    return (
        master.withColumn("month", start)
        .where(F.col("month").between(low, high))
        .groupBy(*by, "month")
        .agg(as_double(F.sum("total_order_value")).alias("revenue"), F.count_distinct("order_id").alias("order_count"))
    )


def monthly_levels(
    master: DataFrame,
    levels: dict[str, str | None],
    first: str = fixed.FORECAST_FIRST_MONTH,
    last: str = fixed.FORECAST_LAST_MONTH,
) -> DataFrame:
    """Revenue and distinct orders per month for several levels at once, by one pass with GROUPING SETS.

    ``levels`` maps a level to the column of its keys, or to None for the level of all orders. A series is named
    ``level:key``, or ``level`` alone where there is no key; a null key is the empty one.
    """
    start = month_start(F.col("order_purchase_timestamp"))
    low, high = (F.to_date(F.lit(f"{m}-01")).cast("timestamp_ntz") for m in (first, last))
    keys = [column for column in levels.values() if column]
    rows = master.select(start.alias("month"), *keys, "total_order_value", "order_id").where(F.col("month").between(low, high))
    sets = [["month", column] if column else ["month"] for column in levels.values()]
    named = [
        F.when(F.grouping(column) == 0, F.concat(F.lit(f"{level}:"), F.coalesce(F.col(column), F.lit(""))))
        for level, column in levels.items()
        if column
    ]
    whole = next((level for level, column in levels.items() if not column), None)
    figures = [F.coalesce(*named, F.lit(whole)).alias("series"), F.sum("total_order_value").alias("sum"), F.count_distinct("order_id").alias("order_count")]
    counted = rows.groupingSets(sets, "month", *keys).agg(*figures)
    return counted.select("series", "month", as_double("sum").alias("revenue"), "order_count")


def series(months: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: values in month order, the number of months and the last month."""
    pairs = F.array_sort(F.collect_list(F.struct("month", "revenue")))
    return months.groupBy(*by).agg(pairs.alias("pairs")).select(
        *by,
        F.transform("pairs", lambda p: p["revenue"]).alias("y"),
        F.size("pairs").alias("months"),
        F.element_at("pairs", -1)["month"].alias("last_month"),
    )


def _smooth(y: Column, alpha: Column, beta: Column, phi: Column) -> Column:
    """Run the damped-trend recursion from (first value, first step); returns its final state."""
    zero = F.lit(0.0)
    start = F.struct(
        y[0].alias("level"), (y[1] - y[0]).alias("trend"), zero.alias("sse"), zero.alias("bias"), zero.alias("steps")
    )

    def step(state: Column, value: Column) -> Column:
        damped = phi * state["trend"]
        expected = state["level"] + damped
        level = alpha * value + (F.lit(1.0) - alpha) * expected
        trend = beta * (level - state["level"]) + (F.lit(1.0) - beta) * damped
        error = value - expected
        return F.struct(
            level.alias("level"),
            trend.alias("trend"),
            (state["sse"] + error * error).alias("sse"),
            (state["bias"] + error).alias("bias"),
            (state["steps"] + F.lit(1.0)).alias("steps"),
        )

    return F.aggregate(F.slice(y, 2, F.size(y)), start, step)


def _best(y: Column) -> Column:
    """The grid point with the least squared error; ties go to the smaller weights."""
    grid = F.expr("array(" + ", ".join(_GRID_POINT.format(*point) for point in GRID) + ")")

    def run(point: Column) -> Column:
        end = _smooth(y, point["alpha"], point["beta"], point["phi"])
        return F.struct(
            end["sse"].alias("sse"),
            point["alpha"].alias("alpha"),
            point["beta"].alias("beta"),
            point["phi"].alias("phi"),
            end["level"].alias("level"),
            end["trend"].alias("trend"),
            end["bias"].alias("bias"),
            end["steps"].alias("steps"),
        )

    return F.array_min(F.transform(grid, run))


def _ahead(fit: str, step: Column) -> Column:
    """Forecast ``step`` months ahead: level plus the damped sum of the trend."""
    phi = F.col(f"{fit}.phi")
    damping = F.aggregate(F.sequence(F.lit(1), step), F.lit(0.0), lambda acc, i: acc + F.pow(phi, i.cast("double")))
    return F.col(f"{fit}.level") + F.col(f"{fit}.trend") * damping


def _long_enough() -> Column:
    return F.col("months") >= MIN_MONTHS


def _with_fit(lines: DataFrame, best: Column) -> DataFrame:
    fitted = lines.withColumn("fit", best)
    mean_error = F.col("fit.bias") / F.col("fit.steps")
    spread = F.col("fit.sse") / F.col("fit.steps") - mean_error * mean_error
    return fitted.withColumn("residual_std", F.sqrt(F.greatest(spread, F.lit(0.0))))


def fit(lines: DataFrame) -> DataFrame:
    """Best parameters, end state and residual deviation of every series of at least 12 months."""
    return _with_fit(lines.where(_long_enough()), _best(F.col("y")))


def fit_report(fitted: DataFrame, by: list[str]) -> DataFrame:
    shown = [F.col(f"fit.{c}").alias(c) for c in ("alpha", "beta", "phi", "level", "trend", "sse")]
    return fitted.select(*by, "months", *shown, "residual_std")


def backtest(lines: DataFrame, by: list[str]) -> DataFrame:
    """Fit without the last four months and report the error on them."""
    held = lines.where(_long_enough()).withColumns(
        {
            "seen": F.slice("y", F.lit(1), F.size("y") - HOLDOUT),
            "actual": F.slice("y", F.lit(-HOLDOUT), F.lit(HOLDOUT)),
        }
    )
    fitted = held.withColumn("fit", _best(F.col("seen")))
    predicted = F.array(*[_ahead("fit", F.lit(h)) for h in range(1, HOLDOUT + 1)])
    misses = fitted.withColumn("predicted", predicted).withColumn(
        "pairs", F.arrays_zip("actual", "predicted")
    )

    def average(error) -> Column:
        return F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + error(p)) / float(HOLDOUT)

    relative = average(lambda p: F.abs(F.try_divide(p["actual"] - p["predicted"], p["actual"]))) * 100.0
    absolute = average(lambda p: F.abs(p["actual"] - p["predicted"]))
    return misses.select(
        *by, round_even(relative, 2).alias("mape"), round_even(absolute, 2).alias("mae"), "months"
    )


def _stepped(df: DataFrame) -> DataFrame:
    steps = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    month = F.add_months(F.col("last_month").cast("date"), F.col("step"))
    return steps.withColumn("ds", F.date_format(month, "yyyy-MM"))


def _fitted_rows() -> dict[str, Column]:
    """Forecast and bands that widen with the square root of the horizon."""
    point = _ahead("fit", F.col("step"))
    columns = {"forecast": point}
    for name, z in fixed.BAND_Z.items():
        width = F.lit(z) * F.col("residual_std") * F.sqrt(F.col("step").cast("double"))
        columns[f"ci_{name}_lower"] = F.greatest(F.lit(0.0), point - width)
        columns[f"ci_{name}_upper"] = point + width
    return columns


def _fallback_rows(kind: str) -> dict[str, Column]:
    """Last value times a fixed growth vector, with fixed relative bands."""
    growth = F.array(*map(F.lit, fixed.FALLBACK_GROWTH[kind]))
    point = F.element_at("y", -1) * F.element_at(growth, F.col("step"))
    columns = {"forecast": point}
    for name, (low, high) in fixed.FALLBACK_BANDS.items():
        columns[f"ci_{name}_lower"] = point * low
        columns[f"ci_{name}_upper"] = point * high
    return columns


def _shown(ahead: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    return ahead.select(*by, "step", "ds", *[col.alias(name) for name, col in columns.items()])


def forecast(fitted: DataFrame, by: list[str]) -> DataFrame:
    """Six months ahead with 80% and 95% bands."""
    ahead = _stepped(fitted)
    return _shown(ahead, by, _fitted_rows())


def fallback(lines: DataFrame, by: list[str], kind: str = "short_series") -> DataFrame:
    """Six months ahead without a model."""
    return _shown(_stepped(lines), by, _fallback_rows(kind))


def forecast_all(lines: DataFrame, by: list[str]) -> DataFrame:
    """Fitted forecasts where a sound fit exists, the fitting fallback for every other series."""
    tried = _with_fit(lines, F.when(_long_enough(), _best(F.col("y"))))
    error = F.col("fit.sse")
    sound = F.coalesce(~F.isnan(error) & (F.abs(error) < float("inf")), F.lit(False))
    ahead = _stepped(tried)
    fitted, failed, short = _fitted_rows(), _fallback_rows("failed_fit"), _fallback_rows("short_series")
    chosen = {
        name: F.when(sound, fitted[name]).when(_long_enough(), failed[name]).otherwise(short[name]) for name in fitted
    }
    return _shown(ahead, by, chosen)


def quarter_growth(lines: DataFrame, ahead: DataFrame, by: list[str]) -> DataFrame:
    """Next three months against the last three; a fixed rate when there is no base."""
    following = ahead.where(F.col("step") <= 3).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("step", "forecast"))).alias("parts"),
    )

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    # One row per series on both sides; without a key there is one series.
    single = F.lit(1).alias("_only")
    both = join_groups(lines.select("*", single), following.select("*", single), by, plain=("_only",))
    projected = add(F.transform("parts", lambda p: p["forecast"]))
    recent = add(F.slice("y", F.greatest(F.lit(1), F.size("y") - 2), F.lit(3)))
    growth = F.when(recent > 0, percent(projected - recent, recent)).otherwise(fixed.GROWTH_WITHOUT_BASE)
    return both.select(
        *by,
        round_even(projected, 2).alias("projected_revenue"),
        recent.alias("recent_revenue"),
        round_even(growth, 1).alias("projected_growth_rate"),
    )


def scenarios(ahead: DataFrame) -> DataFrame:
    """Every forecast row under each scenario multiplier, bands included."""
    options = F.array(
        *[F.struct(F.lit(name).alias("scenario"), F.lit(factor).alias("multiplier")) for name, factor in fixed.SCENARIOS]
    )
    opened = ahead.select("*", F.inline(options))
    figures = [c for c in ahead.columns if c == "forecast" or c.startswith("ci_")]
    return opened.withColumns({c: F.col(c) * F.col("multiplier") for c in figures})
