"""Yeo-Johnson scaling, fitted by aggregation.

The likelihood of a power depends on a measure's distinct values and how often each occurs. Counts
repeat heavily, so each measure is first reduced to (value, users), a frame bounded by the number of
distinct counts, not by the users. Whole powers are tried on it at once; Newton's steps then climb to
the peak.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import by_value, number, yeo_johnson



@dataclass(frozen=True)
class PowerGrid:
    """The powers ``base + i / ticks`` for i from ``first`` to ``last``."""

    base: float
    first: int
    last: int
    ticks: float

    def powers(self) -> Column:
        base, ticks = number(self.base), number(self.ticks)
        return F.expr(f"transform(sequence({self.first}, {self.last}), i -> {base} + i / {ticks})")


@dataclass(frozen=True)
class PowerScale:
    """Fitted power of one measure, with mean, deviation and limits of the transformed values."""

    measure: str
    power: float
    mean: float
    deviation: float
    low: float
    high: float
    log_likelihood: float | None = None

    def transformed(self) -> Column:
        return yeo_johnson(self.measure, number(self.power))

    def standardized(self) -> Column:
        """Zero mean and unit (population) deviation; 0 for a constant measure."""
        if not self.deviation > 0:
            return F.lit(0.0)
        return (self.transformed() - self.mean) / self.deviation

    def scaled(self) -> Column:
        """Scaled to [0, 1]; 0 for a constant measure."""
        if not self.high > self.low:
            return F.lit(0.0)
        return (self.transformed() - self.low) / (self.high - self.low)


def value_counts(users: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(measure, value, users): how many users have each value."""
    doubles = [F.col(m).cast("double").alias(m) for m in measures]
    return (
        users.select(*doubles)
        .unpivot([], list(measures), "measure", "value")
        .groupBy("measure", "value")
        .agg(F.count(F.lit(1)).alias("users"))
    )


def power_likelihoods(values: DataFrame, grids: dict[str, PowerGrid]) -> DataFrame:
    """Log-likelihood and moments of every power of the grid that belongs to each measure."""
    if len(set(grids.values())) == 1:
        powers = next(iter(grids.values())).powers()
    else:
        powers = by_value("measure", {m: grid.powers() for m, grid in grids.items()})
    tried = values.select(
        "measure", "value", F.expr("double(users)").alias("users"), F.explode(powers).alias("power")
    )
    sums = (
        tried.withColumn("y", yeo_johnson("value", "power"))
        .groupBy("measure", "power")
        .agg(
            F.expr("sum(users)").alias("total"),
            F.expr("sum(users * y)").alias("sum_y"),
            F.expr("sum(users * y * y)").alias("sum_yy"),
            F.expr("sum(users * signum(value) * log1p(abs(value)))").alias("jacobian"),
            F.min("y").alias("low"),
            F.max("y").alias("high"),
            F.expr("count(*) > 1").alias("varies"),
        )
    )
    moments = sums.selectExpr(
        "*", "sum_y / total AS mean", "sum_yy / total - pow(sum_y / total, 2) AS variance"
    ).withColumn(
        # Far powers can leave the range of doubles; they are not the best.
        "varies", F.expr("varies AND variance > 0 AND variance < double('infinity')")
    )
    likelihood = "-total / 2 * ln(variance) + (power - 1) * jacobian"
    return moments.selectExpr(
        "measure",
        "power",
        f"CASE WHEN varies THEN {likelihood} END AS log_likelihood",
        "mean",
        "CASE WHEN varies THEN sqrt(variance) ELSE 0D END AS deviation",
        "low",
        "high",
    )


def best_powers(likelihoods: DataFrame) -> DataFrame:
    """The most likely power per measure; of equally likely ones the smallest.

    A constant measure has no likelihood and gets power 1; so does an empty one.
    """
    fit = "struct(power, log_likelihood, mean, deviation, low, high)"
    order = "CASE WHEN log_likelihood IS NOT NULL THEN struct(log_likelihood, -power) END"
    best = likelihoods.groupBy("measure").agg(F.expr(f"max_by({fit}, {order})").alias("fit"))
    rest = ["mean", "deviation", "low", "high"]
    return best.selectExpr(
        "measure",
        "coalesce(fit.power, 1D) AS power",
        "fit.log_likelihood",
        *[f"coalesce(fit.{name}, 0D) AS {name}" for name in rest],
    )


FIRST_POWERS = 32  # the search begins with the whole powers from -32 to 32
NEWTON_ROUNDS = 30  # far more than are ever needed; halving alone gets there in these


def _slopes(values: DataFrame, powers: dict[str, float]) -> DataFrame:
    """First and second derivative of the log-likelihood by the power, at one power per measure.

    They follow from the derivatives of the transformed values, as sums of one aggregation.
    """
    at = by_value("measure", {m: F.lit(p) for m, p in powers.items()})
    rows = values.withColumn("power", at).selectExpr(
        "measure",
        "double(users) AS n",
        "value",
        "log1p(abs(value)) AS u",
        "CASE WHEN value >= 0 THEN power ELSE 2 - power END AS m",
    )
    # Around the power 0 the quotients lose their digits; their series do not.
    z = "(m * u)"
    rows = rows.selectExpr("*", f"abs({z}) < 1e-3 AS near", f"exp({z}) AS e")
    rows = rows.selectExpr(
        "*", f"CASE WHEN near THEN u * (1 + {z} / 2 + {z} * {z} / 6 + {z} * {z} * {z} / 24) ELSE (e - 1) / m END AS g0"
    )
    rows = rows.selectExpr(
        "*", f"CASE WHEN near THEN u * u * (1 / 2D + {z} / 3 + {z} * {z} / 8) ELSE (u * e - g0) / m END AS g1"
    )
    rows = rows.selectExpr(
        "measure", "n", "value", "u", "CASE WHEN value >= 0 THEN g0 ELSE -g0 END AS y", "g1 AS dy",
        f"(CASE WHEN value >= 0 THEN 1 ELSE -1 END) * (CASE WHEN near THEN u * u * u * (1 / 3D + {z} / 4 + {z} * {z} / 10) ELSE (u * u * e - 2 * g1) / m END) AS ddy",
    )
    sums = rows.groupBy("measure").agg(
        F.expr("sum(n)").alias("total"),
        F.expr("sum(n * signum(value) * u)").alias("jacobian"),
        *(
            F.expr(f"sum(n * {x}) / sum(n)").alias(name)
            for name, x in (("a", "y"), ("b", "dy"), ("c", "ddy"), ("aa", "y * y"), ("ab", "y * dy"), ("bb", "dy * dy"), ("ac", "y * ddy"))
        ),
    )
    moved = sums.selectExpr(
        "*", "aa - a * a AS v", "2 * (ab - a * b) AS dv", "2 * (bb + ac - b * b - a * c) AS ddv"
    )
    return moved.selectExpr(
        "measure",
        "CASE WHEN v > 0 THEN jacobian - total / 2 * (dv / v) END AS slope",
        "CASE WHEN v > 0 THEN -total / 2 * (ddv / v - (dv / v) * (dv / v)) END AS curvature",
    )


def _climbed(values: DataFrame, best: dict[str, PowerScale], precision: float) -> dict[str, float]:
    """The peak of each measure's likelihood, from a whole power beside it, by Newton's steps.

    The sign of the slope tells on which side the peak lies; a step that leaves the interval known to
    hold it is replaced by halving the interval.
    """
    ranges = {m: (s.power - 1, s.power + 1) for m, s in best.items() if s.log_likelihood is not None}
    at = {m: best[m].power for m in ranges}
    moving = set(at)
    for _ in range(NEWTON_ROUNDS):
        if not moving:
            break
        rows = _slopes(values.filter(F.col("measure").isin(*moving)), {m: at[m] for m in moving})
        for r in rows.collect():  # one row per measure
            low, high = ranges[r.measure]
            if r.slope is not None and r.slope > 0:
                low = at[r.measure]
            elif r.slope is not None and r.slope < 0:
                high = at[r.measure]
            ranges[r.measure] = low, high
            bent = r.slope is not None and r.curvature is not None and r.curvature < 0
            new = at[r.measure] - r.slope / r.curvature if bent else (low + high) / 2
            if not low <= new <= high:
                new = (low + high) / 2
            # The next step would be about the square of this one.
            if abs(new - at[r.measure]) < precision**0.5 / 4:
                moving.discard(r.measure)
            at[r.measure] = new
    return at


def fit_power_scales(
    users: DataFrame, measures: Sequence[str], precision: float = 1e-4
) -> list[PowerScale]:
    """Fit all measures together; powers are whole multiples of ``precision``.

    Whole powers are tried first, over a range that grows on either side while the best one lies on
    its edge. The likelihood has one peak, so it lies within one of the best whole power, and a few
    Newton steps reach it. Of the multiples of ``precision`` around the peak the likeliest is taken,
    so the result does not depend on the order of sums. Every round is one small aggregation that
    returns one row per measure.
    """
    values = value_counts(users, measures).persist()
    try:
        grids = {m: PowerGrid(0.0, -FIRST_POWERS, FIRST_POWERS, 1.0) for m in measures}
        best: dict[str, PowerScale] = {}
        while grids:
            best |= _best(values.filter(F.col("measure").isin(*grids)), grids)
            grids = {m: g for m, old in grids.items() if (g := _wider(old, best.get(m)))}
        ticks = round(1 / precision)
        near = {m: round(p * ticks) / ticks for m, p in _climbed(values, best, precision).items()}
        while near:
            around = {m: PowerGrid(p, -1, 1, ticks) for m, p in near.items()}
            found = _best(values.filter(F.col("measure").isin(*near)), around)
            best |= found
            near = {m: s.power for m, s in found.items() if abs(s.power - near[m]) > precision / 2}
        return [best[m] for m in measures if m in best]
    finally:
        values.unpersist()


def _wider(grid: PowerGrid, best: PowerScale | None) -> PowerGrid | None:
    """A grid twice as far on the side on whose edge the best power lies."""
    if best is None or best.log_likelihood is None:
        return None
    if best.power <= grid.first:
        return PowerGrid(grid.base, 2 * grid.first, grid.last, grid.ticks)
    if best.power >= grid.last:
        return PowerGrid(grid.base, grid.first, 2 * grid.last, grid.ticks)
    return None


def _best(values: DataFrame, grids: dict[str, PowerGrid]) -> dict[str, PowerScale]:
    rows = best_powers(power_likelihoods(values, grids)).collect()  # one row per measure
    return {r.measure: _scale(r) for r in rows}


def _scale(r) -> PowerScale:
    return PowerScale(r.measure, r.power, r.mean, r.deviation, r.low, r.high, r.log_likelihood)


def add_power_features(users: DataFrame, scales: list[PowerScale]) -> DataFrame:
    """Add ``_yeojohnson`` (standardized) and ``_yeojohnson_scaled`` of every measure."""
    return users.withColumns(
        {f"{s.measure}_yeojohnson": s.standardized() for s in scales}
        | {f"{s.measure}_yeojohnson_scaled": s.scaled() for s in scales}
    )
