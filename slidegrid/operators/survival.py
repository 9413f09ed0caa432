"""Survival tables, confidence bands, covariates and Cox regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidegrid.sources.shared import checkpointed


def part_of(cuts: list[float]) -> Column:
    """The range of a time: how many cuts are not above it."""
    return sum(((F.col("time") >= float(x)).cast("int") for x in cuts), F.lit(0))


def accumulated(rows: DataFrame, columns: list[str], down: bool = False, ranges: bool = True) -> DataFrame:
    """rows (group, part, time and others) with `run_` sums of the columns over the group's times up to each, or, down, from each on.

    Sums run over the times of a range, and over the group's ranges, of which there are a few; so no task orders all times of a group.
    ranges: whether there is more than one range.
    """
    way = F.desc if down else F.asc
    inner = Window.partitionBy("group", "part").orderBy(way("time")).rowsBetween(Window.unboundedPreceding, 0)
    if not ranges:
        return rows.select(*rows.columns, *[F.sum(c).over(inner).alias(f"run_{c}") for c in columns])
    outer = Window.partitionBy("group").orderBy(way("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("group", "part").agg(*[F.sum(c).alias(f"o_{c}") for c in columns])
    parts = parts.select(F.col("group").alias("g"), F.col("part").alias("p"), *[F.coalesce(F.sum(f"o_{c}").over(outer), F.lit(0)).alias(f"o_{c}") for c in columns])
    joined = rows.join(parts, F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, *[(F.sum(c).over(inner) + F.col(f"o_{c}")).alias(f"run_{c}") for c in columns])


def kaplan_meier(subjects: DataFrame, few: int = 1_000_000) -> DataFrame:
    """For each group and distinct time at risk, events, censored, survival from it on and before it, and standard errors.

    subjects: group, time, event. Where there are more than `few` distinct times, running sums go over those of a range, and over ranges, never over a whole group. Survival
    is 0 from the time on at which all at risk have the event; its Greenwood errors are null there.
    """
    counted = subjects.groupBy("group", "time").agg(F.sum("event").alias("events"), F.count_if(F.col("event") == 0).alias("censored"), F.count("*").alias("c"))
    counted = checkpointed(counted)  # subjects are read once; what follows goes over their distinct times
    ranges = counted.count() > few
    counted = counted.withColumn("part", part_of(time_cuts(counted) if ranges else []))
    risk = accumulated(counted, ["c"], down=True, ranges=ranges).withColumnRenamed("run_c", "at_risk")
    share = 1 - F.col("events") / F.col("at_risk")
    steps = risk.withColumns({
        "ended": F.when(share <= 0, 1).otherwise(0),
        "log": F.when(share > 0, F.ln(share)).otherwise(0.0),
        "green": F.when(share > 0, F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(0.0),
    })
    steps = accumulated(steps, ["ended", "log", "green"], ranges=ranges).withColumnsRenamed({"run_ended": "_ended", "run_log": "_log", "run_green": "_green"})
    survival = F.when(F.col("_ended") > 0, 0.0).otherwise(F.exp("_log"))
    live = F.col("_ended") == 0
    before = F.when(F.col("_ended") > F.col("ended"), 0.0).otherwise(F.exp(F.col("_log") - F.col("log")))
    return steps.withColumn("survival", survival).select(
        "group", "time", "at_risk", "events", "censored", "survival", before.alias("before"),
        F.when(live, F.col("survival") * F.sqrt("_green")).alias("se"),
        F.when(live, F.sqrt("_green")).alias("se_log"),
        F.when(live & (F.col("survival") < 1), F.sqrt("_green") / F.abs(F.ln("survival"))).alias("se_loglog"),
    )


def confidence(table: DataFrame, z: float = 1.96) -> DataFrame:
    """ordinary, log and log-log bands of a survival table, clipped to 0 and 1."""
    def clipped(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    s = F.col("survival")
    power = F.exp(F.lit(z) * F.col("se_loglog"))
    return table.select(
        "group", "time",
        F.when(F.col("se").isNotNull(), clipped(s - z * F.col("se"))).alias("low"), F.when(F.col("se").isNotNull(), clipped(s + z * F.col("se"))).alias("high"),
        F.when(F.col("se_log").isNotNull(), clipped(s * F.exp(-z * F.col("se_log")))).alias("log_low"),
        F.when(F.col("se_log").isNotNull(), clipped(s * F.exp(z * F.col("se_log")))).alias("log_high"),
        F.when(F.col("se_loglog").isNotNull(), clipped(F.pow(s, power))).alias("loglog_low"),
        F.when(F.col("se_loglog").isNotNull(), clipped(F.pow(s, 1 / power))).alias("loglog_high"),
    )


def step_points(table: DataFrame) -> DataFrame:
    """Points of the step function: at each time the survival before it and from it on."""
    points = table.select("group", "time", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("before").alias("y")), F.struct(F.lit(1).alias("k"), F.col("survival").alias("y")))).alias("p"))
    return points.select("group", F.col("time").alias("x"), F.col("p.k").alias("step"), F.col("p.y").alias("y"))


def checked(rows: DataFrame) -> DataFrame:
    """rows with text columns time, event, group as numbers, with the defaults event 1 and "Default Group", and what is wrong."""
    time, event = F.expr("try_cast(time AS DOUBLE)"), F.coalesce(F.expr("try_cast(event AS INT)"), F.when(F.col("event").isNull(), 1))
    bad = F.when(time.isNull() | (time < 0), "time").when(event.isNull() | ~event.isin(0, 1), "event")
    return rows.select("subject", time.alias("time"), event.alias("event"), F.coalesce("group", F.lit("Default Group")).alias("group"), bad.alias("error"))


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns that are not binary, minus their mean and by their sample standard deviation; one pass for all figures."""
    figures = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev), ("d", F.count_distinct))])
    both = rows.crossJoin(F.broadcast(figures))
    new = {c: F.when(F.col(f"_d_{c}") == 2, F.col(c).cast("double")).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return both.withColumns(new).select(*rows.columns)


def complete(rows: DataFrame, flip: bool = False) -> DataFrame:
    """rows without missing values; flip turns the event flag around."""
    kept = rows.dropna("any")
    return kept.withColumn("event", 1 - F.col("event")) if flip else kept


def two_figures(x: Column) -> Column:
    """a number with two significant decimal figures; 0 stays 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x / power, 1) * power)


def time_cuts(rows: DataFrame, parts: int = 64) -> list[float]:
    """Times that cut the subjects in about `parts` ranges of one size."""
    return sorted(set(rows.approxQuantile("time", [i / parts for i in range(1, parts)], 0.5 / parts)))


def risk_sums(rows: DataFrame, columns: list[str], beta: np.ndarray, cuts: list[float] | None = None) -> DataFrame:
    """For each event time sums over the subjects still at risk (times from it on) of exp(xb), x exp(xb), xx' exp(xb), and over its events.

    Sums are first made for each distinct time; running sums go over the times of a range, and over the ranges, of which there are a few.
    """
    w = F.exp(sum((F.col(c) * float(b) for c, b in zip(columns, beta, strict=True)), F.lit(0.0)))
    n = len(columns)
    values = {"w": w} | {f"x{i}": w * F.col(columns[i]) for i in range(n)} | {f"x{i}_{j}": w * F.col(columns[i]) * F.col(columns[j]) for i in range(n) for j in range(i, n)}
    dead = F.col("event") == 1
    by_time = rows.groupBy("time").agg(
        *[F.sum(v).alias(f"r_{k}") for k, v in values.items()], *[F.sum(F.when(dead, v).otherwise(0.0)).alias(f"d_{k}") for k, v in values.items()],
        *[F.sum(F.when(dead, F.col(c)).otherwise(0.0)).alias(f"s_{i}") for i, c in enumerate(columns)], F.count_if(dead).alias("deaths"),
    )
    ranged = by_time.withColumn("part", part_of(time_cuts(rows) if cuts is None else cuts))
    beyond = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("part").agg(*[F.sum(f"r_{k}").alias(f"r_{k}") for k in values])
    ranges = ranges.select("part", *[F.coalesce(F.sum(f"r_{k}").over(beyond), F.lit(0.0)).alias(f"o_{k}") for k in values])
    later = Window.partitionBy("part").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.select("time", "part", "deaths", *[F.sum(f"r_{k}").over(later).alias(f"r_{k}") for k in values], *[f"d_{k}" for k in values], *[f"s_{i}" for i in range(n)])
    joined = within.where("deaths > 0").join(F.broadcast(ranges), "part")
    return joined.select("time", "deaths", *[(F.col(f"r_{k}") + F.col(f"o_{k}")).alias(f"r_{k}") for k in values], *[f"d_{k}" for k in values], *[f"s_{i}" for i in range(n)])


def cox(rows: DataFrame, columns: list[str], most: int = 25, tolerance: float = 1e-7) -> dict:
    """Newton steps of the Cox model with Efron's ties: only sums for the whole model reach the driver.

    Each step is one aggregation; its result has 1 + p + p * p numbers. Steps that don't raise the likelihood are halved.
    """
    n = len(columns)
    rows = rows.select("time", "event", *[F.col(c).cast("double").alias(c) for c in columns]).persist()

    cuts = time_cuts(rows)

    def figures(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = risk_sums(rows, columns, beta, cuts).select("*", F.explode(F.expr("sequence(0, CAST(deaths AS INT) - 1)")).alias("l"))
        part = F.col("l") / F.col("deaths")
        of = lambda k: F.col(f"r_{k}") - part * F.col(f"d_{k}")
        first = F.col("l") == 0
        likelihood = sum((F.when(first, F.col(f"s_{i}") * float(beta[i])).otherwise(0.0) for i in range(n)), F.lit(0.0)) - F.ln(of("w"))
        aggs = [F.sum(likelihood)]
        aggs += [F.sum(F.when(first, F.col(f"s_{i}")).otherwise(0.0) - of(f"x{i}") / of("w")) for i in range(n)]
        aggs += [F.sum(of(f"x{i}_{j}") / of("w") - of(f"x{i}") * of(f"x{j}") / (of("w") * of("w"))) for i in range(n) for j in range(i, n)]
        got = list(sums.agg(*aggs).first())
        h = np.zeros((n, n))
        h[np.triu_indices(n)] = got[1 + n :]
        return got[0], np.array(got[1 : 1 + n], float), h + np.triu(h, 1).T

    beta = np.zeros(n)
    value, slope, curve = figures(beta)
    converged = False
    for _ in range(most):
        step = np.linalg.solve(curve, slope)
        for _ in range(10):
            new = figures(beta + step)
            if new[0] >= value - 1e-12:
                break
            step = step / 2
        beta = beta + step
        done = abs(new[0] - value) < tolerance * (abs(value) + tolerance)
        value, slope, curve = new
        if done:
            converged = True
            break
    rows.unpersist()
    return {"beta": beta, "se": np.sqrt(np.diag(np.linalg.inv(curve))), "converged": converged, "log_likelihood": value}


def cox_each(rows: DataFrame, columns: list[str], most: int = 25, tolerance: float = 1e-7) -> dict[str, dict]:
    """The Cox models, with Efron's ties, of every covariate by itself, all in the same jobs.

    A long table has a row for each subject and covariate. Each Newton step is one aggregation over it for all covariates that have not converged
    yet; three numbers for each of them reach the driver. Each covariate halves its own step and ends by itself.
    """
    long = rows.select("time", F.col("event").cast("int").alias("event"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v"))
    long = checkpointed(long.select("time", "event", "v.c", "v.x"))
    cuts = time_cuts(rows)
    part = part_of(cuts)
    sums = {"w": F.col("w"), "wx": F.col("w") * F.col("x"), "wxx": F.col("w") * F.col("x") * F.col("x")}
    dead = F.col("event") == 1

    def figures(beta: dict[str, float]) -> dict[str, tuple[float, float, float]]:
        betas = F.broadcast(rows.sparkSession.createDataFrame(list(beta.items()), "c string, b double"))
        weighed = long.join(betas, "c").withColumn("w", F.exp(F.col("x") * F.col("b")))
        by_time = weighed.groupBy("c", "b", "time", part.alias("part")).agg(
            *[F.sum(v).alias(f"r_{k}") for k, v in sums.items()], *[F.sum(F.when(dead, v).otherwise(0.0)).alias(f"d_{k}") for k, v in sums.items()],
            F.sum(F.when(dead, F.col("x")).otherwise(0.0)).alias("s"), F.count_if(dead).alias("deaths"),
        )
        beyond = Window.partitionBy("c").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        ranges = by_time.groupBy("c", "part").agg(*[F.sum(f"r_{k}").alias(f"r_{k}") for k in sums])
        ranges = ranges.select("c", "part", *[F.coalesce(F.sum(f"r_{k}").over(beyond), F.lit(0.0)).alias(f"o_{k}") for k in sums])
        later = Window.partitionBy("c", "part").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
        within = by_time.select("c", "b", "part", "deaths", "s", *[F.sum(f"r_{k}").over(later).alias(f"r_{k}") for k in sums], *[f"d_{k}" for k in sums])
        risk = within.where("deaths > 0").join(ranges, ["c", "part"]).withColumn("l", F.explode(F.expr("sequence(0, CAST(deaths AS INT) - 1)")))
        of = lambda k: F.col(f"r_{k}") + F.col(f"o_{k}") - F.col("l") / F.col("deaths") * F.col(f"d_{k}")
        first = F.when(F.col("l") == 0, F.col("s")).otherwise(0.0)
        got = risk.groupBy("c").agg(
            F.sum(first * F.col("b") - F.ln(of("w"))).alias("value"), F.sum(first - of("wx") / of("w")).alias("slope"), F.sum(of("wxx") / of("w") - F.pow(of("wx") / of("w"), 2)).alias("curve"),
        )
        return {r.c: (r.value, r.slope, r.curve) for r in got.collect()}

    beta = dict.fromkeys(columns, 0.0)
    at = {c: v for c, v in figures(beta).items() if v[2] > 0}
    step = {c: v[1] / v[2] for c, v in at.items()}
    taken, halved, converged = dict.fromkeys(at, 0), dict.fromkeys(at, 0), set()
    while live := [c for c in at if c not in converged and taken[c] < most]:
        new = figures({c: beta[c] + step[c] for c in live})
        for c in live:
            if new[c][0] < at[c][0] - 1e-12 and halved[c] < 10:
                step[c] /= 2
                halved[c] += 1
                continue
            if abs(new[c][0] - at[c][0]) < tolerance * (abs(at[c][0]) + tolerance):
                converged.add(c)
            beta[c] += step[c]
            at[c], step[c] = new[c], new[c][1] / new[c][2] if new[c][2] > 0 else 0.0
            taken[c] += 1
            halved[c] = 0
    return {c: {"beta": beta[c], "se": at[c][2] ** -0.5 if c in at and at[c][2] > 0 else float("nan"), "converged": c in converged} for c in columns}


def wald(spark: SparkSession, fits: dict[str, tuple[float, float, bool]], z: float = 1.959963984540054) -> DataFrame:
    """One row for each covariate: hazard ratio, its 95 % interval and Wald's p, from its coefficient, error, and whether it converged."""
    out = [(c, math.exp(b), math.exp(b - z * s), math.exp(b + z * s), math.erfc(abs(b / s) / math.sqrt(2)), ok) for c, (b, s, ok) in fits.items()]
    return spark.createDataFrame(out, "variable string, hazard_ratio double, low double, high double, p double, converged boolean")


def cox_each_table(spark: SparkSession, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Hazard ratio, interval and p of each covariate by itself."""
    return wald(spark, {c: (f["beta"], f["se"], f["converged"]) for c, f in cox_each(rows, columns).items()})


def cox_table(spark: SparkSession, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Hazard ratio, interval and p of each covariate in the model of all."""
    fit = cox(rows, columns)
    return wald(spark, {c: (b, s, fit["converged"]) for c, b, s in zip(columns, fit["beta"].tolist(), fit["se"].tolist(), strict=True)})


def side_by_side(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables by variable, the columns of either with its own prefix."""
    left = one.select("variable", *[F.col(c).alias(f"uni_{c}") for c in one.columns if c != "variable"])
    right = other.select("variable", *[F.col(c).alias(f"multi_{c}") for c in other.columns if c != "variable"])
    return left.join(right, "variable", "full_outer")
