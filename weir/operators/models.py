"""Linear and logistic models: scoring and fitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import array_literal, as_col, hashed_uniform, micros, with_count_le
from ..plans.lookups import lookup_join
from ..plans.ordering import ordered
from ..plans.streams import require_id
from ..plans.trailing import few_polls
from .samplers import DEFAULT_SEED


def _numbers(df: DataFrame, features: list[str | Column]) -> list[Column]:
    return [as_col(f).try_cast("double") for f in features]


def _mu(df: DataFrame, features: list, weights: list[float]) -> tuple[DataFrame, Column]:
    if len(features) != len(weights):
        raise ValueError("there must be one weight per feature")
    numbers = _numbers(df, features)
    complete = df
    for x in numbers:
        complete = complete.where(x.isNotNull())
    total = F.lit(0.0)
    for x, w in zip(numbers, weights):
        total = total + x * F.lit(float(w))
    return complete, total


def linear_model(df: DataFrame, features: list[str | Column], weights: list[float]) -> DataFrame:
    """``df`` with ``Response`` = Σ wᵢ·xᵢ (P9); rows with a feature that is no number are dropped."""
    complete, mu = _mu(df, features, weights)
    return complete.withColumn("Response", mu)


def logistic_model(
    df: DataFrame, features: list[str | Column], weights: list[float], id: str = "id",
    seed: int = DEFAULT_SEED, mode: str = "draw",
) -> DataFrame:
    """``df`` with ``Response`` (P10): 1.0 with probability 1/(1+e^-μ), else 0.0. With
    ``mode="probability"`` the probability itself."""
    if mode not in ("draw", "probability"):
        raise ValueError("mode is 'draw' or 'probability'")
    complete, mu = _mu(df, features, weights)
    p = 1 / (1 + F.exp(-mu))
    if mode == "probability":
        return complete.withColumn("Response", p)
    hit = hashed_uniform(seed, 1, id) <= p
    return complete.withColumn("Response", F.when(hit, 1.0).otherwise(0.0))


def moments(df: DataFrame, features: list[str | Column], response: str | Column) -> DataFrame:
    """One row with the sums of xᵢ·xⱼ (``xx_i_j``) and xᵢ·y (``xy_i``) and the row count ``n``:
    all that least squares needs. Partial aggregation; nothing but the sums is shuffled."""
    x, y = _numbers(df, features), as_col(response).try_cast("double")
    complete = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y")).dropna("any")
    d = len(features)
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx_{i}_{j}")
            for i in range(d) for j in range(i, d)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy_{i}") for i in range(d)]
    return complete.agg(F.count(F.lit(1)).alias("n"), *sums)


def learn_linear(
    df: DataFrame, features: list[str | Column], response: str | Column
) -> DataFrame:
    """Least-squares weights as one row with the array ``params`` (A12, linear loss).

    Online gradient steps over all rows tend to this optimum; here it is solved from one pass of
    moment sums. There is no intercept: add a constant feature for one.
    """
    d = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m in batch.to_dict("records"):
                if not m["n"]:
                    continue
                a = np.array([[m[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(d)]
                              for i in range(d)])
                b = np.array([m[f"xy_{i}"] for i in range(d)])
                out.append([float(v) for v in np.linalg.lstsq(a, b, rcond=None)[0]])
            yield pd.DataFrame({"params": out})

    return moments(df, features, response).mapInPandas(solve, "params array<double>")


def solved(df: DataFrame, d: int, out: str = "params") -> DataFrame:
    """``df`` with the least-squares weights from its columns ``xx_i_j`` (i <= j) and ``xy_i``, as the array ``out``.

    The d x d system is solved by a Cholesky factorisation, one column per element, so rows are solved in generated code.
    Null where the features (nearly) depend on each other or fewer messages than features were seen.
    """
    col = F.col
    for j in range(d):
        rest = col(f"xx_{j}_{j}")
        for k in range(j):
            rest = rest - col(f"_l_{j}_{k}") * col(f"_l_{j}_{k}")
        df = df.withColumn(f"_l_{j}_{j}", F.when(rest > F.abs(col(f"xx_{j}_{j}")) * 1e-12, F.sqrt(rest)))
        below = {}
        for i in range(j + 1, d):
            rest = col(f"xx_{j}_{i}")
            for k in range(j):
                rest = rest - col(f"_l_{i}_{k}") * col(f"_l_{j}_{k}")
            below[f"_l_{i}_{j}"] = rest / col(f"_l_{j}_{j}")
        df = df.withColumns(below) if below else df
    for i in range(d):
        rest = col(f"xy_{i}")
        for k in range(i):
            rest = rest - col(f"_l_{i}_{k}") * col(f"_z_{k}")
        df = df.withColumn(f"_z_{i}", rest / col(f"_l_{i}_{i}"))
    for i in reversed(range(d)):
        rest = col(f"_z_{i}")
        for k in range(i + 1, d):
            rest = rest - col(f"_l_{k}_{i}") * col(f"_w_{k}")
        df = df.withColumn(f"_w_{i}", rest / col(f"_l_{i}_{i}"))
    known = F.lit(True)
    for i in range(d):
        known = known & col(f"_w_{i}").isNotNull()
    weights = F.when(known, F.array(*[col(f"_w_{i}") for i in range(d)]))
    return df.withColumn(out, weights).drop(*[c for c in df.columns if c.startswith(("_l_", "_z_", "_w_"))])


def learn_at(
    events: DataFrame, polls: DataFrame, features: list[str | Column], response: str | Column, ts: str = "ts",
    id: str = "id", poll_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``params``, the least-squares weights of all messages up to each poll (A12, linear loss).

    Null before the messages determine the weights. Messages with a feature or response that is no number are skipped.
    The moments of the messages are running sums along time: with few polls they are added up between polls on the map side,
    so no message is shuffled; otherwise they are an ordered scan, which looks at the data first.
    """
    d = len(features)
    names = [f"xx_{i}_{j}" for i in range(d) for j in range(i, d)] + [f"xy_{i}" for i in range(d)]
    x, y = _numbers(events, features), as_col(response).try_cast("double")
    seen = events.select(
        micros(ts).alias("_us"), F.col(require_id(events, id)).alias("_id"), *[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y")
    ).dropna("any").select(
        "_us", F.lit(0).alias("_rank"), "_id",
        *[(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx_{i}_{j}") for i in range(d) for j in range(i, d)],
        *[(F.col(f"x{i}") * F.col("y")).alias(f"xy_{i}") for i in range(d)],
    )
    asked = polls.select(micros(poll_ts).alias("_us")).where("_us IS NOT NULL").distinct()
    times = few_polls(asked, "_us")
    if times:
        slots = with_count_le(
            seen.where(F.col("_us") <= times[-1]), "_slot", array_literal(times, "array<bigint>"), len(times), F.col("_us") - 1)
        seen = slots.groupBy("_slot").agg(
            F.max("_us").alias("_us"), F.lit(0).alias("_rank"), F.max("_id").alias("_id"), *[F.sum(n).alias(n) for n in names]
        ).drop("_slot")
    reads = asked.withColumn("_rank", F.lit(1))
    rows = seen.unionByName(reads, allowMissingColumns=True)
    scan = ordered(rows, ["_us", "_rank", "_id"], None, rows_per_chunk, bounded=bool(times)).scan(
        **{f"_run_{n}": ("sum", F.col(n)) for n in names})
    at_polls = scan.df.where("_rank = 1").select(F.col("_us").alias("_at"), *[F.col(f"_run_{n}").cast("double").alias(n) for n in names])
    found = solved(at_polls, d).select("_at", "params")
    return lookup_join(polls.withColumn("_us", micros(poll_ts)), found, ["_us"], ["_at"]).select(*polls.columns, "params")


def step_size(schedule: str, t: int, eta: float) -> float:
    """Step of iteration ``t`` = 1, 2, …: ``constant``, ``inverse`` in t, or ``bottou``
    (slowly falling, eta / (1 + eta·t))."""
    if schedule == "constant":
        return eta
    if schedule == "inverse":
        return eta / t
    if schedule == "bottou":
        return eta / (1 + eta * t)
    raise ValueError(f"unknown step function: {schedule!r}")


def gradient(
    df: DataFrame, features: list[str | Column], response: str | Column, params: list[float],
    loss: str,
) -> tuple[int, np.ndarray]:
    """Row count and mean gradient of the loss at ``params``, from one aggregation."""
    complete, mu = _mu(df, features, params)
    y = as_col(response).try_cast("double")
    if loss == "linear":
        error = mu - y
    elif loss == "logistic":
        error = 1 / (1 + F.exp(-mu)) - y
    else:
        raise ValueError(f"unknown loss function: {loss!r}")
    sums = [F.sum(error * x).alias(f"g{i}") for i, x in enumerate(_numbers(df, features))]
    row = complete.where(y.isNotNull()).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    n = row["n"]
    return n, np.array([row[f"g{i}"] or 0.0 for i in range(len(params))]) / max(n, 1)


def learn(
    df: DataFrame, features: list[str | Column], response: str | Column, loss: str = "logistic",
    step: str = "constant", init: list[float] | None = None, iterations: int = 20,
    eta: float = 1.0,
) -> DataFrame:
    """Weights after ``iterations`` gradient steps, one row with ``params``.

    Every step is one distributed aggregation over all rows; only one number per feature comes to
    the driver. The reference steps once per message instead, which is the same descent with
    noisier steps. Persist ``df`` if it is costly to compute.
    """
    params = np.array(init if init is not None else [0.0] * len(features), dtype="float64")
    if len(params) != len(features):
        raise ValueError("InitialState needs one value per feature")
    step_size(step, 1, eta)
    for t in range(1, iterations + 1):
        _, g = gradient(df, features, response, list(params), loss)
        params = params - step_size(step, t, eta) * g
        if not all(math.isfinite(p) for p in params):
            raise ValueError("the gradient steps diverge; choose a smaller eta")
    row = [([float(p) for p in params],)]
    return df.sparkSession.createDataFrame(row, "params array<double>")
