"""Merging of model states (long tensor tables: key, i, j, x) and the search for merge weights."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.checks import ConstraintError
from quern.session import materialise

PLACE = ["key", "i", "j"]
PARALLEL, SMALL = 0.9995, 1e-7


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, i, j, a, b): both states' values at each place; a place that one of them lacks is null there."""
    return a.select(*PLACE, F.col("x").alias("a")).join(b.select(*PLACE, F.col("x").alias("b")), PLACE, "full_outer")


def great_circle(a: DataFrame, b: DataFrame, t: float, parallel: float = PARALLEL) -> DataFrame:
    """The state at fraction t of the great circle from a to b, where each whole state is one vector.

    Cosine and norms are of all tensors together, from one aggregate, so every value gets the same two weights. States that
    are nearly parallel, opposite or zero are mixed linearly. Both must hold the same places.
    """
    both = materialise(paired(a, b), "states")
    s = both.agg(F.sum(F.col("a") * F.col("b")).alias("d"), F.sum(F.col("a") * F.col("a")).alias("p"), F.sum(F.col("b") * F.col("b")).alias("q"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("lone")).first()
    if s["lone"]:
        raise ConstraintError(f"{s['lone']} places are in one state only")
    left, right = 1 - t, t
    if s["p"] and s["q"] and math.sqrt(s["p"]) > SMALL and math.sqrt(s["q"]) > SMALL:
        cosine = max(-1.0, min(1.0, s["d"] / math.sqrt(s["p"]) / math.sqrt(s["q"])))
        angle = math.acos(cosine)
        if abs(cosine) <= parallel and abs(math.sin(angle)) > SMALL:
            left, right = math.sin((1 - t) * angle) / math.sin(angle), math.sin(t * angle) / math.sin(angle)
    return both.select(*PLACE, (F.col("a") * left + F.col("b") * right).alias("x"))


def merge_states(reference: DataFrame, deltas: list[DataFrame], weights: list[float], scale: float, before: str = "mean", parallel: float = PARALLEL) -> DataFrame:
    """reference + scale * the deltas' fold by great_circle.

    The fraction of each delta is its weight over that and the weight of those before, which is their mean or sum (before).
    """
    if len(deltas) != len(weights) or not deltas:
        raise ValueError("each delta needs a weight")
    if before not in ("mean", "sum"):
        raise ValueError(f"unknown weight of those before: {before}")
    merged = deltas[0]
    for k in range(1, len(deltas)):
        left = sum(weights[:k]) / (k if before == "mean" else 1)
        merged = great_circle(merged, deltas[k], weights[k] / max(left + weights[k], 1e-12), parallel)
    return paired(reference, merged).select(*PLACE, (F.col("a") + scale * F.col("b")).alias("x"))


def _loss_and_slopes(scores: list[str], target: str, weights: list[float]) -> list[Column]:
    """Mean loss of the mixed scores, and its slope by each score's share, as aggregates."""
    times = lambda s, w: F.transform(F.col(s), lambda v: v * F.lit(w))
    mixed = reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a + b), map(times, scores, weights))
    top = F.array_max("__m")
    total = F.aggregate(F.transform("__m", lambda v: F.exp(v - F.col("__top"))), F.lit(0.0), lambda a, v: a + v)
    wrong = F.transform("__m", lambda v, i: F.exp(v - F.col("__top")) / F.col("__z") - (i == F.col(target)).cast("double"))
    slope = lambda s: F.aggregate(F.zip_with("__d", s, lambda d, v: d * v), F.lit(0.0), lambda a, v: a + v)
    return [mixed, top, total, wrong, F.avg(F.log("__z") + F.col("__top") - F.get("__m", F.col(target))), *(F.avg(slope(s)) for s in scores)]


def gradient_search(examples: DataFrame, scores: list[str], target: str, steps: int = 80, rate: float = 0.5) -> DataFrame:
    """(step, loss, weights): the log of a search for the shares of score arrays that least the mean loss of the target place.

    Weights are softplus of free numbers, and shares are weights over their sum. A step is one aggregate over examples
    (partial sums of the loss and its slopes), after which the driver moves the few numbers by Adam. The best step is the one
    of least loss; equal weights come first.
    """
    rows = materialise(examples.select(*scores, F.col(target).cast("int").alias(target)), "examples")
    free, m, v, log = [math.log(math.e - 1)] * len(scores), [0.0] * len(scores), [0.0] * len(scores), []
    for step in range(steps + 1):
        weights = [math.log1p(math.exp(r)) if r < 30 else r for r in free]
        total = sum(weights)
        shares = [w / total for w in weights]
        mixed, top, z, wrong, *sums = _loss_and_slopes(scores, target, shares)
        got = rows.withColumn("__m", mixed).withColumn("__top", top).withColumn("__z", z).withColumn("__d", wrong).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        log.append((step, got[0], shares))
        if got[0] is None:
            break
        along = sum(g * w for g, w in zip(got[1:], shares))
        for k, g in enumerate(got[1:]):
            slope = (g - along) / total / (1 + math.exp(-free[k]))
            m[k], v[k] = 0.9 * m[k] + 0.1 * slope, 0.999 * v[k] + 0.001 * slope * slope
            free[k] -= rate * (m[k] / (1 - 0.9 ** (step + 1))) / (math.sqrt(v[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return examples.sparkSession.createDataFrame(log, "step int, loss double, weights array<double>")
