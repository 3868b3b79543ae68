"""Vector expressions on array columns, in double precision, evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def scale(v: Column, k: Column) -> Column:
    return F.transform(as_double(v), lambda x: x * k)


def normalise(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, scale(v, 1 / n)).otherwise(as_double(v))


def add(*vs: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [as_double(v) for v in vs])


def logsumexp(v: Column) -> Column:
    m = F.array_max(v)
    return m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def softmax(v: Column) -> Column:
    z = logsumexp(v)
    return F.transform(v, lambda x: F.exp(x - z))


def nll(scores: Column, target: Column) -> Column:
    """-log softmax(scores)[target], target counted from 0."""
    return logsumexp(scores) - F.get(scores, target)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(y: Column) -> Column:
    return F.log(F.expm1(y))


def slerp_weights(cos: Column, t: Column, threshold: float = 0.9995) -> tuple[Column, Column]:
    """Weights of both vectors on the great circle; linear where the cosine is missing, too large, or its sine is nearly 0."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    linear = cos.isNull() | (F.abs(cos) > threshold) | (F.abs(F.sin(angle)) < 1e-8)
    return F.when(linear, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle)), F.when(linear, t).otherwise(F.sin(t * angle) / F.sin(angle))


def pool(tokens: Column, mask: Column, mode: str) -> Column:
    """One vector from token vectors: cls (first), mean (over mask), or last (the last masked token, either padding side)."""
    if mode == "cls":
        return F.get(tokens, F.lit(0))
    if mode == "mean":
        kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] > 0), lambda z: as_double(z["t"]))
        zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
        return F.transform(F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    if mode == "last":
        places = F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
        return F.get(tokens, F.array_max(places))
    raise ValueError(mode)


def truncate(v: Column, dim: int) -> Column:
    """First dim components, scaled to length 1 again."""
    return normalise(F.slice(v, 1, dim))


def merged(vectors: list[Column], weights: list[float], factor: float = 1.0) -> Column:
    """Vectors folded in one at a time: the running mean moves by each weight's share of the sum so far; scaled at the end."""
    m = as_double(vectors[0])
    for k in range(1, len(vectors)):
        share = weights[k] / sum(weights[: k + 1])
        m = add(scale(m, F.lit(1 - share)), scale(vectors[k], F.lit(share)))
    return scale(m, F.lit(factor))


def multi_slerp(df: DataFrame, vectors: list[str], weights: list[float], eps: float = 1e-8) -> DataFrame:
    """df with step and merged: the weighted mean on the sphere of unit vectors, and how far it is from their linear mean.

    Vectors are mapped to the tangent space at the normalised linear mean, averaged there, and mapped back; where a vector or
    the step is that mean itself (to within eps), the linear parts are taken.
    """
    total = sum(weights)
    share = [w / total for w in weights]
    df = df.withColumn("__u", normalise(add(*(scale(F.col(c), F.lit(w)) for c, w in zip(vectors, share)))))
    df = df.withColumns({f"__c{i}": dot(F.col(c), F.col("__u")) for i, c in enumerate(vectors)})
    sine = lambda i: F.sqrt(1 - F.col(f"__c{i}") * F.col(f"__c{i}"))
    df = df.withColumns({f"__k{i}": F.when(sine(i) > eps, w * F.acos(f"__c{i}") / sine(i)).otherwise(w) for i, w in enumerate(share)})
    side = lambda i, c: F.zip_with(as_double(F.col(c)), "__u", lambda x, z: F.col(f"__k{i}") * (x - F.col(f"__c{i}") * z))
    df = df.withColumn("__g", add(*(side(i, c) for i, c in enumerate(vectors)))).withColumn("step", norm(F.col("__g")))
    turn = F.when(F.col("step") > eps, F.sin("step") / F.col("step")).otherwise(0.0)
    out = df.withColumn("__turn", turn).withColumn("merged", F.zip_with("__u", "__g", lambda z, g: F.cos("step") * z + F.col("__turn") * g))
    return out.drop("__u", "__g", "__turn", *(f"__{x}{i}" for x in "ck" for i in range(len(vectors))))


def invalid_scores(rows: DataFrame, scores: str, n: int) -> DataFrame:
    """rows whose scores aren't n numbers, with problem: shape, or nan where one at any place is."""
    problem = F.when(F.size(scores) != n, "shape").when(F.exists(scores, F.isnan), "nan")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL")
