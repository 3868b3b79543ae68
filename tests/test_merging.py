"""State merges, the weight search and state expiry."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from quern.operators import merging
from quern.operators.checks import ConstraintError
from quern.streaming import telemetry as S

SHAPES = {"a": (3, 4), "b": (1, 5)}


def state(spark, tensors):
    return spark.createDataFrame([(k, i, j, float(x[i, j])) for k, x in tensors.items() for i in range(x.shape[0]) for j in range(x.shape[1])], "key string, i long, j long, x double")


def flat(df):
    return np.array([r.x for r in df.orderBy("key", "i", "j").collect()])


def circle(a, b, t):
    c = a @ b / np.linalg.norm(a) / np.linalg.norm(b) if np.linalg.norm(a) and np.linalg.norm(b) else 1.0
    o = math.acos(max(-1, min(1, c)))
    return (1 - t) * a + t * b if abs(c) > 0.9995 else (math.sin((1 - t) * o) * a + math.sin(t * o) * b) / math.sin(o)


def test_states_are_one_vector(spark):
    rng = np.random.default_rng(0)
    make = lambda: {k: rng.normal(size=s) for k, s in SHAPES.items()}
    x, y, z = make(), make(), make()
    v = lambda s: np.concatenate([s[k].ravel() for k in sorted(s)])
    assert flat(merging.great_circle(state(spark, x), state(spark, y), 0.3)) == pytest.approx(circle(v(x), v(y), 0.3))
    near, zero = {k: w * 2 for k, w in x.items()}, {k: w * 0 for k, w in x.items()}
    for other in (near, zero):
        assert flat(merging.great_circle(state(spark, x), state(spark, other), 0.25)) == pytest.approx(0.75 * v(x) + 0.25 * v(other))
    for before, weight in (("mean", 1.5), ("sum", 3.0)):
        got = merging.merge_states(state(spark, z), [state(spark, s) for s in (x, y, z)], [1.0, 2.0, 4.0], 0.5, before)
        want = v(z) + 0.5 * circle(circle(v(x), v(y), 2 / 3), v(z), 4 / (4 + weight))
        assert flat(got) == pytest.approx(want)
    with pytest.raises(ConstraintError):
        merging.great_circle(state(spark, x), state(spark, {"a": x["a"]}), 0.5)
    with pytest.raises(ValueError):
        merging.merge_states(state(spark, x), [state(spark, x)], [1.0, 2.0], 1.0)


def test_gradient_search_meets_the_grid(spark):
    rng = np.random.default_rng(1)
    n, c = 60, 5
    good, bad = rng.normal(size=(n, c)), rng.normal(size=(n, c))
    good[:, 0] += 1.0
    bad[:, 1] += 0.5
    df = spark.createDataFrame([(g.tolist(), b.tolist(), 0) for g, b in zip(good, bad)], "p array<double>, q array<double>, y int")
    log = merging.gradient_search(df, ["p", "q"], "y").orderBy("loss").collect()
    loss = lambda a: float(np.mean([np.log(np.exp(m).sum()) - m[0] for m in a * good + (1 - a) * bad]))
    grid = min((loss(k / 200), k / 200) for k in range(201))
    assert log[0].loss == pytest.approx(grid[0], abs=1e-3) and log[0].weights[0] == pytest.approx(grid[1], abs=0.03)
    assert len(log) == 81 and all(sum(r.weights) == pytest.approx(1) and r.loss == pytest.approx(loss(r.weights[0])) for r in log)
    assert [r.loss for r in merging.gradient_search(df.limit(0), ["p", "q"], "y").collect()] == [None]


def test_idle_runs_leave_the_state_store(spark, tmp_path):
    folder, start = tmp_path / "in", datetime(2024, 1, 1)
    row = lambda run, seq, hours, x: (run, seq, start + timedelta(hours=hours), x)
    batches = [[row("a", 1, 0, 1.0), row("b", 1, 0, 3.0)], [row("b", 2, 3, 5.0)], [row("b", 3, 6, 1.0)], [row("a", 9, 9, 7.0), row("b", 4, 9, 2.0)]]
    held = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run string, seq long, ts timestamp, x double").coalesce(1).write.parquet(str(folder / f"{k}"))
        source = spark.readStream.schema("run string, seq long, ts timestamp, x double").option("recursiveFileLookup", True).parquet(str(folder))
        out = S.smoothed(source, "run", "seq", "x", 0.5, "ts", idle=3600.0)
        seen = []
        q = out.writeStream.outputMode("update").foreachBatch(lambda d, e, seen=seen: seen.extend(map(tuple, d.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        held.append((q.lastProgress["stateOperators"][0]["numRowsTotal"], sorted(seen)))
    assert [h[0] for h in held][0] == 2 and held[2][0] <= 1  # a was idle for hours when b's later events came
    assert ("a", 1, 7.0) in held[3][1]  # and begins anew
