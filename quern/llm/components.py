"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins.

Labels, links and neighbourhoods stay distributed: each step is a grouped minimum (combined before the shuffle) and a
join on the node, which adaptive execution splits for hub nodes. Each round ends in a table in the shared folder.
At most FEW links (16 bytes each) are joined in one task instead, which spares the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

FEW = 1 << 20


def _joined(t: pa.Table) -> pa.Table:
    """(node, component) of a bounded number of links: every label falls to the least label that it meets."""
    names, ends = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
    u, v = ends[: t.num_rows], ends[t.num_rows :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            return pa.table({"node": names, "component": names[label]})
        label = new


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids -> (node, component), component being the smallest id that links reach.

    Only nodes with a link to another node occur in the result. Null ends and self-links are ignored; repeated and
    reversed links count once; an empty table gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "links")
    if e.count() <= FEW:
        return e.selectExpr("cast(u AS long) AS u", "cast(v AS long) AS v", "0 AS all").groupBy("all").applyInArrow(_joined, "node long, component long")
    last = None
    while True:
        e = materialise(e, "links")
        state = e.agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last or not state["c"]:
            break
        last = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(least, "u")
        e = j.select("u", F.col("m").alias("v")).unionByName(j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
