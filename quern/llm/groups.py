"""Joining rows with one row for each of their groups, where one group may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import partitions

HOT = 4


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[tuple[str, str]], size: str) -> DataFrame:
    """rows with the columns of their group; keys name pairs of a column of rows and one of groups, null being equal to null.

    groups is a written table of one row a group, whose column size counts the group's rows. A group that holds more than a
    share of 1 / (HOT * partitions) of all rows is sent to the rows, of which there are HOT * partitions at most; the others
    meet their rows in a shuffle, where none of them is large. Rows of no group are left out; column names must differ.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = total / (HOT * partitions(rows.sparkSession))
    hot, rest = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    same = lambda: reduce(lambda a, b: a & b, (F.col(r).eqNullSafe(F.col(g)) for r, g in keys))
    few = F.broadcast(hot)  # at most HOT * partitions rows
    return rows.join(few, same()).unionByName(rows.join(F.broadcast(hot.select(*(g for _, g in keys))), same(), "left_anti").join(rest, same()))
