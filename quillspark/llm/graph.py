"""Connected components by distributed union-find, in DataFrame functions only.

Large-star and small-star steps in turn point every node at the smallest node it knows of until nothing changes. Minima
are combined before the shuffle and joins meet a hub's edges with one row, so a hub with any number of edges is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _minima(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")


def _large(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the smallest node it knows."""
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
    m = _minima(both)
    return written(both.join(m, "u").where("v > u").selectExpr("v AS u", "least(u, m) AS v").where("u <> v").distinct(), "stars"), m


def _small(edges: DataFrame) -> DataFrame:
    """Every node tells its smaller neighbours, and itself, the smallest of them. Edges run from larger to smaller."""
    m = _minima(edges)
    told = edges.join(m, "u")
    return written(told.selectExpr("v AS u", "m AS v").unionByName(m.selectExpr("u", "m AS v")).where("u <> v").distinct(), "stars"), m


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of ``links(a, b)`` of longs: the smallest node that links reach, for every node with a link.

    Links to itself, repeated and reversed links, and links with a null change nothing; without links there are no rows.
    """
    edges = written(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        large, m1 = _large(edges)
        small, m2 = _small(large)
        for x in (edges, large, m1, m2):
            drop_written(x)
        new = _state(small)
        edges = small
        if new == state:
            break
        state = new
    return edges.selectExpr("u AS node", "v AS component").unionByName(edges.selectExpr("v AS node", "v AS component").distinct())
