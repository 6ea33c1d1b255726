"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import settle


def local_roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links and the smallest node that each is linked to, for the links of one task."""
    nodes, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[: len(left)], places[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node can reach: columns node, component.

    ``links`` has two columns of longs, in any direction, with repeats. The
    rounds alternate between two ways to hang neighbours below smaller nodes,
    until nothing changes; each is a minimum per node and a join. Every round
    is written to the shared folder, which cuts its lineage.
    """
    u, v = links.columns
    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    links = settle(links)
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # The same links twice: every node hangs directly below its smallest one.
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
