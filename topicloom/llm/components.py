"""Connected components of a graph that fits no single machine, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, settle

#: Graphs of up to so many edges (16 bytes each) are worked on by one executor task, larger ones by rounds.
SMALL = 1_000_000


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph -> node, root, by hooking and pointer jumping."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for x in (a, b):
            np.minimum.at(root, x, low)
            np.minimum.at(root, before[x], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, name: str = "components", small: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge list (u, v: bigint); root is the least node of its component.

    Union-find by rounds (Kiveris et al., 2014): every node's larger neighbours, then its smaller ones, are
    hung on its least neighbour, until nothing changes; the rounds grow as the logarithm of the longest
    path. Least neighbours are combined before their shuffle and met by a join that AQE can split, so a
    hub with any number of edges is no burden on one task. Each round is a written table. Self-loops,
    repeated edges and either direction are fine; nulls are dropped; no edges, no rows.
    """
    held = settle(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    if held.count() <= (SMALL if small is None else small):
        return settle(held.coalesce(1).mapInArrow(_one_task, "node long, root long"), name)
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    before = held.agg(mark).first()[0]
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.filter(F.col("u") != F.col("v")).distinct(), name)
        small = large.join(_least(large), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = settle(small.filter(F.col("u") != F.col("v")).distinct(), name)
        remove(held.sparkSession, *{f.rpartition("/")[0] for d in (held, large) for f in d.inputFiles()[:1]})
        now = new.agg(mark).first()[0]
        held = new
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))
