"""Connected components by alternating large-star / small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, release

#: Edges whose forest a task holds at once.
HELD = 1 << 20


def _stats(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Every node of these edges with the least node of its group."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:  # hook each root under the least root it meets, then shorten the paths
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(names[root[out]])], ["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task become stars (same components), HELD edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += batch.num_rows
        if size >= HELD:
            yield _stars(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _stars(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` bigint -> ``(node, component)``, component = least node reachable.

    Every node that occurs in an edge gets a row.  Self-loops and repeated or
    null-ended edges are allowed and add nothing.  Tasks first contract the edges they
    hold to stars, then stars are exchanged until nothing changes, or until no more than
    HELD edges (16 MB) are left: one task ends those.  Each round is
    written to the shared folder, so neither lineage nor driver memory grows.  A hub
    of a third of all edges is aggregated map-side and re-joined by a plain equi-join
    that adaptive execution may split.
    """
    told = lambda e: e.distinct().mapInArrow(_contract, "u long, v long")
    cur = cut(told(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges", narrow=True)
    seen = _stats(cur)
    while seen[0]:
        if seen[0] <= HELD:
            last, cur = cur, cut(cur.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")
            release(last)
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
        )
        last, cur = cur, cut(told(small), "edges", narrow=True)
        release(last)
        now = _stats(cur)
        if now == seen:
            break
        seen = now
    out = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out._written_to = cur._written_to  # for whoever has copied the result and releases it
    return out
