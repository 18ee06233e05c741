"""Exact top-k by inner product: cover trees over queries and over data, searched together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudentia.llm.common import stored

TOP = 20
EVERY = 20
SCALE = 64
#: Rows of one block of queries and of data that a task holds, and points of a leaf.
QUERY_BLOCK = 4096
DATA_BLOCK = 16_384
LEAF = 128
#: Radius of a node's children relative to its own.
SHRINK = 0.7


class Node:
    """Points within ``radius`` of the first of them, ``center``; inner nodes have children, leaves points."""

    __slots__ = ("center", "norm", "radius", "points", "children", "worst")

    def __init__(self, center: np.ndarray, radius: float, points: np.ndarray):
        self.center, self.radius, self.points = center, radius, points
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []
        self.worst = -np.inf


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree with leaves of several points.

    Every child is centred at a point of its node that no earlier child covers, within
    ``SHRINK`` times the node's radius. A node becomes a leaf where it is small, or where
    its points lie so far apart that the children would be mostly single points.
    """
    def node(points: np.ndarray) -> Node:
        center = vectors[points[0]]
        far = np.sqrt(((vectors[points] - center) ** 2).sum(axis=1))
        made = Node(center, float(far.max()), points)
        if len(points) <= leaf or made.radius == 0:
            return made
        rest, parts, bound = points, [], SHRINK * made.radius
        while len(rest):
            away = np.sqrt(((vectors[rest] - vectors[rest[0]]) ** 2).sum(axis=1))
            parts.append(rest[away <= bound])
            rest = rest[away > bound]
            if len(parts) * leaf > 4 * len(points):
                return made
        if len(parts) > 1:
            made.children = [node(p) for p in parts]
        return made

    return node(np.arange(len(vectors)))


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int = TOP,
           counted: list[int] | None = None) -> list[tuple]:
    """Per query the k best (score, id) of the data, its own id left out; ties to the smaller id.

    Pairs of nodes are taken in order of their bound: no product of points of two balls
    exceeds c·d + |c| r(d) + |d| r(c) + r(c) r(d). A pair goes if its bound is below the
    kth score of the worst query of its query node; equal bounds are kept for ties.
    ``counted`` gets the number of products of each pair of leaves that was compared.
    """
    # ints of moderate size have exact products in doubles; beyond that integers of any size
    largest = max(float(np.abs(queries).max(initial=0)), float(np.abs(data).max(initial=0)))
    exact = largest**2 * max(1, queries.shape[1]) < 2**52
    q, d = (queries, data) if exact else (queries.astype(object), data.astype(object))
    best = [np.empty((0, 2), dtype=np.float64 if exact else object) for _ in range(len(q))]
    kth = np.full(len(q), -np.inf)
    slack = 1e-9
    tree_q, tree_d = cover_tree(queries), cover_tree(data)

    def bound(a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + slack * (abs(top) + a.norm * b.norm + 1)

    def compare(a: Node, b: Node) -> None:
        if counted is not None:
            counted.append(len(a.points) * len(b.points))
        for part in (b.points[i:i + 1024] for i in range(0, len(b.points), 1024)):
            scores = q[a.points] @ d[part].T
            for row, i in enumerate(a.points):
                keep = scores[row] >= kth[i]
                keep &= ids[part] != query_ids[i]
                if keep.any():
                    new = np.stack([scores[row][keep], ids[part][keep].astype(scores.dtype)], axis=1)
                    both = np.concatenate([best[i], new])
                    order = np.lexsort((both[:, 1].astype(np.int64), -both[:, 0].astype(np.float64))) if exact else sorted(
                        range(len(both)), key=lambda r: (-both[r, 0], both[r, 1]))
                    best[i] = both[order[:k]]
                    if len(best[i]) == k:
                        kth[i] = float(best[i][-1, 0]) if exact else np.nextafter(float(best[i][-1, 0]), -np.inf)

    waiting, number = [(-bound(tree_q, tree_d), 0, tree_q, tree_d)], 0
    while waiting:
        negative, _, a, b = heapq.heappop(waiting)
        if -negative < kth[a.points].min():
            continue
        if not a.children and not b.children:
            compare(a, b)
            continue
        split_a = a.children and (not b.children or a.radius >= b.radius)
        for x, y in ([(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]):
            number += 1
            top = bound(x, y)
            if top >= kth[x.points].min():
                heapq.heappush(waiting, (-top, number, x, y))
    return [(int(query_ids[i]), int(row[1]), int(row[0])) for i, found in enumerate(best) for row in found]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(64 x) of every component; rows with NULL or non-finite components or without id or vector go."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c).cast("double")).alias("v"))


def top_products(vectors: DataFrame, k: int = TOP, every: int = EVERY, query_block: int = QUERY_BLOCK,
                 data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose vec_id is divisible by ``every``.

    Blocks of queries meet blocks of data, one pair a task, so that a task's memory is
    bounded by the block sizes; only their numbers come to the driver. Each pair gives k rows a query
    at most, and the best of these are ranked. Blocks are dealt by hash, so equal vectors
    spread. Vectors of different lengths are compared as if filled up with zeros. A vec_id
    that occurs several times is several candidates and, if it is a query, one query
    for its smallest vector.
    """
    rows = stored(integers(vectors), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = rows.agg(F.count("*"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")), F.max(F.size("v"))).first()
    data_blocks = max(1, -(-counts[0] // data_block))
    query_blocks = max(1, -(-(counts[1] or 0) // query_block))
    width = counts[2] or 0
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # several rows of one vec_id are dealt by their place, too, so that they spread
    data = rows.select((F.pmod(F.xxhash64("vec_id", "v"), F.lit(data_blocks))).cast("int").alias("block"), "vec_id", "v").select(
        all_of(query_blocks).alias("queries"), "block", "vec_id", "v")
    queries = asked.select((dealt % query_blocks).cast("int").alias("queries"), "vec_id", "v").select(
        "queries", all_of(data_blocks).alias("block"), "vec_id", "v")

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), width))
        for i, v in enumerate(frame["v"]):
            out[i, : len(v)] = v
        return out

    def pair(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(other):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = search(matrix(own), own["vec_id"].to_numpy(), matrix(other), other["vec_id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = queries.groupBy("queries", "block").cogroup(data.groupBy("queries", "block")).applyInPandas(
        pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
