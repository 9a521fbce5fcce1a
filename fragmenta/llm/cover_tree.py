"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are dealt to blocks by hash. For each pair of blocks one task builds a cover tree over
both together and walks pairs of its nodes, a node of queries against a node of data. With centres c
and covering radii r no product in the pair exceeds cq.cd + rq|cd| + rd|cq| + rq rd; a pair that lies below the worst
kth score of the node's queries is pruned. Equal bounds are kept, so ties are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Rows of data and of queries in a block; the number of blocks grows with the table.
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
LEAF, BASE, CHILDREN = 48, 1.4, 24
#: Pairs of nodes of so few queries and rows are not opened further: one product of two matrices costs less.
FEW_QUERIES, FEW_DATA = 64, 256
#: Products below this are exact in float64, and score and rank fit into one int64 key.
EXACT = 1 << 48
#: Bounds beyond this prune nothing.
HUGE = 10**300


class Node:
    __slots__ = ("center", "norm", "radius", "children", "queries", "data")

    def __init__(self, points, center, radius, children, queries, data):
        self.center, self.radius, self.children, self.queries, self.data = center, radius, children, queries, data
        self.norm = float(np.sqrt(center @ center))


def build(points: np.ndarray, n_queries: int, rows: np.ndarray | None = None, center: int = 0) -> Node:
    """A cover tree over the points, of which the first n_queries are queries.

    A node's children cover its points within its radius divided by BASE; beyond CHILDREN centres, points go to
    the nearest. Equal points are one leaf.
    """
    rows = np.arange(len(points)) if rows is None else rows
    away = np.sqrt(((points[rows] - points[center]) ** 2).sum(axis=1))
    radius = float(away.max())
    children: list[Node] = []
    if len(rows) > LEAF and radius > 0:
        reach, left = radius / BASE, rows
        centers, nearest, at = [center], away.copy(), np.zeros(len(rows), int)
        while len(centers) < CHILDREN and (far := int(nearest.argmax())) is not None and nearest[far] > reach:
            d = np.sqrt(((points[left] - points[left[far]]) ** 2).sum(axis=1))
            closer = d < nearest
            at[closer], nearest[closer] = len(centers), d[closer]
            centers.append(int(left[far]))
        if len(centers) == 1:  # the radius is above its share by definition; only rounding leads here
            centers.append(int(rows[away.argmax()]))
            at[away.argmax()] = 1
        children = [build(points, n_queries, rows[at == i], c) for i, c in enumerate(centers) if (at == i).any()]
    # A little over, for what rounding takes from the distances.
    return Node(points, points[center], radius * (1 + 1e-9) + 1e-9, children, np.sort(rows[rows < n_queries]), np.sort(rows[rows >= n_queries]) - n_queries)


def search(queries: np.ndarray, data: np.ndarray, query_ids: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the positions of its k best rows of data and their scores, -1 where there are fewer.

    data_ids are ascending, so that positions order ties. A row with the query's id is its own and takes no part.
    """
    n = len(data)
    kind = np.int64
    worst = int(np.abs(queries).max(initial=0)) * int(np.abs(data).max(initial=0)) * max(queries.shape[1], 1)
    if worst * n >= EXACT * 1024 or worst >= EXACT:  # sizes that no float64 sum holds: whole numbers of any size
        kind = object
    none = (worst + 2) * n
    keys = np.full((len(queries), k), none, dtype=kind)
    bar = np.full(len(queries), -np.inf)
    whole = [[[int(x) for x in v] for v in m] for m in (queries, data)] if kind is object else None

    def leaf(q, d):
        if kind is object:
            products = np.array([[sum(a * b for a, b in zip(whole[0][i], whole[1][j])) for j in d] for i in q], dtype=object).reshape(len(q), len(d))
        else:
            products = np.rint(queries[q] @ data[d].T).astype(np.int64)
        new = -products * n + d
        new[query_ids[q][:, None] == data_ids[d]] = none
        new = np.concatenate([keys[q], new], axis=1)
        new = np.sort(np.partition(new, k, axis=1)[:, :k] if new.shape[1] > k else new, axis=1)[:, :k]
        keys[q] = new
        last = new[:, -1]
        bar[q] = [float(max(-HUGE, min(HUGE, -((x - x % n) // n)))) if x < none else -np.inf for x in last.tolist()] if kind is object else np.where(last < none, -(last // n), -np.inf)

    def bound(a, b):
        return float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius

    slack = 1e-6 * min(max(worst, 1), HUGE) if kind is object else 1e-3
    root = build(np.concatenate([queries, data]), len(queries)) if len(queries) + n else None
    todo = [(np.inf, root, root)] if len(queries) and n else []
    while todo:
        most, a, b = todo.pop()
        if most + slack < bar[a.queries].min():
            continue
        open_a, open_b = a.children and len(a.queries) > FEW_QUERIES, b.children and len(b.data) > FEW_DATA
        if not open_a and not open_b:
            leaf(a.queries, b.data)
            continue
        # The larger of the two is opened; the best pair comes next.
        if open_a and (a.radius >= b.radius or not open_b):
            pairs = [(bound(x, b), x, b) for x in a.children if len(x.queries)]
        else:
            pairs = [(bound(a, x), a, x) for x in b.children if len(x.data)]
        todo += sorted(pairs, key=lambda x: x[0])
    found = keys < none
    place = np.where(found, keys % n if n else -1, -1).astype(np.int64)
    score = np.where(found, -(keys // n) if n else 0, 0)
    return place, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query (vec_id, embedding) its k best vectors (vec_id, embedding): query_id, rank, vec_id, score.

    Components become floor(scale * x), x as double; the score is their whole-number inner product, the shorter
    vector filled up with zeros. A candidate is every row but those with the query's id. Ties go to the smaller
    vec_id; repeated rows each count as candidates, equal queries as one. Vectors or ids that are null, and vectors with
    null or non-finite components (before or after scaling), take no part. Scores beyond a long stay at its ends. No rows give no rows.
    """
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(scale)) < float("inf")))
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).withColumnsRenamed({"id": "vec_id", "v": "embedding"}).filter(fine)
    data, asked = pick(vectors), pick(queries).distinct()
    n_data, n_asked = data.count(), asked.count()
    blocks, groups = max(1, -(-n_data // data_block)), max(1, -(-n_asked // query_block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    left = asked.select(deal(groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("asks"), "vec_id", "embedding")
    right = data.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), deal(blocks).alias("b"), F.lit(False).alias("asks"), "vec_id", "embedding")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        size = max(map(len, pdf["embedding"]), default=0)
        points = np.zeros((len(pdf), size))
        for row, v in zip(points, pdf["embedding"]):
            row[: len(v)] = v
        points = np.floor(scale * points)
        asks = pdf["asks"].to_numpy(bool)
        ids, marks = pdf["vec_id"].to_numpy(), [xxh3_64_intdigest(v.tobytes()) - (1 << 63) for v in points[asks]]
        place, score = search(points[asks], points[~asks], ids[asks], ids[~asks], k)
        q, r = np.nonzero(place >= 0)
        limit = (1 << 63) - 1
        scores = [max(-limit - 1, min(limit, int(x))) for x in score[q, r]]
        return pd.DataFrame({"query_id": ids[asks][q], "query": np.array(marks, dtype="int64")[q], "vec_id": ids[~asks][place[q, r]], "score": np.array(scores, dtype="int64")})

    found = left.unionByName(right).groupBy("g", "b").applyInPandas(block, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
