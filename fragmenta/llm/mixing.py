"""Mixing sources to target weights, as a min-cost flow over membership patterns.

Documents of the same set of sources form a pattern. Word capacity flows from patterns to the sources
they belong to, each further copy of a pattern's documents at a higher cost (convex), until the
sources' quotas are met. Within a pattern documents are taken in seeded order. Only sums by pattern
reach the driver; the order is cut by two levels of hash buckets and a window over the one bucket
where the quota ends.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

#: Columns that mixing adds, in place of any of these names.
ADDED = ("size", "source_size", "target", "copies", "taken")
#: Patterns of sources that the driver takes; their number doesn't grow with the documents.
MOST_PATTERNS = 200_000


def targets(sizes: dict[str | None, int], total: float, weights: Sequence[float], most: float) -> dict[str | None, float]:
    """Shares of total by weight; what a source can't use beyond most times its size goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = list(order), float(total)
    while free:
        by = sum(weight[s] for s in free)
        share = {s: left * weight[s] / by for s in free}
        full = [s for s in free if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
        left = max(left, 0.0)
    return out


def route(capacity: dict[str, int], members: dict[str, list], quota: dict, copies: int) -> dict[str, dict]:
    """Min-cost flow of words from patterns to sources: {pattern: {source: words}}.

    The c-th copy of a pattern costs c a word. Successive shortest paths with potentials, one connected part
    of the network at a time.
    """
    out: dict[str, dict] = {p: {} for p in capacity}
    sources_of = defaultdict(list)
    for p, ms in members.items():
        for s in ms:
            sources_of[s].append(p)
    seen: set = set()
    for start in sorted(capacity):
        if start in seen:
            continue
        part, stack = [], [start]
        seen.add(start)
        while stack:
            part.append(p := stack.pop())
            for s in members[p]:
                for q in sources_of[s]:
                    if q not in seen:
                        seen.add(q)
                        stack.append(q)
        _route_part(sorted(part), capacity, members, quota, copies, out)
    return out


def _route_part(part, capacity, members, quota, copies, out) -> None:
    sources = sorted({s for p in part for s in members[p]}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(sources)}
    n_p, n = len(part), len(part) + len(sources) + 2
    begin, end = n - 2, n - 1
    to, cap, cost, adj = [], [], [], [[] for _ in range(n)]

    def edge(u, v, c, w):
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            adj[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)

    flows = []
    for i, p in enumerate(part):
        for c in range(copies):
            edge(begin, i, capacity[p], c)
        for s in members[p]:
            flows.append((p, s, len(to)))
            edge(i, n_p + place[s], copies * capacity[p], 0)
    for s in sources:
        edge(n_p + place[s], end, quota[s], 0)
    high = [0] * n
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[begin] = 0
        heap = [(0, begin)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in adj[u]:
                if cap[e] and (x := d + cost[e] + high[u] - high[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if dist[end] == float("inf"):
            break
        for v in range(n):
            high[v] += min(dist[v], dist[end])
        v, most = end, float("inf")
        while v != begin:
            most, v = min(most, cap[via[v]]), to[via[v] ^ 1]
        v = end
        while v != begin:
            cap[via[v]] -= most
            cap[via[v] ^ 1] += most
            v = to[via[v] ^ 1]
    for p, s, e in flows:
        out[p][s] = cap[e ^ 1]


def nearest_sum(sizes: list[tuple[int, int]], goal: int, most: int = 4000) -> list[tuple[int, int]]:
    """Those of (size, key) whose sizes add up to about goal; of many sums every few are followed."""
    sums: dict[int, tuple] = {0: ()}
    for s in sizes:
        for total, chosen in list(sums.items()):
            if total + s[0] <= 2 * goal:
                sums.setdefault(total + s[0], (*chosen, s))
        if len(sums) > most:
            near = sorted(sums, key=lambda x: (abs(x - goal), x))[: most // 4]
            kept = {*near, *sorted(sums)[:: max(1, len(sums) * 4 // (3 * most))], 0}
            sums = {x: sums[x] for x in sorted(kept)}
    return list(sums[min(sums, key=lambda x: (abs(x - goal), x))])


def mix(docs: DataFrame, members: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, copies: int = 2, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies (0, 1, .. `copies`) and taken = copies * size added.

    members is an array of the sources a row belongs to; null entries are a source of their own, and an
    empty or null array counts as the null source. source_size and target are those of the row's sources
    together (of its one source, where it has one). Rows are documents: repeated rows each count. Words
    are runs of other than white space; null text has none. Documents are whole: a source misses its
    target by less than its smallest document of those left. Rows of no words take 0. A table without words has
    targets of 0. Columns named like the added ones are replaced, and names that begin with two _ are the operator's own.
    """
    spark = docs.sparkSession
    own = F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members))).otherwise(F.array(F.lit(None).cast("string")))
    docs = docs.withColumns({"__own": own, "__size": n_words(F.col("text"))}).drop(*ADDED)
    # The text is part of the order, so that rows without an id spread too.
    docs = docs.withColumns({"__p": F.to_json("__own"), "__ord": F.xxhash64(F.lit(seed), "doc_id", "text")}).drop("__own")
    docs = docs.withColumns({"__b1": F.shiftrightunsigned("__ord", 52).cast("int"), "__b2": (F.shiftrightunsigned("__ord", 40) % 4096).cast("int")})
    slim = materialize(docs.select("doc_id", "__p", "__size", "__ord", "__b1", "__b2"), "mix_sizes")
    capacity = {r["__p"]: int(r.n) for r in slim.groupBy("__p").agg(F.sum("__size").alias("n")).limit(MOST_PATTERNS + 1).collect()}
    if len(capacity) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
    belongs = {p: json.loads(p) for p in capacity}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in capacity.items():
        for s in belongs[p]:
            sizes[s] += n
    target = targets(sizes, share * sum(capacity.values()), weights, copies)
    flow = route(capacity, belongs, {s: round(t) for s, t in target.items()}, copies)
    rows = []
    for p, n in capacity.items():
        words = min(sum(flow[p].values()), copies * n)
        full = words // n if n else 0
        rows.append((p, int(full), int(words - full * n), sum(sizes[s] for s in belongs[p]), float(sum(target[s] for s in belongs[p]))))
    plan = materialize(spark.createDataFrame(rows, "__p string, full int, rest long, source_size long, target double"), "mix_plan")

    def cut(rows: DataFrame, bucket: str, name: str) -> DataFrame:
        """The bucket in which each pattern's rest ends, and what is left of it there."""
        sums = rows.groupBy("__p", "rest", bucket).agg(F.sum("__size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("__p").orderBy(bucket)))
        return sums.filter("upto - n <= rest and upto > rest").select("__p", F.col(bucket).alias(name), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))

    first = cut(slim.join(plan.select("__p", "rest"), "__p"), "__b1", "c1")
    inside = slim.join(first, "__p").filter("__b1 = c1").select("*", F.col("left").alias("rest")).drop("left")
    bounds = materialize(first.drop("left").join(cut(inside, "__b2", "c2"), "__p"), "mix_bounds")
    cell = slim.join(bounds, "__p").filter("__b1 = c1 and __b2 = c2")
    order = Window.partitionBy("__p").orderBy("__ord", "__size").rowsBetween(Window.unboundedPreceding, 0)
    chosen = cell.withColumn("take", (F.sum("__size").over(order) <= F.col("left")).cast("int"))
    special = materialize(chosen.groupBy("__p", "__ord", "__size").agg(F.sum("take").alias("take")), "mix_cell")
    # What is still missing goes to single documents behind the cut: the largest and smallest of each class of sizes are
    # looked at, so a pattern sends a few dozen rows to the driver.
    used = special.groupBy("__p").agg(F.sum(F.col("take") * F.col("__size")).alias("used"))
    gap = bounds.join(used, "__p").select("__p", "c1", "c2", (F.col("left") - F.col("used")).alias("gap"))
    later = slim.join(gap.filter("gap > 0"), "__p").filter("(__b1 > c1 or (__b1 = c1 and __b2 >= c2)) and __size > 0")
    later = later.join(special.filter("take > 0").select("__p", "__ord", "__size"), ["__p", "__ord", "__size"], "left_anti")
    kind = F.greatest(F.lit(-8), F.least(F.lit(60), F.floor(F.log2(F.col("gap") / F.col("__size")) * 4)))
    one = F.struct(F.col("__size").alias("s"), F.col("__ord").alias("o"))
    ends = later.filter("__size <= 2 * gap").groupBy("__p", "gap", kind.alias("kind")).agg(F.min(one).alias("lo"), F.max(one).alias("hi"))
    fill = []
    for r, found in groupby(sorted(ends.collect(), key=lambda r: (r["__p"], r.kind)), key=lambda r: (r["__p"], r.gap)):
        sizes = sorted({(x.s, x.o) for f in found for x in (f.lo, f.hi)}, reverse=True)
        fill += [(r[0], o, s, 1) for s, o in nearest_sum(sizes, r[1])]
    extra = spark.createDataFrame(fill, "__p string, __ord long, __size long, more long")
    special = special.join(extra, ["__p", "__ord", "__size"], "full").select("__p", "__ord", "__size", (F.coalesce("take", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("take"))
    special = materialize(special, "mix_special")

    keep = [c for c in docs.columns if c not in ("__p", "__ord", "__size", "__b1", "__b2")]
    plan, bounds = plan.drop("rest").withColumnRenamed("full", "__full"), bounds.drop("left").withColumnsRenamed({"c1": "__c1", "c2": "__c2"})
    known = docs.join(plan, "__p").join(bounds, "__p", "left").join(special.withColumnRenamed("take", "__take"), ["__p", "__ord", "__size"], "left")
    before = F.coalesce(F.expr("__b1 < __c1 or (__b1 = __c1 and __b2 < __c2)"), F.lit(False)).cast("int")
    plain = known.filter("__take is null").withColumn("copies", F.col("__full") + before)
    turn = F.row_number().over(Window.partitionBy("__p", "__ord", "__size").orderBy("doc_id"))
    # Rows of the cell, and those that fill the gap; equal rows take turns.
    single = known.filter("__take is not null").withColumn("copies", F.col("__full") + (turn <= F.col("__take")).cast("int"))
    both = plain.unionByName(single).withColumn("copies", F.when(F.col("__size") > 0, F.col("copies")).otherwise(0).cast("long"))
    return both.select(*keep, F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))
