"""Near-duplicate documents by bottom-k sketches of one hash function.

Documents of equal shingle sets are one node. A node's sketch is the k smallest hashes of its set.
Inverted lists of the sketches' values bring nodes together: by the rarest values alone, of which two sketches that
agree enough must share one. Lists are not expanded into pairs. Every list has a hub, the member whose
values are the most common, and members are held against their hub: first by the union sketch's estimate, then by the exact
Jaccard of the full sets. Members that this leaves in another component than their hub are held exactly against all of
the hub's members, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import free, materialize, text_slices, without_shuffle_files
from .graph import components
from .shingles import run_hashes, word_hashes

#: Size of a sketch, and the share of it that two documents must agree on to be compared. At a similarity of 0.85 fewer
#: agree in less than one of 10^5 pairs, at 0.8 in one of 3,000.
SKETCH, AGREE = 32, 0.53
#: Members of a hub in a block; bits of the filter that keeps rows from being read in full, and of one of its parts.
BLOCK, FILTER, PART = 256, 26, 16

_SETS = "doc_id long, mark long, n_shingles long, sig binary, shingles array<long>"


def mark_filter(marks: DataFrame) -> np.ndarray:
    """A bit for each rest of a mark modulo 2 to the FILTER-th, of a fixed 8 MB: with many marks it lets more rows pass, and loses none."""

    def part(found: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART, np.uint8)
        bits[found["at"].to_numpy()] = 1
        return pa.table({"part": found["part"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()])})

    spot = F.pmod("_mark", F.lit(1 << FILTER))
    places = marks.select(F.shiftright(spot, PART).cast("int").alias("part"), (spot % (1 << PART)).cast("int").alias("at")).distinct()
    out = np.zeros((1 << (FILTER - PART), 1 << (PART - 3)), np.uint8)
    for r in places.groupBy("part").applyInArrow(part, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def shingle_sets(docs: DataFrame, words: int, most: int | None, wanted: np.ndarray | None = None) -> DataFrame:
    """(doc_id, mark, n_shingles, sig, shingles): sorted hashes of each row's distinct shingles, the `most` smallest alone if given; of rows alone whose marks are wanted."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        for batch in batches:
            if sent is not None:
                spot = batch.column(2).to_numpy().view(np.uint64) & np.uint64((1 << FILTER) - 1)
                batch = batch.take(pa.array(np.flatnonzero(sent.value[spot >> np.uint64(3)] >> (7 - (spot & np.uint64(7)).astype(np.uint8)) & 1)))
            ids, marks = batch.column(0), batch.column(2)
            for a, b, texts in text_slices(batch.column(1)):
                hashes, bounds = word_hashes(texts)
                sets = [np.unique(run_hashes(hashes[x:y], words)) for x, y in zip(bounds, bounds[1:])]
                kept = [x[:most] for x in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *kept]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), marks.slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), lists], names=["doc_id", "mark", "n_shingles", "sig", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("mark")).mapInArrow(run, _SETS)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Jaccard of two sets from their sorted sketches: the share of the union's k smallest that both hold."""
    both = np.union1d(a, b)[: k if len(a) >= k or len(b) >= k else None]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()) if len(both) else 0.0


def _linked(inter: int, a: int, b: int, percent: int) -> bool:
    return inter > 0 and 100 * inter >= percent * (a + b - inter)


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, k: int = SKETCH, agree: float = AGREE, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    A document's set holds its distinct runs of `words` words, with A-Z in lower case; with fewer words the whole sequence as one; without
    words it is empty and linked with nothing. Two documents are linked when 100 * |intersection| >= percent * |union|, found
    by sketches and confirmed on full sets (64-bit hashes). Rows that share a doc_id are one document in more than one
    version; their links are its links. Rows without doc_id link nothing: component_id is null and kept true. Repeated rows come out as often. Other columns
    are not read.
    """
    # The result is put together afterwards, so it may be run more than once.
    with without_shuffle_files(docs.sparkSession):
        rows, whole = _reached(docs, words, percent, k, agree, block)
    out = rows.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def _reached(docs: DataFrame, words: int, percent: int, k: int, agree: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, component) of the documents that have links. Tables go as soon as no later step reads them."""
    rows = materialize(shingle_sets(docs, words, k).withColumnRenamed("shingles", "sketch"), "sketches")
    usable = rows.filter("n_shingles > 0 and doc_id is not null")
    # The sketch follows from the set, so any row's will do; the mark finds one row of the set again.
    nodes = materialize(usable.groupBy("sig").agg(F.min("doc_id").alias("node"), F.min("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    # Inverted lists: values that more than one node holds, per node the rarest that its sketch needs.
    values = nodes.select("sig", "n", F.size("sketch").alias("z"), F.explode("sketch").alias("value"))
    counts = materialize(values.groupBy("value").agg(F.count("*").alias("held")).filter("held > 1"), "value_counts")
    shared = values.join(counts, "value")
    by_node = Window.partitionBy("sig")
    shared = shared.withColumns({"place": F.row_number().over(by_node.orderBy("held", "value")), "common": F.count("*").over(by_node), "center": F.sum("held").over(by_node) / F.col("z")})
    # What no other node holds comes first in the order, so it uses up places.
    places = F.col("z") - F.ceil(F.lit(agree) * F.col("z")) + 1 - (F.col("z") - F.col("common"))
    lists = materialize(shared.filter(F.col("place") <= places).select("value", "sig", "n", "center"), "lists")
    free(counts)
    hubs = materialize(lists.groupBy("value").agg(F.max(F.struct("center", "n", "sig")).alias("h")).select("value", F.col("h.sig").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    members = materialize(lists.join(hubs, "value").filter("sig <> hub").select("hub", "sig", "n", "hub_n").distinct(), "hub_members")
    free(lists, hubs)

    # Against the hub: sizes, then the union sketch, then the full sets.
    near = members.filter(F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")).select("hub", "sig")
    near = near.join(nodes.select("sig", "sketch"), "sig").join(nodes.select(F.col("sig").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    low = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5

    def estimated(batches):
        for batch in batches:
            a, b = (np.split(x.values.to_numpy().view(np.uint64)[x.offsets[0].as_py() : x.offsets[-1].as_py()], (x.offsets.to_numpy()[1:-1] - x.offsets[0].as_py())) if len(x) else [] for x in (batch.column(2), batch.column(3)))
            keep = [i for i, (x, y) in enumerate(zip(a, b)) if union_estimate(x, y, k) >= low]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["hub", "sig"])

    near = materialize(near.select("hub", "sig", "sketch", "hub_sketch").mapInArrow(estimated, "hub binary, sig binary"), "estimated")
    wanted = members.select("sig").union(members.select("hub")).distinct().join(nodes.select("sig", "mark", "node", "n"), "sig")
    # One row for each set is read again; the filter keeps most others from it, so that texts stay where they are, and the join the rest.
    # A set has one mark here, so rows that repeat are told by what the join has dealt them by: sets are shuffled once.
    again = shingle_sets(docs, words, None, mark_filter(wanted.select(F.col("mark").alias("_mark"))))
    sets = again.filter("doc_id is not null").select("sig", "mark", "shingles").join(wanted.select("sig", "mark"), ["sig", "mark"]).dropDuplicates(["sig", "mark"]).drop("mark")
    sets = materialize(sets, "full_sets")

    def confirmed(batches):
        for batch in batches:
            keep, last, hub = [], None, None
            for i, (h, a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                if h != last:
                    last, hub = h, b.values.to_numpy()
                own = a.values.to_numpy()
                if _linked(len(np.intersect1d(own, hub, assume_unique=True)), len(own), len(hub), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["hub", "sig"])

    pairs = near.join(sets, "sig").join(sets.select(F.col("sig").alias("hub"), F.col("shingles").alias("hub_set")), "hub").select("hub", "sig", "shingles", "hub_set")
    links = materialize(pairs.mapInArrow(confirmed, "hub binary, sig binary"), "links")
    free(near)
    node_of = nodes.select("sig", "node")
    edges = lambda x: x.join(node_of, "sig").join(node_of.select(F.col("sig").alias("hub"), F.col("node").alias("hub_node")), "hub").select(F.col("node").alias("a"), F.col("hub_node").alias("b"))
    # Texts of one set share it, and so do versions of one document.
    same = usable.join(node_of, "sig").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    first = edges(links)
    part = materialize(components(first), "first_components")

    # What is left: members apart from their hub, against all members of the hub that are in another component.
    at = lambda df, name, out: df.join(node_of.select(F.col("sig").alias(name), F.col("node").alias(f"{out}_node")), name).join(part.select(F.col("node").alias(f"{out}_node"), F.col("component").alias(f"{out}_part")), f"{out}_node", "left").withColumn(out, F.coalesce(f"{out}_part", f"{out}_node")).drop(f"{out}_node", f"{out}_part")
    placed = materialize(at(at(members.select("hub", "sig", "n"), "sig", "own"), "hub", "theirs"), "placed")
    free(members, part)
    sizes = placed.groupBy("hub").agg(F.count("*").alias("all"), F.sum((F.col("own") != F.col("theirs")).cast("int")).alias("apart")).filter("apart > 0 and all > 1")
    sizes = materialize(sizes.select("hub", F.ceil(F.col("apart") / block).cast("int").alias("la"), F.ceil(F.col("all") / block).cast("int").alias("lb")), "apart")
    rest = materialize(placed.join(sizes, "hub"), "rest")
    free(placed, sizes)
    deal = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.filter("own <> theirs").select("hub", deal("la").alias("x"), spread("lb").alias("y"), F.lit(True).alias("asks"), "sig", "own")
    right = rest.select("hub", spread("la").alias("x"), deal("lb").alias("y"), F.lit(False).alias("asks"), "sig", "own")
    cells = left.unionByName(right).join(sets, "sig").select("hub", "x", "y", "asks", "sig", "own", "shingles")

    def compared(found: pa.Table) -> pa.Table:
        asks, own, sigs = found["asks"].to_numpy(), found["own"].to_numpy(), found["sig"].to_pylist()
        sets_ = [np.asarray(x.values) for x in found["shingles"]]
        size = np.array([len(x) for x in sets_])
        l, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(l) and len(r):
            flat = np.concatenate(sets_)
            # Only shingles that more than one member holds count.
            value, place, held = np.unique(flat, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets_)), size)
            live = np.flatnonzero(held > 1)
            to = np.full(len(value), -1)
            to[live] = np.arange(len(live))
            inter = np.zeros((len(l), len(r)), np.float32)
            spot = np.full(len(sets_), -1)
            spot[l], other = np.arange(len(l)), np.full(len(sets_), -1)
            other[r] = np.arange(len(r))
            for begin in range(0, len(live), 8192):
                column = to[place] - begin
                ok = (column >= 0) & (column < 8192)
                a, b = np.zeros((len(l), 8192), np.float32), np.zeros((len(r), 8192), np.float32)
                x, c = row[ok], column[ok]
                a[spot[x[asks[x]]], c[asks[x]]] = 1
                b[other[x[~asks[x]]], c[~asks[x]]] = 1
                inter += a @ b.T
            inter = np.rint(inter).astype(np.int64)
            union = size[l][:, None] + size[r] - inter
            hit = (inter > 0) & (100 * inter >= percent * union) & (own[l][:, None] != own[r])
            # One link between two components is enough.
            seen = set()
            for i, j in zip(*np.nonzero(hit)):
                key = (min(own[l[i]], own[r[j]]), max(own[l[i]], own[r[j]]))
                if key not in seen:
                    seen.add(key)
                    out.append((sigs[r[j]], sigs[l[i]]))
        return pa.table({"hub": pa.array([x for x, _ in out], pa.binary()), "sig": pa.array([x for _, x in out], pa.binary())})

    more = materialize(cells.groupBy("hub", "x", "y").applyInArrow(compared, "hub binary, sig binary"), "more_links")
    free(rest, sets)
    whole = materialize(components(first.unionByName(edges(more)).unionByName(same)), "components")
    free(nodes, links, more)
    return rows, whole
