"""Queries over stored fragments, reports, intake and the auditor. Orders are objects and line items their fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, web
from ..operators import audit, catalog, coding, health, ingest, placement, repair, reports, signals, similarity, store
from ..schema import FINGERPRINT, N_PER_LAYER, TAG, K
from ..sources import manifests, tables
from . import cluster, text
from .coding import ORACLE as CODING
from .coding import QUERIES as CODED
from .signals import _LAYERED

KINDS = ("image", "text", "audio", "opaque", "directory")
SAMPLES, SEED, NEW_NODE = 2000, 7, 1_000_000
SURVIVALS = (100, 85, 62, 45, 30)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a catalog: path, object_id, kind, content_type, channels, nlayers, data_cid."""
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (key % 5 + 1).cast("int"))
    path = F.concat(F.lit("order-"), key.cast("string"))
    rows = tables.table(spark, sf_dir, "orders").select(path.alias("path"), key.alias("object_id"), kind.alias("kind"), F.col("o_orderpriority").alias("content_type"), F.lit(1).alias("channels"), F.lit(4).alias("nlayers"))
    return rows.withColumn("data_cid", F.unhex(F.sha2("path", 256)))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct line items as planned fragments: object_id, channel, layer, idx, node, hash, payload, returned, open."""
    body = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("object_id"), F.lit(0).alias("channel"), F.pmod(F.col("l_linenumber") - 1, F.lit(4)).cast("int").alias("layer"), F.col("l_suppkey").cast("int").alias("node"),
        F.encode(body, "utf-8").alias("payload"), (F.col("l_returnflag") == "R").alias("returned"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 3 == 0)).alias("open"),
    ).distinct().withColumn("hash", store.content_hash(F.col("payload")))
    return rows.withColumn("idx", (F.expr("row_number() over (partition by object_id, channel, layer order by hash)") - 1).cast("long"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nodes hold of them: returned ones are lost, some open ones corrupt."""
    return store.corrupted(_expected(spark, sf_dir).filter("not returned"), F.col("open")).select("node", *store.KEY, "hash", "payload")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.live(tables.nodes(spark, sf_dir))


def point_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of one layer of an order."""
    return store.get(_stored(spark, sf_dir), 1, 0, 0).select("node", "hash")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that holds each planned fragment, null for lost ones."""
    found = store.by_hash(_stored(spark, sf_dir), _expected(spark, sf_dir).select(*store.KEY, "hash"))
    return found.select("object_id", "layer", "hash", "node", F.octet_length("payload").alias("size_bytes"))


def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that go with each third order, and none that are left of it."""
    gone = _orders(spark, sf_dir).filter("object_id % 3 = 0")
    left, counts = store.purged(_stored(spark, sf_dir), gone)
    remain = left.filter("object_id % 3 = 0").groupBy("object_id").agg(F.count("*").alias("n_left"))
    return counts.join(remain, "object_id", "left").fillna(0, ["n_left"])


def truncate_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.wiped(_stored(spark, sf_dir), 7).groupBy("node").agg(F.count("*").alias("n"))


def gather_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of each layer that nodes in service hold."""
    return store.gather(_stored(spark, sf_dir), _live(spark, sf_dir)).groupBy("object_id", "layer").agg(F.count("*").alias("n"), F.min("node").alias("first_node"))


def verified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments whose content has an expected hash; a corrupt one is not counted."""
    held = _stored(spark, sf_dir).withColumn("hash", store.content_hash(F.col("payload")))
    return health.verified(held, _expected(spark, sf_dir)).groupBy("object_id", "layer").agg(F.count("*").alias("n"))


def inspect_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two places of each layer of each order: not planned, lost, or found with the first bytes."""
    places = _orders(spark, sf_dir).select("object_id", F.lit(0).alias("channel"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("idx"))
    found = store.zoomed(store.payloads(places, _expected(spark, sf_dir), _stored(spark, sf_dir)))
    return found.select("object_id", "layer", "idx", "state", "size_bytes", "preview")


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _expected(spark, sf_dir).groupBy("object_id", "layer").agg(F.count("*").alias("n_shards"))
    return grid.withColumns({"sym_len": 64 * (F.col("layer") + 1), "k": F.ceil(F.col("n_shards") / 2).cast("long")})


def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, planned bytes and what equal parts from equal nodes would save."""
    hashes = tables.table(spark, sf_dir, "lineitem").select(F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256).alias("hash"))
    return catalog.statistics(_orders(spark, sf_dir), _layers(spark, sf_dir), hashes, tables.nodes(spark, sf_dir))


def statistics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_json(cluster_statistics(spark, sf_dir))


def catalog_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cards(_orders(spark, sf_dir), _layers(spark, sf_dir))


def health_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health_index(_orders(spark, sf_dir), tables.nodes(spark, sf_dir))


def object_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 1: margins, resolution, zone failures and 5000 trials of losses."""
    planned = tables.planned_shards(spark, sf_dir)
    grid = planned.groupBy(*store.KEY).agg(F.count("*").alias("n_shards")).withColumn("k", F.ceil(F.col("n_shards") / 2).cast("long"))
    out = reports.object_health(grid, planned.filter("not lost"), tables.nodes(spark, sf_dir), 1, cluster.TRIALS, cluster.KILL, SEED)
    return out.withColumn("value", F.round("value", 6))


def similar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is like one document, and what shares chunks with it."""
    objects = tables.sketched(tables.objects(spark, sf_dir))
    hashes = text._hashes(spark, sf_dir).join(objects.select(F.col("doc_id").alias("id"), "path"), "id").select(F.col("path").alias("id"), "hash")
    target = objects.filter(F.col("doc_id") == text.TARGET).select("path").first()
    out = reports.similar(objects, hashes, target.path if target else "")
    return out.withColumn("percent", F.round("percent", 4))


def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next id; the languages are their kinds."""
    rows = text._hashes(spark, sf_dir).withColumns({"channel": F.lit(0), "layer": F.lit(0), "k": F.lit(K)})
    cells = similarity.diff_cells(rows.withColumnRenamed("id", "a"), rows.withColumn("a", F.col("id") - 1), ["a"])
    docs = tables.objects(spark, sf_dir).select(F.col("doc_id").alias("a"), F.col("kind").alias("kind_a"), F.ceil(F.octet_length("text") / K).alias("sym_len"))
    pairs = docs.join(docs.select((F.col("a") - 1).alias("a"), F.col("kind_a").alias("kind_b")), "a")
    return reports.diff(pairs, cells, ["a"]).withColumn("percent", F.round("percent", 4))


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put at paths of eight shapes: new, shared by many, without or below a wrong parent, at a directory, empty, broken, and not UTF-8."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang", F.concat_ws("/", "lang", "source").alias("dir"), F.encode("text", "utf-8").alias("b"))
    shape, name = F.col("seq") % 8, F.concat(F.col("seq").cast("string"), F.lit(".txt"))
    path = (
        F.when(shape == 1, F.concat("dir", F.lit("/shared.txt"))).when(shape == 2, F.concat(F.lit("nowhere/"), name)).when(shape == 3, F.concat("lang", F.lit("/notes/"), name))
        .when(shape == 4, F.col("dir")).when(shape == 6, F.concat(F.lit("/"), name)).otherwise(F.concat("dir", F.lit("/"), name))
    )
    body = F.when(shape == 5, F.unhex(F.lit(""))).when(shape == 7, F.concat(F.unhex(F.lit("fffe00")), "b")).otherwise(F.col("b"))
    there = [docs.select(F.col("lang").alias("path"), F.lit("directory").alias("kind")), docs.select(F.col("dir").alias("path"), F.lit("directory").alias("kind")),
             docs.select(F.concat("lang", F.lit("/notes")).alias("path"), F.lit("text").alias("kind")), docs.select(F.concat("dir", F.lit("/shared.txt")).alias("path"), F.lit("text").alias("kind"))]
    known = there[0].unionByName(there[1]).unionByName(there[2]).unionByName(there[3]).distinct().withColumn("object_id", F.lit(7).cast("long"))
    return ingest.ingest(known, docs.select("seq", path.alias("path"), body.alias("body")))


def transport_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a read of each order is answered with, every second one up to a layer."""
    layer = F.when(F.col("object_id") % 2 == 0, F.lit(1))
    rows = _orders(spark, sf_dir).withColumn("t", ingest.transport(F.col("kind"), F.col("content_type"), layer))
    return rows.select("path", "t.error", F.when(F.col("t.error").isNotNull(), web.status(F.col("t.error"))).otherwise(200).cast("int").alias("status"), F.col("t.content_type").alias("content_type"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.samples(_orders(spark, sf_dir), _expected(spark, sf_dir), SAMPLES, SEED)


def audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir).select("draw", "path", "layer", "idx", "hash")


def auditor_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick, from scores of 0.9 for every second node; the others are unknown."""
    nodes = tables.nodes(spark, sf_dir)
    rows = _drawn(spark, sf_dir).collect()  # a row a draw at most
    drawn = spark.createDataFrame(rows, "draw long, path string, object_id long, channel int, layer int, idx long, hash string")
    # Only the layers that were drawn from are looked into, so only their fragments are placed.
    asked = _expected(spark, sf_dir).join(F.broadcast(drawn.select(*store.KEY).distinct()), store.KEY, "left_semi")
    placed = placement.rendezvous_place(asked.filter("not returned").drop("node"), nodes)
    held = store.corrupted(placed, F.col("open")).select("node", *store.KEY, "hash", "payload")
    scores = nodes.filter("node % 2 = 0").select("node", F.lit(0.9).alias("score"))
    return audit.tick(drawn, nodes, held, scores, 0.7).select("draw", "node", "outcome", F.round("score_after", 6).alias("score_after"), "low_score")


def rebalance_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that a new node takes over."""
    keys, nodes = cluster._keys(spark, sf_dir), repair.add_node(tables.nodes(spark, sf_dir).withColumn("zone", F.col("zone").cast("smallint")), NEW_NODE, "new", 0)
    return placement.rendezvous_place(keys, nodes).filter(F.col("node") == NEW_NODE).select("object_id", "layer", "node")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.objects(spark, sf_dir).select(F.col("doc_id").alias("object_id"), "text", F.xxhash64("doc_id").alias("seed"))
    shards = coding.encode_texts(docs).withColumns({"channel": F.lit(0), "layer": F.lit(0), "node": (F.col("idx") % 5).cast("int")})
    return shards.withColumn("hash", hashing.shard_hash(F.col("coeffs"), F.col("payload")))


def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts again after node 2 was refilled by mixing donors and node 0 is lost: sha, holes, fragments that were made."""
    shards = _texts(spark, sf_dir)
    made = repair.repair_node(shards, shards, shards, 2)
    lens = shards.filter("idx = 1").select("object_id", "chunk_lens")
    extra = made.join(lens, "object_id").select("object_id", F.lit(100).alias("idx"), "coeffs", "payload", "chunk_lens")
    left = shards.filter("node not in (0, 2)").select("object_id", "idx", "coeffs", "payload", "chunk_lens").unionByName(extra)
    counts = made.groupBy("object_id").agg(F.count("*").alias("n_made"))
    return coding.decode_texts(left).join(counts, "object_id").select(F.col("object_id").alias("doc_id"), F.sha2("text", 256).alias("text_sha"), "holes", "n_made")


def mix_donors_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three new fragments of each benchmark text, mixed as a join from the coded ones as donors."""
    donors = CODED["rlnc_encode_relational"](spark, sf_dir).withColumnRenamed("idx", "i")
    weights = donors.select("object_id", "i").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"))
    weights = weights.withColumn("c", ((F.col("object_id") * 7 + F.col("idx") * 13 + F.col("i") * 5 + 1) % 256).cast("int"))
    return coding.encode_relational(donors, weights)


def fingerprint_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints from systematic fragments of four components of each embedding, a few of them lost."""
    value = lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int") % 256
    rows = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(FINGERPRINT - 1))).alias("idx"))
    shards = rows.filter((F.col("object_id") + F.col("idx")) % 11 != 0).select("object_id", "idx", F.transform(F.slice("embedding", F.col("idx") * 4 + 1, 4), value).alias("bytes"))
    found = similarity.fingerprint(shards.withColumn("hash", F.col("idx").cast("string")))
    return found.select("object_id", F.array_join(F.transform("fp", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "").alias("fp"))


def reinsert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planned fragments put again: only those that were lost are new."""
    planned = _expected(spark, sf_dir).select("node", *store.KEY, "hash", "payload")
    return catalog.insert_shards(_stored(spark, sf_dir), planned).groupBy("object_id").agg(F.count("*").alias("n_new"))


def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads of embeddings are worth when some percent of all fragments survive."""
    found = signals.degradation(tables.signals(spark, sf_dir), 64, 1.0, SURVIVALS, SEED)
    return found.select("id", "percent", F.round("mse", 8).alias("mse"), F.round("psnr", 4).alias("psnr"))


def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as binary manifests and back."""
    x = _expected(spark, sf_dir)
    grid = _orders(spark, sf_dir).select("object_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer"))
    by_layer = grid.join(x.groupBy("object_id", "layer").agg(F.sort_array(F.collect_list("hash")).alias("hs")), ["object_id", "layer"], "left")
    hashes = F.transform(F.coalesce("hs", F.array().cast("array<string>")), F.unhex)
    lists = by_layer.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("layer", F.size(hashes).cast("long").alias("n"), hashes.alias("h")))).alias("ls"))
    rows = _orders(spark, sf_dir).join(lists, "object_id")
    longs, size = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    full = rows.select(
        "object_id", F.lit(K).alias("k"), "nlayers", "channels", size.alias("width"), size.alias("height"), F.lit(3).alias("levels"), F.lit("rendezvous").alias("placement"), F.col("ls.n").alias("n_per_layer"),
        F.transform("ls.layer", lambda i: (64 * (i + 1)).cast("long")).alias("sym_len"), F.transform("ls.n", lambda n: F.array(n)).alias("positions"), F.array(F.lit("a:1"), F.lit("b:2")).alias("nodes"),
        F.array(F.lit(0), F.lit(1)).alias("zones"), "data_cid", F.unhex(F.repeat(F.lit("00"), 32)).alias("merkle_root"), F.array("ls.h").alias("shard_hashes"), "kind", "content_type", longs.alias("chunk_lens"),
        size.alias("audio_sample_rate"), F.array("object_id").alias("text_minhash"),
    )
    back = manifests.decoded(manifests.encoded(full))
    digest = F.sha2(F.array_join(F.transform(F.flatten(F.flatten("shard_hashes")), lambda h: F.lower(F.hex(h))), ","), 256)
    return back.select("object_id", "k", "kind", "placement", "content_type", F.array_join(F.transform("n_per_layer", lambda n: n.cast("string")), ",").alias("n_per_layer"), F.lower(F.hex("data_cid")).alias("cid"), digest.alias("hashes_sha"))


QUERIES = {
    f.__name__: f
    for f in (
        point_scan, point_lookup, purge_counts, truncate_node, gather_layers, verified_shards, inspect_zoom, cluster_statistics, statistics_json, catalog_cards, health_index, object_health,
        similar_report, diff_report, ingest_outcomes, transport_answers, audit_samples, auditor_tick, rebalance_need, repaired_texts, mix_donors_sql, fingerprint_shards, reinsert_shards, degradation, manifest_roundtrip,
    )
}

_O = f"o AS (SELECT 'order-' || o_orderkey AS path, o_orderkey AS object_id, ['{"', '".join(KINDS)}'][o_orderkey % 5 + 1] AS kind, o_orderpriority AS content_type FROM orders)"
_X = """
    b AS (SELECT DISTINCT l_orderkey AS object_id, ((l_linenumber - 1) % 4)::INT AS layer, l_suppkey::INT AS node, l_returnflag = 'R' AS returned, l_linestatus = 'O' AND l_linenumber % 3 = 0 AS open,
                 concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS body FROM lineitem),
    x AS (SELECT *, sha256(body) AS hash, row_number() OVER (PARTITION BY object_id, layer ORDER BY sha256(body)) - 1 AS idx FROM b),
    s AS (SELECT *, CASE WHEN open THEN lower(to_hex(255 - ascii(body))) ELSE lower(to_hex(ascii(body))) END || lower(substr(hex(encode(body)), 3)) AS payload FROM x WHERE NOT returned)"""
_ST = f"""
    WITH {_O}, {_X}, {cluster._NODES}, g AS (SELECT object_id, layer, count(*) AS n, 64 * (layer + 1) AS sym_len, (count(*) + 1) // 2 AS k FROM x GROUP BY ALL),
    p AS (SELECT coalesce(sum(n), 0)::BIGINT AS shards_total, coalesce(sum(n * (sym_len + k)), 0)::BIGINT AS bytes_total FROM g JOIN o USING (object_id) WHERE kind <> 'directory'),
    u AS (SELECT count(DISTINCT l_partkey || '|' || l_suppkey) AS shards_unique FROM lineitem),
    st AS (SELECT (SELECT count(*) FROM o) AS objects_total, {", ".join(f"(SELECT count(*) FROM o WHERE kind = '{k}') AS n_{k}" for k in KINDS)}, shards_total, bytes_total, shards_unique,
                  (SELECT count(*) FROM n) AS nodes_total, (SELECT count(*) FROM n WHERE NOT admin_killed) AS nodes_live,
                  CASE WHEN shards_total > 0 THEN round((1 - shards_unique / shards_total) * 100, 2) ELSE 0.0 END AS dedup_percent FROM p, u)"""
_STATS = ["objects_total", *(f"n_{k}" for k in KINDS), "shards_total", "bytes_total", "shards_unique", "nodes_total", "nodes_live", "dedup_percent"]
_DRAW = lambda what, of: f"('0x' || substr(sha256('{SEED}-' || draw || '-{what}'), 1, {audit.DRAWN}))::BIGINT % {of}"
_A = f"""
    {_O}, {_X}, r AS (SELECT *, row_number() OVER (ORDER BY substr(sha256(path), 1, {audit.DEALT}), path) - 1 AS spot, count(*) OVER () AS total FROM o),
    d AS (SELECT draw, {_DRAW("object", "(SELECT count(*) FROM o)")} AS spot, ({_DRAW("layer", "4")})::INT AS layer FROM range({SAMPLES}) t(draw) WHERE (SELECT count(*) FROM o) > 0),
    c AS (SELECT object_id, layer, count(*) AS n FROM x GROUP BY ALL),
    a AS (SELECT draw, path, object_id, layer, {_DRAW("hash", "n")} AS idx FROM d JOIN r USING (spot) JOIN c USING (object_id, layer)),
    smp AS (SELECT draw, path, object_id, layer, idx, hash, returned, open FROM a JOIN x USING (object_id, layer, idx))"""
_MORE = f"SELECT node FROM n UNION ALL SELECT {NEW_NODE}"
_CID = lambda kind: f"unhex('{(f'{TAG}-{kind}-v1' + chr(0)).encode().hex()}')"
_TEXT_TYPE, _OPAQUE_TYPE = web.TEXT_TYPES.get("txt", "text/plain; charset=utf-8"), web.OPAQUE_TYPES.get("txt", "application/octet-stream")

_HEALTH = f"""
    WITH {cluster._NODES}, {cluster._GRID}, t1 AS (SELECT * FROM t WHERE object_id = 1), pa AS (SELECT layer, node FROM p WHERE object_id = 1 AND NOT lost),
    zz AS (SELECT DISTINCT zone AS dead FROM n), hz AS (SELECT layer, zone, count(*) AS c FROM pa JOIN n USING (node) GROUP BY ALL),
    za AS (SELECT dead, t1.layer, t1.n_alive - coalesce(c, 0) >= t1.k AS ok FROM t1 CROSS JOIN zz LEFT JOIN hz ON hz.layer = t1.layer AND hz.zone = dead),
    zr AS (SELECT dead, coalesce(min(layer) FILTER (NOT ok) - 1, max(layer)) AS best FROM za GROUP BY dead),
    rs AS (SELECT coalesce(min(layer) FILTER (margin < 0) - 1, max(layer)) AS best FROM t1),
    y AS (SELECT layer, node, count(*) AS c FROM pa GROUP BY ALL),
    d AS (SELECT trial, node, row_number() OVER (PARTITION BY trial ORDER BY sha256('{SEED}-' || trial || '-' || node), node) AS turn, count(*) OVER (PARTITION BY trial) AS c FROM n, (SELECT unnest(range({cluster.TRIALS})) AS trial)),
    e AS (SELECT pct, trial, node FROM d, (SELECT unnest({cluster.KILL}) AS pct) WHERE turn <= floor(c * pct / 100)),
    l AS (SELECT pct, trial, layer, sum(c) AS gone FROM e JOIN y USING (node) GROUP BY ALL),
    a AS (SELECT q.pct, r.trial, t1.layer, n_alive - coalesce(gone, 0) >= k AS ok FROM (SELECT unnest({cluster.KILL}) AS pct) q CROSS JOIN (SELECT unnest(range({cluster.TRIALS})) AS trial) r CROSS JOIN t1
          LEFT JOIN l ON l.pct = q.pct AND l.trial = r.trial AND l.layer = t1.layer),
    f AS (SELECT pct, trial, coalesce(min(layer) FILTER (NOT ok) - 1, max(layer)) AS best FROM a GROUP BY ALL)
    SELECT 'margin' AS section, channel::BIGINT AS a, layer::BIGINT AS b, margin::DOUBLE AS value FROM t1
    UNION ALL SELECT 'resolution', NULL, NULL, CASE WHEN best >= 0 THEN best END FROM rs WHERE best IS NOT NULL
    UNION ALL SELECT 'zone', dead, NULL, CASE WHEN best >= 0 THEN best END FROM zr WHERE (SELECT count(*) FROM zz) > 1
    UNION ALL SELECT 'loss', pct, best, round(count(*) / {float(cluster.TRIALS)}, 6) FROM f GROUP BY pct, best"""
_N_OF = "[" + ", ".join(map(str, N_PER_LAYER)) + "]"

ORACLE = {
    "object_health": _HEALTH,
    "reinsert_shards": f"WITH {_X} SELECT object_id, count(*) AS n_new FROM x WHERE returned GROUP BY object_id",
    "degradation": f"""
        WITH {_LAYERED}, g AS (SELECT pct, layer, unnest(range({_N_OF}[layer + 1])) AS i FROM (SELECT unnest({list(SURVIVALS)}) AS pct), (SELECT unnest(range(4)) AS layer)),
        h AS (SELECT pct, layer, count(*) FILTER (('0x' || substr(sha256('{SEED}-' || pct || '-' || layer || '-' || i), 1, 8))::BIGINT % 100 < pct) >= {K} AS ok FROM g GROUP BY ALL),
        e AS (SELECT id, pct AS percent, sum(CASE WHEN ok THEN 0 ELSE v * v END) / 64 AS mse FROM c JOIN h USING (layer) GROUP BY ALL)
        SELECT id, percent::INT AS percent, round(mse, 8) AS mse, round(CASE WHEN mse < 1e-9 THEN 99 ELSE 10 * log10(1 / mse) END, 4) AS psnr FROM e""",
    "manifest_roundtrip": f"""
        WITH {_O}, {_X}, ly AS (SELECT object_id, l::INT AS layer FROM o, range(4) q(l)),
        ns AS (SELECT object_id, string_agg(n::VARCHAR, ',' ORDER BY layer) AS n_per_layer FROM (SELECT ly.object_id, ly.layer, count(x.hash) AS n FROM ly LEFT JOIN x USING (object_id, layer) GROUP BY ALL) GROUP BY object_id),
        hs AS (SELECT o.object_id, sha256(coalesce(string_agg(hash, ',' ORDER BY layer, hash), '')) AS hashes_sha FROM o LEFT JOIN x USING (object_id) GROUP BY o.object_id)
        SELECT object_id, {K} AS k, kind, 'rendezvous' AS placement, content_type, n_per_layer, sha256(path) AS cid, hashes_sha FROM o JOIN ns USING (object_id) JOIN hs USING (object_id)""",
    "point_scan": f"WITH {_X} SELECT node, hash FROM s WHERE object_id = 1 AND layer = 0",
    "point_lookup": f"WITH {_X} SELECT x.object_id, x.layer, x.hash, CASE WHEN NOT returned THEN node END AS node, CASE WHEN NOT returned THEN octet_length(encode(body)) END AS size_bytes FROM x",
    "purge_counts": f"WITH {_O}, {_X} SELECT o.object_id, count(s.hash) AS n, 0 AS n_left FROM o LEFT JOIN s USING (object_id) WHERE o.object_id % 3 = 0 GROUP BY o.object_id",
    "truncate_node": f"WITH {_X} SELECT node, count(*) AS n FROM s WHERE node <> 7 GROUP BY node",
    "gather_layers": f"WITH {_X}, {cluster._NODES} SELECT object_id, layer, count(*) AS n, min(node) AS first_node FROM s JOIN n USING (node) WHERE NOT admin_killed GROUP BY ALL",
    "verified_shards": f"WITH {_X} SELECT object_id, layer, count(*) AS n FROM s WHERE NOT open GROUP BY ALL",
    "inspect_zoom": f"""
        WITH {_O}, {_X}, p AS (SELECT object_id, l::INT AS layer, i AS idx FROM o, range(4) q(l), range(2) r(i))
        SELECT p.object_id, p.layer, p.idx, CASE WHEN x.hash IS NULL THEN 'BadRequest' WHEN s.hash IS NULL THEN 'lost' ELSE 'found' END AS state, len(payload) // 2 AS size_bytes, substr(payload, 1, 128) AS preview
        FROM p LEFT JOIN x USING (object_id, layer, idx) LEFT JOIN s USING (object_id, layer, idx)""",
    "cluster_statistics": f"{_ST} SELECT * FROM st",
    "statistics_json": f"""{_ST} SELECT '{{' || {" || ',' || ".join(f"'\"{c}\":' || {c}" for c in _STATS)} || '}}' AS json FROM st""",
    "catalog_cards": f"""
        WITH {_O}, {_X} SELECT path AS name, kind, content_type, count(x.hash) AS n_shards, substr(sha256(path), 1, 12) AS cid FROM o LEFT JOIN x USING (object_id) GROUP BY path, kind, content_type""",
    "health_index": f"""
        WITH {_O}, n AS (SELECT s_name, n_regionkey::INT AS zone, s_acctbal < 0 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        r AS (SELECT 'node' AS section, s_name AS name, zone, k AS admin_killed FROM n UNION ALL SELECT 'object', path, NULL, NULL FROM o)
        SELECT *, (SELECT count(*) FROM n WHERE NOT k) AS n_live, (SELECT count(*) FROM n) AS n_total FROM r""",
    "similar_report": f"""
        WITH v AS ({text.ORACLE["sketch_previews"]}), w AS ({text.ORACLE["similar_documents_top10"]}), {text._CHUNKS}, c AS (SELECT doc_id, sha256(data) AS hash FROM chunks WHERE len > 0),
        pt AS (SELECT doc_id, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path FROM documents), m AS (SELECT count(*) AS n FROM c WHERE doc_id = {text.TARGET}),
        z AS (SELECT doc_id, count(*) AS n FROM c WHERE doc_id <> {text.TARGET} AND hash IN (SELECT hash FROM c WHERE doc_id = {text.TARGET}) GROUP BY doc_id)
        SELECT 'self' AS section, preview AS name, (SELECT n FROM m) AS n, NULL::DOUBLE AS percent FROM v WHERE doc_id = {text.TARGET}
        UNION ALL SELECT 'neighbor', path, NULL, round(similarity * 100, 4) FROM w UNION ALL SELECT 'overlap', path, z.n, round(z.n * 100 / m.n, 4) FROM z JOIN pt USING (doc_id), m""",
    "diff_report": f"""
        WITH {text._CHUNKS}, c AS (SELECT * FROM chunks WHERE len > 0),
        e AS (SELECT x.doc_id AS a, count(*) FILTER (x.data = y.data) AS n_common, count(*) AS n_total FROM c x JOIN c y ON y.doc_id = x.doc_id + 1 AND y.idx = x.idx GROUP BY x.doc_id),
        f AS (SELECT x.doc_id AS a, x.lang = y.lang AS same, ceil(octet_length(encode(x.text)) / {K})::BIGINT AS sym_len FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)
        SELECT a, CASE WHEN NOT same THEN 'BadRequest' END AS error, CASE WHEN same THEN coalesce(n_common, 0) END AS n_common, CASE WHEN same THEN coalesce(n_total, 0) END AS n_total,
               CASE WHEN same THEN round(coalesce(n_common * 100 / n_total, 0), 4) END AS percent, CASE WHEN same THEN coalesce(n_common, 0) * sym_len END AS saved_bytes
        FROM f LEFT JOIN e USING (a)""",
    "ingest_outcomes": f"""
        WITH p AS (SELECT doc_id AS seq, doc_id % 8 AS m, lang, lang || '/' || source AS dir, encode(text) AS b, doc_id || '.txt' AS name FROM documents),
        q AS (SELECT seq, m, b, CASE m WHEN 1 THEN dir || '/shared.txt' WHEN 2 THEN 'nowhere/' || name WHEN 3 THEN lang || '/notes/' || name WHEN 4 THEN dir WHEN 6 THEN '/' || name ELSE dir || '/' || name END AS path FROM p),
        t AS (SELECT *, CASE WHEN m IN (5, 6) OR m <> 7 AND octet_length(b) = 0 OR m = 2 THEN 'BadRequest' WHEN m = 4 THEN 'AlreadyExists' WHEN m = 3 THEN 'NotADirectory' ELSE 'stored' END AS status FROM q),
        k AS (SELECT *, CASE WHEN m = 7 THEN 'opaque' ELSE 'text' END AS kind, CASE WHEN m = 7 THEN '{_OPAQUE_TYPE}' ELSE '{_TEXT_TYPE}' END AS content_type FROM t WHERE status = 'stored'),
        h AS (SELECT *, CASE WHEN m = 7 THEN sha256({_CID("opaque")} || encode(content_type) || unhex('fffe00') || b) ELSE sha256({_CID("text")} || b || encode(content_type)) END AS cid FROM k),
        i AS (SELECT *, ('0x' || substr(cid, 1, 16))::UBIGINT AS u FROM h),
        j AS (SELECT *, (CASE WHEN u >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT AS object_id FROM i)
        SELECT seq, path, status, kind, content_type, cid, object_id, coalesce(lag(object_id) OVER w, CASE WHEN m = 1 THEN 7 END) AS replaces, lead(seq) OVER w IS NULL AS current FROM j WINDOW w AS (PARTITION BY path ORDER BY seq)
        UNION ALL SELECT seq, path, status, NULL, NULL, NULL, NULL, NULL, NULL FROM t WHERE status <> 'stored'""",
    "transport_answers": f"""
        WITH {_O}, e AS (SELECT *, CASE WHEN kind = 'directory' THEN 'IsDirectory' WHEN object_id % 2 = 0 AND kind IN ('text', 'opaque') THEN 'PreviewUnsupported' END AS error FROM o)
        SELECT path, error, (CASE error WHEN 'IsDirectory' THEN {web.STATUS.get("IsDirectory", 500)} WHEN 'PreviewUnsupported' THEN {web.STATUS.get("PreviewUnsupported", 500)} ELSE 200 END)::INT AS status,
               CASE WHEN error IS NULL THEN CASE kind WHEN 'image' THEN 'image/png' WHEN 'audio' THEN 'audio/wav' ELSE content_type END END AS content_type FROM e""",
    "audit_samples": f"WITH {_A} SELECT draw, path, layer, idx, hash FROM smp",
    "auditor_tick": f"""
        WITH {_A}, {cluster._NODES},
        k AS ({cluster._mixed(cluster._mixed("SELECT *, object_id::UBIGINT AS o, ((idx << 16) | layer)::UBIGINT AS key FROM smp", "o", "mo"), "key", "mk")}),
        m AS ({cluster._mixed("SELECT node, admin_killed, " + cluster._mul("node", "11400714819323198485") + " AS nn FROM n", "nn", "mn")}),
        f AS ({cluster._mixed("SELECT draw, node, xor(xor(mo, mn), mk) AS z FROM k, m", "z", "score")}), w AS (SELECT draw, arg_max(node, score) AS node FROM f GROUP BY draw),
        e AS (SELECT draw, node, CASE WHEN admin_killed THEN 'Unreachable' WHEN returned THEN 'MissingShard' WHEN open THEN 'HashMismatch' ELSE 'Pass' END AS outcome FROM smp JOIN w USING (draw) JOIN n USING (node)),
        l AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY draw) AS i FROM e),
        v AS (SELECT y.draw, any_value(y.node) AS node, any_value(y.outcome) AS outcome, pow(0.8::DOUBLE, any_value(y.i)) * CASE WHEN any_value(y.node) % 2 = 0 THEN 0.9 ELSE 1 END
                     + sum(CASE WHEN z.outcome = 'Pass' THEN 0.2::DOUBLE * pow(0.8::DOUBLE, y.i - z.i) ELSE 0 END) AS raw FROM l y JOIN l z ON y.node = z.node AND z.i <= y.i GROUP BY y.draw)
        SELECT draw, node, outcome, round(raw, 6) AS score_after, raw < 0.7 AS low_score FROM v""",
    "rebalance_need": f"""
        WITH {cluster._NODES}, k AS ({cluster._mixed(cluster._mixed(cluster._KEYS, "o", "mo"), "key", "mk")}),
        m AS ({cluster._mixed("SELECT node, " + cluster._mul("node", "11400714819323198485") + f" AS nn FROM ({_MORE})", "nn", "mn")}),
        f AS ({cluster._mixed("SELECT object_id, layer, node, xor(xor(mo, mn), mk) AS z FROM k, m", "z", "score")}), w AS (SELECT object_id, layer, arg_max(node, score) AS node FROM f GROUP BY ALL)
        SELECT object_id, layer, node::INT AS node FROM w WHERE node = {NEW_NODE}""",
    "repaired_texts": "SELECT doc_id, sha256(text) AS text_sha, 0 AS holes, 5 AS n_made FROM documents",
    "mix_donors_sql": CODING["rlnc_encode_relational"].rsplit("SELECT object_id, idx::INT", 1)[0].rstrip() + f""",
        dn AS (SELECT object_id, idx AS i, pos, bit_xor(coalesce(gf.p, 0)) AS value FROM t LEFT JOIN gf ON gf.a = c AND gf.b = value GROUP BY ALL),
        tm AS (SELECT object_id, r.idx, pos, value, (object_id * 7 + r.idx * 13 + i * 5 + 1) % 256 AS c FROM dn, range(3) r(idx))
        SELECT object_id, idx::INT AS idx, pos::INT AS pos, bit_xor(coalesce(gf.p, 0))::INT AS value FROM tm LEFT JOIN gf ON gf.a = tm.c AND gf.b = tm.value GROUP BY ALL""",
    "fingerprint_shards": f"""
        WITH e AS (SELECT vec_id, unnest(range({FINGERPRINT})) AS i, embedding AS v FROM embeddings),
        f AS (SELECT vec_id, i, list_transform(v[i * 4 + 1:i * 4 + 4], lambda x: floor(abs(x::DOUBLE) * 100)::INT % 256) AS b FROM e)
        SELECT vec_id AS object_id, string_agg(lpad(lower(to_hex(CASE WHEN (vec_id + i) % 11 = 0 OR len(b) = 0 THEN 0 ELSE list_sum(b)::INT // len(b) END)), 2, '0'), '' ORDER BY i) AS fp FROM f GROUP BY vec_id""",
}
