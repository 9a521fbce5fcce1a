"""Queries over nodes, placements, fragments and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, health, placement, repair
from ..sources import tables

TRIALS, SEED, KILL = 5000, 7, [10, 25, 50, 75]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment per customer, dealt anew: few bytes, each of which is scored against all nodes."""
    rows = tables.table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return rows.select(F.col("c_custkey").alias("object_id"), F.lit(0).alias("channel"), (F.col("c_custkey") % 4).cast("int").alias("layer"), F.lit(0).cast("long").alias("idx"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.live(tables.nodes(spark, sf_dir))


def hrw_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.rendezvous_place(_keys(spark, sf_dir), _live(spark, sf_dir)).select("object_id", "layer", "node")


def hrw_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.balance(placement.rendezvous_place(_keys(spark, sf_dir), _live(spark, sf_dir)))


def hrw_move_on_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the lost node's fragments move; the node of the smallest number goes."""
    live, keys = _live(spark, sf_dir), _keys(spark, sf_dir)
    return placement.moved_on_removal(keys, live, live.agg(F.min("node").alias("node"))).select("object_id", "from_node", "to_node")


def round_robin_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = tables.nodes(spark, sf_dir).agg(F.max("node")).first()[0] + 1
    return placement.round_robin_place(_keys(spark, sf_dir), total, _live(spark, sf_dir)).select("object_id", "layer", "node")


def zone_aware_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _keys(spark, sf_dir).withColumn("n_shards", F.lit(8)).drop("idx")
    return placement.layout(layers, _live(spark, sf_dir), 4)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of orders: n_shards, and half of these, rounded up, as k."""
    rows = tables.planned_shards(spark, sf_dir)
    grid = rows.groupBy("object_id", "channel", "layer").agg(F.count("*").alias("n_shards"))
    return grid.withColumn("k", F.ceil(F.col("n_shards") / 2).cast("long"))


def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.layer_statistics(_grid(spark, sf_dir), tables.planned_shards(spark, sf_dir).filter("not lost"))


def current_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.current_resolution(layer_stats(spark, sf_dir))


def needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.needs_repair(layer_stats(spark, sf_dir), 0.5)


def repair_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.repair_cost(layer_stats(spark, sf_dir), 2, 64 * (F.col("layer") + 1), 2)


def margin_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = layer_stats(spark, sf_dir).withColumn("channel", F.col("layer") % 2).withColumn("layer", (F.col("layer") / 2).cast("int"))
    return health.margin_matrix(stats, [0, 1]).withColumnsRenamed({"0": "channel_0", "1": "channel_1"})


def zone_failure_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = tables.planned_shards(spark, sf_dir).select("object_id", "channel", "layer", "node")
    return health.zone_failures(_grid(spark, sf_dir), placed, tables.nodes(spark, sf_dir))


def loss_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one object, whose layers need 60, 50, 40 and 30 % of their fragments."""
    placed = tables.planned_shards(spark, sf_dir).select("channel", "layer", "node")
    need = placed.groupBy("channel", "layer").agg(F.count("*").alias("n"))
    grid = need.withColumn("k", F.floor(F.col("n") * (6 - F.col("layer")) / 10))
    out = health.simulate_loss(grid, placed, tables.nodes(spark, sf_dir), TRIALS, KILL, SEED)
    return out.withColumn("share", F.round("share", 6))


def loss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = health.loss_table(loss_monte_carlo(spark, sf_dir), [-1, 0, 1, 2, 3])
    return out.withColumnsRenamed({"-1": "dead", "0": "l0", "1": "l0_l1", "2": "l0_l2", "3": "full"})


def liveness_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily looks at nodes that were heard of; a node is live if one of its events succeeded."""
    log = tables.audit_log(spark, sf_dir)
    ticks = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("tick"), "node").agg(F.bool_or("success").alias("live"))
    return audit.changes_by_tick(ticks)


def liveness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that purchased on the first ten days against those on the last ten."""
    log = tables.audit_log(spark, sf_dir).filter("event_type = 'purchase'")
    day = F.dayofmonth("ts")
    return audit.changes(log.filter(day <= 10).select("node").distinct(), log.filter(day > 20).select("node").distinct())


def reputation_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reputation(tables.audit_log(spark, sf_dir), ["ts", "seq"]).withColumn("score", F.round("score", 6))


def scores_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.scores_after(tables.audit_log(spark, sf_dir).select("seq", "ts", "node", "success"), ["ts", "seq"])
    return found.select("seq", "node", F.round("score_after", 6).alias("score_after"))


def low_score_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation_ema(spark, sf_dir).filter("score < 0.7").select("node", "score")


def live_by_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live suppliers that, as users of events, have a score of 0.8 or more; an unknown one has 0."""
    scores = audit.reputation(tables.audit_log(spark, sf_dir), ["ts", "seq"])
    return audit.live_by_reputation(_live(spark, sf_dir).select("node"), scores, 0.8)


def audit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by node over all fragments: its node may be out of service, the fragment lost, or its status other than expected."""
    rows = tables.table(spark, sf_dir, "lineitem").join(F.broadcast(tables.nodes(spark, sf_dir).select("node", "admin_killed")), F.col("l_suppkey") == F.col("node"))
    found = rows.withColumn("outcome", audit.outcome(~F.col("admin_killed"), F.col("l_returnflag") != "R", F.col("l_linestatus"), F.lit("F")))
    return found.groupBy("node", "outcome").agg(F.count("*").alias("n"))


def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_outcomes(spark, sf_dir).filter("outcome <> 'Pass'")


QUERIES = {
    f.__name__: f
    for f in (
        hrw_placement, hrw_balance, hrw_move_on_removal, round_robin_placement, zone_aware_placement, layer_stats, current_resolution, needs_repair, repair_cost, margin_matrix,
        zone_failure_resolution, loss_monte_carlo, loss_table, liveness_ticks, liveness_diff, reputation_ema, scores_after, low_score_nodes, live_by_reputation, audit_outcomes, audit_failures,
    )
}

_M = "18446744073709551616::UHUGEINT"


def _mul(a: str, b: str) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {_M})::UBIGINT"


# SQL has no wrapping product, so the steps of the mix are columns of a chain of selects.
def _mixed(source: str, value: str, name: str) -> str:
    a = f"SELECT *, ((({value})::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M})::UBIGINT AS z0 FROM ({source})"
    b = f"SELECT * EXCLUDE z0, {_mul('xor(z0, z0 >> 30)', '13787848793156543929')} AS z1 FROM ({a})"
    c = f"SELECT * EXCLUDE z1, {_mul('xor(z1, z1 >> 27)', '10723151780598845931')} AS z2 FROM ({b})"
    return f"SELECT * EXCLUDE z2, xor(z2, z2 >> 31) AS {name} FROM ({c})"


_NODES = "n AS (SELECT s_suppkey::INT AS node, n_regionkey::INT AS zone, s_acctbal < 0 AS admin_killed FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_KEYS = "SELECT c_custkey AS object_id, (c_custkey % 4)::INT AS layer, c_custkey::UBIGINT AS o, (c_custkey % 4)::UBIGINT AS key FROM customer"
_HRW = f"""
    k AS ({_mixed(_mixed(_KEYS, "o", "mo"), "key", "mk")}),
    m AS ({_mixed("SELECT node, " + _mul("node", "11400714819323198485") + " AS nn FROM n WHERE NOT admin_killed", "nn", "mn")}),
    s AS ({_mixed("SELECT object_id, layer, node, xor(xor(mo, mn), mk) AS x FROM k, m", "x", "score")})"""
_GRID = """
    p AS (SELECT l_orderkey AS object_id, 0 AS channel, ((l_linenumber - 1) % 4)::INT AS layer, l_suppkey::INT AS node, l_returnflag = 'R' AS lost FROM lineitem),
    g AS (SELECT object_id, channel, layer, count(*) AS n_shards, (count(*) + 1) // 2 AS k, count(*) FILTER (NOT lost) AS n_alive, count(DISTINCT CASE WHEN NOT lost THEN node END) AS n_hosting_nodes FROM p GROUP BY ALL),
    t AS (SELECT *, n_alive - k AS margin FROM g)"""
_LOSS = f"""
    {_NODES}, p AS (SELECT ((l_linenumber - 1) % 4)::INT AS layer, l_suppkey::INT AS node FROM lineitem),
    y AS (SELECT layer, node, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT layer, sum(n) AS total, floor(sum(n) * (6 - layer) / 10) AS k FROM y GROUP BY layer),
    d AS (SELECT trial, node, row_number() OVER (PARTITION BY trial ORDER BY sha256('{SEED}-' || trial || '-' || node), node) AS turn, count(*) OVER (PARTITION BY trial) AS c
          FROM n, (SELECT unnest(range({TRIALS})) AS trial)),
    e AS (SELECT pct AS kill_pct, trial, node FROM d, (SELECT unnest({KILL}) AS pct) WHERE turn <= floor(c * pct / 100)),
    l AS (SELECT kill_pct, trial, layer, sum(n) AS lost FROM e JOIN y USING (node) GROUP BY ALL),
    a AS (SELECT pct AS kill_pct, tr AS trial, q.layer AS layer, total - coalesce(lost, 0) >= k AS ok
          FROM (SELECT unnest({KILL}) AS pct) CROSS JOIN (SELECT unnest(range({TRIALS})) AS tr) CROSS JOIN q LEFT JOIN l ON l.kill_pct = pct AND l.trial = tr AND l.layer = q.layer),
    r AS (SELECT kill_pct, trial, coalesce(min(layer) FILTER (NOT ok) - 1, max(layer)) AS resolution FROM a GROUP BY ALL),
    z AS (SELECT kill_pct, resolution, count(*) AS n, round(count(*) / {float(TRIALS)}, 6) AS share FROM r GROUP BY ALL)"""
_LOG = "g AS (SELECT event_id AS seq, ts, user_id AS node, event_type <> 'error' AS success, event_type FROM events)"
_EMA = f"""{_LOG}, h AS (SELECT node, success, row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) - 1 AS age FROM g),
    e AS (SELECT node, count(*) AS n, pow(0.8::DOUBLE, count(*)) + sum(CASE WHEN success THEN 0.2::DOUBLE * pow(0.8::DOUBLE, age) ELSE 0 END) AS raw FROM h GROUP BY node)"""
_OUT = f"""{_NODES}, o AS (SELECT node, CASE WHEN admin_killed THEN 'Unreachable' WHEN l_returnflag = 'R' THEN 'MissingShard' WHEN l_linestatus <> 'F' THEN 'HashMismatch' ELSE 'Pass' END AS outcome FROM lineitem JOIN n ON l_suppkey = node)"""

ORACLE = {
    "hrw_placement": f"WITH {_NODES}, {_HRW} SELECT object_id, layer, arg_max(node, score) AS node FROM s GROUP BY ALL",
    "hrw_balance": f"WITH {_NODES}, {_HRW}, b AS (SELECT object_id, arg_max(node, score) AS node FROM s GROUP BY object_id) SELECT node, count(*) AS n FROM b GROUP BY node",
    "hrw_move_on_removal": f"""
        WITH {_NODES}, {_HRW}, f AS (SELECT min(node) AS gone FROM n WHERE NOT admin_killed),
        a AS (SELECT object_id, arg_max(node, score) AS from_node, arg_max(node, score) FILTER (node <> (SELECT gone FROM f)) AS to_node FROM s GROUP BY object_id)
        SELECT * FROM a WHERE from_node <> to_node""",
    "round_robin_placement": f"""
        WITH {_NODES}, t AS (SELECT max(node) + 1 AS total FROM n), k AS ({_mixed("SELECT *, xor(o, key << 8) AS x FROM (" + _KEYS + ")", "x", "seed")}),
        f AS (SELECT object_id, layer, (seed % total::UBIGINT)::BIGINT AS first, total FROM k, t),
        c AS (SELECT object_id, layer, node, (node - first + total) % total AS ahead FROM f, n WHERE NOT admin_killed)
        SELECT object_id, layer, arg_min(node, ahead) AS node FROM c GROUP BY ALL""",
    "layer_stats": f"WITH {_GRID} SELECT * FROM t",
    "current_resolution": f"""
        WITH {_GRID}, o AS (SELECT object_id, layer, bool_and(margin >= 0) AS ok FROM t GROUP BY ALL),
        r AS (SELECT object_id, coalesce(min(layer) FILTER (NOT ok) - 1, max(layer)) AS best FROM o GROUP BY object_id)
        SELECT object_id, (CASE WHEN best >= 0 THEN best END)::INT AS resolution FROM r""",
    "needs_repair": f"WITH {_GRID} SELECT object_id, bool_or(n_shards > k AND margin < 0.5 * (n_shards - k)) AS needs_repair FROM t GROUP BY object_id",
    "repair_cost": f"""
        WITH {_GRID}, r AS (SELECT *, n_shards - n_alive AS need, least(2, n_alive) AS take, 64 * (layer + 1) AS slen FROM t WHERE n_shards > n_alive)
        SELECT object_id, sum(CASE WHEN n_alive > 0 THEN take * (slen + 2) ELSE 0 END)::BIGINT AS bytes_downloaded,
               sum(CASE WHEN n_alive > 0 THEN take * (slen + 2) ELSE 0 END)::BIGINT AS bytes_baseline_full,
               sum(CASE WHEN n_alive > 0 THEN need * take * (slen + 2) ELSE 0 END)::BIGINT AS gf_muls_repair,
               sum(CASE WHEN n_alive > 0 THEN 6 * (slen + 2) + need * 2 * slen ELSE 0 END)::BIGINT AS gf_muls_baseline,
               sum(CASE WHEN n_alive > 0 THEN need ELSE 0 END)::BIGINT AS shards_generated, count(*) FILTER (n_alive > 0) AS layers_repaired, count(*) FILTER (n_alive = 0) AS layers_unrecoverable
        FROM r GROUP BY object_id""",
    "margin_matrix": f"""
        WITH {_GRID}, c AS (SELECT object_id, (layer // 2)::INT AS layer, layer % 2 AS channel, n_alive || '/' || k || ' (' || CASE WHEN margin >= 0 THEN '+' ELSE '' END || margin || ')' AS cell FROM t)
        SELECT object_id, layer, max(cell) FILTER (channel = 0) AS channel_0, max(cell) FILTER (channel = 1) AS channel_1 FROM c GROUP BY ALL""",
    "zone_failure_resolution": f"""
        WITH {_NODES}, {_GRID}, d AS (SELECT DISTINCT zone AS dead FROM n),
        a AS (SELECT dead, g.object_id, g.layer, count(*) FILTER (n.zone <> dead) >= any_value(g.k) AS ok FROM g JOIN p USING (object_id, layer) JOIN n USING (node), d GROUP BY ALL),
        r AS (SELECT dead, object_id, coalesce(min(layer) FILTER (NOT ok) - 1, max(layer)) AS best FROM a GROUP BY ALL)
        SELECT dead AS zone, object_id, (CASE WHEN best >= 0 THEN best END)::INT AS resolution FROM r WHERE (SELECT count(*) FROM d) > 1""",
    "loss_monte_carlo": f"WITH {_LOSS} SELECT kill_pct::INT AS kill_pct, resolution::INT AS resolution, n, share FROM z",
    "loss_table": f"""
        WITH {_LOSS} SELECT kill_pct::INT AS kill_pct, coalesce(sum(share) FILTER (resolution = -1), 0) AS dead, coalesce(sum(share) FILTER (resolution = 0), 0) AS l0,
               coalesce(sum(share) FILTER (resolution = 1), 0) AS l0_l1, coalesce(sum(share) FILTER (resolution = 2), 0) AS l0_l2, coalesce(sum(share) FILTER (resolution = 3), 0) AS "full"
        FROM z GROUP BY kill_pct""",
    "liveness_ticks": f"""
        WITH {_LOG}, t AS (SELECT strftime(ts, '%Y-%m-%d') AS tick, node, bool_or(success) AS live FROM g GROUP BY ALL),
        w AS (SELECT *, lag(live) OVER (PARTITION BY node ORDER BY tick) AS was FROM t)
        SELECT tick, node, CASE WHEN live THEN 'revived' ELSE 'died' END AS change FROM w WHERE was IS NOT NULL AND was <> live""",
    "liveness_diff": f"""
        WITH {_LOG}, b AS (SELECT DISTINCT node FROM g WHERE event_type = 'purchase' AND day(ts) <= 10), a AS (SELECT DISTINCT node FROM g WHERE event_type = 'purchase' AND day(ts) > 20)
        SELECT node, 'revived' AS change FROM a WHERE node NOT IN (SELECT node FROM b) UNION ALL SELECT node, 'died' FROM b WHERE node NOT IN (SELECT node FROM a)""",
    "reputation_ema": f"WITH {_EMA} SELECT node, round(raw, 6) AS score, n FROM e",
    "scores_after": f"""
        WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, seq) AS i FROM g),
        l AS (SELECT node, list(CASE WHEN success THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY i) AS s, list(seq ORDER BY i) AS q FROM r GROUP BY node),
        x AS (SELECT node, unnest(q) AS seq, unnest(range(1, len(q) + 1)) AS i, s FROM l)
        SELECT seq, node, round(list_reduce(list_prepend(1.0::DOUBLE, s[:i]), lambda a, b: 0.2::DOUBLE * b + 0.8::DOUBLE * a), 6) AS score_after FROM x""",
    "low_score_nodes": f"WITH {_EMA} SELECT node, round(raw, 6) AS score FROM e WHERE round(raw, 6) < 0.7",
    "live_by_reputation": f"WITH {_NODES}, {_EMA} SELECT n.node FROM n LEFT JOIN e ON n.node = e.node WHERE NOT admin_killed AND coalesce(raw, 0) >= 0.8",
    "audit_outcomes": f"WITH {_OUT} SELECT node, outcome, count(*) AS n FROM o GROUP BY ALL",
    "audit_failures": f"WITH {_OUT} SELECT node, outcome, count(*) AS n FROM o WHERE outcome <> 'Pass' GROUP BY ALL",
}
