"""Operators over catalogs, nodes and streams on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragmenta import schema
from fragmenta.functions import rendezvous
from fragmenta.functions.hashing import shard_hash
from fragmenta.operators import audit, catalog, coding, health, placement, repair, signals, similarity
from fragmenta.sources import records, tables
from fragmenta.streaming import audit as stream


def entries(spark, *paths, kind="text"):
    return spark.createDataFrame([(p, kind) for p in paths], "path string, kind string")


def make_catalog(spark, *paths):
    df = tables.empty(spark, schema.CATALOG)
    for p in paths:
        df = catalog.mkdir(df, p)
    return df


def test_directories(spark):
    cat = make_catalog(spark, "photos", "photos/2026", "docs")
    assert [r.name for r in catalog.list_dir(cat, "").collect()] == ["docs", "photos"]
    for call, kind in ((lambda: catalog.mkdir(cat, "docs"), "Conflict"), (lambda: catalog.mkdir(cat, "x/y"), "NotFound"), (lambda: catalog.mkdir(cat, "a//b"), "BadRequest"), (lambda: catalog.rmdir(cat, "photos"), "Conflict"), (lambda: catalog.rmdir(cat, "none"), "NotFound"), (lambda: catalog.remove(cat, "docs"), "IsDirectory"), (lambda: catalog.rename(cat, "photos", "photos/x"), "BadRequest")):
        with pytest.raises(catalog.CatalogError) as e:
            call()
        assert e.value.kind == kind
    assert catalog.rmdir(cat, "photos/2026").count() == 2
    moved = catalog.rename(cat, "photos", "docs/photos")
    assert {r.path for r in moved.collect()} == {"docs", "docs/photos", "docs/photos/2026"}


def test_missing_ancestors(spark):
    cat = entries(spark, "photos/2026/a.png", "photos/2026/b.png", "docs/note.txt", "top.png", kind="image")
    assert sorted(r.path for r in catalog.missing_ancestors(cat).collect()) == ["docs", "photos", "photos/2026"]


def test_statistics(spark):
    cat = make_catalog(spark, "d").unionByName(catalog.directory_row(tables.empty(spark, schema.CATALOG), "x").withColumns({"kind": F.lit("text"), "object_id": F.lit(7).cast("long"), "channels": F.lit(1).cast("short"), "k": F.lit(16)}))
    layers = spark.createDataFrame([(7, 0, 24, 10, [])], schema.LAYERS)
    hashes = spark.createDataFrame([(7, 0, 0, i, bytes([i % 12])) for i in range(24)], schema.SHARD_HASHES)
    nodes = spark.createDataFrame([(0, "a", 0, False), (1, "b", 0, True)], schema.NODES)
    row = catalog.statistics(cat, layers, hashes, nodes).first()
    assert (row.objects_total, row.n_text, row.n_directory, row.shards_total, row.bytes_total, row.shards_unique, row.dedup_percent, row.nodes_live) == (2, 1, 1, 24, 24 * 26, 12, 50.0, 1)
    assert catalog.statistics(tables.empty(spark, schema.CATALOG), tables.empty(spark, schema.LAYERS), tables.empty(spark, schema.SHARD_HASHES), nodes).first().dedup_percent == 0.0
    assert catalog.cards(cat, layers).filter("n_shards = 24").count() == 1


def test_catalog_store(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    assert tables.read_or_empty(spark, path, schema.CATALOG).count() == 0
    tables.write_atomic(make_catalog(spark, "a"), path)
    tables.write_atomic(catalog.mkdir(tables.read_or_empty(spark, path, schema.CATALOG), "b"), path)
    assert tables.read_or_empty(spark, path, schema.CATALOG).count() == 2


def test_best_node_in_tiles():
    rng = np.random.default_rng(1)
    for keys, nodes in ((20, 70_000), (300, 7), (5, rendezvous.TILE), (3, rendezvous.MANY), (0, 3), (0, 2000)):
        own, mixed = rng.integers(0, 1 << 63, keys, dtype=np.uint64), rng.integers(0, 1 << 63, nodes, dtype=np.uint64)
        mixed[-1] = mixed[0]
        full = rendezvous.mix64(own[:, None] ^ mixed[None, :]).reshape(keys, nodes)
        top, at = rendezvous.best(own, mixed)
        assert (at == full.argmax(axis=1)).all() and (top == full.max(axis=1)).all()
    # Two scores whose upper 31 bits are equal, and whose order the last step of the mix turns.
    invert = lambda z: np.uint64(z * pow(0x94D049BB133111EB, -1, 1 << 64) % (1 << 64))
    unshift = lambda z, n: z ^ (z >> np.uint64(n)) ^ (z >> np.uint64(2 * n)) ^ (z >> np.uint64(3 * n) if 3 * n < 64 else np.uint64(0))
    parts = []
    for z in (0xFFFFFFFE00000000, 0xFFFFFFFF00000000):
        x = unshift(invert(z), 27)
        x = unshift(np.uint64(int(x) * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) % (1 << 64)), 30)
        parts.append((int(x) - 0x9E3779B97F4A7C15) % (1 << 64))
    for order in (parts, parts[::-1]):
        mixed = np.array(order + order[:1] * rendezvous.MANY, np.uint64)
        assert rendezvous.best(np.zeros(1, np.uint64), mixed)[1] == rendezvous.mix64(mixed).argmax() == order.index(parts[0])


def test_removal_places_only_what_is_lost(spark, monkeypatch):
    live = spark.range(30).select(F.col("id").cast("int").alias("node"))
    keys = spark.range(500).select(F.col("id").alias("object_id"), F.lit(0).alias("channel"), F.lit(1).alias("layer"), F.lit(0).cast("long").alias("idx"))
    gone = live.filter("node in (3, 29)")
    want = placement.moved(placement.rendezvous_place(keys, live), placement.rendezvous_place(keys, live.filter("node not in (3, 29)")))
    found = placement.moved_on_removal(keys, live, gone)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert placement.moved_on_removal(keys, live, live).isEmpty()


def test_zone_aware_of_unequal_layers(spark):
    live = [(i, i % 3 if i < 8 else 2) for i in range(12)]
    layers = [(o, 0, o % 4, o % 14) for o in range(60)]
    want = []
    for o, c, layer, n in layers:
        used = dict.fromkeys(range(3), 0)
        for idx in range(n):
            order = sorted(live, key=lambda x: -int(rendezvous.score(o, c, layer, idx, x[0])[0]))  # noqa: B023
            node, zone = next(x for x in order if used[x[1]] < -(-n // 3))
            used[zone] += 1
            want.append((o, c, layer, idx, node))
    layers = spark.createDataFrame(layers, "object_id long, channel int, layer int, n_shards int")
    live = spark.createDataFrame(live, "node int, zone int")
    assert sorted(map(tuple, placement.zone_aware_place(layers, live).collect())) == sorted(want)
    assert placement.zone_aware_place(layers, live.limit(0)).isEmpty()


def test_zone_aware(spark):
    live = spark.createDataFrame([(i, i // 4) for i in range(16)], "node int, zone int")
    layers = spark.createDataFrame([(0xABCD, 0, 0, 16)], "object_id long, channel int, layer int, n_shards int")
    assert [r.node for r in placement.zone_aware_place(layers, live).orderBy("idx").collect()] == [1, 8, 8, 15, 3, 9, 15, 8, 14, 4, 1, 6, 0, 6, 5, 12]


def shards_of(spark, n=24):
    rows = [(0xABCD, "".join(chr(97 + i % 26) for i in range(300)), 5)]
    df = coding.encode_texts(spark.createDataFrame(rows, "object_id long, text string, seed long"), n)
    return df.withColumns({"channel": F.lit(0), "layer": F.lit(0), "node": (F.col("idx") % 8).cast("int")}).withColumn("hash", shard_hash(F.col("coeffs"), F.col("payload")))


def test_repair(spark):
    have = shards_of(spark).select("node", "object_id", "channel", "layer", "coeffs", "payload", "hash")
    plan = spark.createDataFrame([(0xABCD, 0, 0, 24)], "object_id long, channel int, layer int, n_shards long")
    after = repair.regenerate_node(have, plan, 3)
    assert after.count() == 24 and after.filter("node = 3").count() == 3
    whole = coding.decode_layers(after.withColumn("idx", F.monotonically_increasing_id())).first().data
    assert bytes(whole) == bytes(coding.decode_layers(have.withColumn("idx", F.monotonically_increasing_id())).first().data)
    bad = have.limit(1).withColumn("hash", F.lit("0"))
    expected = have.select("object_id", "channel", "layer", "hash")
    assert health.verified(have.unionByName(bad), expected).count() == 24
    placed = have.select("object_id", "channel", "layer", "node")
    new = repair.repair_node(have.filter("node <> 2"), placed, expected, 2)
    assert new.count() == 3
    listed = expected.withColumn("idx", F.lit(0).cast("long")).select("object_id", "channel", "layer", "idx", "hash")
    assert repair.appended_hashes(listed, new).agg(F.max("idx")).first()[0] == 3
    assert catalog.insert_shards(have, have).count() == 0
    assert catalog.purge(have, 0xABCD, spark.createDataFrame([(0,), (1,)], "node int")).count() == 18


def test_systematic(spark):
    rows = shards_of(spark).select("idx", coding.systematic_index(F.col("coeffs")).alias("s")).collect()
    assert {r.idx: r.s for r in rows} == {i: i if i < 16 else None for i in range(24)}


def test_needs_repair(spark):
    stats = lambda alive: spark.createDataFrame([(1, 0, 0, 32, 16, alive, alive - 16)], "object_id long, channel int, layer int, n_shards long, k long, n_alive long, margin long")
    assert [health.needs_repair(stats(32 - lost), 0.5).first().needs_repair for lost in (8, 9)] == [False, True]


def test_resolution(spark):
    rows = [(1, 0, 0, 2), (1, 0, 1, -1), (1, 0, 2, 3), (2, 0, 0, -1), (3, 0, 0, 0), (3, 0, 1, 0)]
    stats = spark.createDataFrame(rows, "object_id long, channel int, layer int, margin int")
    assert {r.object_id: r.resolution for r in health.current_resolution(stats).collect()} == {1: 0, 2: None, 3: 1}


def test_loss(spark):
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node int")
    placed = spark.createDataFrame([(0, layer, i % 10) for layer, n in enumerate((20, 16, 10, 8)) for i in range(n)], "channel int, layer int, node int")
    grid = spark.createDataFrame([(0, layer, 4) for layer in range(4)], "channel int, layer int, k int")
    loss = health.simulate_loss(grid, placed, nodes, 50, [10, 50, 90], 1).collect()
    assert all(abs(sum(r.share for r in loss if r.kill_pct == p) - 1) < 1e-9 for p in (10, 50, 90))
    mean = lambda p: sum(r.share * r.resolution for r in loss if r.kill_pct == p)
    assert mean(10) >= mean(50) >= mean(90)


def test_reputation(spark):
    log = spark.createDataFrame([(i, 1, i % 3 != 0) for i in range(20)] + [(i, 2, True) for i in range(5)], "seq long, node long, success boolean")
    s = 1.0
    for i in range(20):
        s = 0.2 * (i % 3 != 0) + 0.8 * s
    found = {r.node: r.score for r in audit.reputation(log, ["seq"]).collect()}
    assert abs(found[1] - s) < 1e-12 and abs(found[2] - 1) < 1e-12
    last = audit.scores_after(log, ["seq"]).filter("node = 1 and seq = 19").first()
    assert abs(last.score_after - s) < 1e-12


def test_fingerprints(spark):
    rows = [("x", i, [10 * i] * 64, "a") for i in range(16) if i != 3] + [("x", 5, [1, 2], "b")]
    shards = spark.createDataFrame(rows, "object_id string, idx int, bytes array<int>, hash string")
    fp = similarity.fingerprint(shards).first().fp
    assert fp == [10 * i if i not in (3, 5) else (0 if i == 3 else 1) for i in range(16)]
    objects = spark.createDataFrame([("self", fp), ("near", [v + 1 for v in fp]), ("far", [200] * 16)], "id string, fp array<int>")
    assert [(r.id, r.distance) for r in similarity.nearest(objects, "self", 2).collect()][0] == ("near", 16)


def test_diff(spark):
    make = lambda xs: spark.createDataFrame([(0, 0, i, x, 16) for i, x in enumerate(xs)], "channel int, layer int, idx int, hash string, k int")
    row = similarity.chunk_diff(make("1234"), make("1536")).first()
    assert (row.n_common, row.n_total) == (2, 4)
    hashes = spark.createDataFrame([("a", x) for x in "123"] + [("b", x) for x in "239"], "id string, hash string")
    row = similarity.overlaps(hashes, "a").first()
    assert (row.id, row.common, row.total_b, round(row.percent, 2)) == ("b", 2, 3, 66.67)


def test_signal_layers(spark):
    plane = [float(120 + 50 * np.sin(0.3 * x)) for y in range(32) for x in range(32)]
    df = spark.createDataFrame([(1, 0, plane)], "id long, channel int, values array<float>")
    plan = signals.layer_plan(32, 32)
    layers = signals.layer_bytes(df, plan, 32, 32)
    error = lambda upto: float(np.abs(np.array(signals.restored(layers.filter(F.col("layer") <= upto), plan, 32, 32).first()["values"]) - plane).max())
    assert error(3) < 1e-2 < error(1) < error(0)


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "1.shard").write_bytes(records.encode_shard(7, 0, 1, b"\1", b"xyz"))
    (tmp_path / "2.shard").write_bytes(b"broken")
    assert [(r.object_id, r.layer) for r in records.read_shards(spark, str(tmp_path)).collect()] == [(7, 1)]
    with pytest.raises(Exception, match="another magic"):
        records.read_shards(spark, str(tmp_path), skip_bad=False).collect()


def test_stream_scores(spark, sf_dir, tmp_path):
    log = tables.audit_log(spark, sf_dir).select("seq", "ts", "node", "success")
    log.orderBy("seq").coalesce(1).write.parquet(f"{tmp_path}/log")
    query = stream.scores(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")).writeStream.outputMode("update").format("memory").queryName("scores").start()
    query.processAllAvailable()
    query.stop()
    found = {r.node: (round(r.score, 9), r.n) for r in spark.table("scores").collect()}
    assert found == {r.node: (round(r.score, 9), r.n) for r in audit.reputation(log, ["seq"]).collect()}


def test_stream_monitor(spark, tmp_path):
    grid = spark.createDataFrame([(1, 0, 0, 4, 2)], "object_id long, channel int, layer int, n_shards long, k long")
    alive = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 0, 6)], "object_id long, channel int, layer int, node int")
    looks = stream.monitor(spark, f"{tmp_path}/state", grid, alive)
    live = lambda *ns: spark.createDataFrame([(n,) for n in ns], "node int")
    assert [r.event for r in looks.tick(live(5, 6), 0).collect()] == ["low_margin"]
    assert sorted((r.event, r.node) for r in looks.tick(live(6, 7), 1).collect() if r.node) == [("died", 5), ("revived", 7)]
    pings = spark.createDataFrame([(5, True), (6, False)], "node int, ping_ok boolean")
    pings.write.parquet(f"{tmp_path}/pings")
    query = stream.monitor(spark, f"{tmp_path}/state2", grid, alive).start(spark.readStream.schema(pings.schema).parquet(f"{tmp_path}/pings"), f"{tmp_path}/events", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/events").count() == 1


def test_stream_windows(spark, sf_dir, tmp_path):
    log = tables.audit_log(spark, sf_dir).select("ts", "success")
    log.write.parquet(f"{tmp_path}/log")
    counts = stream.windowed(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), "1 day")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == log.count()


def test_stream_auditor(spark, tmp_path):
    from pyspark.sql import functions as F

    from fragmenta.operators import placement, store

    catalog = spark.createDataFrame([(f"p{i}", i, 1, 2) for i in range(20)], "path string, object_id long, channels int, nlayers int")
    expected = catalog.select("object_id", F.lit(0).alias("channel"), F.lit(0).alias("layer"), F.explode(F.expr("sequence(0L, 2L)")).alias("idx"))
    expected = expected.withColumn("payload", F.encode(F.concat_ws("-", F.col("object_id").cast("string"), F.col("idx").cast("string")), "utf-8")).withColumn("hash", store.content_hash(F.col("payload")))
    nodes = spark.createDataFrame([(i, i == 0) for i in range(3)], "node int, admin_killed boolean")
    shards = store.corrupted(placement.rendezvous_place(expected, nodes), F.col("node") == 1)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/ticks")
    auditor = stream.Auditor(spark, f"{tmp_path}/state", catalog, expected, nodes, shards, samples=60)
    auditor.start(spark.readStream.schema("x int").parquet(f"{tmp_path}/ticks"), f"{tmp_path}/checkpoint").awaitTermination(120)
    first = auditor.scores(0).toPandas().set_index("node").score
    events = auditor.tick(1).collect()
    # The second layer has no fragments, so draws that meet it are spent.
    assert 10 < len(events) < 50
    assert {(e.node, e.outcome) for e in events} == {(0, "Unreachable"), (1, "HashMismatch"), (2, "Pass")}
    for node in range(3):
        score = first[node]
        for e in sorted((e for e in events if e.node == node), key=lambda e: e.draw):
            score = 0.2 * (e.outcome == "Pass") + 0.8 * score
            assert abs(score - e.score_after) < 1e-12 and e.low_score == (score < 0.5)
    assert auditor.tick(1).orderBy("draw").collect() == sorted(events, key=lambda e: e.draw)


def test_stream_snapshots(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/ticks")
    look = lambda: spark.createDataFrame([(1, "a")], "n int, s string")
    stream.snapshots(spark.readStream.schema("x int").parquet(f"{tmp_path}/ticks"), look, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").select("value").collect()] == ['{"n":1,"s":"a"}']


def test_long_logs_keep_their_scores(spark):
    from fragmenta.operators import audit

    ok = [(i * i) % 7 < 4 for i in range(2000)]
    rows = spark.createDataFrame([(i, 1, x) for i, x in enumerate(ok)], "seq int, node int, success boolean")
    score, want = 1.0, []
    for x in ok:
        score = 0.2 * x + 0.8 * score
        want.append(score)
    found = [r.score_after for r in audit.scores_after(rows, ["seq"]).orderBy("seq").collect()]
    assert max(abs(a - b) for a, b in zip(found, want)) < 1e-12


def test_placement_without_and_beyond_few_nodes(spark, monkeypatch):
    from fragmenta.operators import placement

    keys = spark.createDataFrame([(i, 0, 0, i % 3) for i in range(200)], "object_id long, channel int, layer int, idx long")
    nodes = spark.createDataFrame([(i * 3,) for i in range(20)], "node int")
    none = nodes.filter("node < 0")
    few = [sorted(map(tuple, f.collect())) for f in (placement.rendezvous_place(keys, nodes), placement.round_robin_place(keys, 60, nodes))]
    assert placement.rendezvous_place(keys, none).isEmpty() and placement.round_robin_place(keys, 60, none).isEmpty()
    monkeypatch.setattr(placement, "MOST_NODES", 5)
    assert [sorted(map(tuple, f.collect())) for f in (placement.rendezvous_place(keys, nodes), placement.round_robin_place(keys, 60, nodes))] == few


def test_manifest_refuses_broken_records():
    import pytest

    from fragmenta.sources import manifests
    from fragmenta.sources.records import BadRecord

    row = dict(object_id=-5, k=16, nlayers=1, channels=1, width=3, height=4, levels=3, placement="zone_aware", n_per_layer=[2], sym_len=[9], positions=[[0, 5]], nodes=["a:1"], zones=[2], data_cid=bytes(32), merkle_root=bytes(32),
               shard_hashes=[[[bytes(32)]]], kind="directory", content_type="é", chunk_lens=[1], audio_sample_rate=8000, text_minhash=[7])
    data = manifests.encode(row)
    assert manifests.decode(data) == row == manifests.decode(manifests.encode(row, manifests.LEGACY))
    for bad in (b"", data[:-1], b"x" + data, data[:7 + 8 + 2 + 1] ):
        with pytest.raises(BadRecord):
            manifests.decode(bad)
    place = len(manifests.MAGIC) + 8 + 2 + 1 + 1 + 4 + 4 + 1
    with pytest.raises(BadRecord):
        manifests.decode(data[:place] + b"\x09" + data[place + 1 :])
    with pytest.raises(BadRecord):
        manifests.encode(row | {"zones": []})


def test_store_survives_a_writer_that_dies(spark, tmp_path):
    path = f"{tmp_path}/table"
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    tables.write_atomic(one(1), path)
    (tmp_path / "table").rename(tmp_path / "table.old")  # stopped between the two moves
    assert tables.read_or_empty(spark, path, "n int").first().n == 1
    one(2).write.parquet(f"{path}.new")
    tables.write_atomic(one(3), path)
    assert tables.read_or_empty(spark, path, "n int").first().n == 3
    assert not (tmp_path / "table.old").exists()


def test_merkle_roots_of_any_number_of_leaves(spark):
    from pyspark.sql import functions as F

    from fragmenta.functions import hashing

    sets = [[bytes([i]) * 32 for i in range(n)] for n in (0, 1, 2, 3, 5, 8, 13, 64)]
    rows = spark.createDataFrame([(n, [x.hex() for x in xs]) for n, xs in enumerate(sets)] + [(-1, None)], "n int, xs array<string>")
    found = {r.n: r.root for r in rows.select("n", hashing.merkle_root_hex(F.col("xs")).alias("root")).collect()}
    assert found == {n: hashing.merkle_root(xs).hex() for n, xs in enumerate(sets)} | {-1: None}


def test_added_node_takes_its_share(spark):
    from pyspark.sql import functions as F

    from fragmenta.functions import hashing
    from fragmenta.operators import coding, placement, repair

    texts = spark.createDataFrame([(i, "some words of a text " * (i + 1), i) for i in range(6)], "object_id long, text string, seed long")
    coded = coding.encode_texts(texts).withColumns({"channel": F.lit(0), "layer": F.lit(0), "idx": F.col("idx").cast("long"), "hash": hashing.shard_hash(F.col("coeffs"), F.col("payload"))})
    nodes = spark.createDataFrame([(i, f"n{i}", 0, False) for i in range(4)], "node int, addr string, zone smallint, admin_killed boolean")
    shards = placement.rendezvous_place(coded, nodes)
    more = repair.add_node(nodes, 4, "n4", 1)
    keys = coded.select("object_id", "channel", "layer", "idx")
    made = repair.rebalanced(shards, keys, coded, more, 4)
    due = placement.rendezvous_place(keys, more).filter("node = 4").groupBy("object_id").count()
    assert sorted(map(tuple, made.groupBy("object_id").count().collect())) == sorted(map(tuple, due.collect())) != []
    # Mixed fragments stand in for as many of the others.
    some = made.groupBy("object_id").agg(F.count("*").alias("n"))
    left = coded.join(some, "object_id").filter("idx >= least(n, 8)").select("object_id", "channel", "layer", F.col("idx").cast("int").alias("idx"), "coeffs", "payload")
    both = left.unionByName(made.select("object_id", "channel", "layer", F.lit(99).alias("idx"), "coeffs", "payload"))
    assert {r.data is not None for r in coding.decode_layers(both).collect()} == {True}
