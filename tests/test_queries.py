"""Every query of the library itself against its SQL, on the smallest tables."""

import pytest
from oracle import agree, connect

from fragmenta.plans import MODULES

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: sql for m in MODULES for k, sql in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, sf_dir, con, name):
    agree(QUERIES[name](spark, sf_dir), con, ORACLE[name])


def test_zone_quota(spark, sf_dir):
    from pyspark.sql import functions as F

    from fragmenta.operators import repair
    from fragmenta.sources import tables

    placed = QUERIES["zone_aware_placement"](spark, sf_dir)
    live = repair.live(tables.nodes(spark, sf_dir))
    zones = live.select("zone").distinct().count()
    most = placed.join(live, "node").groupBy("object_id", "zone").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= -(-8 // zones)


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 2


def test_tick_places_only_layers_that_were_drawn(spark, sf_dir, monkeypatch):
    from fragmenta.operators import audit, placement
    from fragmenta.plans import store

    placed = []
    place = placement.rendezvous_place
    monkeypatch.setattr(placement, "rendezvous_place", lambda keys, live: placed.append(keys) or place(keys, live))
    monkeypatch.setattr(store, "_drawn", lambda s, d: audit.samples(store._orders(s, d), store._expected(s, d), 20, store.SEED))
    store.auditor_tick(spark, sf_dir)
    assert len(placed) == 1 and 0 < placed[0].count() < 200
