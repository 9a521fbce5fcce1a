"""The operators against brute force and SQL, on small tables and on odd rows."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import agree, connect
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmenta.llm import bpe, cover_tree, graph, minhash_dedup, mixing, quality, queries, shingles, substring_dedup, toxicity, warc
from fragmenta.llm.common import held_out, text_slices
from fragmenta.llm.exact_dedup import dedup_exact
from fragmenta.llm.line_dedup import dedup_lines
from fragmenta.llm.minhash_dedup import near_duplicates
from fragmenta.llm.sampling import Logistic, examples, labelled, measured, pieces

from llm.conftest import TEXTS

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, sf_dir, name):
    agree(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name])


# 1. Passages


def repeats(texts, n=50):
    seen = defaultdict(set)
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s}


def test_passages_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = substring_dedup.repeated_passages(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert repeats(texts.items()) <= set(found["doc_id"])
    for r in found.itertuples():
        a, b = (shingles.run_hashes(shingles.word_hashes([" ".join(words(texts[i])[s:e])])[0], 5) for i, s, e in ((r.doc_id, r.begin, r.end), (r.match_doc_id, r.match_begin, r.match_end)))
        inter = len(np.intersect1d(a, b))
        assert r.end - r.begin >= 50 and abs(inter / (len(set(a)) + len(set(b)) - inter) - r.similarity) < 1e-9 and r.similarity >= 0.8
        assert r.component_id <= min(r.doc_id, r.match_doc_id)


def test_passages_edited(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(80)
    near = [*passage[:40], "new", *passage[40:]]
    data = [(1, [*fresh(90), *passage, *fresh(30)]), (2, [*fresh(10), *near, *fresh(70)]), (3, fresh(200)), (4, passage[:45] + fresh(60))]
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string"))
    got = {(r.doc_id, r.match_doc_id): r for r in found.collect()}
    assert set(got) == {(1, 2), (2, 1)} and abs(got[1, 2].begin - 90) <= 6 and abs(got[1, 2].end - 170) <= 6


def test_compact_windows():
    rng = np.random.default_rng(0)
    tokens, bounds, w = rng.integers(0, 40, 300).astype(np.uint64), np.array([0, 100, 110, 300]), 10
    text, _, l, c, r = substring_dedup.compact_windows(tokens, bounds, 2, w)
    h = shingles.mix(tokens ^ shingles.mix(np.full(1, 3, np.uint64)))
    h = h & ~np.uint64((1 << 20) - 1)
    for t in range(3):
        own, got = h[bounds[t] : bounds[t + 1]], defaultdict(list)
        for a, b, d in zip(l[text == t], c[text == t], r[text == t]):
            got[b].append((a, d))
        for s in range(len(own) - w + 1):
            least = s + int(own[s : s + w].argmin())
            assert any(a <= s and s + w - 1 <= d for a, d in got[least])
        for b, spans in got.items():
            for a, d in spans:
                assert d - a + 1 >= w and own[a : d + 1].min() == own[b]


def test_passages_edges(edge, empty):
    assert {(r.doc_id, r.match_doc_id) for r in substring_dedup.repeated_passages(edge).collect()} == {(12, 13), (13, 12)}
    assert substring_dedup.repeated_passages(empty).count() == 0


def root(parent, i):
    return i if parent[i] == i else root(parent, parent[i])


def passages_by_brute(texts, n=50, least=0.8):
    """Documents of which some n words are near enough to n words of another document, and the components of such pairs."""
    sets = {i: [set(h[k : k + n - 4].tolist()) for k in range(len(h) - n + 5)] for i, t in texts.items() for h in [shingles.run_hashes(shingles.word_hashes([t])[0], 5)]}
    parent, near = {i: i for i in sets}, set()
    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) >= least * len(x | y) for x in sets[a] for y in sets[b]):
                near |= {a, b}
                x, y = root(parent, a), root(parent, b)
                parent[max(x, y)] = min(x, y)
    return near, parent


def edited_chain(rng, n, ids):
    """Documents of one passage between fresh words; each has one word more replaced than the one before."""
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    passage, out = fresh(n), {}
    for i in ids:
        out[i] = " ".join([*fresh(20), *passage, *fresh(20)])
        passage = passage.copy()
        passage[int(rng.integers(0, n))] = fresh(1)[0]
    return out


def test_passages_chains(spark):
    """Each document is near its neighbours of the chain alone, or so; hubs of the values are the ends."""
    rng, texts = np.random.default_rng(11), {}
    for k, size in enumerate((4, 6, 9, 14, 30)):
        ids = [1000 * (k + 1) + int(x) for x in rng.permutation(size)]
        texts |= edited_chain(rng, 70, ids)
    found = substring_dedup.repeated_passages(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).toPandas()
    near, parent = passages_by_brute(texts)
    got = dict(zip(found["doc_id"], found["component_id"]))
    assert near <= set(got) and {i: root(parent, i) for i in near} == {i: int(got[i]) for i in near}


def test_passages_of_a_large_group(spark):
    """Many documents share 30 words, too few alone; two of them, far from first and last, share 60."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    common, more, texts = fresh(44), [fresh(16) for _ in range(6)], {}
    for i in range(300):
        texts[i] = [*fresh(15), *common, *fresh(40)]
    for k, tail in enumerate(more):
        texts[100 + k] = [*fresh(15), *common, *tail, *fresh(20)]
        texts[200 + k] = [*fresh(15), *common, *tail, *fresh(20)]
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).toPandas()
    got = set(zip(found["doc_id"], found["match_doc_id"]))
    assert {(100 + k, 200 + k) for k in range(6)} <= got


def test_passages_cover(spark):
    """Rows cover all words of a document's passages, with as few as do so: they grow with documents, not with pairs of them."""
    rng = np.random.default_rng(15)
    begin = rng.integers(0, 400, 300)
    data = [(int(rng.integers(0, 6)), int(b), int(b + rng.integers(50, 90)), int(rng.integers(10, 99)), 0, 60, 0.9) for b in begin]
    data += [(7, 0, 60, 1, 0, 60, 1.0), (7, 0, 60, 2, 0, 60, 1.0), (7, 60, 120, 3, 0, 60, 1.0), (7, 300, 350, 3, 0, 50, 1.0)]
    rows = spark.createDataFrame(data, "doc_id long, begin int, end int, match_doc_id long, match_begin int, match_end int, similarity double")
    found = [tuple(r) for r in substring_dedup.covering(rows).collect()]
    assert set(found) <= set(data) and {x[:4] for x in found if x[0] == 7} == {(7, 0, 60, 1), (7, 60, 120, 3), (7, 300, 350, 3)}
    cover = lambda xs, i: {k for x in xs if x[0] == i for k in range(x[1], x[2])}
    for i in range(6):
        own = sorted(x[1:3] for x in found if x[0] == i)
        assert cover(found, i) == cover(data, i) and all(c[0] > a[1] for a, c in zip(own, own[2:]))
    assert substring_dedup.covering(rows.filter("false")).count() == 0

    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(80)
    texts = {i: [*fresh(20), *passage, *fresh(20)] for i in range(40)}
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, 0) for i in texts} and len(found) == len(texts)


def test_passages_leave_no_shuffle_files(spark):
    """What a step has shuffled goes with it; else it stays on disk until the driver collects its garbage."""
    import gc
    import time

    def files():
        for _ in range(40):
            blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
            if not re.search(r"shuffle_\d+_\d+_\d+\.?", blocks):
                return 0
            time.sleep(0.1)
        return len(re.findall(r"shuffle_\d+_\d+_\d+", blocks))

    gc.collect()
    spark._jvm.System.gc()
    texts = edited_chain(np.random.default_rng(13), 70, range(8))
    docs, before = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    found = substring_dedup.repeated_passages(docs)
    assert files() <= before and spark.conf.get(key, None) == held
    assert {r.doc_id for r in found.collect()} == set(texts)


def test_passages_meet_once(spark):
    """Windows of two documents meet once, by whichever value; who has met all of its value doesn't ask."""
    rows = [(1, d, 0, b"", 1, 4, 4) for d in (1, 2, 3, 4)] + [(2, d, 1, b"", 2, 3, 2) for d in (2, 3)]
    rest = spark.createDataFrame(rows, "key long, doc_id long, f int, w binary, lo long, hi long, n long")
    met = sorted((r.doc_id, r.other, r.f) for r in substring_dedup.first_met(rest).collect())
    assert met == [(2, 1, 0), (3, 1, 0), (3, 2, 1), (4, 1, 0), (4, 2, 0), (4, 3, 0)]
    assert sorted((r.key, r.doc_id) for r in rest.filter(substring_dedup._OPEN).collect()) == [(1, 2), (1, 3)]


def test_alike():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 60, 80).astype(np.uint32)
        b = np.concatenate([a[:30], rng.integers(60, 90, 6).astype(np.uint32), a[30:]])
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert abs(substring_dedup._alike(a, b) - inter / union) < 1e-12
        assert (substring_dedup._within(a, np.unique(b)) == np.isin(a, b)).all()


def test_texts_are_made_a_slice_at_a_time():
    """A worker holds the strings of a slice, not of a whole batch, and keeps little once a batch is done."""
    import subprocess
    import sys

    column = pa.array([None, "a" * 30, "é" * 20, "", "b" * 200, "c"])
    assert [(a, b, texts) for a, b, texts in text_slices(column.slice(1), 60)] == [(0, 1, ["a" * 30]), (1, 3, ["é" * 20, ""]), (3, 4, ["b" * 200]), (4, 5, ["c"])]
    assert [x[:2] for x in text_slices(column, 75)] == [(0, 4), (4, 5), (5, 6)] and list(text_slices(column.slice(0, 0))) == []
    code = """
import numpy as np, pyarrow as pa
from fragmenta.llm import quality

class Docs:
    columns, schema = ["doc_id", "text"], []
    drop = lambda self, *names: self
    def mapInArrow(self, run, schema):
        self.run = run
        return self

def held(key):
    return next(int(x.split()[1]) / 1e3 for x in open("/proc/self/status") if x.startswith(key))

docs = quality.score(Docs(), quality.Model())
batch = pa.RecordBatch.from_arrays([pa.array(range(20000)), pa.array(("x" * 3000 for _ in range(20000)), pa.string())], names=docs.columns)
pa.default_memory_pool().release_unused()
open("/proc/self/clear_refs", "w").write("5")
before = held("VmRSS")
rows = sum(x.num_rows for x in docs.run(iter([batch])))
assert rows == 20000
print(held("VmHWM") - before)
"""
    more = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path)}).stdout)
    assert more < 40  # MB, of a batch of 60


# 2. Near-duplicates


def brute_components(texts, percent=85):
    sets = defaultdict(list)
    for i, t in texts:
        w = words(t)
        if i is not None and w:
            sets[i].append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)]))
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((top(a), top(b)))
                part[q] = p
    return {i: top(i) for i in sets}


def test_near_duplicates_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {**{r.doc_id: r.doc_id for r in docs.collect()}, **expected}


def test_near_duplicates_of_a_group(spark):
    """Copies of one text with ever more edits: many pairs are just over or under the threshold."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 10)), replace=False):
            w[at] = f"e{rng.integers(0, 30)}"
        texts.append((int(i * 7 % 150), " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, block=32).collect()}
    assert found == brute_components(texts)


def test_near_duplicates_edges(edge, empty):
    found = near_duplicates(edge)
    assert found.count() == len(TEXTS)
    component = {r.doc_id: r.component_id for r in found.filter("doc_id is not null").collect()}
    expected = brute_components(TEXTS)
    assert component == {i: expected.get(i, i) for i, _ in TEXTS if i is not None}
    assert all(r.kept and r.component_id is None for r in found.filter("doc_id is null").collect())
    assert {r.doc_id: r.n_shingles for r in found.collect() if r.doc_id in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert near_duplicates(empty).count() == 0


def test_union_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(2))
    assert abs(minhash_dedup.union_estimate(a, b, 100) - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 1e-12


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(200, 5), (7, 7), (200, 5), (None, 3)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: i // 20 * 20 for i in range(60)}, 200: 0}


# 3 and 10. Classifiers


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 5 else i % 2) for i in range(1, 14)] + [(None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("kind", "label", "folds", "fold"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifier_edges(spark, edge, empty, labels, kind, label, folds, fold):
    out = held_out(F.col("doc_id"), folds, fold)
    for known in (labels, labels.limit(0)):
        model = kind.fit(edge, known, label, out)
        found = kind.score(edge, model)
        assert found.count() == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.collect())
        assert kind.score(empty, model).count() == 0
        assert found.schema["score"].dataType == T.DoubleType() and "source" in found.columns
    assert kind.fit(empty, labels, label, out).share == 0.5


def test_sample_leaves_out(spark, edge, labels):
    out = held_out(F.col("doc_id"), 5, 0)
    kept = {r.doc_id for r in spark.createDataFrame([(i,) for i in range(1, 14)], "doc_id long").filter(~out).collect()}
    sample = labelled(edge, labels, "quality", out, 3, 100, 1)
    found, (x, y) = examples(sample, 10, 1), measured(sample, lambda texts: np.array([[len(t)] for t in texts], dtype=float))
    assert len(y) == len(kept) and len(found["0"]) <= 3 and all(len(t) <= 10 for ts in found.values() for t in ts)
    shortest = {}
    for i, t in TEXTS:
        shortest[i] = min(shortest.get(i, t or ""), t or "")
    assert sorted(x[:, 0]) == sorted(len(shortest[i]) for i in kept)


def test_pieces_come_from_all_of_a_text():
    long = "".join(chr(256 + i // 1000) for i in range(200_000))
    found = [pieces(long, 8000, str(i)) for i in range(50)]
    assert all(len(x) <= 8000 for x in found) and len(set("".join(found)) - {"\n"}) > 150
    assert pieces(long, 8000, "1") == pieces(long, 8000, "1") and pieces("short", 8000, "1") == "short"


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, label, least in (("op3_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.95)):
        found = queries.QUERIES[name](spark, sf_dir).filter("held_out").join(known, "doc_id").toPandas()
        assert (found["predicted"] == found[label]).mean() >= least


def test_field_marginals():
    """Forward-backward against all taggings of short sequences."""
    rng = np.random.default_rng(2)
    f = toxicity.Field({}, 0.0, rng.normal(size=(2, 2)), 0.3)
    emit, length = rng.normal(size=(3, 6)), np.array([6, 4, 1])
    got, pairs = toxicity.passes(emit, length, f)
    sums = np.zeros((2, 2))
    for row, n in enumerate(length):
        total, mass, seen = 0.0, np.zeros(6), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = f.first * y[0] + sum(emit[row, i] * y[i] for i in range(n)) + sum(f.between[a, b] for a, b in zip(y, y[1:]))
            w = np.exp(s)
            total += w
            mass[:n] += w * np.array(y)
            for a, b in zip(y, y[1:]):
                seen[a, b] += w
        assert np.allclose(got[row], mass / total)
        sums += seen / total
    assert np.allclose(pairs, sums)


def test_toxic_spans(spark):
    bad = [f"some text {i} with vile words" for i in range(40)]
    good = [f"some text {i} with kind words" for i in range(40)]
    model = toxicity.train({"1": bad, "0": good})
    model.calibrate = Logistic(toxicity.summary(model.marginals(bad + good)), np.array([1.0] * len(bad) + [0.0] * len(good)), penalty=0.1, square=False)
    found = toxicity.score(spark.createDataFrame([(1, "text with Vile, words\nvile words"), (2, "kind stuff")], "doc_id long, text string"), model).collect()
    assert ["text with Vile, words\nvile words"[s.begin : s.end] for s in found[0].spans] == ["Vile", "vile"] and not found[1].spans
    assert found[0].predicted == 1 and found[1].predicted == 0


# 4. Exact duplicates


def test_exact_edges(edge, empty):
    norm = lambda t: re.sub(r"[ \t-\r]", "", t or "")
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    expected = []
    for i, t in TEXTS:
        g = groups[norm(t)]
        expected.append((i, min(g)[3], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    for options in ({}, {"least": 4, "most": 16, "bits": 4}):
        found = dedup_exact(edge, **options)
        assert rows(found.select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(expected, key=repr)
        assert found.filter("kept").count() == len(groups)
    assert dedup_exact(empty).count() == 0


# 5. Mixing


def test_mix_of_table(spark, sf_dir):
    found = queries.QUERIES["op5_mixing"](spark, sf_dir)
    again = queries.QUERIES["op5_mixing"](spark, sf_dir)
    assert rows(found) == rows(again)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in found.collect():
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        size[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
        target[docs[r.doc_id].source] = r.target
    expected = mixing.targets(size, 1.5 * sum(size.values()), (3, 1, 2), 2)
    least = min(len(words(d.text)) for d in docs.values())
    for s, t in expected.items():
        assert abs(t - target[s]) < 1e-6 and t <= 2 * size[s] + 1e-6 and abs(taken[s] - t) <= max(0.15 * t, 200 + least)


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 100}, 315, (3, 1, 2), 2)
    assert got["a"] == 20 and abs(got["b"] - 295 / 3) < 1e-9 and abs(got[None] - 590 / 3) < 1e-9
    assert mixing.targets({}, 0, (1,), 2) == {}


def test_route_shares_patterns():
    """A document of two sources goes where words are missing; repeats come last."""
    flow = mixing.route({"ab": 100, "a": 100}, {"ab": ["a", "b"], "a": ["a"]}, {"a": 120, "b": 80}, 2)
    assert flow["a"]["a"] == 100 and flow["ab"] == {"a": 20, "b": 80}
    flow = mixing.route({"x": 10, "y": 10}, {"x": ["s"], "y": ["s"]}, {"s": 30}, 2)
    assert sum(sum(f.values()) for f in flow.values()) == 30 and all(10 <= sum(f.values()) <= 20 for f in flow.values())


def test_mix_edges(spark, edge, empty):
    found = mixing.mix(edge, F.array("source"))
    assert found.count() == len(TEXTS) and all(r.taken == r.copies * r.size and r.copies <= 2 for r in found.collect())
    assert mixing.mix(empty, F.array("source")).count() == 0
    both = mixing.mix(spark.createDataFrame([(i, "a b c", ["x", "y"] if i % 2 else ["x"]) for i in range(20)], "doc_id long, text string, s array<string>"), F.col("s"))
    assert both.count() == 20


# 6. BPE


ODD = ["", "a<|endoftext|>b  <|endoftext|>", "aaaaaaaaaaaaaaaaa  \x1c\x1d \x85 x y  z　﻿​᠎ q", "'S 's I'll don't 12³½Ⅷ ٣ 漢字 🎉🏳️‍🌈 \r\n\t\t \n\n x", "-" * 300 + "=" * 77 + " " * 90 + "\n" * 40, "abababab" * 300, "ﬁ" * 50 + "é" * 99]


def test_bpe_is_the_library(spark, sf_dir, edge, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    known = Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t or "" for _, t in TEXTS]
    codec = bpe.Codec(path)
    for text, ids in zip(texts, codec.encode(texts)):
        expected = known.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected and codec.decode(ids) == known.decode(expected, skip_special_tokens=False)
    found = bpe.encode(edge, path)
    assert found.count() == len(TEXTS) and bpe.encode(empty, path).count() == 0
    assert [r.token_ids for r in found.filter("doc_id in (1, 2)").collect()] == [[], []]
    row = bpe.encode_decode_digests(spark.createDataFrame([(1, ODD[1])], "doc_id long, text string"), path).first()
    ids = known.encode(ODD[1], add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ODD[1].encode()).hexdigest())


# 7. Lines


def test_line_edges(spark, edge, empty):
    found = dedup_lines(edge, min_docs=3)
    assert found.count() == len(TEXTS) and found.columns[: len(edge.columns) - 2] == [c for c in edge.columns if c not in ("n_lines", "n_dropped")]
    by = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found.collect()}
    assert by[1] == by[2] == ("", 1, 0) and by[5] == ("same text", 2, 1) and by[7] == ("Same Text", 2, 1) and by[9] == ("é ü 漢字 🎉", 2, 1) and by[3] == (" \n\t ", 2, 0)
    assert dedup_lines(empty).count() == 0
    case = dedup_lines(spark.createDataFrame([(i, "ÄB") for i in range(5)] + [(i, "äb") for i in range(5, 9)], "doc_id long, text string"), min_docs=5)
    assert sorted(r.text for r in case.collect()) == [""] * 5 + ["äb"] * 4


# 8. Top k


def brute_top(vectors, asked, k):
    good = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in good]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ints if i in asked}:
        best = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in ints if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=8).round(2)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(40)]
    vectors += [(400, None), (401, []), (402, [None, 1.0]), (403, [float("nan")] * 8), (None, [9.0] * 8), (404, [float("inf")] + [0.0] * 7), (405, [1.0, 2.0]), (10, [5.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    asked = {i for i in range(0, 410, 50)} | {320, 401}
    found = cover_tree.top_k(df, df.filter(F.col("vec_id").isin(*asked)), 5, data_block=97, query_block=4)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors, asked, 5)
    assert cover_tree.top_k(df.limit(0), df.limit(0), 5).count() == 0 and cover_tree.top_k(df.limit(1), df.limit(1), 5).count() == 0


def test_search_of_large_numbers():
    points = np.array([[2.0**40, 1.0], [2.0**40, -1.0], [3.0, 2.0**41]])
    place, score = cover_tree.search(points[:1], points, np.array([9]), np.array([1, 2, 3]), 2)
    assert [int(s) for s in score[0]] == [2**80 + 1, 2**80 - 1] and place[0].tolist() == [0, 1]


def test_top_k_of_huge_components(spark):
    vectors = [(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [-1e300, 0.0]), (4, [1e308, 0.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = [(r.rank, r.vec_id) for r in cover_tree.top_k(df, df.filter("vec_id = 1"), 5).collect()]
    assert sorted(found) == [(1, 2), (2, 5), (3, 3)]


def test_pruning_keeps_results():
    rng = np.random.default_rng(5)
    data = np.floor(256 * (rng.normal(size=(3000, 4)) * 0.05 + rng.integers(0, 4, 3000)[:, None]))
    ids = np.arange(3000)
    place, score = cover_tree.search(data[:200], data, ids[:200], ids, 5)
    products = data[:200] @ data.T
    products[np.arange(200), np.arange(200)] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, products.shape), -products), axis=1)[:, :5]
    assert (order == place).all() and (np.take_along_axis(products, order, 1) == score.astype(float)).all()


# 9. WARC


def test_warc(spark):
    page = "<p>" + "é" * 60
    data = [(1, "http://a/1\r\nX: y", page), (2, "http://a/2", page), (3, None, page), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (2, "http://a/2", page), (None, "n", page), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "big", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "?") for r in data], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages)
    found = warc.read_records(index).collect()
    by = {(r.page_id, r.record_type): r for r in found}
    assert len(found) == len(data) and (1, "response") in by and by[2, "revisit"].refers_to == by[3, "revisit"].refers_to == by[None, "revisit"].refers_to == 1
    for i, _, html in data:
        raw = (html or "").encode()
        for r in (r for r in found if r.page_id == i):
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest()) and (r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw)
    assert by[7, "response"].refers_to is None and by[1, "response"].url == "http://a/1 X: y"
    some = warc.read_records(index.filter("page_id in (4, 9)")).collect()
    assert sorted(r.page_id for r in some) == [4, 9]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


# The pipeline


def test_pipeline_stages(spark, edge, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (edge.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, start, str(tmp_path))
            assert out.count() <= 2 * len(TEXTS)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == start.columns


def test_pipeline_drops_copies(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, base + (" x" if i else ""), "en", "s", 0) for i in range(6)] + [(0, base, "en", "s", 0), (9, "other text here", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 9]


def test_pipeline_drops_extended_copies(spark):
    """Documents with 22 % appended (Jaccard 0.82) are copies, with 35 % (0.74) they aren't."""
    import corpus_pipeline

    base = [" ".join(f"d{k}w{i}" for i in range(200)) for k in range(20)]
    more = [" ".join(f"d{k}e{i}" for i in range(44 if k < 10 else 70)) for k in range(20)]
    data = [(k, t) for k, t in enumerate(base)] + [(100 + k, f"{t} {e}") for k, (t, e) in enumerate(zip(base, more))]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), "").collect()}
    assert kept == {*range(20), *range(110, 120)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and found.filter(F.col("n_tokens") != F.size("token_ids")).count() == 0
    assert SPACE  # the white space of every contract
