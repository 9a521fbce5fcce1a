"""Known values and algebraic laws of the pure functions."""

import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fragmenta.functions import galois, haar, hashing, paths, rendezvous, web
from fragmenta.functions.rng import XorShift
from fragmenta.operators import coding, escrow, signals
from fragmenta.sources import media, records


def test_generator():
    rng = XorShift(42)
    assert [f"{rng.next():016x}" for _ in range(3)] == ["0000000ad5d36aeb", "b00aebfbf40316fe", "100dbdb3bf576f53"]
    rng = XorShift(0xC0FFEE)
    assert [rng.byte() for _ in range(8)] == [15, 206, 107, 88, 74, 218, 217, 241]


def test_field():
    assert [int(galois.MUL[a, b]) for a, b in ((2, 128), (0x53, 0xCA), (255, 255))] == [29, 143, 226]
    assert [galois.inverse(a) for a in (2, 0x53)] == [142, 140]
    assert all(galois.MUL[a, galois.inverse(a)] == 1 for a in range(1, 256))
    a, b, c = np.random.default_rng(1).integers(0, 256, (3, 500))
    m = galois.MUL
    assert (m[a, b] == m[b, a]).all() and (m[a, m[b, c]] == m[m[a, b], c]).all() and (m[a, b ^ c] == m[a, b] ^ m[a, c]).all()
    with pytest.raises(ZeroDivisionError):
        galois.inverse(0)


def test_rendezvous():
    assert [f"{int(x):X}" for x in rendezvous.mix64(np.arange(3))] == ["E220A8397B1DCDAF", "910A2DEC89025CC1", "975835DE1C9756CE"]
    assert f"{int(rendezvous.score(0xABCD, 1, 2, 0, 0)[0]):x}" == "65738950e68e7333"
    nodes = np.arange(16)
    assert [int(rendezvous.score(0xABCD, 1, 2, i, nodes).argmax()) for i in range(12)] == [2, 4, 1, 5, 1, 6, 0, 5, 2, 14, 6, 0]
    counts = np.bincount([int(rendezvous.score(0xABCD, 1, 2, i, nodes).argmax()) for i in range(10_000)], minlength=16)
    assert counts.min() > 300 and counts.max() < 1000


def test_fnv_and_sketch():
    assert hashing.fnv1a(b"abcde") == 1956368136 and hashing.fnv1a(b"hi") == 1748694682
    assert len(hashing.sketch("abcdefghij" * 1000)) == 10
    assert hashing.sketch("hi").tolist() == [1748694682] and not len(hashing.sketch("")) and not len(hashing.sketch(None))


def test_merkle():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    assert hashing.merkle_root([]) == bytes(32) and hashing.merkle_root(leaves[:1]) == leaves[0]
    assert hashing.merkle_root(leaves) == hashing.merkle_root([*leaves, leaves[4], leaves[4], leaves[4]])
    assert hashing.merkle_root(leaves) != hashing.merkle_root(leaves[::-1])


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 20), st.integers(0, 10), st.integers(0, 2**63))
def test_coding_round_trip(data, k, extra, seed):
    symbols = coding.split_symbols(data, k)
    coeffs, payload = coding.encode(symbols, k + extra, XorShift(seed))
    keep = np.random.default_rng(seed % 1000).permutation(k + extra)[: k + extra - min(extra, 2)]
    found = coding.decode(coeffs[keep], payload[keep], k)
    rank = len(galois.eliminate(coeffs[keep], payload[keep])[2])
    assert (found is None) == (rank < k)
    if found is not None:
        assert found.tobytes()[: len(data)] == data
    holes = coding.decode_with_holes(coeffs[keep], payload[keep], k)
    assert all(h is None or h == s.tobytes() for h, s in zip(holes, symbols))


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=200))
def test_text_split(text):
    chunks = coding.split_text(text)
    assert len(chunks) == 16 and b"".join(chunks).decode() == text
    for c in chunks:
        c.decode()
    rows, lengths = coding.text_symbols(text)
    assert coding.assemble_text([r.tobytes() for r in rows], lengths) == (text.encode(), 0)
    assert coding.assemble_text([None, *[r.tobytes() for r in rows[1:]]], lengths)[1] == 1


def test_donors():
    symbols = coding.split_symbols(bytes(range(200)), 8)
    coeffs, payload = coding.encode(symbols, 12, XorShift(3))
    c, p = coding.mix_donors(coeffs[:8], payload[:8], 10, XorShift(9))
    assert (galois.combine(c, symbols) == p).all()
    assert (coding.decode(c, p, 8) == symbols).all()
    assert not len(coding.mix_donors(coeffs[:0], payload[:0], 3, XorShift(1))[0])


def test_haar():
    y, x = np.mgrid[0:256, 0:256]
    plane = (50 * np.sin(6.28 * x / 256) + 30 * np.cos(12.56 * y / 256) + 128).astype(np.float32)
    c = haar.forward_2d(plane, 3)
    assert np.abs(haar.inverse_2d(c, 3) - plane).max() < 1e-2
    assert abs((c.astype(float) ** 2).sum() / (plane.astype(float) ** 2).sum() - 1) < 1e-5
    i = np.arange(1024)
    s = (0.5 * np.sin(0.05 * i) + 0.3 * np.cos(0.13 * i)).astype(np.float32)
    assert np.abs(haar.inverse_1d(haar.forward_1d(s, 3), 3) - s).max() < 1e-5
    layer = haar.layer_2d(*np.meshgrid(np.arange(64), np.arange(64)), 64, 64, 3)
    assert np.bincount(layer.ravel()).tolist() == [64, 192, 768, 3072]


def test_layer_plan():
    plan = signals.layer_plan(512, 512)
    assert plan["n_shards"].tolist() == [64, 40, 26, 18] and plan["sym_len"].tolist() == [1024, 3072, 12288, 49152]
    assert len(signals.layer_plan(1003)["positions"].sum()) == 1000
    with pytest.raises(ValueError):
        signals.layer_plan(7)


def test_jaccard(spark):
    rows = [([1, 2, 3], [1, 2, 4]), ([], [1]), ([5], [5])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    assert [round(r[0], 4) for r in df.select(hashing.jaccard(F.col("a"), F.col("b"))).collect()] == [0.6667, 0.0, 1.0]


def test_paths(spark):
    cases = {"": "Empty", "/a": "LeadingSlash", "a/": "TrailingSlash", "a//b": "EmptySegment", "a/./b": "DotSegment", "a/../b": "DotDotSegment", "x" * 256: "SegmentTooLong", "x" * 255: None, "a/b": None}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.v for r in df.select("p", paths.violation(F.col("p")).alias("v")).collect()} == cases
    row = spark.range(1).select(paths.parent(F.lit("a/b/c")).alias("p"), paths.parent(F.lit("a")).alias("q"), paths.ancestors(F.lit("a/b/c")).alias("r"), paths.ancestors(F.lit("a")).alias("s")).first()
    assert (row.p, row.q, row.r, row.s) == ("a/b", None, ["a", "a/b"], [])


def test_ranges(spark):
    cases = {
        ("bytes=0-9", 100): ("Range", 0, 9), ("bytes=90-", 100): ("Range", 90, 99), ("bytes=-10", 100): ("Range", 90, 99), ("bytes=0-999", 100): ("Range", 0, 99), ("bytes=-999", 100): ("Range", 0, 99),
        ("", 100): ("NoRange", None, None), ("bytes=0-1,4-5", 100): ("Multiple", None, None), ("bytes=100-", 100): ("Unsatisfiable", None, None), ("bytes=9-3", 100): ("Unsatisfiable", None, None),
        ("bytes=-0", 100): ("Unsatisfiable", None, None), ("bytes=0-", 0): ("Unsatisfiable", None, None), ("items=0-1", 100): ("Malformed", None, None), ("bytes=a-b", 100): ("Malformed", None, None), ("bytes=-", 100): ("Malformed", None, None),
        ("bytes=", 100): ("Malformed", None, None), ("bytes=5", 100): ("Malformed", None, None),
    }
    df = spark.createDataFrame([(h, n) for h, n in cases], "h string, n long")
    found = {(r.h, r.n): (r.r.outcome, r.r["first"], r.r["last"]) for r in df.select("h", "n", web.parse_range(F.col("h"), F.col("n")).alias("r")).collect()}
    assert found == cases


def test_web(spark):
    row = spark.range(1).select(
        web.form_decode(F.lit("a+b%41%zz")).alias("f"), web.html_escape(F.lit("<a&'\">")).alias("h"), web.json_escape(F.lit('x"\n')).alias("j"), web.hex_block(F.lit(bytes(range(18)))).alias("x"),
        web.zone_label(F.lit(None).cast("int")).alias("d"), web.zone_label(F.lit(0)).alias("z"), web.zone_label(F.lit(2)).alias("l"), web.opaque_type(F.lit("PDF")).alias("o"), web.text_type(F.lit("md")).alias("t"), web.status(F.lit("LayerLost")).alias("s"),
    ).first()
    assert (row.f, row.h, row.j) == ("a bA%zz", "&lt;a&amp;&#39;&quot;&gt;", 'x\\"\\n')
    assert row.x == "000102030405060708090a0b0c0d0e0f\n1011" and (row.d, row.z, row.l) == ("DEAD", "L0", "L0-L2")
    assert (row.o, row.t, row.s) == ("application/pdf", "text/plain; charset=utf-8", 503)


def test_records():
    shard = records.encode_shard(-5, 1, 2, b"\1\0", b"abc")
    assert records.decode_shard(shard) == (-5, 1, 2, b"\1\0", b"abc")
    for bad in (shard[:-1], b"x" + shard):
        with pytest.raises(records.BadRecord):
            records.decode_shard(bad)
    share = (bytes(16), 1, 5, 3, 99, "text/plain", "n", b"\1\2\3", b"p")
    assert records.decode_share(records.encode_share(*share)) == share
    nodes = [("h:1", bytes(32), 3), ("h:2", bytes(range(32)), 0)]
    assert records.decode_whitelist(records.encode_whitelist(nodes)) == nodes
    with pytest.raises(records.BadRecord):
        records.decode_whitelist(records.encode_whitelist(nodes) + b"x")


def test_media(spark):
    t = np.arange(512) / 8000
    wave = [np.sin(440 * t), np.cos(220 * t)]
    back, rate = media.decode_wav(media.encode_wav(wave, 8000))
    assert rate == 8000 and all(np.sqrt(((a - b) ** 2).mean()) < 1e-3 for a, b in zip(wave, back))
    assert media.encode_png(media.thumbnail(b"abcde")).startswith(b"\x89PNG") and media.thumbnail(b"abcde").shape == (3, 3) and media.thumbnail(b"").shape == (1, 1)
    planes = media.fit_square(np.full((10, 20, 3), 7.0), 4, 4)
    assert len(planes) == 3 and np.allclose(planes[0], 7)
    assert media.synthetic(spark, 4, 4).count() == 48


def test_escrow_errors(spark):
    with pytest.raises(ValueError):
        escrow.split(spark.createDataFrame([(b"x", "t", "f")], "data binary, content_type string, filename string"), 3, 2)
    shares = escrow.split(spark.createDataFrame([(b"seed phrase", "t", "f")], "data binary, content_type string, filename string"), 3, 5)
    assert bytes(escrow.recover(shares.unionByName(shares)).first().data) == b"seed phrase"
    assert escrow.recover(shares.filter("shard_idx < 2")).first().error == "NotEnough"


def test_any_shares_recover(spark):
    for k, n in ((1, 4), (3, 5), (4, 7), (2, 64)):
        for seed in range(5):
            coeffs = escrow.draw(k, n, XorShift(seed))
            for some in itertools.islice(itertools.combinations(range(n), k), 60):
                assert len(galois.eliminate(coeffs[list(some)], np.zeros((k, 1), np.uint8))[2]) == k
    secrets = spark.range(1000).selectExpr("encode('secret ' || id, 'utf-8') AS data", "'t' AS content_type", "'f' AS filename")
    found = escrow.recover(escrow.split(secrets, 3, 5).filter("shard_idx >= 2")).collect()
    assert all(r.error is None for r in found) and {bytes(r.data) for r in found} == {f"secret {i}".encode() for i in range(1000)}
