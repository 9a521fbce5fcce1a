"""Tables of the data model, and the constants that define its semantics."""

from __future__ import annotations

NODES = "node int, addr string, zone smallint, admin_killed boolean"
CATALOG = (
    "path string, object_id bigint, kind string, k int, nlayers smallint, channels smallint, width bigint, height bigint, levels smallint, placement string, "
    "data_cid binary, merkle_root binary, content_type string, chunk_lens array<bigint>, audio_sample_rate bigint, text_minhash array<bigint>"
)
LAYERS = "object_id bigint, layer smallint, n_shards bigint, sym_len bigint, positions array<bigint>"
SHARD_HASHES = "object_id bigint, channel smallint, layer smallint, idx bigint, hash binary"
SHARDS = "node int, object_id bigint, channel smallint, layer smallint, hash binary, coeffs binary, payload binary"
SIGNALS = "object_id bigint, channel smallint, values array<float>"
AUDIT_LOG = "seq bigint, node int, path string, channel smallint, layer smallint, outcome string"
SHARES = "escrow_id binary, shard_idx int, total_n int, total_k int, real_len bigint, content_type string, filename string, coeffs binary, payload binary"

# Fixed values of the data model.
K = 16
LEVELS = 3
NLAYERS = 4
REDUNDANCY = (4.0, 2.5, 1.6, 1.15)
N_PER_LAYER = tuple(int(K * r + 0.5) for r in REDUNDANCY)
TEXT_SHARDS = K + K // 2
SHINGLE, SKETCH = 5, 64
FINGERPRINT = 16
KILL_PERCENT = (10, 25, 50, 75)
ALPHA, THRESHOLD, FIRST_SCORE = 0.2, 0.5, 1.0
MAX_SEGMENT = 255
MOST_SHARES = 64
TAG = "fragmenta"
