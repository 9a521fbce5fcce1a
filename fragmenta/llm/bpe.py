"""Byte-level BPE by a prefix-sharing trie traversal.

The distinct words of a batch, in byte order, are a trie read depth-first: two neighbours share the path
of their common prefix. At each node the last token of the prefix's encoding is kept. It is the one
vocabulary entry that ends there and may stand behind the last token of the prefix before it, that is,
a pair of tokens that merging leaves alone. States of a shared prefix are found once; a word's tokens are
read off by walking back.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

# How byte-level BPE splits text into words; white space as Unicode has it.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
#: A worker keeps the encodings of so many words, and of as many that were used before these; and so many pairs.
MOST_WORDS, MOST_PAIRS = 100_000, 1_000_000


def _letters() -> dict[str, int]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a tokenizer file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[self.ids[a], self.ids[b]] = r, self.ids[a + b]
        #: The merge that makes a token, as (rank, left, right); None for single bytes.
        self.made: list[tuple[int, int, int] | None] = [None] * (1 + max([*self.ids.values(), *special.values()], default=-1))
        for (a, b), (r, i) in self.rank.items():
            self.made[i] = r, a, b
        self.bytes_of = [b""] * (max([*self.ids.values(), *special.values()], default=-1) + 1)
        for t, i in self.ids.items():
            self.bytes_of[i] = t
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.size_of = [len(t) for t in self.bytes_of]
        self.special = special
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        ends: dict[bytes, set[int]] = {}
        for t in self.ids:
            ends.setdefault(t[-2:], set()).add(len(t))
        #: Lengths of the entries that end in two given bytes, longest first, with the single byte last.
        self.lengths = {e: tuple(sorted(n | {1}, reverse=True)) for e, n in ends.items() if len(e) == 2}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, parts: list[int]) -> list[int]:
        """Plain BPE: the pair of lowest rank first, leftmost of equals."""
        while True:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]

    def _fits(self, before: int, token: int) -> bool:
        """Whether merging leaves the pair alone.

        Merges are undone from the last one on. That shows which two parts touched at the border at each
        rank; had these a merge of their own that came earlier than the next on either side, it would have won.
        """
        left, right, made = before, token, self.made
        until = (len(made) + 1, 0)
        while True:
            own = self.rank.get((left, right))
            if own is not None and (own[0], 1) < until:
                return False
            # Of equal ranks the left merge comes first, the border's next, the right one last.
            a, b = made[left], made[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                until, left = (a[0], 0), a[2]
            else:
                until, right = (b[0], 2), b[1]

    def _starts(self, token: int) -> bool:
        found = self.whole.get(token)
        if found is None:
            data = self.bytes_of[token]
            found = self.whole[token] = self.merged([self.ids[data[i : i + 1]] for i in range(len(data))]) == [token]
        return found

    def traverse(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words in byte order."""
        get, lengths, size_of, pairs, fits, one = self.ids.get, self.lengths, self.size_of, self.pairs, self._fits, (1,)
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        out, last, before = [], [-1], b""
        for word in words:
            n = len(word)
            d = len(commonprefix((word, before)))
            del last[d + 1 :]
            while d < n:
                d += 1
                for size in lengths.get(word[d - 2 : d], one) if d > 1 else one:
                    token = get(word[d - size : d]) if size <= d else None
                    if token is None:
                        continue
                    if size == d:
                        found = self._starts(token)
                    else:
                        key = last[d - size] << 32 | token
                        found = pairs.get(key)
                        if found is None:
                            found = pairs[key] = fits(last[d - size], token)
                    if found:
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends at byte {d} of {word!r}")
            tokens = []
            while d:
                tokens.append(last[d])
                d -= size_of[last[d]]
            out.append(tokens[::-1])
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, int32; special tokens are found in the text as the library does, none are added."""
        split = [self._words(x or "") for x in texts]
        distinct = set().union(*split)
        if len(self.words) > MOST_WORDS:
            self.older, self.words = self.words, {}
        words, older, new = self.words, self.older, []
        for w in distinct:
            if w not in words:
                if w in older:
                    words[w] = older[w]
                elif w in self.special:
                    words[w] = np.array([self.special[w]], "<i4").tobytes()
                else:
                    new.append((w.encode(), w))
        new.sort()
        for (_, w), tokens in zip(new, self.traverse([b for b, _ in new])):
            words[w] = array("i", tokens).tobytes()
        get = words.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "i4") for ws in split]

    def _words(self, text: str) -> list[str]:
        if not self.split or not self.split.search(text):
            return WORDS.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += WORDS.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + WORDS.findall(text[at:])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _map(docs: DataFrame, kinds: dict[str, T.DataType], make) -> DataFrame:
    """docs with columns of `kinds` added, which make(texts) gives as lists for a slice of the texts."""
    docs = docs.drop(*({*kinds} & {*docs.columns}))
    names, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *(T.StructField(k, v) for k, v in kinds.items())])

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *make(texts)], names=[*names, *kinds])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with token_ids, a list of ids, added. Null and empty texts have none; repeated rows are encoded alike; a column of that name is replaced."""

    def make(texts):
        found = codec(path).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.empty(0, "<i4"), *found])))]

    return _map(docs, {"token_ids": T.ArrayType(T.IntegerType())}, make)


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (the ids decoded again) added.

    As encode(), but the ids stay in the Python worker, which needs only their digests outside.
    """

    def make(texts):
        c = codec(path)
        found = c.encode(texts)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return [pa.array([len(x) for x in found], pa.int64()), pa.array([sha(",".join(map(str, x.tolist())).encode()) for x in found], pa.string()), pa.array([sha(c.decode(x).encode()) for x in found], pa.string())]

    return _map(docs, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, make)
