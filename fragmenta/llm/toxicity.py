"""Toxicity by a linear-chain conditional random field over words.

Tokens for training are labelled from document labels: words that set toxic documents apart, and that
together explain them, are toxic there. The field has two tags, a weight per word and weights between
tags; forward-backward gives each word's marginal. A document's score is calibrated from its highest marginal and the
expected number of toxic words, and runs of words over one half are its spans.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import free, text_slices
from .sampling import Logistic, examples, labelled, measured

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of the training sample: documents per label, documents to calibrate on, characters of each for the tagger, segments trained on.
PER_CLASS, MIXED, CHARS, SEGMENTS = 2000, 3000, 8000, 6000
#: Words of a sequence in training and in tagging; a longer text is several sequences.
SHORT, LONG = 32, 128


@dataclass
class Field:
    """Log potentials: a word's for the toxic tag, between tags (from, to), and of a sequence's first tag."""

    words: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    between: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: float = 0.0


def passes(emit: np.ndarray, length: np.ndarray, f: Field) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences side by side: marginals of the toxic tag (n, steps), and pair marginals summed over all (2, 2).

    emit holds the toxic tag's log potentials, padded behind length.
    """
    n, steps = emit.shape
    e = np.exp(np.clip(emit, -30, 30))
    move, start = np.exp(f.between), np.exp(np.clip(f.first, -30, 30))
    ahead, behind = np.empty((steps, n, 2)), np.ones((steps, n, 2))
    for t in range(steps):
        if t:
            o = ahead[t - 1, :, 0] * move[0, 0] + ahead[t - 1, :, 1] * move[1, 0]
            x = (ahead[t - 1, :, 0] * move[0, 1] + ahead[t - 1, :, 1] * move[1, 1]) * e[:, t]
        else:
            o, x = np.ones(n), start * e[:, 0]
        both = o + x
        ahead[t, :, 0], ahead[t, :, 1] = o / both, x / both
    for t in range(steps - 2, -1, -1):
        o, x = behind[t + 1, :, 0], behind[t + 1, :, 1] * e[:, t + 1]
        a, b = move[0, 0] * o + move[0, 1] * x, move[1, 0] * o + move[1, 1] * x
        both, inside = a + b, t + 1 < length
        behind[t, :, 0], behind[t, :, 1] = np.where(inside, a / both, 1), np.where(inside, b / both, 1)
    p = ahead * behind
    p /= p.sum(axis=2, keepdims=True)
    marginals = p[:, :, 1].T
    marginals = np.where(np.arange(steps) < length[:, None], marginals, 0)
    pairs = np.zeros((2, 2))
    if steps > 1:
        inside = (np.arange(1, steps)[:, None] < length).astype(float)
        w = [[ahead[:-1, :, i] * move[i, j] * (e.T[1:] if j else 1) * behind[1:, :, j] for j in (0, 1)] for i in (0, 1)]
        total = sum(w[i][j] for i in (0, 1) for j in (0, 1))
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = (w[i][j] / total * inside).sum()
    return marginals, pairs


def marking_words(toxic: list[set[str]], clean: list[set[str]], ratio: float = 8, need: int = 2, least: float = 0.005) -> set[str]:
    """Words `ratio` times as frequent in toxic documents, taken greedily while each explains `least` of the toxic
    documents that have fewer than `need` such words yet."""
    in_toxic, in_clean = Counter(w for ws in toxic for w in ws), Counter(w for ws in clean for w in ws)
    floor = max(2, least * len(toxic))
    able = {w for w, n in in_toxic.items() if n >= floor and n / len(toxic) >= ratio * (in_clean[w] + 0.5) / max(len(clean), 1)}
    holders = {w: [] for w in able}
    for i, ws in enumerate(toxic):
        for w in ws & able:
            holders[w].append(i)
    has, out = [0] * len(toxic), set()
    gain = {w: len(h) for w, h in holders.items()}
    while gain:
        w = max(gain, key=lambda w: (gain[w], w))
        now = sum(has[i] < need for i in holders[w])
        if now < gain[w]:  # others have explained some meanwhile
            gain[w] = now
            if now < floor:
                del gain[w]
            continue
        del gain[w]
        out.add(w)
        for i in holders[w]:
            has[i] += 1
    return out


def train_field(sequences: list[tuple[list[str], list[int]]], rounds: int = 40) -> Field:
    """Maximum likelihood with an L2 penalty, by AdaGrad over all sequences at once."""
    count = Counter(w for ws, _ in sequences for w in ws)
    place = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= 3))}
    other, n, steps = len(place), len(sequences), max((len(ws) for ws, _ in sequences), default=1)
    ids, tags, length = np.full((n, steps), other + 1), np.zeros((n, steps)), np.array([len(ws) for ws, _ in sequences])
    for i, (ws, ys) in enumerate(sequences):
        ids[i, : len(ws)] = [place.get(w, other) for w in ws]
        tags[i, : len(ys)] = ys
    inside = np.arange(steps) < length[:, None]
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((tags[:, :-1] == i) & (tags[:, 1:] == j) & inside[:, 1:]).sum()
    w, between, first = np.zeros(other + 2), np.zeros((2, 2)), 0.0
    w[: other + 1] = -2.0
    known = np.bincount(ids.ravel(), weights=(tags * inside).ravel(), minlength=other + 2)
    past = np.full(other + 2 + 5, 1e-6)
    for _ in range(rounds):
        p, pairs = passes(w[ids], length, Field(between=between, first=first))
        g = np.concatenate([known - np.bincount(ids.ravel(), weights=p.ravel(), minlength=other + 2) - 0.05 * w, (seen - pairs).ravel() - 0.05 * between.ravel(), [(tags[:, 0] - p[:, 0]).sum() - 0.05 * first]])
        past += g * g
        step = 1.5 * g / np.sqrt(past)
        w += step[: other + 2]
        between = between + step[other + 2 : -1].reshape(2, 2)
        first += step[-1]
    # A word that training hardly knows is no more suspect than the median word.
    unknown = min([float(w[other]), *([float(np.median(w[:other]))] if other else [])])
    return Field({x: float(w[i]) for x, i in place.items()}, unknown, between, float(first))


@dataclass
class Model:
    share: float = 0.5
    tagger: Field | None = None
    calibrate: Logistic | None = None

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text's words the probability of the toxic tag."""
        get, other = self.tagger.words.get, self.tagger.other
        weights = [[get(w.lower(), other) for w in WORD.findall(x or "")] for x in texts]
        lengths = np.array([len(x) for x in weights])
        parts = -(-lengths // LONG)
        n = int(parts.sum())
        if not n:
            return [np.empty(0)] * len(texts)
        emit, length = np.zeros((n, LONG)), np.full(n, LONG)
        flat = np.concatenate([np.array(x, dtype=float) for x in weights])
        ends = np.cumsum(parts)
        last = parts > 0
        length[ends[last] - 1] = lengths[last] - (parts[last] - 1) * LONG
        inside = np.arange(LONG) < length[:, None]
        emit[inside] = flat
        p = passes(emit, length, self.tagger)[0][inside]
        return np.split(p, np.cumsum(lengths)[:-1])

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return np.clip(self.calibrate(summary(marginals)), 0, 1) if marginals else np.empty(0)


def summary(marginals: list[np.ndarray]) -> np.ndarray:
    """A document's highest marginal, and the expected number of toxic words among those that may well be; 0 without words."""
    return np.array([(p.max(), np.log1p(p[p > 0.05].sum())) if len(p) else (0.0, 0.0) for p in marginals]).reshape(-1, 2)


def train(sample: dict[str, list[str]]) -> Model:
    """The tagger of toxic ("1") and clean ("0") texts; no calibration yet."""
    words = {k: [[w.lower() for w in WORD.findall(x)] for x in sample[k]] for k in ("0", "1")}
    marks = marking_words([set(x) for x in words["1"]], [set(x) for x in words["0"]])
    cut = lambda docs, toxic: [(x[i : i + SHORT], [int(toxic and w in marks) for w in x[i : i + SHORT]]) for x in docs for i in range(0, len(x), SHORT)]
    pick = lambda xs, n: xs[:: max(1, -(-len(xs) // n))]
    toxic = cut(words["1"], True)
    # Half of the sequences are of toxic words, a quarter of others of toxic documents, a quarter of clean ones.
    chosen = pick([x for x in toxic if any(x[1])], SEGMENTS // 2) + pick([x for x in toxic if not any(x[1])], SEGMENTS // 4) + pick(cut(words["0"], False), SEGMENTS // 4)
    return Model(0.5, train_field(chosen))


def fit(docs: DataFrame, labels: DataFrame, label: str, out: Column, seed: int = 10) -> Model:
    """Trains on a bounded sample (PER_CLASS, MIXED, CHARS above) of documents with a label that aren't held out.

    The tagger is trained on pieces from anywhere in the texts; the calibration measures whole texts, as scores do.
    """
    sample = labelled(docs, labels, label, out, PER_CLASS, MIXED, seed)
    texts = examples(sample, CHARS, seed)
    if not texts["0"] or not texts["1"]:
        free(sample)
        return Model(1.0 if texts["1"] else 0.0 if texts["0"] else 0.5)
    model = train(texts)
    x, y = measured(sample, lambda part: summary(model.marginals(part)))
    free(sample)
    share = float(y.mean())
    if share in (0, 1):
        return Model(share)
    model.share, model.calibrate = share, Logistic(x, y, penalty=0.1, square=False)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, spans: bool = True) -> DataFrame:
    """docs with score, predicted and, if wanted, spans (begin, end, score) added.

    Whole texts are tagged, in sequences of LONG words. Spans are code point offsets of runs of words whose
    marginals are over one half, with the highest. Null and empty texts have no spans and the score of no toxic
    words; repeated rows score alike. Without labels of both kinds every score is the share of label 1, 0.5 without any, and there are no spans.
    Columns named like the added ones are replaced.
    """
    docs = docs.drop("score", "predicted", "spans")
    names, at = docs.columns, docs.columns.index("text")
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def runs(text, p):
        out, open_ = [], False
        if not len(p) or p.max() <= 0.5:
            return out
        for m, x in zip(WORD.finditer(text), p.tolist()):
            if x > 0.5 and open_:
                out[-1] = {"begin": out[-1]["begin"], "end": m.end(), "score": max(out[-1]["score"], x)}
            elif x > 0.5:
                out.append({"begin": m.start(), "end": m.end(), "score": x})
            open_ = x > 0.5
        return out

    def run(batches):
        for batch in batches:
            for a, b, part in text_slices(batch.column(at)):
                if model.tagger is None:
                    p, found = [np.empty(0)] * (b - a), np.full(b - a, model.share)
                else:
                    p = model.marginals(part)
                    found = model.scores(p)
                more = [pa.array([runs(t, x) for t, x in zip(part, p)], pa.list_(span))] if spans else []
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype("i4")), *more], names=[*names, "score", "predicted", *["spans"] * spans])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if spans:
        kind = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
        added.append(T.StructField("spans", T.ArrayType(kind)))
    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), *added]))
