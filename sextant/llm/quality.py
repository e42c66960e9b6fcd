"""Document quality: gradient-boosted trees over statistics of whole texts.

Statistics of each document (``FEATURES``) are computed once and stored.  Up to
``SAMPLE`` labelled rows, chosen by a hash of the id, train boosted trees on
histograms of at most ``BINS`` bins a feature; the trees are complete and lie in
flat arrays, so that scoring walks all rows of a batch down a tree at once.

Defined cases: null and empty texts have all statistics 0 and a score like any
other; null labels are left out and several labels of one document averaged;
without both labels present the score is the share of label 1, or 0.5 without
any; rows that share an id keep a row each; a null id is not held out; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import table, text_hash, texts_of, written
from sextant.llm.kernels import Words, mix
from sextant.llm.language_id import held_out

SAMPLE, BINS, DEPTH, ROUNDS, RATE = 20_000, 64, 5, 120, 0.12
FEATURES = (
    "log_bytes log_words word_bytes word_spread distinct_words repeats_previous top_word distinct_trigrams letters upper digits spaces punctuation "
    "symbols exclamation bars other_bytes entropy log_lines line_bytes distinct_lines short_lines ended_lines capital_words upper_words odd_words long_words top_trigram second_half_distinct"
).split()
_KIND = np.zeros((8, 256), bool)
_KIND[0, [*range(65, 91), *range(97, 123)]] = True
_KIND[1, 65:91] = True
_KIND[2, 48:58] = True
_KIND[3, [32, 9, 10, 11, 12, 13]] = True
_KIND[4, list(b".,;:?'\"()-")] = True
_KIND[5, list(b"*#$%&@^~_=+<>{}[]\\/`")] = True
_KIND[6, list(b"!")] = True
_KIND[7, list(b"|")] = True
_SHARES = _KIND.astype(float).T
_ODD = _KIND[5] | _KIND[6] | _KIND[7]


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    words = Words(texts)
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    length = words.end - words.start
    first, last = buffer[words.start], buffer[words.end - 1]
    capital = (first >= 65) & (first < 91)
    upper = capital & (length > 1) & (buffer[np.minimum(words.start + 1, len(buffer) - 1)] >= 65) & (buffer[np.minimum(words.start + 1, len(buffer) - 1)] < 91)
    odd = _ODD[last]
    for i, (data, lo, hi) in enumerate(zip(texts, words.first[:-1], words.first[1:], strict=True)):
        if not data:
            continue
        row, n, w = out[i], len(data), hi - lo
        count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        share = count[count > 0] / n
        row[0] = np.log1p(n)
        row[8:16] = count @ _SHARES / n
        row[16] = count[128:].sum() / n
        row[17] = -(share * np.log2(share)).sum()
        lines = [x for x in data.split(b"\n") if x.strip()]
        if lines:
            row[18] = np.log1p(len(lines))
            row[19] = n / len(lines)
            row[20] = len(set(lines)) / len(lines)
            row[21] = sum(len(x) < 40 for x in lines) / len(lines)
            row[22] = sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
        if w:
            h, size = words.hash[lo:hi], length[lo:hi]
            ordered = np.sort(h)
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            row[1] = np.log1p(w)
            row[2], row[3] = size.mean(), size.std()
            row[4] = (len(edge) - 1) / w
            row[5] = np.count_nonzero(h[1:] == h[:-1]) / w
            row[6] = np.diff(edge).max() / w
            row[23], row[24], row[25] = capital[lo:hi].mean(), upper[lo:hi].mean(), odd[lo:hi].mean()
            row[26] = np.count_nonzero(size > 16) / w
            row[28] = len(np.unique(h[w // 2 :])) / (w - w // 2)
            if w > 2:
                three = np.sort(mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]))
                edge = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1], [True]]))
                row[7], row[27] = (len(edge) - 1) / (w - 2), np.diff(edge).max() / (w - 2)
    return out


class Boosted:
    """Gradient-boosted trees for one binary target in [0, 1]."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, ridge: float = 2.0, least: int = 10) -> None:
        self.depth = depth
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        inner = 2**depth - 1
        self.feature, self.cut, self.leaf = np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1))
        if not len(y) or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        n_features, trees = len(edges), []
        margin = np.full(len(y), self.base)
        offset = np.arange(n_features)[:, None] * BINS
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                width, base = 2**level, 2**level - 1
                at = (offset + binned + (node - base)[None, :] * (n_features * BINS)).ravel()
                total = width * n_features * BINS
                g, h, c = (np.bincount(at, np.tile(v, n_features) if v is not None else None, total).reshape(width, n_features, BINS).cumsum(2) for v in (grad, hess, None))
                all_g, all_h, all_c = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(c < least) | (all_c - c < least)] = -1
                flat = gain.reshape(width, -1)
                top = flat.argmax(1)
                chosen, where = top // BINS, top % BINS
                for k in range(width):
                    if flat[k, top[k]] > 1e-6 and where[k] < len(edges[chosen[k]]):
                        feature[base + k], cut[base + k] = chosen[k], edges[chosen[k]][where[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            slot = node - inner
            leaf = -rate * np.bincount(slot, grad, inner + 1) / (np.bincount(slot, hess, inner + 1) + ridge)
            margin += leaf[slot]
            trees.append((feature, cut, leaf))
        self.feature, self.cut, self.leaf = (np.stack(c) for c in zip(*trees, strict=True))

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and packed statistics of every document, stored."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in statistics(texts_of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "text_hash", "stats"])

    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))
    return written(base.mapInArrow(go, "doc_id bigint, text_hash bigint, stats binary"), "statistics")


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed)).reshape(len(packed), len(FEATURES))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Boosted:
    """Fit on at most about ``sample`` labelled documents."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    some = known.where(draw < min(1.0, sample / max(n, 1))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y")).limit(2 * sample)
    got = stats.join(F.broadcast(some), "doc_id").select("doc_id", "stats", "y").limit(4 * sample).collect()  # bounded by the sample
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.stats)))
    return Boosted(_matrix([r.stats for r in got]), np.array([r.y for r in got]))


def scored(stats: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, text_hash, score, predicted for every row of statistics."""
    box = stats.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = box.value.score(_matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "text_hash", "score", "predicted"])

    return stats.select("doc_id", "text_hash", "stats").mapInArrow(go, "doc_id bigint, text_hash bigint, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op2``: all ``documents``, learning from two thirds of the labels."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    stats = measured(table(spark, sf_dir, "documents"))
    out = scored(stats, train(stats, labels))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
