"""Language identification with a string kernel.

A text is the set of its 1-, 2- and 3-grams over 64 classes of bytes (letters
without case, everything else in ASCII as one class, bytes of other characters
folded onto the rest).  The blended-spectrum presence kernel of two texts is the
number of grams both have over the geometric mean of the numbers each has.  A
bounded sample of labelled texts trains one-versus-rest kernel ridge regression
in the Nystroem space of ``LANDMARKS`` of them; all texts are scored by batched
matrix products: presence rows by landmark columns, then by the weights.

All languages of the training rows are told apart.  The sample takes at most
about ``SAMPLE`` texts, or ``EACH`` for each language if that is more, in equal
parts for each language as far as it has them, chosen by a hash of id and text;
it is the only part of the corpus that training sees.  Each language has a
landmark at least.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is everything if nothing is labelled; very long texts count whole; rows that
share an id keep a row each; a null id is not held out; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import join_sized, table, texts_of, written

SAMPLE, LANDMARKS, RIDGE = 1600, 256, 1e-2
#: Texts of each language at least, as far as it has them.
EACH = 20
CLASSES = 64
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
_CLASS = np.zeros(256, np.int32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def grams(data: bytes, seen: np.ndarray) -> None:
    """Mark the grams of a text in ``seen``."""
    c = _CLASS[np.frombuffer(data, np.uint8)]
    seen[c] = True
    if len(c) > 1:
        two = c[:-1] * CLASSES + c[1:]
        seen[CLASSES + two] = True
        if len(c) > 2:
            seen[CLASSES + CLASSES**2 + two[:-1] * CLASSES + c[2:]] = True


def has_letter(data: bytes, seen: np.ndarray) -> bool:
    return bool(seen[1:27].any()) or any(ch.isalpha() for ch in data.decode("utf-8", "replace"))


class Model:
    """Trained from rows of gram numbers and their languages."""

    def __init__(self, rows: list[np.ndarray], langs: list[str], seed: int = 7) -> None:
        self.langs = sorted(set(langs))
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        picked: list[int] = []
        pools = [[i for i in order.tolist() if langs[i] == x] for x in self.langs]
        most = min(max(LANDMARKS, len(self.langs)), len(rows))
        while len(picked) < most:  # each language in turn
            for pool in pools:
                if pool and len(picked) < most:
                    picked.append(pool.pop())
        self.columns = np.unique(np.concatenate([rows[i] for i in picked]))
        size = np.array([len(r) for r in rows], float)
        marks = self._presence([rows[i] for i in picked])
        self.marks = np.ascontiguousarray((marks / np.sqrt(size[picked])[:, None]).T).astype(np.float32)
        values, vectors = np.linalg.eigh(self._kernel(marks, size[picked]).astype(float))
        good = values > 1e-6 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        features = np.concatenate([self._kernel(self._presence(rows[i : i + 256]), size[i : i + 256]) for i in range(0, len(rows), 256)]) @ whiten
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        share = np.array([langs.count(x) for x in self.langs], float)
        weight = (len(langs) / len(self.langs) / share)[[self.langs.index(x) for x in langs]]
        left = features.T * weight
        solved = np.linalg.solve(left @ features + RIDGE * len(langs) / features.shape[1] * np.eye(features.shape[1]), left @ target)
        self.weights = (whiten @ solved).astype(np.float32)

    def _presence(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.columns)), np.float32)
        for to, r in zip(out, rows, strict=True):
            to[np.searchsorted(self.columns, np.intersect1d(r, self.columns, assume_unique=True))] = 1
        return out

    def _kernel(self, presence: np.ndarray, size: np.ndarray) -> np.ndarray:
        return presence @ self.marks / np.sqrt(np.maximum(size, 1))[:, None]

    def scores(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        presence = np.zeros((len(texts), len(self.columns)), np.float32)
        size, known = np.zeros(len(texts)), np.zeros(len(texts), bool)
        seen = np.zeros(GRAMS, bool)
        for i, data in enumerate(texts):
            if not data:
                continue
            seen[:] = False
            grams(data, seen)
            known[i] = has_letter(data, seen)
            size[i] = np.count_nonzero(seen)
            presence[i] = seen[self.columns]
        margin = self._kernel(presence, size) @ self.weights
        odds = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        top = odds.argmax(1)
        score = odds.max(1) / odds.sum(1)
        return [self.langs[k] if ok else "und" for k, ok in zip(top, known, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, known, strict=True)]


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of ``labelled``, whose languages are not null."""
    counts = written(labelled.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")), "languages")
    n = counts.count()
    if not n:
        return None
    each = max(EACH, sample // n)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    drawn = labelled.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), draw.alias("__draw"))
    some = join_sized(drawn, counts, ["__lang"], "inner").where(F.col("__draw") < F.lit(each) / F.col("__n")).select("__lang", "__text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(GRAMS, bool)
        for batch in batches:
            rows = []
            for data in texts_of(batch.column(1)):
                seen[:] = False
                grams(data, seen)
                rows.append(np.flatnonzero(seen).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "grams"])

    got = some.mapInArrow(go, "lang string, grams binary").where(F.octet_length("grams") > 0).limit(2 * max(sample, each * n)).collect()
    got = sorted(got, key=lambda r: (r.lang, bytes(r.grams)))
    return Model([np.frombuffer(r.grams, np.int32) for r in got], [r.lang for r in got]) if got else None


def identify(docs: DataFrame, model: Model | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns (named) with lang_pred and score for every row."""
    base = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    names = base.columns[:-1]
    box = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = box.value
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            texts = texts_of(batch.column(len(names)))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                p, s = model.scores(part) if model else (["und"] * len(part), [0.0] * len(part))
                pred += p
                score += s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(go, f"{schema}, lang_pred string, score double")


def held_out(id_col: str, by: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % by == remainder, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op1``: all ``documents``, learning from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("lang").isNotNull() & ~held_out("doc_id", 5, 0)), "doc_id", "text", "lang")
    return identify(docs, model, [F.col("doc_id"), held_out("doc_id", 5, 0).alias("held_out")])
