"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, text_slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Bound of the labelled rows that the model is fitted on, by their share; the fewest rows of the table that make a
#: language; and rows of each language that count even if its share is less (all, if it has no more).
TRAINING_ROWS, LEAST_ROWS, LANGUAGE_ROWS = 20_000, 3, 1000
#: Additive smoothing of bucket counts.
SMOOTHING = 0.5
#: Characters handled at once.
SLICE = 1 << 18
UNDETERMINED = "und"
_BLANK, _OUT = 0, BUCKETS


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Grams:
    """Hashed n-grams of texts: lower-cased letters, with each run of other characters as one blank."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS):
        self.orders, self.buckets, self.letters = orders, buckets, _letters()

    def batches(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one past the last, their symbols, the symbols' text) in slices of about SLICE characters; one text
        that is longer comes in several slices, which overlap by an n-gram less one."""
        for a, b in text_slices(texts, SLICE):
            joined = texts[a:b]
            step = SLICE if b - a == 1 else len(joined[0]) + 1
            if b - a == 1 and len(joined[0]) > SLICE:
                for k in range(0, len(joined[0]), step):
                    yield a, b, *self._symbols([joined[0][k : k + step + max(self.orders) - 1]])
            else:
                yield a, b, *self._symbols(joined)

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lowered = [t.lower() for t in texts]
        codes = np.frombuffer(f" {'  '.join(lowered)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2)
        codes = np.where(self.letters[codes], codes, _BLANK)
        kept = np.ones(len(codes), dtype=bool)
        kept[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK) | (owner[1:] != owner[:-1])
        return codes[kept], owner[kept]

    def hashed(self, codes: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """For each order: the bucket of the n-gram at each symbol; those over a text's end have bucket _OUT, and so has
        a lone blank."""
        for n in self.orders:
            value = np.zeros(len(codes), dtype=np.uint32)
            for k in range(n):
                value[: len(codes) - k] = (value[: len(codes) - k] ^ codes[k:]) * np.uint32(0x9E3779B1) + np.uint32(n)
            bucket = ((value ^ value >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - self.buckets.bit_length() + 1)).astype(np.int64)
            if n == 1:
                bucket[codes == _BLANK] = _OUT
            else:
                bucket[len(codes) - n + 1 :] = _OUT
                bucket[: len(codes) - n + 1][owner[n - 1 :] != owner[: len(codes) - n + 1]] = _OUT
            yield bucket


@dataclass
class LanguageModel:
    """languages, and log probabilities: one row for each bucket and a last row of zeros, one column for each language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def score(self, grams: Grams, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log joint of each text and language, letters of each text)."""
        total, letters = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
        for a, b, codes, owner in grams.batches(texts):
            first = np.searchsorted(owner, np.arange(b - a))
            for bucket in grams.hashed(codes, owner):
                total[a:b] += np.add.reduceat(self.weights[bucket], first, axis=0)
            letters[a:b] += np.add.reduceat((codes != _BLANK).astype(np.int64), first)
        return total, letters


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> LanguageModel:
    """Learns from (text, lang, doc_id); rows with a null text or lang are left out, and so are languages with under
    LEAST_ROWS rows. About `rows` rows, chosen by a hash of doc_id, are counted, and of rare languages more than their share:
    up to LANGUAGE_ROWS each. Priors are those of the whole table.

    Tasks send sparse counts (language, bucket, n), which are summed by a shuffle; the driver gets the matrix alone.
    """
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    docs = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect() if r["count"] >= LEAST_ROWS}
    languages = sorted(docs)
    if not languages:
        return LanguageModel([], np.zeros((buckets + 1, 0), dtype=np.float32), np.zeros(0), orders)
    share, parts = rows / sum(docs.values()), 1 << 53
    most = F.create_map(*[F.lit(x) for lang, n in docs.items() for x in (lang, int(parts * min(1.0, max(share, LANGUAGE_ROWS / n))))])
    labelled = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(parts)) < most[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(orders, buckets), {}
        for batch in batches:
            texts, langs = strings(batch.column(1)), batch.column(2).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                into = counts.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                for _, _, codes, owner in grams.batches(own):
                    for bucket in grams.hashed(codes, owner):
                        into += np.bincount(bucket, minlength=buckets + 1)
        for lang, into in counts.items():
            at = np.flatnonzero(into[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(into[at])], names=["lang", "bucket", "n"])

    found = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((buckets + 1, len(languages)))
    for r in found:
        counts[r.bucket, at[r.lang]] = r.n
    weights = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * buckets))
    weights[buckets] = 0
    total = np.array([docs[x] for x in languages], dtype=float)
    return LanguageModel(languages, weights.astype(np.float32), np.log(total / total.sum()), orders)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents with lang_pred and score, columns of these names replaced. The score is the probability of the
    predicted language if its evidence is taken for a text of the square root of the true number of letters: letters
    depend on each other, and naive Bayes itself is sure after a line. Texts without a letter (null and empty ones too),
    and all texts where no language was learned, are `und` with score 0."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*[f"`{c}`" for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grams = Grams(model.orders, len(model.weights) - 1)
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = strings(batch.column(batch.schema.names.index("text")))
            if model.languages and texts:
                total, letters = model.score(grams, texts)
                odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(letters, 1))[:, None])
                best, score = total.argmax(axis=1), 1 / odds.sum(axis=1)
                best, score = np.where(letters > 0, best, -1), np.where(letters > 0, score, 0.0)
            else:
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
