"""Toxicity: a linear-chain conditional random field over words, with two states, clean and toxic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, buffers, word_hashes, words_of
from .common import bounded_sample, frozen, stored

#: Labelled rows that words are counted on, and rows of each label that the field is fitted on, at most about.
LEXICON_ROWS, FIELD_ROWS = 20_000, 1_000
#: Bytes of the word starts that are features beside the whole word (0).
STARTS = (0, 4, 5, 6, 7, 8)
#: Words and starts with weights of their own; toxic rows that one needs; share of toxic rows from which it marks a token.
VOCABULARY, LEAST_ROWS, PURITY = 4000, 3, 0.6
#: Words of a training sequence, and the penalty of squared weights.
CHUNK, PENALTY = 64, 1e-4
#: The gradient's length, as a share of its first one, at which the fit has converged, and steps after which it ends anyway.
CONVERGED, MOST_STEPS = 1e-4, 500
#: Steps that the fit remembers.
MEMORY = 8
#: Bytes of text handled at once (a longer text is handled alone).
SLICE = 4 << 20
#: Marginal probability from which a word belongs to an offending span.
TOXIC = 0.5
#: See _summary.
FAINT, SHORT = 0.1, 20


@dataclass
class ToxicityModel:
    """words: sorted hashes of words and starts; emissions: weights of a word's own features, and of the whole words before
    and after it (entry 0: any other one); transitions[a, b]: from state a to b; document: weights of what _summary gives."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    emissions: np.ndarray = field(default_factory=lambda: np.zeros((3, 1)))
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for the known words, 0 for others."""
        if not len(self.words):
            return np.zeros(len(hashes), dtype=np.int32)
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1).astype(np.int32)
        return np.where(self.words[k] == hashes, k + np.int32(1), np.int32(0))

    def potentials(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The toxic state's log potential of each word, against the clean one's 0; ids[f, i] is feature f of word i."""
        own, left, right = self.emissions
        before, after = _neighbours(ids[0], first)
        total = self.bias + left[before] + right[after]
        for x in ids:  # one feature at a time: all at once take six times the memory
            total += own[x]
        return total


def _ends(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last word of each sequence that has words."""
    some = first[:-1] < first[1:]
    return first[:-1][some], first[1:][some] - 1


def _neighbours(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each word, 0 over a text's ends."""
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    begins, lasts = _ends(first)
    before[begins] = after[lasts] = 0
    return before, after


def features(words: Words) -> np.ndarray:
    """Hashes of each word's features, one row for each of STARTS; a word that is no longer than a start lacks it (0)."""
    rows = []
    for k in STARTS:
        cut = words if not k else Words(words.data, words.start, np.minimum(words.end, words.start + k), words.first)
        hashes = word_hashes(cut) * np.uint64(2 * k + 1)
        rows.append(np.where(words.end - words.start > k, hashes, np.uint64(0)))
    return np.stack(rows)


def marginals(potentials: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the toxic state for each word; of the step from state a to b into each word, as 4 columns, zero for
    a sequence's first) by the forward-backward recursions, run for all sequences at once, on log-odds so that long ones
    don't underflow. Sequence t has the words first[t] to first[t + 1]; a clean state stands before and after each."""
    (cc, ct), (tc, tt) = transitions
    begins, lasts = _ends(first)
    potentials = potentials.copy()
    potentials[begins] += ct - cc
    potentials[lasts] += tc - cc
    forward, backward = potentials.copy(), np.zeros(len(potentials))
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")  # longer than step
    for step in range(1, len(active)):
        at = starts[: active[step]] + step
        before = forward[at - 1]
        forward[at] += np.logaddexp(ct, before + tt) - np.logaddexp(cc, before + tc)
    ends = first[1:][order]
    for step in range(1, len(active)):
        at = ends[: active[step]] - 1 - step
        after = backward[at + 1] + potentials[at + 1]
        backward[at] = np.logaddexp(tc, after + tt) - np.logaddexp(cc, after + ct)
    toxic = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    pair = np.zeros((len(potentials), 4))
    inner = np.ones(len(potentials), dtype=bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    f, b = forward[at - 1], potentials[at] + backward[at]
    logs = np.stack([np.full(len(at), cc), ct + b, f + tc, f + tt + b], axis=1)
    logs = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(at) else logs
    pair[at] = logs / logs.sum(axis=1, keepdims=True) if len(at) else logs
    return toxic, pair


def fit_field(model: ToxicityModel, ids: np.ndarray, toxic: np.ndarray, first: np.ndarray, most: int = MOST_STEPS) -> int:
    """Sets the field's weights to the maximum of the labelled words' conditional likelihood, less a penalty, which is
    concave: limited-memory quasi-Newton steps until the gradient is gone. Returns the number of steps."""
    k = len(model.words) + 1
    before, after = _neighbours(ids[0], first)
    begins, lasts = _ends(first)
    inner = np.ones(ids.shape[1], dtype=bool)
    inner[begins] = False
    # Steps from and to the clean states around each sequence are steps like others.
    around = lambda p: np.array([2 * len(begins) - p[begins].sum() - p[lasts].sum(), p[begins].sum(), p[lasts].sum(), 0])
    steps_seen = np.bincount((2 * np.roll(toxic, 1) + toxic)[inner].astype(int), minlength=4) + around(toxic)

    def set_weights(weights: np.ndarray) -> None:
        model.emissions, model.bias, model.transitions = weights[: 3 * k].reshape(3, k), float(weights[3 * k]), weights[3 * k + 1 :].reshape(2, 2)

    def gradient_at(weights: np.ndarray) -> np.ndarray:
        set_weights(weights)
        p, pair = marginals(model.potentials(ids, first), first, model.transitions)
        error = toxic - p
        out = np.concatenate([sum(np.bincount(x, error, minlength=k) for x in ids), *(np.bincount(x, error, minlength=k) for x in (before, after)), [error.sum()], steps_seen - pair.sum(axis=0) - around(p)]) / max(1, len(first) - 1)
        out[[0, k, 2 * k]] = 0  # the bias stands for words without a weight
        return out - PENALTY * weights

    weights = np.concatenate((model.emissions.ravel(), [model.bias], model.transitions.ravel()))
    gradient = gradient_at(weights)
    enough, past, step = CONVERGED * np.linalg.norm(gradient), [], 0
    while step < most and np.linalg.norm(gradient) > enough:
        direction = _quasi_newton(gradient, past)
        slope, length = gradient @ direction, 1.0 if past else 1 / max(1.0, np.linalg.norm(gradient))
        for _ in range(20):  # the slope along the direction falls; a step must not go far beyond where it is zero
            moved = weights + length * direction
            new = gradient_at(moved)
            step, end = step + 1, new @ direction
            if end >= -0.5 * slope:
                break
            length *= slope / (slope - end)
        past = [*past[-MEMORY + 1 :], (moved - weights, gradient - new)]
        weights, gradient = moved, new
    set_weights(weights)
    return step


def _quasi_newton(gradient: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The direction of ascent by the two-loop recursion over past (moves, falls of the gradient)."""
    past = [(s, y) for s, y in past if s @ y > 1e-12]
    direction, rates = gradient.copy(), []
    for s, y in reversed(past):
        rates.append((s @ direction) / (s @ y))
        direction -= rates[-1] * y
    if past:
        s, y = past[-1]
        direction *= (s @ y) / (y @ y)
    for (s, y), rate in zip(past, reversed(rates)):
        direction += (rate - (y @ direction) / (s @ y)) * s
    return direction


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(1, log-odds of the largest marginal, log of the marginals' sum, log of their mean) of each text. Marginals under
    FAINT count as none, and means as if each text had SHORT more words, so that a text of a word or two is not judged by
    how rare that word is."""
    out = np.tile([1.0, np.log(1e-4), np.log(1e-2), np.log(1e-4)], (len(first) - 1, 1))
    some, p = np.flatnonzero(first[:-1] < first[1:]), np.where(p >= FAINT, p, 0.0)
    if len(some):
        top, total = np.maximum.reduceat(p, first[some]), np.add.reduceat(p, first[some])
        out[some, 1], out[some, 2] = np.log((top + 1e-4) / (1 - top + 1e-4)), np.log(total + 1e-2)
        out[some, 3] = np.log(total / (np.diff(first)[some] + SHORT) + 1e-4)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton steps; the penalty leaves the first weight alone."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Words, np.ndarray]]:
    data, offsets = buffers(column)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, offsets[a : b + 1] - offsets[a], words, features(words)
        a = b


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic rows, rows) for rows (text, label): each row counts a feature once."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for a, b, _, words, hashes in _parts(batch.column("text")):
            owner = np.tile(np.repeat(np.arange(b - a), np.diff(words.first)), len(STARTS))
            hashes = hashes.ravel()
            owner, hashes = owner[hashes != 0], hashes[hashes != 0]
            order = np.lexsort((owner, hashes))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            h, toxic = h[new], labels[a:b][o[new]].astype(np.int64)
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=int)
            if len(starts):
                yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(np.add.reduceat(toxic, starts)), pa.array(np.diff(np.append(starts, len(h))))], names=["word", "toxic", "n"])


def _ids_of(words: np.ndarray):
    """(label, n, ids) of rows (text, label): the features of a text's words as numbers of the lexicon's, STARTS by STARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(words=words)
        for batch in batches:
            for a, b, _, found, own in _parts(batch.column("text")):
                ids = model.ids(own.ravel()).reshape(own.shape).astype("<u2")
                lengths = np.diff(found.first)
                made = [ids[:, s:e].tobytes() for s, e in zip(found.first[:-1].tolist(), found.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(lengths), pa.array(made, pa.binary())], names=["label", "n", "ids"])

    return run


def fit(docs: DataFrame, labels: DataFrame, lexicon_rows: int = LEXICON_ROWS, field_rows: int = FIELD_ROWS) -> ToxicityModel:
    """Learns from docs (doc_id, text) and labels (doc_id, label 0 or 1). No one labelled words, so a word of a toxic row is
    a toxic token if most rows that hold it, or one of its starts, are toxic, each label counted as often as the table has
    it; all other words are clean. The field learns from these tokens and their neighbours, and a logistic model from the
    rows' marginals to their labels.

    Words are counted over at most about half of `lexicon_rows` rows of each label, and field and logistic model fitted on at
    most about `field_rows` of each; rows are chosen by a hash, from the narrow labels, before a text is read. Tasks turn
    texts into numbers, so the driver holds two bytes a feature. Of several labels of a doc_id the largest counts; null ones
    and rows without a doc_id are left out; null texts are empty. With one label only, or none, the score is its smoothed
    share.
    """
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("long")).alias("label"))
    totals = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    if set(totals) != {0, 1}:
        share = np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
        return ToxicityModel(document=np.array([share, 0.0, 0.0, 0.0]))
    each = [bounded_sample(labels.where(F.col("label") == x), "doc_id", lexicon_rows // 2, n=totals[x]) for x in (0, 1)]
    chosen = frozen(each[0].union(each[1]))  # about lexicon_rows narrow rows at most: small enough to broadcast
    some = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"))  # read three times below
    counts = some.mapInArrow(_count_words, "word long, toxic long, n long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    found = {r.label: r["count"] for r in some.groupBy("label").count().collect()}
    if set(found) != {0, 1}:
        return ToxicityModel(document=np.array([np.log((totals[1] + 1) / (totals[0] + 1)), 0.0, 0.0, 0.0]))
    base = totals[1] / (totals[0] + totals[1])
    bad_rows, clean_rows = F.col("toxic") * (totals[1] / found[1]), (F.col("n") - F.col("toxic")) * (totals[0] / found[0])
    purity, weight = (bad_rows + base) / (bad_rows + clean_rows + 1), bad_rows + clean_rows
    # Words that speak for toxic rows have weights of their own; all others share one, which so is that of unseen words.
    known = counts.where(F.col("toxic") >= LEAST_ROWS).withColumns({"purity": purity, "weight": weight}).where(F.col("purity") > 1.5 * base).withColumn("gain", F.sqrt("weight") * F.abs(F.log(F.col("purity") / base)))
    known = known.orderBy(F.desc("gain"), "word").limit(VOCABULARY).collect()
    hashes = np.array([r.word for r in known], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = ToxicityModel(words=hashes[order])
    bad = np.concatenate(([False], np.array([r.purity for r in known], dtype=float)[order] >= PURITY))
    model.emissions = np.zeros((3, len(hashes) + 1))
    field_sample = [bounded_sample(some.where(F.col("label") == x).select("doc_id", "text", "label"), "doc_id", field_rows, "field", n=found[x]) for x in (0, 1)]
    rows = field_sample[0].union(field_sample[1]).select("text", "label").mapInArrow(_ids_of(model.words), "label long, n long, ids binary").toArrow()  # bounded
    labels_of, lengths = rows.column("label").to_numpy(), rows.column("n").to_numpy()
    ids = np.concatenate([np.frombuffer(x.as_buffer(), "<u2").reshape(len(STARTS), -1) for x in rows.column("ids")], axis=1).astype(np.int32)
    first = np.concatenate(([0], np.cumsum(lengths)))
    toxic = bad[ids].any(axis=0) & (np.repeat(labels_of, lengths) == 1)
    # Training sequences are pieces of the texts, of one length at most.
    cuts = np.unique(np.concatenate([first, *(np.arange(s, e, CHUNK) for s, e in zip(first[:-1], first[1:]))]))
    fit_field(model, ids, toxic.astype(float), cuts)
    p, _ = marginals(model.potentials(ids, first), first, model.transitions)
    # Both labels were sampled alone: their weights bring back their shares.
    model.document = fit_logistic(_summary(p, first), labels_of.astype(float))
    model.document[0] += np.log(max((labels_of == 0).sum(), 1) / max((labels_of == 1).sum(), 1)) + np.log(totals[1] / totals[0])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, spans) for each document, null texts as empty: the probability that it is toxic, and its offending
    spans (start, end, p) in code points, end exclusive: runs of words whose marginals reach TOXIC (the value itself too), p
    being the largest. Repeated rows count each; an empty table gives none; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, offsets, words, hashes in _parts(batch.column("text")):
                p, _ = marginals(model.potentials(model.ids(hashes.ravel()).reshape(hashes.shape), words.first), words.first, model.transitions)
                score = 1 / (1 + np.exp(-np.clip(_summary(p, words.first) @ model.document, -500, 500)))
                spans: list[list] = [[] for _ in range(b - a)]
                hit = np.flatnonzero(p >= TOXIC) if len(model.words) else np.zeros(0, dtype=int)
                if len(hit):
                    owner = np.searchsorted(words.first, hit, side="right") - 1
                    breaks = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (np.diff(owner) > 0)))
                    leads = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))  # code points before each byte
                    for i, j in zip(breaks.tolist(), [*breaks[1:].tolist(), len(hit)]):
                        t = int(owner[i])
                        zero = leads[offsets[t]]
                        spans[t].append((int(leads[words.start[hit[i]]] - zero), int(leads[words.end[hit[j - 1]]] - zero), float(p[hit[i:j]].max())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score), pa.array([[dict(zip(("start", "end", "p"), s)) for s in x] for x in spans], pa.list_(span))], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,p:double>>")
