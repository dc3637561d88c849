"""Benchmark decontamination by winnowed word k-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Words, buffers, gram_hashes, word_hashes, words_of
from .common import frozen, ragged, stored

WINDOW = 10
GRAM = 5
#: Bytes of text handled at once (a longer text is handled alone).
SLICE = 2 << 20
#: Bytes of the windows' table up to which it is sent to every task; beyond it, fingerprints are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a window beside its words: fingerprint, place, key, offsets; and of an item beside its id.
ROW_BYTES, ITEM_BYTES = 48, 8
_NONE = np.uint64(2**64 - 1)


def _grams(words: Words, hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` words by their first word; those that would leave their text have the largest value."""
    out = np.full(len(hashes), _NONE, dtype=np.uint64)
    grams = gram_hashes(hashes, width)
    out[: len(grams)] = np.minimum(grams, _NONE - np.uint64(1))
    ends = words.first[1:]
    lengths = np.minimum(np.diff(words.first), width - 1)
    out[ragged(ends - lengths, lengths)] = _NONE
    return out


def winnow(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints: of each `window` words of a text, the k-grams with the smallest hash. Two
    equal windows have equal fingerprints at equal places, so a shared span of `window` words always shares one."""
    gram = min(gram, window)
    grams = _grams(words, hashes, gram)
    if not len(grams):
        return np.zeros(0, dtype=np.int64), grams
    span = min(window - gram + 1, len(grams))
    least = grams.copy()
    for k in range(1, span):
        least[:-k] = np.minimum(least[:-k], grams[k:])
        least[-k:] = _NONE
    lengths = np.minimum(np.diff(words.first), window - 1)
    least[ragged(words.first[1:] - lengths, lengths)] = _NONE
    chosen = np.zeros(len(grams), dtype=bool)
    for k in range(span):
        chosen[k:] |= (least[: len(least) - k] == grams[k:]) & (least[: len(least) - k] != _NONE)
    at = np.flatnonzero(chosen)
    return at, grams[at]


@dataclass
class Windows:
    """Distinct windows of the benchmark of one length in words, to look up in documents. No Python object per window, so that a
    task holds about as many bytes as the table has."""

    prints: np.ndarray  # fingerprints, sorted
    at: dict[int, tuple[np.ndarray, np.ndarray]]  # by the fingerprint's place in its window: sorted keys, and whose they are
    words: pa.Array  # each window's words, joined by a blank (binary)
    first: np.ndarray  # where each window's items begin, and their end
    items: pa.DictionaryArray  # the items of all windows, one window after another


def _keys(prints: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One number for a fingerprint and a hash of all words; windows that share it are told apart by their words."""
    return prints * np.uint64(0x9E3779B97F4A7C15) ^ whole.view(np.uint64)


def item_windows(items: list[tuple[str, bytes]], window: int, gram: int) -> list[tuple[int, int, int, bytes, int, str]]:
    """(window's words, fingerprint, fingerprint's place in it, words' bytes, hash of all of them, item) for each window of each item. An item
    of fewer words than a window is one window of as many."""
    column = pa.array([t for _, t in items], type=pa.large_string())
    words = words_of(*buffers(column))
    hashes = word_hashes(words)
    out = []
    grams = {w: _grams(words, hashes, min(gram, w)) for w in {min(window, int(n)) for n in np.diff(words.first)} if w}
    for t, (item, _) in enumerate(items):
        first, last = int(words.first[t]), int(words.first[t + 1])
        if first == last:
            continue
        n = min(window, last - first)
        whole = gram_hashes(hashes[first:last], n).view(np.int64)
        for i in range(first, last - n + 1):
            own = grams[n][i : i + n - min(gram, n) + 1]
            k = int(np.argmin(own))
            out.append((n, int(own[k].astype(np.int64)), k, words.text(i, i + n), int(whole[i - first]), item))
    return out


def _windows(table: pa.Table) -> dict[int, Windows]:
    """From rows (n, h, back, whole, words, items), one for each window."""
    made, lengths = {}, table.column("n").to_numpy()
    for n in sorted(set(lengths.tolist())):
        own = table.take(pa.array(np.flatnonzero(lengths == n))).combine_chunks()
        prints, back, whole = own.column("h").to_numpy().view(np.uint64), own.column("back").to_numpy(), own.column("whole").to_numpy()
        keys, at = _keys(prints, whole), {}
        for place in np.unique(back).tolist():
            rows = np.flatnonzero(back == place)
            rows = rows[np.argsort(keys[rows], kind="stable")]
            at[place] = (keys[rows], rows)
        lists = own.column("items")
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        items = pa.chunked_array([pc.list_flatten(lists)] if not isinstance(lists, pa.ChunkedArray) else pc.list_flatten(lists).chunks, pa.string()).combine_chunks()
        made[n] = Windows(np.sort(prints), at, own.column("words").cast(pa.large_binary()).combine_chunks(), first, items.dictionary_encode())
    return made


def _found(windows: Windows, n: int, words: Words, hashes: np.ndarray, at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of the windows of n words that stand in the texts, given the texts' fingerprints. For each place a
    fingerprint can have in its window, the words around it are looked up by fingerprint and hash of all of them, at once for
    all texts; what is found is compared word for word."""
    known = np.searchsorted(windows.prints, prints, side="right") > np.searchsorted(windows.prints, prints, side="left")
    at, prints = at[known], prints[known]
    text = np.searchsorted(words.first, at, side="right") - 1
    starts, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    whole = gram_hashes(hashes, n) if len(at) else None
    for back, (keys, own) in windows.at.items() if len(at) else ():
        s = at - back
        good = (s >= words.first[text]) & (s + n <= words.first[text + 1])
        s = s[good]
        asked = _keys(prints[good], whole[s])
        low, high = np.searchsorted(keys, asked, side="left"), np.searchsorted(keys, asked, side="right")
        starts.append(np.repeat(s, high - low))
        rows.append(own[ragged(low, high - low)])
    start, row = np.concatenate(starts), np.concatenate(rows)
    same = [words.text(s, s + n) == windows.words[w].as_py() for s, w in zip(start.tolist(), row.tolist())]
    same = np.array(same, dtype=bool)
    return start[same], row[same]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        yield start, stop
        start = stop


def _batches_of_words(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    data, offsets = buffers(column)
    for a, b in _slices(offsets):
        words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, words, word_hashes(words)


_COUNTS = "n_words long, n_hit long, items array<string>"


def _counted(a: int, b: int, words: Words, hit: np.ndarray, items: dict[int, set]) -> tuple[list, list, list]:
    sums = np.concatenate(([0], np.cumsum(hit)))
    return np.diff(words.first).tolist(), (sums[words.first[1:]] - sums[words.first[:-1]]).tolist(), [sorted(items.get(t, ())) for t in range(b - a)]


def _search(windows: dict[int, Windows], gram: int):
    """Documents (columns..., text) with the counts of _COUNTS in place of the text; each hit of a fingerprint is extended to
    its window and compared word for word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for a, b, words, hashes in _batches_of_words(batch.column("text")):
                hit, found = np.zeros(len(hashes), dtype=bool), defaultdict(set)
                for n, own in windows.items():
                    start, window = _found(own, n, words, hashes, *winnow(words, hashes, n, gram))
                    hit[ragged(start, np.full(len(start), n))] = True
                    text = np.searchsorted(words.first, start, side="right") - 1
                    for t in np.unique(text).tolist():
                        mine = np.unique(window[text == t])  # a text's window counts once, however often it stands there
                        codes = np.unique(own.items.indices.to_numpy()[ragged(own.first[mine], own.first[mine + 1] - own.first[mine])])
                        found[t].update(own.items.dictionary.take(pa.array(codes)).to_pylist())
                for column, values in zip((n_words, n_hit, items), _counted(a, b, words, hit, found)):
                    column += values
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "n_hit", "items"]
            )

    return run


def _prints(lengths: list[int], gram: int):
    """(key, n, h, back, whole, start) for each fingerprint of the documents' windows of each length and each window that
    may hold it at place `back`; `whole` is a hash of all the window's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, hashes in _batches_of_words(batch.column("text")):
                for n in lengths:
                    at, prints = winnow(words, hashes, n, gram)
                    t = np.searchsorted(words.first, at, side="right") - 1
                    whole = gram_hashes(hashes, n)
                    for back in range(n - min(gram, n) + 1):
                        s = at - back
                        good = (s >= words.first[t]) & (s + n <= words.first[t + 1])
                        s, of = s[good], t[good]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("key").slice(a, b - a).take(pa.array(of)), pa.array(np.full(len(s), n, dtype=np.int64)), pa.array(prints[good].view(np.int64)), pa.array(np.full(len(s), back, dtype=np.int64)),
                                pa.array(whole[s].view(np.int64)), pa.array(s - words.first[of]),
                            ],
                            names=["key", "n", "h", "back", "whole", "start"],
                        )

    return run


def _verify():
    """(key, n_words, n_hit, found) of texts that come with their candidate windows (start, n, words): found are the windows
    that are equal word for word, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("n", pa.int64()), ("words", pa.binary())]))
        for batch in batches:
            n_words, n_hit, found = [], [], []
            tried = batch.column("tried")
            for a, b, words, _ in _batches_of_words(batch.column("text")):
                hit, own = np.zeros(len(words.start), dtype=bool), defaultdict(set)
                for t in range(b - a):
                    first, last = int(words.first[t]), int(words.first[t + 1])
                    for x in tried[a + t].as_py() or ():
                        s = first + x["start"]
                        if s >= first and s + x["n"] <= last and words.text(s, s + x["n"]) == x["words"]:
                            hit[s : s + x["n"]] = True
                            own[t].add((x["n"], x["words"]))
                for column, values in zip((n_words, n_hit, found), _counted(a, b, words, hit, own)):
                    column += values
            windows = pa.array([[{"n": n, "words": w} for n, w in own] for own in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), windows], names=["key", "n_words", "n_hit", "found"])

    return run


def _item_table(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["n", "h", "back", "words", "whole", "item"]
    for batch in batches:
        for t in range(len(batch)):
            if rows := item_windows([(batch.column(0)[t].as_py(), batch.column(1)[t].as_py())], window, gram):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns..., n_words, n_hit, items, contaminated) for each document; a kept column may have any name but
    these.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. A window is `window`
    consecutive words of an item, or all words of a shorter one. A document's word is hit if it lies in an occurrence of a
    window; `items` are the ids, sorted as strings, of the items with such windows. Found are windows that share a winnowed
    fingerprint (the smallest k-gram hash of the window) and are then equal word for word. Null texts have no words; items
    without an id, or without words, are left out; repeated rows count each for itself. No documents give no rows, and
    without a benchmark nothing is contaminated.

    The benchmark's windows are made in tasks. Their table goes to every task if it has at most `broadcast_bytes`, as
    measured; otherwise both sides' windows are joined by a shuffle on fingerprint and hash of all words, and those that
    match are sent to the documents for the comparison.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    tests = frozen(items.mapInArrow(lambda batches: _item_table(batches, window, gram), "n long, h long, back long, words binary, whole long, item string").distinct())
    window_keys = ("n", "h", "back", "whole", "words")
    sizes = tests.groupBy(*window_keys).agg(F.sum(F.octet_length("item") + ITEM_BYTES).alias("items"))
    size = sizes.agg(F.sum(F.octet_length("words") + ROW_BYTES + F.col("items"))).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(("doc_id", *keep))]).alias("row"), "text")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {_COUNTS}"
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(_windows(tests.groupBy(*window_keys).agg(F.collect_list("item").alias("items")).toArrow()))
        out = rows.mapInArrow(lambda batches: _search(shared.value, gram)(batches), schema)
    else:
        out = _joined(rows, tests, gram)
    return out.select("row.*", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def _joined(rows: DataFrame, tests: DataFrame, gram: int) -> DataFrame:
    """By shuffles: texts are keyed by their hash, so that copies are looked at once. Windows are joined without their items,
    which follow for the windows that a text holds, each once."""
    lengths = sorted(r[0] for r in tests.select("n").distinct().collect())  # at most as many as a window has words
    keyed = rows.withColumn("key", F.sha2("text", 256))
    texts = keyed.select("key", "text").where("text is not null").dropDuplicates(["key"])
    prints = texts.mapInArrow(_prints(lengths, gram), "key string, n long, h long, back long, whole long, start long")
    tried = prints.join(tests.drop("item").distinct(), ["n", "h", "back", "whole"]).select("key", F.struct("start", "n", "words").alias("x"))
    tried = tried.groupBy("key").agg(F.collect_set("x").alias("tried"))
    checked = stored(texts.join(tried, "key", "left").mapInArrow(_verify(), "key string, n_words long, n_hit long, found array<struct<n:long,words:binary>>"))
    items = checked.select("key", F.inline("found")).join(tests.select("n", "words", "item").distinct(), ["n", "words"]).select("key", "item").distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = keyed.drop("text").join(checked.drop("found"), "key", "left").join(items, "key", "left")
    nothing = F.array().cast("array<string>")
    return out.select("row", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_words", "n_hit")], F.coalesce("items", nothing).alias("items"))
