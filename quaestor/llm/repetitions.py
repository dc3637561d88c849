"""Runs of periodic text: maximal repetitions of words, found by the algorithm of Kolpakov and Kucherov (1999)."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import gram_hashes

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 24, 3
Run = tuple[int, int, int]  # start, end (exclusive), period


def suffix_automaton(w: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """(transitions, last letter of the first occurrence) of each state of the automaton of all factors of w."""
    moves: list[dict[int, int]] = [{}]
    length, link, first = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(moves)
        moves.append({})
        length.append(i + 1)
        link.append(0)
        first.append(i)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                first.append(first[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves, first


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, earlier start): the longest that began earlier, or one new letter (earlier: -1)."""
    moves, first = suffix_automaton(w)
    out, i, n = [], 0, len(w)
    while i < n:
        state, j, end = 0, i, -1
        while j < n and (to := moves[state].get(w[j], -1)) >= 0 and first[to] < j:
            state, end = to, first[to]
            j += 1
        out.append((i, j - i, end - (j - i) + 1) if j > i else (i, 1, -1))
        i = max(j, i + 1)
    return out


def _matches(w: list[int]) -> np.ndarray:
    """For each place, how long what begins there agrees with the beginning of w."""
    n = len(w)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and w[k] == w[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z, dtype=np.int64)


def _around(w: list[int], low: int, b: int, high: int, words: int, periods: int) -> Iterator[Run]:
    """Main's step: periodic stretches of w[low:high] that meet the boundary b, with one whole period on one of its sides."""
    left, right = w[low:b][::-1], w[b:high]
    nx, ny = len(left), len(right)
    most = (nx + ny) // periods
    back = _matches([*left, -1, *right[::-1], *left])  # how far left of a place the words agree with those left of b
    on = _matches([*right, -2, *w[low:high]])  # how far from a place on they agree with those from b on
    for n, agree_left, agree_right, shift in (
        (min(most, ny), lambda p: back[nx + 1 + ny - p], lambda p: np.append(on[1:ny], 0)[p - 1], 0),  # a period to the right of b
        (min(most, nx), lambda p: np.append(back[1:nx], 0)[p - 1], lambda p: on[ny + 1 + nx - p], 1),  # one to the left
    ):
        p = np.arange(1, n + 1)
        if n:
            l, r = agree_left(p), agree_right(p)
            start, end = b - l - shift * p, b + r + (1 - shift) * p
            good = (end - start >= np.maximum(words, periods * p)) & (l <= nx) & (r <= ny)
            yield from zip(start[good].tolist(), end[good].tolist(), p[good].tolist())


def maximal_runs(w: list[int], words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of w, by start: stretches of at least `words` words and `periods` (two or more) times their smallest period,
    which no neighbouring word extends.

    Runs that meet a boundary of two Lempel-Ziv factors are found by Main's algorithm, in a stretch that is linear in these
    factors; any other one lies strictly within a factor, and is a copy of one that is known from the factor's earlier
    occurrence. A stretch comes out with multiples of its period too; the smallest one counts.
    """
    n = len(w)
    cut = factors(w)
    bounds = [f[0] for f in cut] + [n]
    found: list[tuple[int, int]] = []  # (start, end), sorted
    period: dict[tuple[int, int], int] = {}

    def add(s: int, e: int, p: int) -> None:
        if (s, e) not in period:
            insort(found, (s, e))
            period[s, e] = p
        else:
            period[s, e] = min(p, period[s, e])

    for i, (b, size, earlier) in enumerate([*cut, (n, 0, -1)]):
        if i:
            before = b - bounds[i - 1]
            low, high = max(0, b - 2 * before - size - 1), min(n, b + size + 1)
            if high - low >= words:
                for s, e, p in _around(w, low, b, high, words, periods):
                    # What reaches the edge of the stretch may go on beyond it; then another boundary has it.
                    if (s > low or low == 0) and (e <= b + size or high == n) and s <= b <= e:
                        add(s, e, p)
        if earlier >= 0 and size >= words:
            k = bisect_right(found, (earlier, n))
            while k < len(found) and found[k][0] < earlier + size:  # copies may be copied again within the same factor
                s, e = found[k]
                if e < earlier + size:
                    add(s + b - earlier, e + b - earlier, period[s, e])
                k += 1
    return [(s, e, period[s, e]) for s, e in found]


def _stretches(ids: np.ndarray, words: int, periods: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) outside of which no run lies: each run of so many words and periods is covered by grams of a
    width that stand in it twice. Take one at i of a run [s, e) of period q, width = words * (periods - 2) / periods: it stands
    at i - q too if i >= s + q, else at i + q, as i + q + width < s + 2 * q + width <= e."""
    width = words * (periods - 2) // periods
    if width < 1 or len(ids) < words:
        if len(ids) >= words:
            yield 0, len(ids)
        return
    grams = gram_hashes(ids.astype(np.uint64), width)
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(np.diff(grams[order].view(np.int64)) == 0)
    again = np.zeros(len(grams) + 2, dtype=np.int8)
    again[order[same] + 1] = again[order[same + 1] + 1] = 1
    edges = np.diff(again)
    for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        if e - s + width - 1 >= words:
            yield s, e + width - 1


def document_runs(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of a document's words. Only stretches that repeat themselves are factorised."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(x, len(numbers)) for x in words], dtype=np.int64)
    return [(a + s, a + e, p) for a, z in _stretches(ids, least, periods) for s, e, p in maximal_runs(ids[a:z].tolist(), least, periods)]


def _kept(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by a blank, without those that any run holds after its first period."""
    out, at = [], 0
    for s, e in sorted((s + p, e) for s, e, p in runs):
        if s > at:
            out += words[at:s]
        at = max(at, e)
    return b" ".join(out + words[at:])


def _collapse(least: int, periods: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                runs, kept = [], []
                for text in batch.column(1):
                    words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # at ASCII's blanks
                    found = document_runs(words, least, periods) if len(words) >= least else []
                    runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in found])
                    kept.append(_kept(words, found))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["kept", "runs", "collapsed"])

    return run


def collapse(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The columns of `keep`, then runs (an array of start, length and period in words, by start) and collapsed (the words,
    joined by one blank, of which no run holds those after its first period).

    Words are what stands between blanks and ASCII's other white space. Null, empty and blank texts have no run and collapse to
    the empty text. Repeated rows, and rows without a doc_id, count each; overlapping runs all count; an empty table stays
    empty. Columns outside `keep` are left out; one in `keep` with the name of a result gives way to it.

    Each document is a matter of its own, so nothing is shuffled. A task holds one document's words, and some 0.5 KB for each
    word of one of its stretches that repeats.
    """
    kept: Column = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    kind = docs.select(kept).schema["kept"].dataType.simpleString()
    made = docs.select(kept, F.col("text").cast("string").alias("text")).mapInArrow(_collapse(least_words, least_periods), f"kept {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return made.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c not in ("runs", "collapsed")], "runs", "collapsed")
