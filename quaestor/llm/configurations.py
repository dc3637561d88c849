"""Bin packing of a length histogram: the configuration linear program by multiplicative weights, then rounded."""

from __future__ import annotations

import numpy as np

#: Rounds of pricing: so many at least, more for few lengths; and how much the price of a length falls as it is covered once.
ROUNDS, PRICED, RATE = 12, 10_000, 0.1
#: A configuration is used while its value is within this part of the best one's.
SLACK = 0.05
#: Rounding: a configuration that leaves more room than this part of a sequence is filled anew.
LOOSE = 0.001
Configuration = dict[int, int]  # length: pieces of that length


def _chunks(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(place of a length, pieces): binary parts of how many pieces of each length can lie in one sequence."""
    out = []
    for i, (l, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        left, k = min(n, capacity // l), 1
        while left > 0:
            out.append((i, min(k, left)))
            left -= k
            k *= 2
    return out


def price(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[dict[int, int]]]:
    """The best value of a configuration that takes no more pieces of a length than there are, and for each length the best
    configuration of which it is the longest (as places of lengths). One knapsack table, shorter lengths first, by dynamic programming over capacities; then all
    configurations are read back from it together."""
    chunks = _chunks(lengths, counts, capacity)
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(chunks), capacity + 1), dtype=bool)
    for k, (i, pieces) in enumerate(chunks):
        size = int(lengths[i]) * pieces
        with_it = best[: capacity + 1 - size] + prices[i] * pieces
        taken[k, size:] = with_it > best[size:]
        best[size:] = np.maximum(with_it, best[size:])
    room, found = capacity - lengths, [{i: 1} for i in range(len(lengths))]
    for k in range(len(chunks) - 1, -1, -1):
        i, pieces = chunks[k]
        hit = np.flatnonzero(taken[k, room[i:]]) + i  # what is longer than a configuration's own length stays out
        if len(hit):
            room[hit] -= int(lengths[i]) * pieces
            for h in hit.tolist():
                found[h][i] = found[h].get(i, 0) + pieces
    return float(best[-1]), found


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(how often each configuration is used, a lower bound of the sequences) of the linear program: cover all pieces by
    configurations, as few as may be.

    Multiplicative weights: each length has a price, its share of the capacity at first. In each round the knapsack gives the
    best configuration for each length; those near the best value are used, the least covered lengths first, and the price
    of what they cover falls exponentially. All uses are scaled so that each token is
    covered once on average. Any prices
    bound the program from below: the value of all pieces over the best value of a configuration.
    """
    prices, covered = lengths / capacity, np.zeros(len(lengths))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    bound = 0.0
    for _ in range(max(ROUNDS, min(PRICED // len(lengths), 200))):
        best, found = price(lengths, counts, prices, capacity)
        bound = max(bound, float(prices @ counts) / best)
        for i in np.argsort(covered, kind="stable").tolist():
            places = np.array(list(found[i]))
            pieces = np.array(list(found[i].values()))
            if prices[places] @ pieces < (1 - SLACK) * best and covered[i] > covered.min():
                continue
            amount = float((counts[places] / pieces).min())
            gain = amount * pieces / counts[places]
            covered[places] += gain
            prices[places] *= np.exp(-RATE * gain)
            key = tuple(sorted(found[i].items()))
            used[key] = used.get(key, 0.0) + amount
    mean = float(covered @ (lengths * counts)) / float(lengths @ counts)
    return {k: x / mean for k, x in used.items()}, bound


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The longest piece that is left, and with it the pieces that leave the least room: a subset sum over capacities as the
    bits of a number, longer pieces first, which ends as soon as a sequence is full."""
    first = int(np.flatnonzero(left)[-1])
    room = capacity - int(lengths[first])
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for i in np.flatnonzero(left[: first + 1] * (lengths[: first + 1] <= room))[::-1].tolist():
        n, k = min(int(left[i]) - (i == first), room // int(lengths[i])), 1
        while n > 0:
            k = min(k, n)
            steps.append((i, k, sums))
            sums |= sums << int(lengths[i]) * k & mask
            n -= k
            k *= 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {first: 1}
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            at -= int(lengths[i]) * k
            out[i] = out.get(i, 0) + k
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Configuration, int]], float]:
    """(configurations and how many sequences have each, a lower bound of the sequences) for pieces by length.

    The program's solution is rounded from the longest piece down. Pieces of a length that are left go into the configurations
    of which they are the longest, the most used first and each as often as the program uses it, rounded up, while all its
    pieces are left; what these can't take is filled, each time with the pieces that leave the least room. So no sequence is
    filled with short pieces while longer ones need them. The work depends on the capacity, not on the number of pieces.
    """
    lengths = np.array(sorted(l for l, n in histogram.items() if n), dtype=np.int64)
    left = np.array([histogram[l] for l in lengths.tolist()], dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = []
    bound = -(-int(lengths @ left) // capacity)
    by_longest: dict[int, list[tuple[float, tuple[tuple[int, int], ...]]]] = {}
    if len(lengths):
        used, least = fractional(lengths, left, capacity)
        bound = max(bound, int(np.ceil(least - 1e-6)))
        for key, x in used.items():
            by_longest.setdefault(key[-1][0], []).append((-x, key))

    def use(places: dict[int, int], most: float) -> None:
        n = int(min([most, *(left[i] // k for i, k in places.items())]))
        if n > 0:
            for i, k in places.items():
                left[i] -= n * k
            out.append((places, n))

    for longest in range(len(lengths) - 1, -1, -1):
        for x, key in sorted(by_longest.get(longest, ())):
            if left[longest] and lengths[[i for i, _ in key]] @ [k for _, k in key] >= (1 - LOOSE) * capacity:
                use(dict(key), np.ceil(-x))
        while left[longest]:
            use(_fill(lengths, left, capacity), np.inf)
    return [({int(lengths[i]): k for i, k in sorted(c.items(), reverse=True)}, n) for c, n in out], bound
