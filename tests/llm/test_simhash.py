import random
import re

import numpy as np
import pytest
import xxhash

from quaestor.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rep string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, radius):
    """points: (id, fingerprint)."""
    root = {i: i for i, _ in points}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in points:
        for j, y in points:
            if (x ^ y).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in points}


TEXTS = [None, "", " \t\n", "One", "one two", "ONE TWO three", "a b c d", "É a b c", "a b c d", "x " * 5000, "ı İ K k"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_meet_all_close_pairs():
    masks = [m % (1 << 64) for m in simhash.block_masks()]
    rng = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("tile", [4, 30, 10_000])
def test_components_of_dense_points(spark, tile):
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = list({b ^ sum(1 << x for x in rng.sample(range(14), rng.randint(0, 5))) for b in base for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    points = list(enumerate(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in points], "fp long, rep long")
    parts = simhash.connected_components(simhash.close_links(frame, tile=tile))
    got = {i: i for i, _ in points} | {r.node: r.component for r in parts.collect()}
    assert got == plain_components(points, 3)


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = TEXTS[:]
    for _ in range(12):
        text = rng.choices(words, k=300)
        for _ in range(3):
            text[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(text))
    rows = [(i, t, None, None, None, "clash", "clash") for i, t in enumerate(texts)] + [(3, "One", None, None, None, None, None), (None, "One", None, None, None, None, None), (None, "alone here", None, None, None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in enumerate(texts)], 3)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    nulls = [r for r in got if r.doc_id is None]
    assert sorted(x.component_id or -1 for x in nulls) == [-1, 3]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
