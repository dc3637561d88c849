import random
from bisect import bisect_left, insort
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaestor.llm import bins, configurations, queries
from quaestor.llm.tokens import _STEADY, WordBPE

PATH, SF = public_tokenizers.path("word_bpe_49k.json"), "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, length string, row string, piece string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(plain):
    bpe, rng = WordBPE(PATH), random.Random(2)
    steady = [chr(c) for c in range(1, 0x3000) if _STEADY.fullmatch(chr(c))]
    for c in steady:
        for text in (c, f"a{c}b", f"{c}{c}1", f"A {c}'s", f"{c}́"):
            assert bpe.ids(text).tolist() == plain(text), repr(text)
    parts = ["The", "don't", "'s", "''ll", "we're", " ", "\n", "\t", "É", "ñandú", "ß", "İ", "ΣΑΣ", "中文", "🙂", "12", "3.5", "²", "_x_", "!!", "\x85", "\x1c", "\x01", "\x00", "<|endoftext|>", "x" * 60, "é", "½"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert bpe.ids(text).tolist() == plain(text), repr(text)
    for text in ("z" * 200_000, " " * 200_000, "7" * 100_000, "a b " * 100_000):
        assert bpe.ids(text).tolist() == plain(text), text[:9]


def best_fit(pieces, capacity):
    rooms = []
    for x in sorted(pieces, reverse=True):
        k = bisect_left(rooms, x)
        room = rooms.pop(k) - x if k < len(rooms) else capacity - x
        insort(rooms, room)
    return len(rooms)


@pytest.mark.parametrize("name", ["uniform", "halves", "thirds", "short", "one", "none"])
def test_plan(name):
    """Every piece once, no sequence too long, no more sequences than best fit, and none fewer than the bound."""
    rng = np.random.default_rng(6)
    pieces = {
        "uniform": rng.integers(1, 1025, 3000), "halves": rng.integers(400, 620, 2000), "thirds": rng.integers(300, 380, 2000), "short": rng.geometric(0.01, 4000).clip(1, 1024), "one": np.array([5]), "none": np.zeros(0, int),
    }[name].tolist()
    plan, bound = configurations.plan(Counter(pieces), 1024)
    placed = Counter()
    for configuration, n in plan:
        assert n > 0 and sum(l * k for l, k in configuration.items()) <= 1024
        for l, k in configuration.items():
            placed[l] += k * n
    assert placed == Counter(pieces)
    assert -(-sum(pieces) // 1024) <= bound <= sum(n for _, n in plan) <= best_fit(pieces, 1024)


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(3, 40), 5, replace=False))
        counts, prices = rng.integers(1, 4, 5), rng.random(5)
        best, found = configurations.price(lengths, counts, prices, 60)
        every = [np.array(k) for k in np.ndindex(*(counts + 1))]
        assert best == pytest.approx(max(prices @ k for k in every if lengths @ k <= 60))
        for i, places in enumerate(found):
            assert places[i] >= 1 and max(places) == i and sum(int(lengths[j]) * k for j, k in places.items()) <= 60


def test_work_does_not_grow_with_the_pieces():
    plan, bound = configurations.plan({100: 10**12, 37: 3 * 10**11, 64: 10**12 + 7}, 128)
    assert len(plan) < 100 and bound <= sum(n for _, n in plan) == 1_600_000_000_004


def check(got, rows, ids_of, sequence):
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
    for i, text in rows:
        want = [*ids_of(text or ""), 1]
        pieces = sorted(docs[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, k * sequence, min(sequence, len(want) - k * sequence)) for k in range(-(-len(want) // sequence))]
        for r in pieces:
            part = np.array(want[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.ids == part) if "ids" in r else (r.ids_crc32 == crc32(part))
    tokens = sum(r.length for r in got)
    return len(sequences), -(-tokens // sequence)


def test_pieces_give_back_the_documents(spark, plain):
    rng = random.Random(4)
    texts = [None, "", "word", "same text", "same text", "end <|endoftext|> of", "ΣΑΣ İ é", "long " * 700, "x " * 255, *(" ".join(rng.choices(["alpha", "beta", "gamma.", "λ", "\n"], k=rng.randint(0, 300))) for _ in range(150))]
    rows = [(i, t, None, "clash", "clash") for i, t in enumerate(texts)]
    more = [(None, "no id", None, None, None), (9000, "twice", None, None, None), (9000, "twice", None, None, None)]
    got = bins.pack(spark.createDataFrame(rows + more, SCHEMA).repartition(3), PATH, sequence=256).collect()
    assert len([r for r in got if r.doc_id == 9000]) == 2 and len([r for r in got if r.doc_id is None]) == 1
    assert len({r.sequence_id for r in got}) <= best_fit([r.length for r in got], 256)
    single = bins.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, sequence=256).collect()
    n, _ = check(single, [r[:2] for r in rows], plain, 256)
    assert n <= best_fit([r.length for r in single], 256)


def test_query(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, least = check(queries.op12_best_fit_packing(spark, SF).collect(), docs, plain, 4096)
    assert n == least


def test_empty_table(spark):
    assert bins.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
