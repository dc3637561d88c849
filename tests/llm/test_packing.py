import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaestor.llm import packing
from quaestor.llm.tokens import ByteBPE

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n long, key string, place string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(plain):
    bpe = ByteBPE(PATH)
    rng = random.Random(2)
    parts = ["a", "The", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "ñandú", "ß", "中文", "🙂", "12", "3.5", "!!", "###", " ", "\x85", "\x1c", " ", "<|endoftext|>", "x" * 60, "́", "½"]
    texts = ["", " ", "  ", "a ", " a", "\n a", "a \n", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000))]
    for text in texts:
        assert bpe.ids(text).tolist() == plain(text), repr(text)


def test_ids_of_added_tokens_and_long_runs(plain):
    """The added token's string is that token; runs of blanks of any length, and other long runs, are what the library makes of them."""
    bpe = ByteBPE(PATH)
    assert bpe.ids("<|endoftext|>").tolist() == [50256]
    texts = ["a  <|endoftext|>\n b<|endoftext|><|endoftext|> c", "<|endoftext|", *("x" * 200_000, "1" * 200_000, "é!" * 100_000)]
    for run in (" " * 2_000_000, "\n" * 2_000_000, " \n" * 20_000, "\u3000\xa0" * 20_000):
        texts += [run, "word" + run + "end", "word." + run + "\n", run[:12_000] + "<|endoftext|>" + run[:12_000]]
    for text in texts:
        assert bpe.ids(text).tolist() == plain(text), repr(text[:40])


def test_hilbert_curve_steps_to_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(points, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_pieces_give_back_the_documents(spark, plain):
    rng = random.Random(4)
    texts = [None, "", "word", "same text here", "same text here", "end <|endoftext|> of", "\n" * 50_000 + "x", *(" ".join(rng.choices(["alpha", "beta", "gamma.", "λ", "\n"], k=rng.randint(0, 400))) for _ in range(60)), "long " * 3000]
    rows = [(i, t, None, "clash", "clash") for i, t in enumerate(texts)] + [(3, "same text here", None, None, None), (None, "no id", None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, sequence=256).collect()
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        assert len(r.ids) == 4 * r.length
    for k, own in sequences.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 256 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    for i, t, *_ in rows:
        want = [*plain(t or ""), 1]
        if i != 3:
            pieces = sorted(docs[i])
            assert sum((p[1] for p in pieces), []) == want and {p[2] for p in pieces} == {len(want)}
            assert [p[0] for p in pieces] == np.cumsum([0, *(len(p[1]) for p in pieces)])[:-1].tolist()
    assert sum(len(p[1]) for p in docs[3]) == 2 * (len(plain(texts[3])) + 1)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
