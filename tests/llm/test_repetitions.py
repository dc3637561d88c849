import hashlib
import random
import re
from zlib import crc32

from quaestor.llm import queries
from quaestor.llm import repetitions as rep

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, collapsed string, kept string"


def plain_runs(w, words, periods):
    """All maximal periodic stretches, period by period; of one stretch the smallest period."""
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(words, periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def plain_collapse(w, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_words(rng, most):
    n, letters = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    for _ in range(rng.choice([0, 0, 1, 2]) if n else 0):
        w[rng.randrange(n)] = rng.randrange(letters)
    return w


def test_runs_are_those_of_brute_force():
    rng, seen = random.Random(3), 0
    for _ in range(6000):
        w = made_words(rng, 70)
        words, periods = rng.choice([(2, 2), (5, 2), (3, 3), (9, 3), (24, 3), (8, 4), (1, 3)])
        want = plain_runs(w, words, periods)
        assert rep.maximal_runs(w, words, periods) == want, (w, words, periods)
        assert rep.document_runs([b"%d" % x for x in w], words, periods) == want, (w, words, periods)
        seen += len(want)
    assert seen > 10_000


def test_factors_are_the_longest_earlier_ones():
    rng = random.Random(8)
    for _ in range(300):
        w, at = made_words(rng, 40), 0
        for start, size, earlier in rep.factors(w):
            assert start == at
            longest = max((n for n in range(len(w) - start + 1) if any(w[j : j + n] == w[start : start + n] for j in range(start))), default=0)
            assert size == max(1, longest)
            assert w[earlier : earlier + size] == w[start : start + size] and earlier < start if longest else earlier == -1
            at += size
        assert at == len(w)


def test_long_and_nested_repetitions():
    unit = [rng % 7 for rng in range(50)] + [9] * 40
    w = (unit * 400)[:35_990]
    got = rep.maximal_runs(w)
    assert (0, len(w), 90) in got and len([r for r in got if r[2] == 1]) == 400 and len([r for r in got if r[2] == 7]) == 400
    w = list(range(30_000)) * 3
    assert rep.document_runs([b"%d" % x for x in w]) == [(0, 90_000, 30_000)]


def test_collapse(spark):
    """Nulls, blanks of all kinds, words of any script, repeated rows, rows without an id and columns of clashing names."""
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a b " * 30, "x\x0b" * 23, "x\x0b" * 24, "é é " * 40, "\x1c \x85 " * 30, "中 " * 25 + "end", "word " * 300_000]
    texts += [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n ", "\t"]).join(map(str, made_words(rng, 90))) for _ in range(300)]
    rows = [(i, t, "r", "c", "k") for i, t in enumerate(texts)] + [(4, texts[4], None, None, None), (None, "b " * 50, None, None, None)]
    got = rep.collapse(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=("doc_id", "text", "kept", "runs")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = [(0, len(w), 1)] if len(w) == 300_000 else plain_runs(w, 24, 3)
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == runs and r.collapsed == plain_collapse(w, runs)
    assert rep.collapse(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    """op11 on the whole small table, planted repeats included, against the contract word by word."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_repetitions(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        n, h = len(w), crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = rep.maximal_runs(w) if n > 3000 else plain_runs(w, 24, 3)
        best = max(runs, key=lambda x: ((x[1] - x[0]) / x[2], -x[0]), default=None)
        want = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got) > 10
