import random
import re

import pytest

from quaestor.llm import pii

SCHEMA = "doc_id long, text string, base string, spans string, redacted string"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The base spans."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


EDGES = [
    None, "", "a@b", "a@b.c", "a@b.c_d@e.f", "x.a@b.c@d.e.f..", "@a.b", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1", "1.2.3", "1..2.3.4.5", "9" * 400 + ".1.1.1",
    "4111 1111-1111 1111", "4111111111111111 4111111111111111", "4111111111111112", "é4111-1111-1111-1111ñ", "1 2 3", "+1 (017) 555-7713", "+1", "+1)2", "++12 345 678 90 12 (", "+123456789012345678", "🙂 +1 (017) 555-7713 é@é.é b@c.de",
    "tok = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "5 " * 3000, "a." * 5000 + "@x.y", "0" * 20000, "+" + "(" * 5000, "joe (at) example (dot) org", "mail joe [at] example.com or call (555) 123-4567 now", "call 030 1234 5678, +49 (30) 123 456 78 90",
]


def texts(rng, n):
    parts = ["joe", ".", "@", "x.com", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "4111111111111111", "+1 (017) 555-7713", "1.2.3.4", "é", "\n", "_", "%"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    words = ["order", "the", "call", "of", "token", "house", "wird", "être", "sí", "note"]
    return pii.fit(spark.createDataFrame([(i, " ".join(rng.choices(words, k=60)), None, None, None) for i in range(1500)], SCHEMA))


@pytest.mark.parametrize("learned", [False, True])
def test_base_spans(spark, model, learned):
    model = model if learned else pii.SpanModel()
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(EDGES + texts(random.Random(1), 400))] + [(3, "a@b.c", None, None, None), (None, "a@b.c", None, None, None)]
    got = pii.redact(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows)
    order = list(pii.KINDS)
    for r in got:
        base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert base == plain(r.text), r.text
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (order.index(s[0]), s[1]))
        added = [s for s in spans if s not in base]
        assert learned or not added
        for k, a, b in added:
            assert not any(x < b and a < y for _, x, y in base)
        if r.text is not None:
            want, at = "", 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
                want += r.text[at:a] + f"[{kind.upper()}]" if a >= at else ""
                at = max(at, b)
            assert r.redacted == want + r.text[at:]
        else:
            assert r.redacted is None


def test_learned_spans(spark, model):
    """Each generator adds what is personal, on shapes that the trees never saw, and leaves look-alikes alone."""
    assert set(model.thresholds) == set(pii.GENERATORS)
    assert all(p >= pii.PRECISION and r >= 0.9 for p, r in model.report.values()), model.report
    key, more = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    want = {
        f'x token = "{key}" y': [("secret", 11, 51)], f"see commit {key} y": [], "abcdefghijabcdefghijabcdefghij 4111111111111112 plain": [], "write joe_x (at) my-host (dot) org now": [("email", 6, 34)],
        "sold 20 (at) 12.50 each": [], "please call 555.123.4567 now": [("phone", 12, 24)], "order 4238397436896689 of 2024-11-05": [], "é🙂 tel. (030) 1234567!": [("phone", 8, 21)],
        f"a@b.c password={more} 1.2.3.4": [("email", 0, 5), ("ip", 56, 63), ("secret", 15, 55)], "look at the.point dot": [],
    }
    rows = [(i, t, None, None, None) for i, t in enumerate(want)]
    got = {r.text: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert got == want


def test_overlaps(spark):
    """Against a plain version: base spans stay, then by rank and start."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        spans = [(s := rng.randrange(60), s + rng.randint(1, 9), rng.choice([-2.0, -0.9, -0.8, -0.7, -0.6]), rng.choice("ab")) for _ in range(rng.randint(0, 30))]
        rows.append((i, sorted(set(spans))))
    df = spark.createDataFrame(rows, "id long, s array<struct<start:int,end:int,rank:double,kind:string>>")
    got = {r.id: sorted(tuple(x) for x in r.c) for r in df.select("id", pii._chosen(pii.F.col("s")).alias("c")).collect()}
    for i, spans in rows:
        want = [s for s in spans if s[2] == -2]
        for s in sorted((x for x in spans if x[2] != -2), key=lambda x: (x[2], x[0], x[1], x[3])):
            if not any(y[0] < s[1] and s[0] < y[1] for y in want):
                want.append(s)
        assert got[i] == sorted(want)


def test_long_texts(spark, model):
    """A million characters of what each generator takes: no pattern recurses, and no step goes over the text for each match."""
    texts = {
        "spelled": "a[at]b" + ".c" * 500_000, "dots": "1." * 500_000, "cards": "4 " * 500_000, "mails": "ab@c.de " * 125_000, "numbers": "(555) 123-4567 " * 66_000, "letters": "a" * 1_000_000, "ats": "a[at]" * 200_000,
        "plus": "+1" + "(" * 1_000_000, "keys": 'key = "0123456789abcdef0123456789abcdef01234567" ' * 20_000, "blanks": " " * 2_000_000, "lines": "\n" * 2_000_000,
    }
    rows = [(i, text, None, None, None) for i, (name, text) in enumerate(texts.items())]
    got = {list(texts)[r.doc_id]: r for r in pii.redact(spark.createDataFrame(rows, SCHEMA), model).collect()}
    for name, r in got.items():
        if name not in ("spelled", "dots", "letters"):  # quadratic in the plain version
            assert [tuple(s) for s in r.base] == plain(texts[name])
        if name in ("letters", "blanks", "lines"):
            assert r.redacted == texts[name]
        if name in ("mails", "keys"):
            assert len(r.spans) > 15_000


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = pii.fit(none)
    assert model == pii.SpanModel() and pii.find(none, model).collect() == []
