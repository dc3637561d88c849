import hashlib
import random

from quaestor.llm import fim

SCHEMA = "doc_id long, text string, n string, output string, kept string"


def plain_form(doc_id, text):
    """The contract, letter by letter."""
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fim.fill_in_middle(docs, keep=("doc_id", "n", "kept", "text"))
    made.cache()
    assert made.columns == ["doc_id", "kept", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(repr, (tuple(r) for r in made.select("doc_id", "text", *made.columns[3:]).collect())))
    assert got == sorted(repr((i, t, *plain_form(i, t))) for i, t, *_ in rows)
    back = fim.restore(made, keep=("text",)).collect()
    assert len(back) == len(rows) and all((r.text or "") == r.restored for r in back)
    made.unpersist()
    return made


def test_forms_and_their_texts(spark):
    """All forms, marks half there, code points of any width, line breaks, a null character, combining marks and repeated rows."""
    rng = random.Random(5)
    parts = ["a", "The ", "<", ">", "<P", "S>", "M", "<M", "é", "é", "中", "🙂", "👩‍🚀", "\n", "\r\n", "\t", "\x00", " ", "\\", "'", "%"]
    texts = ["", "a", "é", "<P>", "a<S>b", "<M>", "\n", "🙂", *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(700))]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(7, "twice", "n", None, None)] * 2 + [(9000, "", None, None, None)]
    forms = [r.form for r in check(spark, rows).collect()]
    assert all(forms.count(k) > 40 for k in ("plain", "spm", "psm"))


def test_nulls_and_very_long_texts(spark):
    rows = [(1, None, None, None, None), (None, "without an id", None, "o", None), (3, "x", None, None, None), (4, "word ü " * 700_000, None, None, None), (5, "🙂<" * 300_000, None, None, None)]
    check(spark, rows)


def test_settings(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fim.fill_in_middle(docs, cut=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(docs, cut=100, suffix_first=100).collect()} == {"spm"}
    one, two = ([r.output for r in fim.fill_in_middle(docs, seed=s).orderBy("doc_id").collect()] for s in (1, 2))
    assert one != two


def test_empty_table(spark):
    made = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert made.collect() == [] and fim.restore(made).collect() == []
