"""Operators that SQL does not cover: against plain Python, or for their edge cases."""

import json
import time
import random
import re

import pytest
from pyspark.sql import functions as F

from quaestor import dims
from quaestor.functions import text as tx
from quaestor.operators import catalog, chunks, evaluation, feedback, reconcile, report, search, verdicts
from quaestor.schema import protocol_type, protocols_of, skeleton
from quaestor.sources import html, ingest
from quaestor.streaming import windows
from quaestor.operators import sessions


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(expression(F.col("x"))).collect()]


def test_mentions(spark):
    rows = ["a ko mouse", "kos", "koala", "KO", "knockouts", "ko_x", "x-ko,", "קo"]
    want = [bool(re.search(r"(?<!\w)(?:ko)(?:s|ed|ing)?(?!\w)|knockout", x)) for x in rows]
    assert values(spark, rows, lambda c: tx.mentions(c, ("ko", "knockout"))) == want


def test_words_in_any_script(spark):
    rows = ["CO₂ level", "שלום עולם", "a_b-c", "", "naïve ½"]
    assert values(spark, rows, tx.word_count) == [len(re.findall(r"\w+", x)) for x in rows]


def test_strip_and_collapse(spark):
    rows = ["  a   b\n", "", " \t"]
    assert values(spark, rows, tx.collapse) == [" ".join(x.split()) for x in rows]


def test_snippet(spark):
    rows = ["short", "x" * 10, "aa bb cc dd ee"]
    assert values(spark, rows, lambda c: tx.snippet(c, 8)) == ["short", "x" * 8 + " …", "aa bb …"]


def test_matrix(spark):
    rows = spark.createDataFrame([("mouse", "CO2"), ("mouse", "MS-222"), ("zebrafish", "CO2"), ("dog", "CO2"), (None, "CO2"), ("mouse", "")], "s string, m string")
    assert [r[0] for r in rows.select(tx.method_status(F.col("s"), F.col("m"))).collect()] == ["conditional", "unacceptable", "unacceptable", "unknown", None, None]


def test_totals_modes(spark):
    totals = spark.createDataFrame([("p", "mouse", "a", "M", "wt", 5), ("p", "mouse", "b", "M", "wt", 7)], "protocol_id string, species string, strain string, sex string, genetic_status string, n_total int")
    details = spark.createDataFrame([("p", "mouse", "a", "M", "wt", 5), ("p", "mouse", "c", "M", "wt", 9), ("p", "mouse", None, "M", "wt", 9)], "protocol_id string, species string, strain string, sex string, genetic_status string, n int")
    assert [r.simplified for r in reconcile.simplified(totals).collect()] == [False]
    assert [(r.strain, r.n_total, r.n_details) for r in reconcile.strict_mismatches(totals, details).collect()] == [("b", 7, 0)]
    assert [(r.species, r.n_total, r.n_details) for r in reconcile.simplified_mismatches(totals, details).collect()] == [("mouse", 12, 14)]


def plain_windows(paragraphs, most):
    out, open_ = [], ""
    for p in (x.strip(" ") for x in paragraphs):
        if not p:
            continue
        for piece, by in [(p, "\n")] if len(p) <= most else [(s, " ") for s in re.split(r"(?<=[.!?:;])\s+", p)]:
            if not open_:
                open_ = piece
            elif len(open_) + 1 + len(piece) <= most:
                open_ += by + piece
            else:
                out.append(open_)
                open_ = piece
    return out + [open_] if open_ else out


def test_windows_of_paragraphs(spark):
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choices(["aa", "bbb.", "c;", "dddd"], k=rng.randint(0, 30))) for _ in range(rng.randint(0, 8))) for _ in range(100)]
    got = values(spark, texts, lambda c: chunks.pack_windows(F.split(c, "\n"), 40))
    assert got == [plain_windows(t.split("\n"), 40) for t in texts]


def test_records_and_staleness(spark):
    docs = spark.createDataFrame([(1, "# One\nbody of the first section\n# Two\nx\n# One\nanother body that is long enough")], "id0 long, body string")
    made = chunks.records(docs, "id0", "body", "guidance_section", 10)
    assert sorted(r.id for r in made.collect()) == ["1-one", "1-one-2"]
    assert chunks.stale(made, made).count() == 0 and chunks.stale(made, made.limit(1)).count() == 1


def test_wiki_text(spark):
    assert values(spark, ["== Title ==\n'''bold''' [[a|link]] {{x}}\n<b>y</b>\nSTOP\nz"], lambda c: chunks.wiki_text(c, "STOP")) == ["# Title\nbold link\ny"]


def test_bm25_by_join_is_bm25_by_broadcast(spark):
    docs = spark.createDataFrame([(1, "mouse welfare law"), (2, "mouse mouse"), (3, "rat"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "mouse law law"), (8, "nothing known"), (9, "")], "q long, words string")
    hits = [search.bm25(docs, asked, "id", F.col("text"), "q", F.col("words"), 2, broadcast_bytes=n).collect() for n in (1 << 20, 1)]
    assert sorted(hits[0]) == sorted(hits[1]) and [(r.q, r.id) for r in sorted(hits[0], key=lambda r: r.rank)] == [(7, 1), (7, 2)]


def test_search_falls_back_to_words(spark):
    docs = spark.createDataFrame([(1, "mouse", [1.0, 0.0]), (2, "rat", [0.0, 1.0])], "id long, text string, v array<double>")
    asked = spark.createDataFrame([(7, "rat", [1.0, 0.1])], "q long, words string, a array<double>")
    by_vector = search.search(docs, asked, "id", F.col("text"), "q", F.col("words"), 1, "v", "a").first()
    by_words = search.search(docs.drop("v"), asked, "id", F.col("text"), "q", F.col("words"), 1, "v", "a").first()
    assert (by_vector.id, by_vector.method, by_words.id, by_words.method) == (1, "embedding", 2, "lexical")


def test_cosine_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    docs, asked = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(rows[:9], "q long, a array<double>")
    whole, cut = (search.cosine(docs, asked, "id", "v", "q", "a", 3, broadcast_bytes=n).collect() for n in (1 << 20, 40))
    assert sorted(whole) == sorted(cut) and len(whole) == 27


@pytest.mark.parametrize(
    "answer, want",
    [('{"a": 1}', '{"a": 1}'), ('<think>{"b":2}</think> so: {"a": "}"} end', '{"a": "}"}'), ('```json\n{"a": 1}\n``` then ```\n{"a": 2}\n```', '{"a": 2}'), ("none", None), ("{broken", None), (None, None), ('{x} {"a": 3}', None), ('so {"a": {"b": 1}} and {"c": 2}', '{"a": {"b": 1}}'), ("{" * 200_000, None), ('<Thinking>{"b": 2}</thinking>{"a": 4}', '{"a": 4}')],
)
def test_json_recovery(spark, answer, want):
    assert values(spark, [answer], verdicts.recovered) == [want]


def test_reconcile_falls_back(spark):
    first = spark.createDataFrame([("p", "t", 2, None)], "protocol_id string, theme string, score int, label string")
    got = verdicts.reconcile(first, first.limit(0), ["protocol_id", "theme"]).first()
    assert (got.score, got.label, got.reconciled, got.origin) == (2, "partially_adequate", False, "first")


def test_review_runs_a_provider(spark):
    def provider(frames):
        for f in frames:
            yield f.assign(answer=f.prompt.str.upper())

    rows = spark.createDataFrame([("p", "x")], "protocol_id string, prompt string")
    assert verdicts.review(rows, provider, "protocol_id string, prompt string, answer string").first().answer == "X"


def test_feedback_is_checked(spark):
    rows = spark.createDataFrame([("t", "lint", "header", "up", "1.2.0", None), ("t", "lint", "writing_quality", "up", None, None), ("t", "x", "header", "up", None, None)], "created_at string, kind string, key string, verdict string, ruleset_version string, profile string")
    kept = feedback.accepted(rows, [r for r, _, _ in dims.RULES], [t for t, *_ in dims.THEMES]).collect()
    assert [(r.kind, r.key) for r in kept] == [("lint", "header")]


PAGE = """<!DOCTYPE html><html><head><title> A  page </title><style>p{}</style></head><body><div class="table-header">Details</div>
<table><tr><td>Name<td>Mouse<tr><td>Count</td><td>12</td></tr></table><h2>Staff</h2>
<table><tr><th>Who</th><th>Role</th></tr><tr><td>Ann</td><td>PI</td></tr><tr><td>Bo</td></tr></table><p>open <b>para<p>next</body>"""


def test_html_cells(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", "<td>stray"), (4, "u", "")], "page_id long, url string, html string")
    cells = html.with_cells(pages).select("page_id", F.inline("cells")).cache()
    fields = {(r.page_id, r.section): r.fields for r in html.vertical(cells, "page_id").collect()}
    assert fields[1, "Details"] == {"Name": "Mouse", "Count": "12"}
    rows = sorted((r.row, r.fields) for r in html.horizontal(cells, "page_id").collect() if r.section == "Staff")
    assert rows == [(1, {"Who": "Ann", "Role": "PI"}), (2, {"Who": "Bo"})]
    assert [r.text for r in cells.where("kind = 'text'").collect()] == ["open para", "next"]
    assert pages.select(html.title_of(F.col("html"))).first()[0] == "A page"


def test_ingest_and_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("﻿" + json.dumps({"header": {"protocol_id": "1"}, "experiments": []}), "utf-8")
    (tmp_path / "in/b.json").write_text("{not json")
    (tmp_path / "in/c.txt").write_text("plain")
    (tmp_path / "in/d.json").write_bytes(b"\xff\xfe{}")
    (tmp_path / "in/e.html").write_text("<html></html>")
    rows = {r.path.rsplit("/")[-1]: r for r in ingest.ingest(ingest.read_files(spark, str(tmp_path / "in"))).collect()}
    assert {k: r.error for k, r in rows.items()} == {"a.json": None, "b.json": "not JSON", "c.txt": "unknown format", "d.json": "not UTF-8", "e.html": None}
    assert rows["a.json"].header.protocol_id == "1" and "header.institution" in rows["a.json"].missing_keys and "header" not in rows["a.json"].missing_keys
    protocols = protocols_of(spark, [("p<1>", "{}")])
    made = report.reports(protocols)
    ingest.write_reports(made, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert "p&lt;1&gt;" in ingest.render(made).first().html


def test_skeleton_and_samples(spark):
    assert skeleton(protocol_type())["header"] == {"protocol_id": "", "institution": "", "subcommittee": "", "export_version": ""}
    assert "experiments[].animals.species" in catalog.leaf_paths(protocol_type())
    protocols = protocols_of(spark, [(str(i), json.dumps({"experiments": [{"animals": {"species": s}} for s in ("rat", "mouse")] * 2})) for i in range(3)])
    got = catalog.field_samples(protocols, ["experiments[].animals.species", "header.institution"]).collect()
    assert [(r.path, r.value, r.protocol_id, r.place) for r in got] == [("experiments[].animals.species", "mouse", "0", 1), ("experiments[].animals.species", "rat", "0", 2)]


def test_violations_never_show_values(spark):
    protocols = protocols_of(spark, [("1", json.dumps({"header": {}, "research": {"request_type": "SECRET"}, "pi": {}, "experiments": [{"severity_level_1_to_5": 9}]}))])
    rows = catalog.violations(protocols, 5).collect()
    assert len(rows) == 5 and "SECRET" not in str(rows)
    assert {(r.path, r.rule) for r in catalog.violations(protocols, 99).collect()} >= {("research.request_type", "enum"), ("experiments[].severity_level_1_to_5", "range")}


def test_flip_rate_of_nothing(spark):
    none = spark.createDataFrame([], "c string, p string, score int, parse_ok boolean")
    assert evaluation.flip_rate(none, ["p"], "c").collect() == []


def test_streams_give_the_batch(spark, tmp_path):
    """Files come one by one in time order; what streams give out is what the batch has."""
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "events")
    first, last = raw.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3):  # one file after another: a stream takes them by the time they were written
        third = F.least(F.floor(3 * (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / (F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))), F.lit(2))
        raw.where(third == k).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = lambda: windows.read_events(spark, source, raw.schema)
    cases = {
        "s": (windows.stream_sessions(stream(), "user_id", "ts", late="1 day"), sessions.sessions(events, "user_id", "ts")),
        "r": (windows.stream_rates(stream(), "user_id", "event_type", "ts", 1, "1 hour", "1 day"), sessions.rate_hits(events, "user_id", "event_type", "ts", {}, 1, "1 hour").drop("n_over")),
    }
    for name, (streamed, batch) in cases.items():
        windows.drain(streamed, str(tmp_path / name), str(tmp_path / f"c-{name}"))
        done, whole = ({tuple(r) for r in df.collect()} for df in (spark.read.parquet(str(tmp_path / name)), batch))
        assert done <= whole and len(done) > len(whole) / 4
    windows.drain(windows.stream_first(stream(), ["user_id", "event_type"], "ts", "400 days"), str(tmp_path / "f"), str(tmp_path / "c-f"))
    firsts = spark.read.parquet(str(tmp_path / "f"))
    assert firsts.select("user_id", "event_type").distinct().count() == firsts.count() == events.select("user_id", "event_type").distinct().count()
