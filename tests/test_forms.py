"""Form exports, made here, to protocol blocks."""

import pytest
from pyspark.sql import functions as F

from quaestor.sources import form_experiments as fe
from quaestor.sources import forms


def page(quantity="12"):
    vertical = lambda rows: "<div class='table vertical'><table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table></div>"
    horizontal = lambda heads, rows: "<div class='table horizontal'><table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table></div>"
    research = [(forms.RESEARCH["title_he"], "מחקר"), (forms.RESEARCH["title_en"], "A Pilot &amp; more"), (forms.CONTINUATION, "חדש"), (forms.THIRD_PARTY, forms.YES), (forms.THIRD["sponsor_org"], "Org"), (forms.TERM, "3 שנים"), (forms.SITES, "A, B,")]
    return (
        "<html><body><div class='header'><div>בקשת ניסוי מס': <span>IL-7</span></div><div>שם המוסד: <span>Uni</span></div></div><div class='sub-header'>המחקר</div>" + vertical(research) + "<div class='sub-header'>החוקר הראשי</div>" + vertical([(forms.ID_TYPE, "ת.ז."), (forms.PI["email"], "x@y.z"), (forms.PI["email"], "last@y.z")])
        + "<div class='table-header'>הכשרות החוקר</div>" + horizontal(list(forms.TRAINING.values()), [("7", "U", "mice", "2020"), ("8",)])
        + "<div class='sub-header'>משתתפים במחקר</div>" + "".join(
            f"<div class='table-header'>משתתף מס {i}</div>" + horizontal(list(forms.PARTICIPANTS.values()), [(name, "g", str(i), role, "כן" if i == 1 else "לא")]) + ("<div class='table-header'>הכשרות</div>" + horizontal(list(forms.PARTICIPANT_TRAINING.values()), [("c", "u", "rats")]) if i == 1 else "")
            for i, name, role in ((1, "לוי", "עובד עם בעלי חיים"), (2, "כהן", "אחר"))
        )
        + "<div class='sub-header'>נימוק למספר בעלי החיים</div><div class='table'><div>Power: 12 for 80%: yes</div></div>"
        + "<div class='sub-header'>תקציר מדעי</div>" + vertical([(q, a) for q, a in zip(forms.SUMMARY.values(), ("t", "", "q"))]) + "<div class='sub-header'>תקציר לקהל הרחב</div><div class='table'><div>lay words</div></div>"
        + "<div class='sub-header'>חיפוש חלופות</div><div class='table'><div>מנועים: PubMed, EURL</div></div><div class='table'><div>שאילתות: a; b</div></div><div class='table'><div>מסקנה: none</div></div>"
        + "<div class='sub-header'>ניסויים מקדימים</div>" + vertical([("האם היו שלבים בלי חיות?", "כן"), ("פרוט הניסויים", "cells")])
        + "<div class='sub-header'>ניסוי 1</div>" + horizontal(list(forms.EXPERIMENT_ANIMALS.values()), [("עכברים", "", "C57", "wt", "זכר", "5", "8 Weeks", "אחר")]) + horizontal(list(forms.HOUSING.values()), [("קבוצתי", "", "")])
        + "<div class='table-header'>נימוקים לבחירה</div>" + vertical([("הנימוק לבחירת סוג, זן ומין בעל החיים", "best"), ("תיאור מהלך הניסוי", "steps"), ("האם נעשה שימוש במשככי כאבים", "לא"), ("שאלת המחקר", "why")])
        + "<div class='sub-header'>ניסוי 2</div><p>nothing</p>"
        + "<div class='sub-header'>בעלי החיים הדרושים</div>" + horizontal(list(forms.TOTALS.values()), [("עכברים", "", "C57", "", "זכר, נקבה", "8", quantity, "מקור חיצוני"), ("dog", "", "", "", "", "", "", "a, b")]) + "</body></html>"
    )


def nested_page(groups, quantity="30"):
    """An export whose experiments are tables that nest others, four cells to a row."""
    flat = lambda pairs: "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in pairs)
    four = lambda pairs: "".join(f"<tr><td> {a[0]} </td><td>{a[1]}</td><td> {b[0]} </td><td><p>{b[1]}</p></td></tr>" for a, b in zip(pairs[::2], [*pairs[1::2], ("", "")]))
    wrapped = lambda rows: f"<div class='table vertical'><table><tbody>{rows}</tbody></table></div>"
    drugs = lambda heads, rows: "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in (heads, *rows)) + "</table>"
    parts = fe.DESCRIPTION
    body = ""
    for i, own in enumerate(groups, 1):
        tables = "".join(wrapped(four([(fe.GROUP[k], v) for k, v in g.items()])) for g in own)
        body += wrapped(
            f"<tr><td colspan='4'> ניסוי {i}</td></tr><tr><td>נא לציין את שאלת המחקר</td><td>why {i}</td><td>{fe.NESTED_HOUSING['enrichment']}</td><td>toys</td></tr>"
            f"<tr><td>{fe.NESTED_HOUSING['group_housed']}</td><td>{fe.NESTED_IN_GROUPS}</td><td>{fe.NESTED_HOUSING['single_housing_duration_days']}</td><td>3</td></tr><tr><td>{fe.ANIMALS}</td><td colspan='3'><br>{tables}</td></tr>"
        ) + "<div class='table-header'>נימוקים לבחירה</div>" + wrapped(
            flat([("הנימוק לבחירת סוג, זן ומין בעל החיים", "best"), (parts["timeline"], "inject category D"), (parts["analgesia_used"], "כן")])
            + f"<tr><td>{fe.ANALGESIA}</td><td>{drugs(['שם החומר', 'מינון', 'משטר'], [['Drug', '5', 'daily']])}</td></tr><tr><td>{fe.ANESTHESIA}</td><td>{drugs(['שם החומר', 'נימוק', 'משטר', 'מינון'], [['Iso', 'short', '2%', 'once'], ['', 'x', 'y', 'z']])}</td></tr>"
            + flat([("הנימוק למספר של בעלי החיים", f"n{i}"), (parts["regulatory"], "לא"), (parts["prior"], "לא"), (parts["prior_id"], "IL-9"), (parts["pain"] + " צפויה", "דרגה 4"), (parts["monitoring"], "daily look"), (parts["euthanasia"], "CO2"), (parts["fate"], "המתה"), (parts["general"], "20%"), (parts["specific"], "tumour")])
        )
    totals = f"<tr><th>{forms.TOTALS['species']}</th><th>{forms.TOTALS['n_total']}</th></tr><tr><td>עכבר</td><td>{quantity}</td></tr>"
    return (
        "<html><body><div class='sub-header'> ניסויים במחקר </div>" + body + "<div class='sub-header'>בעלי החיים הדרושים</div><div class='table horizontal'><table>" + totals + "</table></div>"
        + "<div class='sub-header'>עיבוד לאחר המתה</div><div class='table'><div>Perfusion: PBS: cold</div></div><div class='sub-header'>הצהרת החוקר הראשי</div>" + wrapped(flat([("שם החוקר", "Dana"), ("תאריך הצהרה", "1/2/2025")]))
        + "<div class='sub-header'>החלטת יו\"ר</div><div class='table'><div>החלטה: approved</div></div></body></html>"
    )


MICE = {"species": "עכבר", "strain": "B6", "sex": "זכר", "n": "16", "age": "10", "age_unit": "שבועות", "weight": "25", "weight_unit": "גרם", "source": "גידול עצמי", "supplier": "", "genetic_modification": "כן"}
PUPS = {"species": "עכבר", "strain": "A1", "sex": "נקבה", "n": "14", "age": "2", "age_unit": "חודשים", "weight": "", "weight_unit": "", "source": "מקור חיצוני", "supplier": "Farm", "genetic_modification": "לא"}


def test_nested_tables(spark):
    """Both experiments of a page, the groups of animals aggregated, drugs of nested tables, and totals filled from the experiments."""
    pages = [("a", nested_page([[MICE, PUPS], [{**MICE, "age_unit": "?", "n": "0"}]])), ("b", nested_page([[{**MICE, "n": "some"}]])), ("c", nested_page([])), ("d", nested_page([[]]))]
    got = {r.protocol_id: r for r in forms.extract(spark.createDataFrame(pages, "k string, html string"), "k").collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": "quantity is not a whole number", "c": "experiments could not be read", "d": None}
    r = got["a"]
    one, two = r.experiments
    a = one.animals
    assert (a.species, a.species_standard, a.strain, a.sex, a.n, a.genetic_status, a.source, a.supplier) == ("עכבר", "mouse", "A1, B6", "both", 30, "כן, לא", "גידול עצמי, מקור חיצוני", "Farm")
    assert (a.age.value, a.age.unit, a.weight.value, a.weight.unit) == (2.0, "months", 25.0, "g")  # 60 days are less than 70
    assert [(g.sex, g.n, g.age.unit, g.weight and g.weight.value, g.genetic_modification) for g in a.groups] == [("M", 16, "weeks", 25.0, "כן"), ("F", 14, "months", None, "לא")]
    assert two.animals.groups is None and two.animals.n == 0 and (two.animals.age.value, two.animals.age.unit) == (10.0, "?")
    assert [(e.label, e.question, e.housing.group_housed, e.housing.single_housing_duration_days, e.housing.enrichment, e.housing.enrichment_custom) for e in r.experiments] == [(f"ניסוי {i}", f"why {i}", True, 3.0, "custom", "toys") for i in (1, 2)]
    assert (one.rationale_species_strain_sex, one.procedure_timeline[0].step, one.analgesia_used, one.regulatory_requirement, one.fate) == ("best", "inject category D", True, False, "euthanasia")
    assert (one.severity_level_1_to_5, one.pain_category, one.pain_category_structured.raw, one.pain_category_structured.parsed) == (4, "D", "דרגה 4", None)
    assert [(d.phase, d.agent, d.dose, d.frequency) for d in one.analgesia] == [("unknown", "Drug", "5", "daily")]
    assert [(d.agent, d.dose, d.frequency, d.rationale, d.route, d.source_text) for d in one.anesthesia_drugs] == [("Iso", "2%", "once", "short", "", "Iso | 2% | once | short")]
    assert (one.euthanasia.primary, one.euthanasia.method_standard, one.humane_endpoints.general, one.humane_endpoints.specific, one.monitoring.parameters) == ("CO2", "CO2", ["20%"], ["tumour"], ["daily look"])
    assert (one.reuse_or_prior_procedures.has_prior, one.reuse_or_prior_procedures.prior_protocol_ids, one.oncology) == (False, ["IL-9"], None)
    (t,) = r.animals_total
    assert (t.species_standard, t.strain, t.sex, t.genetic_status, t.source, t.supplier, t.n_total) == ("mouse", "A1, B6, B6", "unknown", "כן, כן, לא", "other", "Farm", 30)
    assert r.n_justification.details == "n1 n2" and r.postmortem_processing.perfusion == "PBS: cold" and r.postmortem_processing.used
    assert (r.pi_declaration.name, r.pi_declaration.date, r.chair_statement.decision, r.chair_statement.comments) == ("Dana", "1/2/2025", "approved", None)
    assert got["d"].experiments[0].animals is None


def test_nested_tables_give_findings(spark, tmp_path):
    """The rules see the experiments of such a page: totals agree, CO2 needs its conditions; a wrong total fails."""
    from quaestor.operators import report
    from quaestor.sources import ingest

    for name, quantity in (("a", "30"), ("b", "31")):
        (tmp_path / f"{name}.html").write_text(nested_page([[MICE, PUPS]], quantity), encoding="utf-8")
    made = ingest.ingest(ingest.read_files(spark, str(tmp_path))).withColumn("protocol_id", F.regexp_extract("path", r"([ab])\.html", 1))
    failed = {}
    for r in report.findings(made, ("default",)).where("status = 'fail'").collect():
        failed.setdefault(r.protocol_id, set()).add(r.ref.split("[")[0])
    assert failed["b"] - failed["a"] == {"animals:totals-vs-exps"} and any(x.startswith("euthanasia:") for x in failed["a"])


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.createDataFrame([(1, page()), (2, page("many")), (3, "<p>nothing"), (4, None)], "page_id long, html string")
    return {r.protocol_id: r for r in forms.extract(made, "page_id").collect()}


def test_blocks(rows):
    r = rows["1"]
    assert (r.research.title_en, r.research.request_type, r.research.approval_term_years, r.research.is_continuation) == ("A Pilot & more", "pilot", 3, False)
    assert [(s.name, s.steps) for s in r.research.sites] == [("A", [forms.ALL_STEPS]), ("B", [forms.ALL_STEPS])]
    assert r.third_party.sponsor_org == "Org" and r.pi.id_type == "TZ" and r.pi.email == "last@y.z"
    assert [(t.cert_no, t.issuer) for t in r.pi.training] == [("7", "U"), ("8", "")]
    assert [(t.species_standard, t.sex, t.n_total, t.source) for t in r.animals_total] == [("mouse", "both", 12, "vendor"), ("", "M", 0, "other")]  # the sparse one takes its sex from the experiments


def test_further_blocks(rows):
    r = rows["1"]
    assert (r.header.protocol_id, r.header.institution) == ("IL-7", "Uni")
    assert [(p.family_name, p.role, p.certified, len(p.training)) for p in r.participants] == [("לוי", "performs_procedures", True, 1), ("כהן", "participant", False, 0)]
    assert (r.n_justification.method, r.n_justification.details) == ("power", "12 for 80%: yes")
    assert r.summaries["scientific_en_≤300w"] == "t q" and r.summaries["lay_he_≤150w"] == "lay words" and r.summaries["_sub_questions"]["specific_question"] == "q"
    a = r.alternatives_search
    assert (a.engines, a.queries, a.conclusion, a.alternatives_checked) == (["PubMed", "EURL"], ["a", "b"], "none", None)
    assert (a.preliminary_experiments.had_alternative_methods, a.preliminary_experiments.details) == (True, "cells")
    one, two = r.experiments
    assert (one.label, one.question, one.rationale_species_strain_sex, one.procedure_timeline[0].step, one.analgesia_used) == ("Experiment 1", "why", "best", "steps", False)
    assert (one.animals.species_standard, one.animals.sex, one.animals.n, one.animals.age.value, one.animals.age.unit, one.housing.group_housed) == ("mouse", "M", 5, 8.0, "weeks", True)
    assert two.animals is None and two.housing is None


def test_ingest_gives_findings(spark, tmp_path):
    """HTML files and JSON files become protocols, and what can't be read says so."""
    from quaestor.operators import report
    from quaestor.sources import ingest

    for name, text in (("a.html", page()), ("b.json", '{"is_colony": true}'), ("c.html", page("many")), ("d.json", "[1]"), ("e.txt", "?")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    made = ingest.ingest(ingest.read_files(spark, str(tmp_path))).withColumn("protocol_id", F.regexp_extract("path", r"([a-e])\.", 1))
    got = {r.protocol_id: r for r in made.collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": None, "c": "quantity is not a whole number", "d": "not an object", "e": "unknown format"}
    assert got["a"].pi.email == "last@y.z" and got["a"].missing_keys == [] and got["b"].is_colony and len(got["a"].experiments) == 2
    refs = {r.ref for r in report.findings(made.where("protocol_id = 'a'"), ("default",)).collect() if r.status == "fail"}
    assert "animals:totals-vs-exps" in refs and not {"header", "research", "pi"} & refs


def test_bad_and_empty_pages(rows):
    assert rows["2"].error and rows["2"].research is None and rows["2"].animals_total is None
    for k in ("3", "4"):
        assert rows[k].error is None and rows[k].research.approval_term_years == forms.DEFAULT_TERM and rows[k].animals_total == [] and rows[k].third_party is None


def test_vocabularies(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert [one(forms.fate, x) for x in ("המתה", "rehoming", "sold", "", None)] == ["euthanasia", "rehoming", "other", "", ""]


def test_aliases_are_looked_up_once(spark):
    """Texts as they stand, or with blanks and capitals, give the same; a lookup has no branch for each alias, which would
    work its text out anew."""
    from quaestor.functions.text import age_days, by_alias
    from quaestor.sources import form_parts

    names = {"a": ("x", "y z"), "b": ("x", "w")}
    rows = spark.createDataFrame([("x",), (" X ",), ("Y Z",), ("w\u00a0",), ("",), ("q",), (None,), (" M",), ("male",), (" זכר",), ("זכר",), ("Days",), ("days",), (" שבוע ",), (" q ",)], "t string")
    got = rows.select("t", by_alias(F.col("t"), names), form_parts.sex(F.col("t")), form_parts.unit(F.col("t"), form_parts.AGE_UNITS), age_days(F.struct(F.lit(2.0).alias("value"), F.col("t").alias("unit"))))
    assert [tuple(r) for r in got.collect()] == [
        ("x", "a", "x", "x", None), (" X ", "a", "X", "X", None), ("Y Z", "a", "Y Z", "Y Z", None), ("w\u00a0", "b", "w", "w", None), ("", None, "unknown", "", None), ("q", None, "q", "q", None), (None, None, "unknown", "", None),
        (" M", None, "M", "M", None), ("male", None, "male", "male", None), (" זכר", None, "M", "זכר", None), ("זכר", None, "M", "זכר", None), ("Days", None, "Days", "days", 2.0), ("days", None, "days", "days", 2.0), (" שבוע ", None, "שבוע", "weeks", None),
        (" q ", None, "q", "q", None),
    ]
    for made in (by_alias(F.col("t"), names), form_parts.unit(F.col("t"), form_parts.AGE_UNITS), form_parts.sex(F.col("t"))):
        plan = rows.select(made.alias("m"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_replace(") <= 3 and plan.count("lower(") <= 3
