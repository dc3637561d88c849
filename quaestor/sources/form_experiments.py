"""The experiments of a form export, in both dialects: numbered headings with tables under them, or tables that nest others."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import SPECIES_ALIASES
from ..functions.text import age_days, by_alias, flattened, method_key, strip, text
from ..plans.spec import let
from ..schema import protocol_type
from .form_parts import AGE_UNITS, WEIGHT_UNITS, YES, blocks, decimal, enrichment, fate, pairs_of, rows_under, sex, source, unit, value_of, whole_number

# Headings (patterns) and labels of the form.
EXPERIMENT, NUMBER = r"ניסוי \d+", r"(\d+.*)$"
IN_RESEARCH, NESTED_EXPERIMENT = "ניסויים במחקר", r"^ניסוי(\s|$)"
EXPERIMENT_ANIMALS = {"species": "מין", "species_standard": "מין מובנה", "strain": "זן/קווים", "genetic_status": "סטטוס גנטי", "sex": "זוויג", "n": "כמות", "age": "גיל", "source": "מקור"}
ANIMALS = "חיות בניסוי"
GROUP = {
    "species": "בעל חיים", "strain": "זן", "sex": "מין", "n": "כמות", "age": "גיל", "age_unit": "תקופת גיל", "weight": "משקל", "weight_unit": "מידת משקל", "genetic_modification": "עבר שינוי גנטי",
    "source": 'מקור בע"ח', "supplier": "מקור אחר",
}
HOUSING = {"group_housed": "שיכון", "single_housing_reason": "סיבת שיכון בודד", "single_housing_duration_days": "משך שיכון בודד (ימים)", "enrichment": "העשרה"}
IN_GROUPS = "קבוצתי"
NESTED_HOUSING = {"group_housed": 'אופן החזקת בע"ח', "single_housing_duration_days": "משך זמן החזקת חיה בודדת (במידה ונדרש)", "enrichment": 'מהי ההעשרה שתינתן לבעה"ח, ובמידה וחורגת מהמקובל, נא לנמק'}
NESTED_IN_GROUPS = "קבוצה"
DESCRIPTION = {
    "question": "שאלת המחקר|שאלה הספציפית", "rationale": "^הנימוק לבחירת סוג, זן ומין בעל החיים$", "timeline": "תיאור מהלך הניסוי", "analgesia_used": "האם נעשה שימוש במשככי כאבים", "omission": "סיבה לאי שימוש במשככי כאבים",
    "anesthesia_used": "האם נעשה שימוש בחומרי הרדמה", "n_justification": "הנימוק למספר.*בעלי", "regulatory": "צורך רגולטורי", "prior": "נערך כבר ניסוי", "prior_id": "מס' הניסוי הקודם", "pain": "דרגת כאב",
    "monitoring": "פירוט המעקב", "euthanasia": "שיטת המתה", "fate": "גורל בע''ח", "general": "תנאים כלליים להפסקת", "specific": "תנאים ספציפיים",
}
ANALGESIA, ANALGESICS = "משככי כאבים", {"agent": ("שם החומר", "Agent"), "dose": ("מינון", "Dose"), "route": ("מסלול", "דרך מתן", "Route"), "frequency": ("משטר", "תדירות", "Frequency")}
ANESTHESIA, ANESTHETICS = "חומרי הרדמה", {"agent": ("שם החומר", "Agent"), "dose": ("משטר", "Dose"), "frequency": ("מינון", "Frequency"), "rationale": ("נימוק", "Rationale")}
STRUCTURED, DRUGS = "Structured Anesthesia Drugs", {
    "agent": ("Agent", "agent", "שם החומר"), "dose": ("Dose", "dose", "מינון"), "route": ("Route", "route", "מסלול", "דרך מתן"), "frequency": ("Frequency", "frequency", "תדירות"),
    "rationale": ("Rationale", "rationale", "נימוק"), "induction": ("Induction", "induction"), "maintenance": ("Maintenance", "maintenance"), "monitoring": ("Monitoring", "monitoring"),
}
TIMELINE = {"day_or_timepoint": "זמן/יום", "step": "שלב", "route_or_site": "מסלול/איבר", "volume_or_dose": "נפח/מינון", "device_or_material": "מכשור/חומר"}
SEVERITY = {"pain": "דרגת כאב וסבל", "category": "קטגוריית כאב", "category_en": "Pain category", "parameters": "פרמטרים", "initial": "ניטור 72ש ראשונות", "weekly": "ניטור שבועי"}
EUTHANASIA = {"primary": "ראשית", "standard": "שיטה מובנית", "standard_en": "Method standard", "parameters": "פרמטרים", "conditions": "תנאים", "conditions_en": "Conditions", "confirmation": "אישור מוות"}
KILLING, QUESTION = "שיטת המתה", "שאלת המחקר"
AFTERWARDS = "מצב אחרי הניסוי"
SPECIALTIES = {
    "stereotaxic_implant": "Stereotaxic / Implant", "oncology": "Oncology", "diabetes": "Diabetes", "biosafety_infectious_agents": "Biosafety & Infectious Agents", "nanomaterials": "Nanomaterials", "ocular_procedures": "Ocular Procedures",
    "housing_density": "Housing Density", "restraint": "Restraint", "reuse_review": "Reuse Review", "field_study_permits": "Field Study Permits",
}
#: A USDA category as a text names it.
CATEGORY = (r"(?i)(?:pain\s*category|category|usda|קטגוריה(?:\s+של\s+כאב)?)[^A-Za-z0-9]{0,10}([BCDE])\b", r"(?i)^\s*([BCDE])\s*$")


@cache
def _type() -> T.StructType:
    return protocol_type()["experiments"].dataType.elementType


def stated_category(said: Column) -> Column:
    """The pain category (B to E) that a text states, empty if none."""
    found = [F.upper(F.regexp_extract(text(said), p, 1)) for p in CATEGORY]
    return F.when(found[0] != "", found[0]).otherwise(found[1])


def _filled(value: Column) -> Column:
    return F.nullif(text(value), F.lit(""))


def _set(groups: Column, name: str) -> Column:
    """The non-empty values of the groups, each once, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(groups, lambda g: g[name]), lambda x: x != ""))), ", ")


def aggregated(groups: Column) -> Column:
    """The animals of an experiment from its groups (the columns of GROUP as texts): joined sets, the sum, the least age that a
    unit makes comparable (the last group's if none), the last weight that is given, and the groups, if there are several."""

    def quantity(value: Column, of: Column) -> Column:
        return F.struct(value.alias("value"), of.alias("unit"))

    one = lambda g: F.struct(
        g["species"], g["strain"], sex(g["sex"]).alias("sex"), whole_number(g["n"]).alias("n"), quantity(decimal(g["age"]), unit(g["age_unit"], AGE_UNITS)).alias("age"),
        F.when(g["weight"] != "", quantity(decimal(g["weight"]), unit(g["weight_unit"], WEIGHT_UNITS))).alias("weight"), g["genetic_modification"], g["source"], g["supplier"],
    )

    def made(groups: Column, own: Column, species: Column) -> Column:
        aged = F.filter(F.transform(own, lambda g, i: F.struct(age_days(g["age"]).alias("days"), i.alias("i"), g["age"].alias("age"))), lambda a: a["days"].isNotNull())
        weighed = F.try_element_at(F.filter(own, lambda g: g["weight"].isNotNull()), F.lit(-1))["weight"]
        return F.struct(
            species.alias("species"), F.coalesce(by_alias(species, SPECIES_ALIASES), F.lit("")).alias("species_standard"), _set(groups, "strain").alias("strain"), _set(groups, "genetic_modification").alias("genetic_status"),
            sex(_set(groups, "sex")).alias("sex"), F.aggregate(own, F.lit(0), lambda n, g: n + g["n"]).alias("n"), F.coalesce(F.array_min(aged)["age"], F.try_element_at(own, F.lit(-1))["age"]).alias("age"),
            F.when(weighed["value"] != 0, weighed).alias("weight"), _set(groups, "source").alias("source"), _set(groups, "supplier").alias("supplier"), F.when(F.size(own) > 1, own).alias("groups"),
        )

    return F.when(F.size(groups) > 0, let(F.transform(groups, one), lambda own: let(_set(groups, "species"), lambda species: made(groups, own, species))))


def _nested(block: Column, pairs: Column) -> Column:
    """The animals of a table that nests one table for each group, below the label of the animals."""
    at = F.try_element_at(F.filter(block["cells"], lambda c: (c["tbl"] == block["tbl"]) & c["text"].contains(ANIMALS)), F.lit(1))

    def group(tbl: Column, own: Column) -> Column:
        said = lambda label: value_of(F.filter(own, lambda p: (p["tbl"] == tbl) & (p["label"] == label)))
        return F.struct(*[said(label).alias(name) for name, label in GROUP.items()])

    def made(cell: Column) -> Column:
        tables = F.array_sort(F.array_distinct(F.transform(F.filter(block["cells"], lambda c: (c["up"] == cell["tbl"]) & (c["up_row"] == cell["row"]) & (c["up_col"] == cell["col"] + 1)), lambda c: c["tbl"])))
        return let(F.transform(tables, lambda t: group(t, pairs)), aggregated)

    return let(at, made)


def _listed(a: Column) -> Column:
    """The animals of a table with a header row."""
    age = F.regexp_extract(a["age"], r"(?i)^(\d+(?:\.\d+)?)\s*(?:weeks|days|months)", 1)
    standard = F.when(a["species_standard"] == "", F.coalesce(by_alias(a["species"], SPECIES_ALIASES), F.lit(""))).otherwise(a["species_standard"])
    none = {f.name: F.lit(None).cast(f.dataType) for f in _type()["animals"].dataType.fields if f.name in ("weight", "supplier", "groups")}
    return F.when(a.isNotNull(), F.struct(
        a["species"], standard.alias("species_standard"), a["strain"], a["genetic_status"], sex(a["sex"]).alias("sex"), whole_number(a["n"]).alias("n"),
        F.struct(F.coalesce(F.nullif(age, F.lit("")).cast("double"), F.lit(0.0)).alias("value"), F.lower(F.regexp_extract(a["age"], r"(?i)^\d+(?:\.\d+)?\s*(weeks|days|months)", 1)).alias("unit")).alias("age"),
        none["weight"].alias("weight"), a["source"], none["supplier"].alias("supplier"), none["groups"].alias("groups"),
    ))


def _first_of(names: dict[str, tuple[str, ...]]) -> tuple[dict[str, str], Callable[[Column, str], Column]]:
    """(labels by a name each, what reads the first of a name's labels that is filled)."""
    labels = {f"{k}_{i}": label for k, all_ in names.items() for i, label in enumerate(all_)}
    return labels, lambda row, k: F.coalesce(*[_filled(row[f"{k}_{i}"]) for i in range(len(names[k]))], F.lit(""))


def _drugs(cells: Column, inside: Callable[[Column], Column], names: dict[str, tuple[str, ...]], needed: tuple[str, ...], extra: dict[str, Column]) -> Column:
    """The rows of a drug table in which all that is needed is filled, with all their texts as one; null if there are none."""
    labels, said = _first_of(names)
    row = lambda r: F.struct(*[said(r, k).alias(k) for k in names], *[v.alias(k) for k, v in extra.items()], F.array_join(F.filter(F.array(*[r[k] for k in labels]), lambda x: x != ""), " | ").alias("source_text"))
    found = F.transform(rows_under(cells, inside, labels), row)
    for k in needed:
        found = F.filter(found, lambda d: d[k] != "")  # noqa: B023
    return F.when(F.size(found) > 0, found)


def _as(value: Column, field: str, names: tuple[str, ...] = ()) -> Column:
    """A struct, or an array of structs, with the fields of the experiment's type, missing ones null."""
    kind = _type()[field].dataType
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: F.struct(*[(x[f.name] if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]))
    return F.when(value.isNotNull(), F.struct(*[(value[f.name] if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]))


def _specialty(cells: Column, field: str, title: str) -> Column:
    """A block of lines `key: value` under its title; values of other kinds than their field's are null."""
    lines = F.filter(cells, lambda c: (c["kind"] == "text") & c["section"].contains(title) & c["text"].contains(":"))
    entries = F.transform(lines, lambda c: F.struct(strip(F.regexp_extract(c["text"], "^([^:]*):", 1)).alias("key"), strip(F.regexp_extract(c["text"], "^[^:]*:(.*)$", 1)).alias("value")))
    said = lambda own, name: F.try_element_at(F.filter(own, lambda e: e["key"] == name), F.lit(-1))["value"]
    fields = _type()[field].dataType.fields
    return let(entries, lambda own: F.when(F.size(own) > 0, F.struct(*[said(own, f.name).try_cast(f.dataType).alias(f.name) for f in fields])))


def _experiment(b: Column, label: Column) -> Column:
    cells = b["cells"]
    # Of the block's tables with a header row: the one with such a column.
    headed = lambda column: F.array_min(F.transform(F.filter(cells, lambda c: (c["row"] == 0) & (c["text"] == column)), lambda c: c["tbl"]))
    table = lambda column, labels: rows_under(cells, lambda c: c["tbl"] == headed(column), labels)
    first = lambda column, labels: F.get(table(column, labels), F.lit(0))
    # A table in the cell beside a label.
    below = lambda name: lambda c: c["up"].isNotNull() & F.exists(cells, lambda l: (l["text"] == name) & (l["tbl"] >= 0) & (l["tbl"] == c["up"]) & (l["row"] == c["up_row"]) & (l["col"] + 1 == c["up_col"]))

    def read(pairs: Column) -> Column:
        """What stands in the block, each worked out once."""
        main = F.filter(pairs, lambda p: p["tbl"] == b["tbl"])
        others = F.filter(pairs, lambda p: (p["tbl"] != b["tbl"]) & (p["up"] < 0))

        def told(others: Column) -> list[Column]:
            at = {"question": 1, "timeline": 1, "n_justification": 1, "regulatory": 1}
            return [F.try_element_at(F.filter(others, lambda p: p["label"].rlike(label)), F.lit(at.get(name, -1)))["value"].alias(name) for name, label in DESCRIPTION.items()]  # noqa: B023

        def kept(main: Column) -> list[Column]:
            said = [F.try_element_at(F.filter(main, lambda p: p["label"] == label), F.lit(-1))["value"].alias(name) for name, label in NESTED_HOUSING.items()]  # noqa: B023
            return [*said, F.try_element_at(F.filter(main, lambda p: p["label"].contains(QUESTION)), F.lit(1))["value"].alias("question")]

        left = F.try_element_at(F.filter(cells, lambda c: (c["kind"] == "text") & c["section"].contains(AFTERWARDS) & (c["text"] != "")), F.lit(1))["text"]
        return F.struct(
            let(others, lambda o: F.struct(*told(o))).alias("own"), let(main, lambda m: F.struct(*kept(m))).alias("main"), _nested(b, pairs).alias("animals"), left.alias("left"),
            let(first(EXPERIMENT_ANIMALS["species"], EXPERIMENT_ANIMALS), _listed).alias("listed_animals"), first(HOUSING["group_housed"], HOUSING).alias("housed"), table(TIMELINE["day_or_timepoint"], TIMELINE).alias("steps"),
            first(SEVERITY["pain"], SEVERITY).alias("severe"), F.get(rows_under(cells, lambda c: c["section"].contains(KILLING) & F.exists(cells, lambda h: (h["tbl"] == c["tbl"]) & (h["row"] == 0) & h["text"].isin(*EUTHANASIA.values())), EUTHANASIA), F.lit(0)).alias("killed"),
            _drugs(cells, below(ANALGESIA), ANALGESICS, (), {"phase": F.lit("unknown")}).alias("relief"), _drugs(cells, lambda c: c["section"].contains(STRUCTURED), DRUGS, ("agent", "dose", "route", "frequency"), {}).alias("structured"),
            _drugs(cells, below(ANESTHESIA), ANESTHETICS, ("agent",), {"route": F.lit("")}).alias("numbing"), *[_specialty(cells, name, title).alias(name) for name, title in SPECIALTIES.items()],
        )

    def housing(in_groups: Column, reason: Column, days: Column, richer: Column) -> Column:
        kind, custom = enrichment(richer)
        return F.struct(in_groups.alias("group_housed"), reason.alias("single_housing_reason"), decimal(days).alias("single_housing_duration_days"), kind.alias("enrichment"), custom.alias("enrichment_custom"))

    def made(v: Column) -> Column:
        own, main, housed, severe, killed = (v[k] for k in ("own", "main", "housed", "severe", "killed"))
        nested_housing = F.when(main["group_housed"].isNotNull(), housing(main["group_housed"] == NESTED_IN_GROUPS, F.lit(""), main["single_housing_duration_days"], main["enrichment"]))
        listed_housing = F.when(housed.isNotNull(), housing(housed["group_housed"] == IN_GROUPS, housed["single_housing_reason"], housed["single_housing_duration_days"], housed["enrichment"]))
        described = F.when(own["timeline"].isNotNull(), F.array(F.struct(F.lit("All").alias("day_or_timepoint"), own["timeline"].alias("step"))))
        timeline = F.when(F.size(v["steps"]) > 0, _as(v["steps"], "procedure_timeline", tuple(TIMELINE))).otherwise(_as(described, "procedure_timeline", ("day_or_timepoint", "step")))
        asked = F.coalesce(own["question"], main["question"])
        listed = own["pain"].isNull()
        pain = F.coalesce(own["pain"], severe["pain"])
        category = F.coalesce(*[F.when(listed, _filled(severe[k])) for k in ("category", "category_en")], _filled(stated_category(F.when(listed, flattened(*[severe[k] for k in SEVERITY])).otherwise(pain))))
        told = F.array_join(F.flatten(F.transform(timeline, lambda t: F.array(*[F.coalesce(t[k], F.lit("")) for k in TIMELINE]))), " ")
        nothing = F.lit(None)
        watched = F.when(listed & severe.isNotNull(), F.struct(
            F.when(severe["initial"] != "", severe["initial"] == YES).alias("initial_72h_daily"), F.when(severe["weekly"] != "", severe["weekly"].try_cast("int")).alias("ongoing_per_week"),
            F.filter(F.transform(F.split(severe["parameters"], ","), lambda x: strip(x)), lambda x: x != "").alias("parameters"), F.lit("").alias("documentation"),
        )).when(own["monitoring"].isNotNull(), F.struct(nothing.cast("boolean").alias("initial_72h_daily"), nothing.cast("int").alias("ongoing_per_week"), F.array(own["monitoring"]).alias("parameters"), F.lit("").alias("documentation")))
        ends = F.when(own["general"].isNotNull() | own["specific"].isNotNull(), F.struct(*[F.when(own[k].isNotNull(), F.array(own[k])).alias(k) for k in ("general", "specific")]))
        primary = F.when(killed.isNotNull(), killed["primary"]).otherwise(own["euthanasia"])
        conditions = F.coalesce(_filled(killed["conditions"]), _filled(killed["conditions_en"]), killed["parameters"], F.lit(""))
        method = F.coalesce(_filled(killed["standard"]), _filled(killed["standard_en"]), _filled(method_key(F.lit(""), primary)))
        death = F.when(primary.isNotNull(), F.struct(primary.alias("primary"), method.alias("method_standard"), F.coalesce(killed["parameters"], F.lit("")).alias("parameters"), conditions.alias("conditions_text"), F.coalesce(killed["confirmation"], F.lit("")).alias("confirmation")))
        earlier = _filled(own["prior_id"])
        before = F.when(own["prior"].isNotNull() | earlier.isNotNull(), F.struct(
            F.coalesce(own["prior"] == YES, F.lit(True)).alias("has_prior"), F.when(earlier.isNotNull(), F.array(earlier)).otherwise(F.array().cast("array<string>")).alias("prior_protocol_ids"),
        ))
        values = {
            "label": label, "question": asked, "animals": F.coalesce(v["animals"], v["listed_animals"]), "housing": F.coalesce(nested_housing, listed_housing), "rationale_species_strain_sex": own["rationale"],
            "procedure_timeline": timeline, "analgesia_used": own["analgesia_used"] == YES, "analgesia_justification_for_omission": own["omission"], "anesthesia_used": own["anesthesia_used"] == YES,
            "analgesia": _as(v["relief"], "analgesia", ("phase", *ANALGESICS)), "n_justification_detail": own["n_justification"], "regulatory_requirement": own["regulatory"] == YES, "reuse_or_prior_procedures": before,
            "anesthesia_drugs": F.coalesce(_as(v["structured"], "anesthesia_drugs", (*DRUGS, "source_text")), _as(v["numbing"], "anesthesia_drugs", (*ANESTHETICS, "route", "source_text"))),
            "severity_level_1_to_5": F.when(pain.isNotNull(), F.coalesce(_filled(F.regexp_extract(pain, r"(\d)", 1)).cast("int"), F.lit(1))),
            "pain_category": F.coalesce(category, _filled(stated_category(flattened(label, asked, told)))),
            "pain_category_structured": F.when(pain.isNotNull(), F.struct(pain.alias("raw"), _filled(stated_category(pain)).alias("parsed"))),
            "monitoring": watched, "humane_endpoints": ends, "euthanasia": _as(death, "euthanasia", ("primary", "method_standard", "parameters", "conditions_text", "confirmation")), "fate": F.coalesce(_filled(fate(v["left"])), _filled(fate(own["fate"]))),
            **{name: v[name] for name in SPECIALTIES},
        }
        return F.struct(*[x.alias(k) for k, x in values.items()])

    return let(let(pairs_of(cells), read), made)


def experiments() -> Column:
    """All experiments, by the first dialect if the page has any of it. What is not stated is null, never a default."""
    sub = lambda c: c["kind"] == "sub-header"
    labelled = lambda found, label: F.transform(found, lambda b: b.withField("label", label(b["head"])))
    numbered = labelled(blocks(lambda c: sub(c) & c["text"].rlike(EXPERIMENT), sub), lambda head: F.concat(F.lit("Experiment "), strip(F.regexp_extract(head, NUMBER, 1))))
    opens = lambda c: (c["kind"] == "td") & (c["row"] == 0) & (c["col"] == 0) & (c["up"] < 0) & c["text"].rlike(NESTED_EXPERIMENT)
    nested = F.when(F.exists("cells", lambda c: sub(c) & c["text"].contains(IN_RESEARCH)), labelled(blocks(opens, sub), lambda head: head))
    found = let(numbered, lambda own: F.when(F.size(own) > 0, own).otherwise(F.coalesce(nested, own)))
    return F.transform(found, lambda b: _experiment(b, b["label"]))


def announced() -> Column:
    """Whether the page has a heading of experiments."""
    return F.coalesce(F.exists("cells", lambda c: (c["kind"] == "sub-header") & (c["text"].rlike(EXPERIMENT) | c["text"].contains(IN_RESEARCH))), F.lit(False))


def animals_filled(totals: Column, found: Column) -> Column:
    """Totals that name neither strain, genetic status nor sex take these, source and supplier from the experiments: the sorted
    set of what these say, of sexes only a single one."""
    said = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda e: F.coalesce(e["animals"][name], F.lit(""))), lambda x: x != "")))
    joined = lambda name: F.array_join(said(name), ", ")

    def total(t: Column) -> Column:
        sparse = (t["strain"] == "") & (t["genetic_status"] == "") & t["sex"].isin("", "unknown")
        new = {"strain": joined("strain"), "genetic_status": joined("genetic_status"), "sex": F.when(F.size(said("sex")) == 1, F.get(said("sex"), F.lit(0))).otherwise(t["sex"]), "supplier": joined("supplier")}
        new["source"] = F.when((text(t["source"]) == "") & (joined("source") != ""), source(joined("source"))).otherwise(t["source"])
        return F.struct(*[(F.when(sparse, new[k]).otherwise(t[k]) if k in new and k != "supplier" else F.when(sparse, new[k]).otherwise("") if k == "supplier" else t[k]).alias(k) for k in ("species", "species_standard", "strain", "sex", "genetic_status", "source", "supplier", "age", "n_total")])

    return F.transform(totals, total)


def method_details(justified: Column, found: Column) -> Column:
    """A justification of numbers without details takes those of the experiments."""
    said = F.array_join(F.filter(F.transform(found, lambda e: F.coalesce(e["n_justification_detail"], F.lit(""))), lambda x: x != ""), " ")
    return F.struct(justified["method"], F.when(justified["details"] == "", said).otherwise(justified["details"]).alias("details"), justified["attachments"])
