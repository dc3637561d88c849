"""From the cells of a form export to the protocol's blocks: what stands under which heading and label goes where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import KEYWORDS, SPECIES_ALIASES
from ..functions.text import by_alias, contains_any, strip
from ..plans.spec import compiled
from .form_experiments import EXPERIMENT_ANIMALS, HOUSING, animals_filled, announced, experiments, method_details  # noqa: F401
from .form_parts import YES, blocks, fate, pairs_of, rows_under, sex, source, value_of  # noqa: F401
from .html import with_cells

# Headings (patterns) and labels of the form.
SECTIONS = {"research": r"^\s*המחקר\s*$", "details": "פרטי המחקר", "pi": r"^\s*החוקר הראשי\s*$", "pi_training": r"^\s*הכשרות החוקר\s*$", "totals": r"בעלי\s*ה?חיים\s*ה?דרושים"}
RESEARCH = {"title_he": "נושא המחקר בעברית", "title_en": "נושא המחקר באנגלית", "continuation_reason": "סיבה למחקר המשך", "prior_protocol_id": "ציין את מס' הבקשה הקודם"}
CONTINUATION, CONTINUED = "האם זה מחקר המשך?", "המשך"
THIRD_PARTY = "המחקר הוא מחקר שרות עבור מוסד צד ג?"
THIRD = {"sponsor_org": "שם המוסד המזמין", "ordering_investigator_name": "שם החוקר המזמין", "sponsor_approver_name": "שם המאשר במוסד המזמין", "declaration_url": "קישור לצרופת הצהרת צד ג'"}
TERM, SITES, ALL_STEPS = "תוקף האישור המבוקש (שנים)", "אתר ביצוע המחקר", "כל השלבים"
PURPOSES = {"primary_purpose": "מטרה ראשית", "secondary_purpose": "מטרה משנית"}
PI = {
    "id_number": "מספר זהוי", "last_name_he": "שם משפחה בעברית", "first_name_he": "שם פרטי בעברית", "last_name_en": "שם משפחה באנגלית", "first_name_en": "שם פרטי באנגלית", "faculty": "פקולטה",
    "department": "מחלקה", "email": "דואר אלקטרוני", "phone_primary": "טלפון נייד", "phone_secondary": "טלפון נוסף", "institutional_cert_no": "מס' הסמכה במוסד המחקר",
}
ID_TYPE, NATIONAL_ID = "סוג זהוי", "ת.ז."
TRAINING = {"cert_no": "מס' תעודה", "issuer": "מוסד נותן התעודה", "animal_scope": 'סוג בע"ח', "date": "תאריך תעודה"}
TOTALS = {"species": "בעל חיים", "species_standard": "מין מובנה", "strain": "זן/קווים", "genetic_status": "סטטוס גנטי", "sex": "זוויג", "age": "גיל", "n_total": "כמות", "source": "מקור"}
SPECIES_TOO = "מין"
HEADER = {"protocol_id": r"בקשת ניסוי מס\S*\s*:?\s*(.*)$", "institution": r"שם המוסד\s*:?\s*(.*)$"}
PARTICIPANT, TRAINED = "משתתף מס", "הכשרות"
PARTICIPANTS = {"family_name": "שם משפחה", "given_name": "שם פרטי", "national_id_or_passport": "מספר ת.ז / דרכון", "role": "קשר למחקר", "certified": "מוסמך"}
PARTICIPANT_TRAINING = {"cert_no": "מס' תעודה", "issuer": "מוסד נותן תעודה", "animal_scope": 'סוג בע"ח'}
ROLES = {"performs_procedures": "עובד עם", "PI": "חוקר ראשי"}
JUSTIFICATION, METHODS = "נימוק למספר בעלי החיים", ("power", "literature", "eda")
SCIENTIFIC, LAY = "תקציר מדעי|תקציר המחקר", "תקציר לקהל הרחב"
SUMMARY = {
    "topic": "מהו הנושא המדעי אותו אתם חוקרים", "background": "מהו הרקע הרלוונטי למחקר", "specific_question": "מהי השאלה הספציפית שתחקר בבקשה והרציונל המדעי לה",
    "proposed_animal_use": "מהו השימוש המוצע בבעלי החיים ומדוע הוא מתאים לענות על השאלה שתחקר", "expected_outcome": "מהו התוצר החזוי של מחקר זה", "animal_use_justification": "נמק את סיבת השימוש בבעלי חיים לצורך המחקר",
}
ALTERNATIVES, PRELIMINARY = "חיפוש חלופות", "ניסויים מקדימים"
ALTERNATIVE_LABELS = {"engines": "אופן חיפוש חלופות", "queries": "פרוט אופן חיפוש אחר", "conclusion": "תוצאות חיפוש החלופות", "checked": "נבדקו חלופות?"}
ALTERNATIVE_LINES = {"engines": "מנועים:", "date": "תאריך:", "queries": "שאילתות:", "conclusion": "מסקנה:"}
PRELIMINARY_LABELS = {"had_alternative_methods": "האם היו שלבים", "details": "פרוט הניסויים"}
POSTMORTEM, POSTMORTEM_LINES = "עיבוד לאחר המתה", {"perfusion": "Perfusion:", "fixation": "Fixation:", "clearing_or_special_technique": "Technique:", "chemical_safety_notes": "Safety:"}
DECLARATION, DECLARED, DECLARED_LINES = "הצהרת החוקר", {"name": "שם החוקר", "date": "תאריך הצהרה"}, {"name": "שם:", "date": "תאריך:"}
CHAIR, CHAIR_LINES = 'החלטת יו"ר', {"decision": "החלטה:", "comments": "הערות:"}
DEFAULT_TERM = 4
#: The protocol's blocks that a page gives.
BLOCKS = ("header", "research", "third_party", "pi", "participants", "animals_total", "n_justification", "summaries", "alternatives_search", "experiments", "postmortem_processing", "pi_declaration", "chair_statement")


def field(section: str, label: str, exact: bool = True) -> Column:
    """The value at a label of a section, empty if there is none; of repeated labels the last one."""
    return value_of(F.filter("pairs", lambda p: p["section"].rlike(SECTIONS.get(section, section)) & ((p["label"] == label) if exact else p["label"].contains(label))))


def paragraph(section: str) -> Column:
    """The first text of a section outside tables, empty if there is none."""
    return F.coalesce(F.get(F.filter("cells", lambda c: (c["kind"] == "text") & (c["text"] != "") & c["section"].rlike(section)), F.lit(0))["text"], F.lit(""))


def line(section: str, start: str) -> Column:
    """What follows a start of line in a section's texts, empty if there is none; of several the last one."""
    found = F.filter("cells", lambda c: (c["kind"] == "text") & c["section"].rlike(section) & c["text"].startswith(start))
    return strip(F.replace(F.coalesce(F.try_element_at(found, F.lit(-1))["text"], F.lit("")), F.lit(start), F.lit("")))


def table(section: str, labels: dict[str, str]) -> Column:
    """The rows of a section's first table as structs: the cells under the labels, empty where there is none."""
    return rows_under(F.col("cells"), lambda c: c["section"].rlike(SECTIONS[section]), labels)


def participants() -> Column:
    """Each numbered participant with the training tables under its own heading."""
    def one(b: Column) -> Column:
        person = F.get(rows_under(b["cells"], lambda c: c["section"].contains(PARTICIPANT), PARTICIPANTS), F.lit(0))
        training = rows_under(b["cells"], lambda c: c["section"].contains(TRAINED), PARTICIPANT_TRAINING)
        role = F.lit("participant")
        for name, words in reversed(ROLES.items()):
            role = F.when(person["role"].contains(words), name).otherwise(role)
        own = [person[k].alias(k) for k in ("family_name", "given_name", "national_id_or_passport")]
        return F.struct(*own, F.when(person.isNotNull(), role).alias("role"), (person["certified"] == YES).alias("certified"), F.transform(training, lambda t: F.struct(t["cert_no"], t["issuer"], t["animal_scope"], F.lit("").alias("date"))).alias("training"))

    heading = lambda c: c["kind"] == "heading"
    return F.transform(blocks(lambda c: heading(c) & c["text"].contains(PARTICIPANT), lambda c: (c["kind"] == "sub-header") | (heading(c) & ~c["text"].contains(TRAINED))), one)


def justification() -> Column:
    """Method and details: the method is what stands before a colon, if it is one of METHODS."""
    said = paragraph(JUSTIFICATION)
    known = F.lower(F.regexp_extract(said, "^([^:]*):", 1)).isin(*METHODS)
    method, details = F.when(known, F.lower(F.regexp_extract(said, "^([^:]*):", 1))).otherwise("literature"), F.when(known, strip(F.regexp_extract(said, r"(?s)^[^:]*:(.*)$", 1))).otherwise(said)
    return F.struct(method.alias("method"), details.alias("details"), F.array().cast("array<string>").alias("attachments"))


def summaries() -> Column:
    """The scientific summary is a text, or the answers to its questions one after another; the lay one is a text."""
    answers = {k: field(SCIENTIFIC, label) for k, label in SUMMARY.items()}
    asked = F.exists("pairs", lambda p: p["section"].rlike(SCIENTIFIC))
    whole = F.array_join(F.filter(F.array(*answers.values()), lambda x: x != ""), " ")
    questions = F.create_map(*[x for k, v in answers.items() for x in (F.lit(k), v)])
    return F.struct(F.when(asked, whole).otherwise(paragraph(SCIENTIFIC)).alias("scientific_en_≤300w"), paragraph(LAY).alias("lay_he_≤150w"), F.when(asked, questions).alias("_sub_questions"))


def alternatives() -> Column:
    """The search for alternatives in both dialects: a table of labels, or lines that begin with a word."""
    labelled = {k: field(ALTERNATIVES, label) for k, label in ALTERNATIVE_LABELS.items()}

    said = {k: line(ALTERNATIVES, start) for k, start in ALTERNATIVE_LINES.items()}
    parts = lambda value, mark: F.when(value == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(value, mark), lambda x: strip(x)))
    engines = F.when(said["engines"] != "", parts(said["engines"], ",")).otherwise(F.filter(parts(labelled["engines"], ","), lambda x: x != ""))
    queries = F.when(said["queries"] != "", parts(said["queries"], ";")).otherwise(F.filter(F.array(labelled["queries"]), lambda x: x != ""))
    before = {k: field(PRELIMINARY, label, False) for k, label in PRELIMINARY_LABELS.items()}
    asked = F.exists("pairs", lambda p: p["section"].rlike(PRELIMINARY) & (p["label"].contains(PRELIMINARY_LABELS["had_alternative_methods"]) | p["label"].contains(PRELIMINARY_LABELS["details"])))
    return F.struct(
        engines.alias("engines"), said["date"].alias("date"), queries.alias("queries"), F.when(said["conclusion"] != "", said["conclusion"]).otherwise(labelled["conclusion"]).alias("conclusion"),
        F.when(labelled["checked"] != "", labelled["checked"] == YES).alias("alternatives_checked"), F.when(asked, F.struct((before["had_alternative_methods"] == YES).alias("had_alternative_methods"), before["details"].alias("details"))).alias("preliminary_experiments"),
    )


def closing() -> dict[str, Column]:
    """Processing after death, the investigator's declaration and the chair's statement; null values for what is not said."""
    def filled(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    worked = F.exists("cells", lambda c: (c["kind"] == "sub-header") & c["text"].contains(POSTMORTEM))
    declared = {k: F.coalesce(filled(field(DECLARATION, DECLARED[k])), filled(line(DECLARATION, DECLARED_LINES[k]))) for k in DECLARED}
    return {
        "postmortem_processing": F.struct(F.coalesce(worked, F.lit(False)).alias("used"), *[filled(line(POSTMORTEM, start)).alias(k) for k, start in POSTMORTEM_LINES.items()]),
        "pi_declaration": F.struct(*[v.alias(k) for k, v in declared.items()], F.array().cast("array<string>").alias("affirmations")),
        "chair_statement": F.struct(*[filled(line(CHAIR, start)).alias(k) for k, start in CHAIR_LINES.items()]),
    }


def extract(pages: DataFrame, key: str, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(protocol_id, kept columns, BLOCKS, error) of form exports. A quantity that is no whole number rejects the page, and so do
    headings of experiments under which there is none to read: its blocks are null and `error` says so. What totals and the
    justification of numbers leave out is taken from the experiments."""
    rows = with_cells(pages.select(F.col(key).cast("string").alias("protocol_id"), F.col(html).alias("html"), *keep)).withColumn("pairs", pairs_of(F.col("cells")))
    titles = F.lower(F.concat_ws(" ", field("research", RESEARCH["title_he"]), field("research", RESEARCH["title_en"])))
    sites = F.filter(F.transform(F.split(field("research", SITES), ","), lambda x: F.trim(x)), lambda x: x != "")
    research = F.struct(
        *[field("research", label).alias(name) for name, label in RESEARCH.items()],
        F.when(contains_any(titles, KEYWORDS["pilot"]), "pilot").otherwise("regular").alias("request_type"), (field("research", CONTINUATION) == CONTINUED).alias("is_continuation"), (field("research", THIRD_PARTY) == YES).alias("third_party_service"),
        F.coalesce(F.try_to_number(F.regexp_extract(field("research", TERM), r"(\d+)", 1), F.lit("999")).cast("int"), F.lit(DEFAULT_TERM)).alias("approval_term_years"),
        F.transform(sites, lambda x: F.struct(x.alias("name"), F.array(F.lit(ALL_STEPS)).alias("steps"))).alias("sites"), *[field("details", label, False).alias(name) for name, label in PURPOSES.items()],
    )
    third = F.when(field("research", THIRD_PARTY) == YES, F.struct(*[field("research", label).alias(name) for name, label in THIRD.items()]))
    pi = F.struct(F.when(field("pi", ID_TYPE).contains(NATIONAL_ID), "TZ").otherwise("passport").alias("id_type"), *[field("pi", label).alias(name) for name, label in PI.items()], table("pi_training", TRAINING).alias("training"))
    raw = table("totals", TOTALS | {"species_too": SPECIES_TOO})

    def total(t: Column) -> Column:
        species = F.when(t["species"] == "", t["species_too"]).otherwise(t["species"])
        standard = F.when(t["species_standard"] == "", F.coalesce(by_alias(species, SPECIES_ALIASES), F.lit(""))).otherwise(t["species_standard"])
        n = F.when(t["n_total"] == "", F.lit(0))
        return F.struct(
            species.alias("species"), standard.alias("species_standard"), t["strain"].alias("strain"), sex(t["sex"]).alias("sex"), t["genetic_status"].alias("genetic_status"), source(t["source"]).alias("source"), t["age"].alias("age"),
            F.coalesce(n, F.when(t["n_total"].rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(t["n_total"]).cast("int"))).alias("n_total"),
        )

    head = lambda name: F.coalesce(F.array_max(F.filter(F.transform(F.filter("cells", lambda c: c["kind"] == "text"), lambda c: strip(F.regexp_extract(c["text"], HEADER[name], 1))), lambda x: x != "")), F.lit(""))
    header = F.struct(head("protocol_id").alias("protocol_id"), head("institution").alias("institution"), F.lit("").alias("subcommittee"), F.lit("2.0.0").alias("export_version"))
    made = rows.select(
        "protocol_id", *keep, header.alias("header"), research.alias("research"), third.alias("third_party"), pi.alias("pi"), participants().alias("participants"), F.transform(raw, total).alias("animals_total"),
        justification().alias("n_justification"), summaries().alias("summaries"), alternatives().alias("alternatives_search"), compiled(pages.sparkSession, "form experiments", experiments).alias("experiments"),
        *[v.alias(k) for k, v in closing().items()], announced().alias("announced"),
    )
    bad = F.coalesce(F.exists("animals_total", lambda t: t["n_total"].isNull()), F.lit(False)) | F.coalesce(F.exists("experiments", lambda e: e["animals"].isNotNull() & e["animals"]["n"].isNull()), F.lit(False))
    unread = F.col("announced") & (F.size("experiments") == 0)
    made = made.withColumn("error", F.when(bad, "quantity is not a whole number").when(unread, "experiments could not be read"))
    made = made.withColumns({"animals_total": animals_filled(F.col("animals_total"), F.col("experiments")), "n_justification": method_details(F.col("n_justification"), F.col("experiments"))})
    return made.select("protocol_id", *keep, *[F.when(F.col("error").isNull(), F.col(b)).alias(b) for b in BLOCKS], "error")
