"""What the parts of a form export share: pairs, tables and runs of cells, and the form's vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import by_alias, strip, text
from ..plans.spec import let

# The form's words for a value.
YES = "כן"
SEXES = {"M": ("זכר",), "F": ("נקבה",), "both": ("זכר, נקבה", "נקבה, זכר"), "unknown": ("לא חשוב", "")}
SOURCES = {"vendor": ("מקור חיצוני",), "in-house": ("גידול עצמי",), "other": ("אחר",)}
FATES = {"euthanasia": ("המתה", "euthanized"), "return_to_colony": ("החזרה לגידול",), "rehoming": ("אימוץ",)}
AGE_UNITS = {"days": ("יום", "ימים"), "weeks": ("שבוע", "שבועות"), "months": ("חודש", "חודשים"), "years": ("שנה", "שנים")}
WEIGHT_UNITS = {"g": ("גרם", "ג"), "kg": ('ק"ג', "קג", "קילוגרם")}
USUAL = ("", "standard", "אין", "לא", "רגיל", "רגילה", "סטנדרטי", "סטנדרטית")


def canonical(raw: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """The canonical value of a raw one; canonical and unknown values stay as they are."""
    return F.coalesce(by_alias(text(raw), vocabulary), strip(text(raw)))


def sex(raw: Column) -> Column:
    return let(text(raw), lambda x: F.when(x.isin(*SEXES), x).otherwise(F.coalesce(by_alias(x, SEXES), strip(x))))


def source(raw: Column) -> Column:
    """Mixed sources have no value of their own: they are `other`."""
    return F.when(text(raw).contains(","), "other").otherwise(canonical(raw, SOURCES))


def fate(raw: Column) -> Column:
    known = strip(text(raw))
    return F.when((known == "") | known.isin(*FATES), known).otherwise(F.coalesce(by_alias(known, FATES), F.lit("other")))


def pairs_of(cells: Column) -> Column:
    """Labels and values with their section and place: of a row's cells, the first and second, the third and fourth, and so on. A
    value's nested tables stand between it and the next label."""
    found = F.filter(cells, lambda c: (c["tbl"] >= 0) & (c["label"] != ""))
    return F.transform(found, lambda c: F.struct(c["section"], c["label"], c["text"].alias("value"), *[c[x] for x in ("tbl", "row", "col", "up")]))


def value_of(found: Column) -> Column:
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))


def unit(raw: Column, units: dict[str, tuple[str, ...]]) -> Column:
    """The canonical unit, lower-cased if it is one already; unknown ones stay as they are."""
    slow = lambda known: F.coalesce(F.when(F.lower(known).isin(*units), F.lower(known)), known)
    return let(text(raw), lambda x: F.coalesce(by_alias(x, units), F.when(x.isin(*units), x), let(strip(x), slow)))


def enrichment(raw: Column) -> tuple[Column, Column]:
    """(standard or custom, the custom enrichment's text)."""
    known = strip(text(raw))
    usual = F.lower(known).isin(*USUAL)
    return F.when(usual, "standard").otherwise("custom"), F.when(~usual & (F.lower(known) != "custom"), known)


def whole_number(raw: Column) -> Column:
    """An empty text is 0; what is no whole number is null, for the page to be rejected."""
    return F.when(text(raw) == "", F.lit(0)).when(raw.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(raw).cast("int"))


def decimal(raw: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.trim(text(raw)), F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(0.0))


def rows_under(cells: Column, inside: Callable[[Column], Column], labels: dict[str, str]) -> Column:
    """The rows of the first table whose cells pass `inside`, as structs: the cells under the labels, empty where there is none."""
    own = F.filter(cells, lambda c: inside(c) & c["kind"].isin("td", "th"))
    first = lambda own: F.filter(own, lambda c: c["tbl"] == F.array_min(F.transform(own, lambda x: x["tbl"])))

    def rows(mine: Column) -> Column:
        numbers = F.array_sort(F.array_distinct(F.transform(F.filter(mine, lambda c: c["row"] > 0), lambda c: c["row"])))

        def cell(row: Column, label: str) -> Column:
            col = F.try_element_at(F.filter(mine, lambda c: (c["row"] == 0) & (c["text"] == label)), F.lit(-1))["col"]
            return F.coalesce(F.try_element_at(F.filter(mine, lambda c: (c["row"] == row) & (c["col"] == col)), F.lit(1))["text"], F.lit(""))

        return F.transform(numbers, lambda r: F.struct(*[cell(r, label).alias(name) for name, label in labels.items()]))

    return let(own, lambda o: let(first(o), rows))


def blocks(opens: Callable[[Column], Column], closes: Callable[[Column], Column]) -> Column:
    """Runs of cells: each from one that `opens` to the next that opens or closes; (head, tbl, cells)."""
    marks = F.filter(F.transform("cells", lambda c, i: F.when(opens(c) | closes(c), F.struct(i.alias("i"), opens(c).alias("opens"), c["text"].alias("head"), c["tbl"].alias("tbl")))), lambda m: m.isNotNull())
    end = lambda at, k: F.coalesce(F.get(at, k + 1)["i"], F.size("cells"))
    cut = lambda at: F.transform(at, lambda m, k: F.when(m["opens"], F.struct(m["head"].alias("head"), m["tbl"].alias("tbl"), F.slice("cells", m["i"] + 2, end(at, k) - m["i"] - 1).alias("cells"))))
    return F.filter(let(marks, cut), lambda b: b.isNotNull())
