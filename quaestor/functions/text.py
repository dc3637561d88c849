"""Text and number functions that rules are made of, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DAYS_PER_UNIT, METHOD_ALIASES, SPECIES_ALIASES, SPECIES_METHODS

#: A word character in any script; `\\w` is ASCII only in Spark.
WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\s\p{Z}]"


def text(value: Column | str) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{_SPACE}+|{_SPACE}+$", "")


def collapse(value: Column) -> Column:
    return strip(F.regexp_replace(value, rf"{_SPACE}+", " "))


def filled(value: Column) -> Column:
    """Whether a text has more than white space."""
    return F.coalesce(strip(value) != "", F.lit(False))


def contains_any(value: Column, terms: Iterable[str]) -> Column:
    """Whether the text holds one of the terms: a few by a chain of `contains`, more by one alternation of literals, which
    makes a far smaller plan. Both stay in generated code."""
    terms = list(terms)
    if len(terms) > 3:
        return value.rlike("|".join(map(re.escape, terms)))
    return reduce(lambda a, b: a | b, [value.contains(t) for t in terms])


def mentions(value: Column, terms: Iterable[str]) -> Column:
    """Terms of under five characters as whole words, with an optional s, ed or ing; longer ones anywhere."""
    terms = list(terms)
    short, long = [re.escape(t) for t in terms if len(t) < 5], [re.escape(t) for t in terms if len(t) >= 5]
    parts = [rf"(?<!{WORD})(?:{'|'.join(short)})(?:s|ed|ing)?(?!{WORD})"] if short else []
    return value.rlike("|".join(parts + long))


def words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(f"{WORD}+"), F.lit(0))


def word_count(value: Column) -> Column:
    return F.size(words(value))


def joined(values: Column, separator: str = " ") -> Column:
    """An array of texts joined, null elements as empty ones."""
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))), separator)


def flattened(*values: Column) -> Column:
    """The non-empty values as one text."""
    return F.array_join(F.filter(F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values]), lambda x: x != ""), " ")


def percent_below(value: Column, limit: float) -> Column:
    """Whether a number below the limit stands before a percent sign."""
    return F.exists(F.regexp_extract_all(value, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.cast("double") < limit)


def looked_up(value: Column, table: dict) -> Column:
    """The table's entry for the text, lower-cased and stripped; null for others. A text that is a key as it stands takes
    neither."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, value), F.try_element_at(entries, F.lower(strip(value))))


def by_alias(value: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The key whose alias the text is, lower-cased and stripped; null for others."""
    keys: dict[str, str] = {}
    for key, names in aliases.items():
        for name in names:
            keys.setdefault(name, key)
    return looked_up(value, keys)


def species_key(standard: Column, raw: Column) -> Column:
    """The structured value if there is one, by alias or else as it is; then the raw text's alias."""
    given = strip(text(standard))
    return F.when(given != "", F.coalesce(by_alias(given, SPECIES_ALIASES), given)).otherwise(by_alias(text(raw), SPECIES_ALIASES))


def method_key(standard: Column, raw: Column) -> Column:
    return F.coalesce(by_alias(text(standard), METHOD_ALIASES), by_alias(text(raw), METHOD_ALIASES), F.lit(""))


def method_status(species: Column, method: Column) -> Column:
    """unacceptable, conditional or acceptable, in this order of precedence; unlisted methods are unacceptable, species
    that the matrix lacks `unknown`, and without a method or a species there is no status."""
    out = F.when((text(method) == "") | species.isNull(), F.lit(None).cast("string"))
    for key, (good, conditional, bad) in SPECIES_METHODS.items():
        known = F.when(method.isin(*bad), "unacceptable").when(method.isin(*conditional), "conditional").when(method.isin(*good), "acceptable").otherwise("unacceptable")
        out = out.when(species == key, known)
    return out.otherwise("unknown")


def per_species(species: Column, values: dict[str, float]) -> Column:
    """A number of the species, null for others."""
    out = F.lit(None).cast("double")
    for key, v in values.items():
        out = F.when(species == key, float(v)).otherwise(out)
    return out


def age_days(age: Column) -> Column:
    return age["value"] * looked_up(text(age["unit"]), {name: float(days) for name, days in DAYS_PER_UNIT.items()})


def weight_grams(weight: Column) -> Column:
    return F.when(F.lower(strip(text(weight["unit"]))) == "kg", weight["value"] * 1000).otherwise(weight["value"])


def pain_category(explicit: Column, parsed: Column) -> Column:
    known = [F.upper(strip(text(x))) for x in (explicit, parsed)]
    return F.coalesce(*[F.when(x.isin("B", "C", "D", "E"), x) for x in known])


def slug(value: Column, longest: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, longest)


def snippet(value: Column, most: int = 700) -> Column:
    """At most `most` characters, without a last partial word, marked as cut; a cut text without a blank stays whole."""
    head = F.substring(value, 1, most)
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), F.lit(" …")))
