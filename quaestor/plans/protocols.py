"""Rules about a whole protocol, its participants and groups of its experiments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import KEYWORDS
from ..functions.text import contains_any, filled, joined, text, word_count
from ..schema import REQUIRED, protocol_type
from .spec import CHECK, Rule, finding, let

K = KEYWORDS
SCIENTIFIC_WORDS, LAY_WORDS = 2500, 150
# Fixed value: what is no cosmetic product.
_NO_COSMETIC = r"cosmetic\s+surg[\p{L}\p{N}_]*|ניתוח[\p{L}\p{N}_]*\s+קוסמט[\p{L}\p{N}_]*"


def _strings(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def _everything() -> Column:
    """The values of the blocks in which products are looked for, as one text of their leaves, without any keys. As SQL text:
    there are hundreds of leaves, and each would be a call to the JVM otherwise."""
    blocks = ("research", "summaries", "n_justification", "experiments")
    return F.expr(f"array_join(filter(concat({', '.join(leaves(b, protocol_type()[b].dataType) for b in blocks)}), x -> x <> ''), ' ')")


def leaves(value: str, kind: T.DataType, depth: int = 0) -> str:
    """SQL for the texts of a nested value, in order: an array of strings that is never null."""
    if isinstance(kind, T.StructType):
        return f"concat({', '.join(leaves(f'{value}.`{f.name}`', f.dataType, depth) for f in kind)})"
    if isinstance(kind, T.ArrayType):
        return f"coalesce(flatten(transform({value}, v{depth} -> {leaves(f'v{depth}', kind.elementType, depth + 1)})), array())"
    if isinstance(kind, T.MapType):
        return f"coalesce(transform(map_values({value}), v{depth} -> coalesce(string(v{depth}), '')), array())"
    return f"array(coalesce(string({value}), ''))"


def texts() -> Column:
    """The texts and sums that protocol rules share, as one struct."""
    exps, research = F.col("experiments"), F.col("research")
    steps = F.flatten(F.transform(exps, lambda e: F.coalesce(F.transform(e["procedure_timeline"], lambda s: s["step"]), F.array().cast("array<string>"))))
    alternatives = F.col("alternatives_search")
    made = {
        "titles": F.lower(F.concat(text(research["title_he"]), F.lit(" "), text(research["title_en"]))),
        "request_type": research["request_type"],
        "n_exps": F.coalesce(F.size("experiments"), F.lit(0)),
        "has_totals": F.coalesce(F.size("animals_total"), F.lit(0)) > 0,
        "total_n": F.coalesce(F.aggregate("animals_total", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(t["n_total"], F.lit(0))), F.lit(0)),
        "sexes": F.array_sort(F.array_distinct(F.filter(_strings(F.transform(exps, lambda e: e["animals"]["sex"])), lambda x: text(x) != ""))),
        "rationale": F.lower(joined(F.transform(exps, lambda e: F.trim(text(e["rationale_species_strain_sex"]))))),
        "colony": F.coalesce("is_colony", F.lit(False)),
        "all_steps": F.lower(joined(steps)),
        "all_text": F.regexp_replace(F.lower(_everything()), _NO_COSMETIC, " "),
        "no_alternatives": (F.size(_strings(alternatives["engines"])) == 0) & (F.size(_strings(alternatives["queries"])) == 0) & ~filled(alternatives["conclusion"]) | alternatives.isNull(),
    }
    return F.struct(*[x.alias(name) for name, x in made.items()])


def protocol_rules(x: Column) -> list[Rule]:
    """The rules about a whole protocol; `x` is the struct of `texts`."""
    made = ("titles", "request_type", "n_exps", "has_totals", "total_n", "sexes", "rationale", "colony", "all_steps", "all_text", "no_alternatives")
    c, no = (lambda name: x[name] if name in made else F.col(name)), F.lit(False)
    research, third = c("research"), c("third_party")
    lacks = lambda key: F.array_contains("missing_keys", key)
    pilot, term = contains_any(c("titles"), K["pilot"]), research["approval_term_years"]
    typed = text(c("request_type")) != ""
    in_range = term.between(1, 4)
    single = (F.size(c("sexes")) == 1) & F.get(c("sexes"), F.lit(0)).isin("M", "F")
    details = F.trim(text(c("n_justification")["details"]))
    numbers = F.lower(F.concat(text(c("n_justification")["method"]), F.lit(" "), details))
    alternatives = c("alternatives_search")
    engines = F.transform(_strings(alternatives["engines"]), lambda x: F.lower(F.trim(x)))
    invasive = contains_any(c("all_steps"), K["colony_invasive"])
    colony = F.lower(text(c("n_justification")["details"]))
    rules = [Rule(block, (0, i * 10, 0), lacks(block), no, "E", f"Block {block} is missing") for i, block in enumerate(("header", "research"))]
    rules.append(Rule("pi", (0, 60, 0), lacks("pi") | c("pi").isNull(), no, "E", "Block pi is missing"))
    for i, (block, keys) in enumerate(REQUIRED.items()):
        gone = F.filter("missing_keys", _within(block))
        rules.append(Rule("required", (0, {"header": 1, "research": 11, "pi": 61}[block], 0), c(block).isNotNull() & ~lacks(block) & (F.size(gone) > 0), no, "E", F.concat(F.lit("Missing keys: "), F.array_join(gone, ", ")), ref=F.lit(f"required:{block}")))
    return rules + [
        Rule("title:track", (0, 12, 0), c("request_type") == "regular", ~pilot, "E", "A regular request has a pilot title", True),
        Rule("title:pilot-label", (0, 13, 0), c("request_type") == "pilot", pilot, "W", "A pilot request has no pilot title", True),
        Rule("term:track", (0, 14, 0), term.isNotNull() & typed, in_range & ((c("request_type") != "pilot") | (term == 1)), F.when(in_range & (c("request_type") == "pilot") & (term != 1), "warning").otherwise("error"), "Approval term does not fit the request type", True),
        Rule("continuation", (0, 15, 0), research["is_continuation"], filled(research["prior_protocol_id"]) & filled(research["continuation_reason"]), "E", "Continuation without predecessor or reason", True),
        Rule("third-party", (0, 16, 0), research["third_party_service"], filled(third["sponsor_org"]) & filled(third["ordering_investigator_name"]) & filled(third["sponsor_approver_name"]), "E", "Third-party service without sponsor details", True),
        Rule("pi:training", (0, 62, 0), c("pi").isNotNull(), F.coalesce(F.size(c("pi")["training"]), F.lit(0)) > 0, "E", "No training of the principal investigator", True),
        Rule("scope:pilot-size", (1, 2, 0), (c("request_type") == "pilot") & c("has_totals"), (c("total_n") <= 500) & (c("n_exps") <= 5), "W", "The pilot is large"),
        Rule("sex:rationale", (1, 3, 0), single, contains_any(c("rationale"), K["sex"]), "W", "A single sex without rationale"),
        Rule("sex:sabv", (1, 4, 0), single, (F.trim(c("rationale")) != "") & ~contains_any(c("rationale"), K["sabv_convenience"]) & contains_any(c("rationale"), K["sabv_scientific"]), "W", "Sex as a biological variable is not considered"),
        Rule("N:justification-detail", (1, 5, 0), c("total_n") >= 500, F.length(details) >= 80, "W", "Little justification for many animals"),
        Rule("N:power-analysis", (1, 6, 0), (text(c("request_type")) != "pilot") & (c("total_n") > 50), contains_any(numbers, K["power"]), "W", "No power analysis or precedent"),
        Rule("alts:missing", (4, 0, 0), c("no_alternatives"), no, "W/E", "No search for alternatives"),
        Rule("alts:engines", (4, 1, 0), ~c("no_alternatives"), F.size(engines) > 0, "W/E", "No databases are listed"),
        Rule("alts:queries", (4, 2, 0), ~c("no_alternatives"), (F.size(_strings(alternatives["queries"])) > 0) | _any(engines, lambda x: x.isin(*K["standard_engines"])), "W", "No queries are listed"),
        Rule("alts:conclusion", (4, 3, 0), ~c("no_alternatives"), filled(alternatives["conclusion"]), "W", "No conclusion of the search"),
        Rule("cosmetics:ban", (5, 0, 0), contains_any(c("all_text"), K["cosmetic"]), no, "W/E", "Cosmetics or household products are tested"),
        Rule("colony:breeding-plan", (10, 0, 0), c("colony"), contains_any(colony, K["colony"]), "W", "No colony management plan"),
        Rule("colony:no-invasive", (12, 0, 0), c("colony"), ~invasive, "E", "A colony protocol has invasive steps", True),
        Rule("summaries:scientific-length", (13, 0, 0), filled(c("summaries")["scientific_en_≤300w"]), word_count(text(c("summaries")["scientific_en_≤300w"])) <= SCIENTIFIC_WORDS, "W", "The scientific summary is long", True),
        Rule("summaries:lay-length", (13, 1, 0), filled(c("summaries")["lay_he_≤150w"]), word_count(text(c("summaries")["lay_he_≤150w"])) <= LAY_WORDS, "W", "The lay summary is long", True),
    ]


def _within(block: str):
    return lambda key: key.startswith(f"{block}.")


def participant_rules(p: Column) -> list[Rule]:
    trained = F.coalesce(F.size(p["training"]), F.lit(0)) > 0
    return [
        Rule("participant:training", (0, 70, 1), p["role"] == "performs_procedures", trained, "E", "No training of a participant", True, ref=F.lit("participant:training")),
        Rule("participant:certified-without-training", (0, 70, 2), F.coalesce(p["certified"], F.lit(False)), trained, "W", "Certified without training", ref=F.lit("participant:certified-without-training")),
    ]


def survivors(exps: Column) -> Column:
    """One finding for each raw species with more than one experiment that the animals survive; `exps` are structs of
    `experiments.derived`."""
    alive = F.filter(F.transform(exps, lambda x, i: F.struct((i + 1).alias("at"), text(x["e"]["animals"]["species"]).alias("species"), contains_any(x["fate"], ("euthanized", "euthanasia")).alias("dead"))), lambda x: ~x["dead"])

    def one(species: Column, found: Column) -> Column:
        message = F.concat(F.lit("Multiple survival experiments on "), F.when(species == "", "unknown").otherwise(species), F.lit(": "), F.array_join(found.cast("array<string>"), ", "))
        seq = F.lit((6 * 100 + 2) * 10**9) + F.element_at(found, 1).cast("long") * 1000
        return F.when(F.size(found) > 1, finding("surgery:multiple-survival", seq, F.lit("surgery:multiple-survival"), F.lit(False), "W", message))

    def groups(rows: Column) -> Column:
        kinds = F.array_distinct(F.transform(rows, lambda x: x["species"]))
        return F.transform(kinds, lambda k: let(F.transform(F.filter(rows, lambda x: x["species"] == k), lambda x: x["at"]), lambda found: one(k, found)))

    return F.filter(F.coalesce(let(alive, groups), F.array().cast(f"array<{CHECK}>")), lambda x: x.isNotNull())
