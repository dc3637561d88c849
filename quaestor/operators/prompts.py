"""What a reviewer is shown of a protocol: slices by theme, without identities, and the texts made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import THEMES
from .report import with_prefixes

# The blocks, and the fields of each experiment, that a theme is shown.
_MONITORING = ("procedure_timeline", "pain_category_structured", "severity_level_1_to_5", "monitoring", "analgesia", "analgesia_used", "analgesia_justification_for_omission", "anesthesia_used", "anesthesia_drugs")
SHOWN: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "three_Rs_alternatives": (("alternatives_search", "summaries"), ()),
    "N_and_justification": (("animals_total", "n_justification"), ("animals", "n_justification_detail", "fate")),
    "severity_monitoring_analgesia": ((), _MONITORING),
    "euthanasia_and_endpoints": ((), ("animals", "humane_endpoints", "euthanasia", "fate", "monitoring")),
    "harm_benefit_analysis": (("summaries", "alternatives_search"), ("question", "pain_category_structured", "severity_level_1_to_5", "humane_endpoints", "fate")),
    "sex_and_reuse": ((), ("animals", "rationale_species_strain_sex", "reuse_or_prior_procedures")),
    "housing_and_husbandry": ((), ("animals", "housing", "monitoring")),
    "scientific_coherence": (("summaries", "animals_total"), ("question", "animals", "rationale_species_strain_sex", "procedure_timeline")),
    "personnel_and_training": (("participants", "pi"), ("procedure_timeline",)),
    "surgical_standards": ((), ("procedure_timeline", "anesthesia_drugs", "analgesia", "monitoring")),
    "hazardous_agents": (("summaries", "postmortem_processing"), ("procedure_timeline", "regulatory_requirement")),
    "writing_quality": (("summaries", "alternatives_search"), ("question", "procedure_timeline")),
}
#: Of people, only these fields are ever shown.
PEOPLE = {"pi": ("training",), "participants": ("role", "certified", "training")}


def _block(name: str) -> Column:
    if name == "pi":
        return F.struct(*[F.col(f"pi.{k}").alias(k) for k in PEOPLE["pi"]])
    if name == "participants":
        return F.transform("participants", lambda p: F.struct(*[p[k].alias(k) for k in PEOPLE["participants"]]))
    return F.col(name)


def theme_slice(theme: str) -> Column:
    """The JSON text of what a theme is shown: an explicit list of columns, never all of them."""
    blocks, fields = SHOWN[theme]
    parts = [_block(b).alias(b) for b in blocks]
    if fields:
        parts.append(F.transform("experiments", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("experiments"))
    return F.to_json(F.struct(*parts))


def slices(protocols: DataFrame, themes: list[str] | None = None) -> DataFrame:
    """(protocol_id, theme_ord, theme, slice): one scan for all themes."""
    chosen = [(i, t) for i, (t, *_) in enumerate(THEMES) if themes is None or t in themes]
    rows = F.array(*[F.struct(F.lit(i).alias("theme_ord"), F.lit(t).alias("theme"), theme_slice(t).alias("slice")) for i, t in chosen])
    return protocols.select("protocol_id", F.inline(rows))


def failing_lines(found: DataFrame, theme: str) -> DataFrame:
    """(protocol_id, findings): a theme's failing rows in order, one for each line."""
    prefixes = list(next(p for t, p, _ in THEMES if t == theme))
    rows = with_prefixes(found.where("status = 'fail'"), prefixes).groupBy("protocol_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", "ref", "message").alias("line")))).alias("x"))
    return rows.select("protocol_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("findings"))


def prompts(protocols: DataFrame, found: DataFrame, theme: str, grounding: DataFrame | None = None, blind: bool = False) -> DataFrame:
    """(protocol_id, theme, prompt): task, grounding and slice; unless it is blind, the theme's findings too. `grounding` is
    (block): one text for the theme."""
    rows = slices(protocols, [theme])
    parts = [F.lit(f"Grade the theme {theme} from 0 to 3. Answer with one JSON object."), F.col("slice")]
    if grounding is not None:
        rows = rows.join(F.broadcast(grounding.select("block").limit(1)))  # a single row
        parts.insert(1, F.col("block"))
    if not blind:
        rows = rows.join(failing_lines(found, theme), "protocol_id", "left")
        parts.append(F.coalesce("findings", F.lit("")))
    return rows.select("protocol_id", "theme", F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n").alias("prompt"))
