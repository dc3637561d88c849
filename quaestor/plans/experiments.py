"""Experiments of protocols, with the texts that rules share, and the rules about one experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CERVICAL_LIMITS, CO2_RATES, KEYWORDS, NEONATAL_DAYS, SPECIES_METHODS
from ..functions.text import (
    age_days, contains_any, filled, flattened, joined, mentions, method_key, method_status, pain_category, per_species, percent_below, species_key, text, weight_grams,
)
from .spec import Rule, let

K = KEYWORDS
_NEONATAL = r"(?<![\p{L}\p{N}_])(?:pups?|p[0-3]|day [0-3])(?![\p{L}\p{N}_])"
# What says and what denies a modification, and phrases that are no sign of tumour or infectious work.
_MODIFIED = r"(?<![\p{L}\p{N}_])כן(?![\p{L}\p{N}_])"
_NOT_MODIFIED = r"(?<![\p{L}\p{N}_])(?:not|non)[\s-]"
_NO_TUMOR = "tumor necrosis factor"
_NO_AGENT = r"(?:[\p{L}\p{N}_]+\s+){0,3}virus\s+reverse\s+transcriptase"


def derived(e: Column) -> Column:
    """An experiment `e` with the texts and keys that rules share, as one struct; each is worked out once."""
    strings = F.array().cast("array<string>")
    steps = F.transform(e["procedure_timeline"], lambda s: s["step"])
    drugs = F.transform(e["anesthesia_drugs"], lambda d: flattened(*[d[k] for k in ("agent", "dose", "route", "frequency", "rationale", "induction", "maintenance", "monitoring", "source_text")]))
    older = F.transform(e["anesthesia"], lambda d: flattened(*[d[k] for k in ("agent", "rationale", "dose", "frequency", "induction", "maintenance", "route", "monitoring")]))
    eu = e["euthanasia"]
    made = {
        "label_q": F.lower(F.concat(text(e["label"]), F.lit(" "), text(e["question"]))),
        "timeline": F.lower(joined(steps)),
        "param_text": F.lower(joined(e["monitoring"]["parameters"])),
        "mon_text": F.lower(F.concat(text(e["monitoring"]["documentation"]), F.lit(" "), joined(e["monitoring"]["parameters"]))),
        "he_text": F.lower(joined(F.concat(F.coalesce(e["humane_endpoints"]["general"], strings), F.coalesce(e["humane_endpoints"]["specific"], strings)))),
        "anes_text": F.lower(joined(F.when(F.coalesce(F.size(drugs), F.lit(0)) > 0, drugs).otherwise(older))),
        "fate": F.lower(text(e["fate"])),
        "eu_params": F.lower(F.array_join(F.array_distinct(F.filter(F.array(text(eu["conditions_text"]), text(eu["parameters"])), lambda x: x != "")), " ")),
        "eu_confirm": F.lower(text(eu["confirmation"])),
        "restraint_text": F.lower(flattened(*[e["restraint"][k] for k in ("method", "acclimation", "monitoring", "humane_removal_criteria", "food_water_plan", "justification")])),
        "permits_text": F.lower(flattened(*[e["field_study_permits"][k] for k in ("collection_permit_ids", "cites_documentation", "biosafety_approval_id", "field_euthanasia_method", "field_euthanasia_details")])),
        "species_key": species_key(e["animals"]["species_standard"], e["animals"]["species"]),
        "method": method_key(eu["method_standard"], eu["primary"]),
        "severity": e["severity_level_1_to_5"],
        "category": pain_category(e["pain_category"], e["pain_category_structured"]["parsed"]),
        "weight_g": weight_grams(e["animals"]["weight"]),
        "age_d": age_days(e["animals"]["age"]),
    }
    first = F.struct(e.alias("e"), *[x.alias(name) for name, x in made.items()])
    more = lambda x: F.struct(*[x[n].alias(n) for n in ("e", *made)], F.concat(x["label_q"], F.lit(" "), x["timeline"]).alias("joined"), method_status(x["species_key"], x["method"]).alias("status"))
    return let(first, more)


def experiments(protocols: DataFrame) -> DataFrame:
    """One row for each experiment: protocol_id, exp_idx from 1, and the fields of `derived`."""
    rows = protocols.select("protocol_id", F.posexplode(F.transform("experiments", derived)).alias("_pos", "x"))
    return rows.select("protocol_id", (F.col("_pos") + 1).alias("exp_idx"), "x.*")


def _has(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def _is(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _missing(parts: dict[str, Column]) -> Column:
    """The names of the parts that are missing, in order."""
    return F.filter(F.array(*[F.when(absent, F.lit(name)) for name, absent in parts.items()]), lambda x: x.isNotNull())


def _listed(what: str, names: Column) -> Column:
    return F.concat(F.lit(f"Experiment lacks {what}: "), F.array_join(names, ", "))


def has_analgesia(e: Column) -> Column:
    return F.exists(F.coalesce(F.transform(e["analgesia"], lambda r: r["agent"]), F.array().cast("array<string>")), lambda a: filled(a))


def _remaining(species_key: Column, method: Column) -> Column:
    """Whether the species' conditions on the method go beyond rate, secondary method and weight."""
    out = F.lit(False)
    for species, (_, conditional, _) in SPECIES_METHODS.items():
        left = [m for m, rest in conditional.items() if rest]
        out = F.when(species_key == species, method.isin(*left)).otherwise(out)
    return out


def experiment_rules(x: Column) -> list[Rule]:
    """The rules about one experiment, a struct of `derived`."""
    c, e = (lambda name: x[name]), x["e"]
    has = lambda column, name: contains_any(c(column) if isinstance(column, str) else column, K[name])
    both = lambda *names: F.concat_ws(" ", *[c(n) if isinstance(n, str) else n for n in names])
    yes = F.lit(True)
    co2, inhalant = c("method") == "CO2", c("method") == "inhalant_overdose"
    confirmed = filled(e["euthanasia"]["confirmation"])
    asleep = contains_any(c("anes_text"), ("isoflurane", "ketamine", "xylazine")) | c("timeline").contains("anesthe")
    neonate = F.when(c("age_d").isNotNull(), F.coalesce(c("age_d") <= per_species(c("species_key"), NEONATAL_DAYS), F.lit(False))).otherwise(has("joined", "neonatal") | c("joined").rlike(_NEONATAL))
    eu_all = both("eu_params", "eu_confirm")
    invasive, severity = has("joined", "invasive"), c("severity")
    moderate, severe = mentions(c("joined"), K["moderate"]), mentions(c("joined"), K["severe"])
    too_low = F.when(c("category").isNotNull(), (c("category").isin("B", "C") & (moderate | severe)) | ((c("category") == "D") & severe)).otherwise(
        ((severity <= 2) & moderate) | ((severity <= 3) & severe)
    )
    terminal = contains_any(c("fate"), ("euthanized", "euthanasia")) & ~has("joined", "recovery")
    per_animal = F.when(c("species_key") == "mouse", F.when(c("weight_g") > 25, 96.8).otherwise(77.4)).when(
        c("species_key") == "rat", F.when(_is(e["housing_density"]["breeding_with_litter"]), 800.0).when(c("weight_g") > 500, 451.6).otherwise(109.7)
    )
    animals, area = e["housing_density"]["animals_per_enclosure"], e["housing_density"]["cage_floor_area_cm2"]
    required = F.when(_is(e["housing_density"]["breeding_with_litter"]), per_animal).otherwise(per_animal * animals)
    held, review, permits = e["restraint"], e["reuse_review"], e["field_study_permits"]
    restrained = _is(held["used"]) | has(both("joined", "restraint_text"), "restraint")
    reused = _is(e["reuse_or_prior_procedures"]["has_prior"]) | review.isNotNull()
    field_text = both("joined", "permits_text")
    afield = _is(permits["field_study"]) | _is(permits["wildlife"]) | has(field_text, "field")
    restraint_parts = _missing(
        {"maximum duration": held["max_duration_minutes"].isNull(), "acclimation procedure": ~filled(held["acclimation"]), "humane removal criteria": ~filled(held["humane_removal_criteria"]), "monitoring plan": ~filled(held["monitoring"])}
    )
    reuse_parts = _missing(
        {
            "mild or moderate prior severity": ~text(review["prior_severity"]).isin("mild", "moderate"),
            "full recovery": ~_is(review["fully_recovered"]),
            "mild, moderate or non-recovery new severity": ~text(review["new_procedure_severity"]).isin("mild", "moderate", "non_recovery"),
            "veterinary consultation": ~_is(review["vet_consulted"]),
        }
    )
    pathogens = _is(permits["wildlife_pathogen_handling"]) | (_is(permits["wildlife"]) & has(field_text, "pathogen"))
    permit_parts = _missing(
        {
            "collection permits": ~filled(permits["collection_permit_ids"]),
            "protected-species documents": _is(permits["protected_species"]) & ~filled(permits["cites_documentation"]),
            "biosafety approval": pathogens & ~filled(permits["biosafety_approval_id"]),
            "field euthanasia method": ~filled(permits["field_euthanasia_method"]),
        }
    )
    cleaned = lambda phrase: F.regexp_replace(c("joined"), phrase, " ")
    modified_text = F.lower(text(e["animals"]["genetic_status"]))
    modified = modified_text.rlike(_MODIFIED) | (~modified_text.rlike(_NOT_MODIFIED) & mentions(modified_text, K["modified"]))
    onc = e["oncology"]
    return [
        Rule("euthanasia:CO2", (2, 1, 1), co2, confirmed | asleep, "W/E", "CO2 without a confirmation step"),
        Rule("euthanasia:overdose-confirm", (2, 1, 2), inhalant, confirmed, "W/E", "Inhalant overdose without a confirmation step", True),
        Rule("special:neonatal-CO2", (2, 2, 1), co2 & neonate, has(both(eu_all, "timeline"), "neonatal_secondary"), "W/E", "CO2 is the sole method for neonates"),
        Rule("euthanasia:species-method", (2, 3, 1), c("status") == "unacceptable", ~yes, "E", F.concat(F.lit("Method not acceptable for "), c("species_key"))),
        Rule("euthanasia:precharged-chamber", (2, 3, 2), co2, ~(has(both(eu_all, F.lower(e["euthanasia"]["primary"]), F.lower(e["euthanasia"]["method_standard"])), "precharged") | (c("timeline").contains("chamber") & has("timeline", "precharged"))), "E", "Pre-charged CO2 chamber"),
        Rule(
            "euthanasia:displacement-rate", (2, 3, 3), co2 & per_species(c("species_key"), {s: r[0] for s, r in CO2_RATES.items()}).isNotNull(),
            percent_below(c("eu_params"), 100) | contains_any(c("eu_params"), ("displacement", "vol/min")), "W/E", "CO2 displacement rate is not given",
        ),
        Rule("euthanasia:secondary-method", (2, 3, 4), (co2 | inhalant) & c("status").isNotNull(), has(eu_all, "physical"), "W/E", "No secondary physical method"),
        Rule(
            "euthanasia:cervical-weight", (2, 3, 5), (c("method") == "cervical_dislocation") & per_species(c("species_key"), CERVICAL_LIMITS).isNotNull(),
            c("weight_g") <= per_species(c("species_key"), CERVICAL_LIMITS), "W/E", "Weight is missing or over the limit for cervical dislocation",
        ),
        Rule("euthanasia:conditions-missing", (2, 3, 6), (c("status") == "conditional") & _remaining(c("species_key"), c("method")), has(both(eu_all, "timeline"), "conditions"), "W/E", "Conditions of the method are not documented"),
        Rule("severity:monitoring", (3, 1, 1), severity >= 4, _is(e["monitoring"]["initial_72h_daily"]) | (F.length(c("param_text")) > 50) | has("param_text", "daily"), "E", "Severity 4 or more without daily monitoring", True),
        Rule("severity:analgesia", (3, 2, 1), (severity >= 3) & invasive, has_analgesia(e), "E", "Invasive steps of severity 3 or more without analgesia"),
        Rule("paralytic:without-anesthesia", (3, 3, 1), has(both("joined", "anes_text"), "paralytic"), has(both("anes_text", "timeline"), "anesthetic"), "W/E", "Paralytic agent without anesthesia"),
        Rule("pain:category-consistency", (3, 4, 1), severity.isNotNull() | c("category").isNotNull(), ~too_low, "W/E", "Declared pain category is low for the procedures"),
        Rule("endpoints:generic-consult", (5, 1, 1), c("he_text").contains("consult") & c("he_text").contains("vet"), has("he_text", "quantified"), "W", "Endpoints only refer to a veterinarian"),
        Rule("endpoints:20%-only", (5, 2, 1), c("he_text").contains("20%") & ~c("he_text").contains("10%"), has("he_text", "clinical"), "W/E", "20 percent weight loss is the only endpoint"),
        Rule("endpoints:death-only", (6, 0, 1), has("he_text", "death"), has("he_text", "score"), "W/E", "Death or moribundity is the only endpoint"),
        Rule("postop:monitoring", (6, 1, 1), ~terminal & has("joined", "surgery"), has("mon_text", "postop"), "W/E", "Survival surgery without a post-operative plan"),
        Rule("vet:consultation", (7, 0, 1), severity >= 4, has("mon_text", "vet"), "W", "Severity 4 or more without veterinary consultation"),
        Rule("housing:density", (8, 0, 1), (animals != 0) & area.isNotNull() & per_animal.isNotNull(), area >= required, "W", "Floor area is below the required one"),
        Rule(
            "housing:density", (8, 0, 2), c("species_key").isin(*K["social_species"]) & (e["housing"]["group_housed"] == F.lit(False)), filled(e["housing"]["single_housing_reason"]), "W", "Single housing of a social species without a reason",
        ),
        Rule("restraint:duration", (8, 1, 1), restrained, F.size(restraint_parts) == 0, "W", _listed("restraint details", restraint_parts)),
        Rule("restraint:duration", (8, 1, 2), restrained & (held["max_duration_minutes"] > 15), filled(held["justification"]), "W", "Restraint of over 15 minutes without justification"),
        Rule("restraint:duration", (8, 1, 3), restrained & (held["max_duration_minutes"] > 360), filled(held["food_water_plan"]), "W", "Restraint of over 6 hours without food and water plan"),
        Rule("reuse:justification", (8, 2, 1), reused, F.size(reuse_parts) == 0, "W/E", _listed("reuse conditions", reuse_parts)),
        Rule("permits:field-study", (8, 3, 1), afield, F.size(permit_parts) == 0, "W/E", _listed("field documents", permit_parts)),
        Rule("deprivation:protocol", (9, 0, 1), has("timeline", "deprivation"), has("mon_text", "weight"), "W", "Deprivation without weight monitoring"),
        Rule("gma:ibc", (9, 1, 1), modified, ~yes, "W", "Genetically modified animals: refer to the biosafety approval"),
        Rule("ascites:in-vitro", (9, 2, 1), c("timeline").contains("ascites"), ~yes, "W", "Ascites production: justify against in-vitro methods"),
        Rule("special:stereotaxic", (11, 0, 1), has("joined", "stereotaxic"), filled(e["stereotaxic_implant"]["implant_type"]) | e["stereotaxic_implant"]["craniotomy"].isNotNull(), "W", "Stereotaxic work without implant details", True),
        Rule("special:oncology", (11, 1, 1), contains_any(cleaned(_NO_TUMOR), K["oncology"]), filled(onc["tumor_burden_cap"]) & filled(onc["ulceration_policy"]), "W", "Tumour work without burden cap or ulceration policy", True),
        Rule("special:diabetes", (11, 2, 1), has("joined", "diabetes"), text(e["diabetes"]["measurement"]).isin("fasted", "non_fasted"), "W", "Diabetes model without measurement mode", True),
        Rule("special:biosafety", (11, 3, 1), contains_any(cleaned(_NO_AGENT), K["biosafety"]), filled(e["biosafety_infectious_agents"]["agent_name"]), "W", "Infectious work without an agent's name", True),
        Rule("special:nanomaterials", (11, 4, 1), has("joined", "nanomaterials"), filled(e["nanomaterials"]["particle_type"]), "W", "Nanomaterial work without a particle type", True),
        Rule("special:ocular", (11, 5, 1), has("joined", "ocular"), filled(e["ocular_procedures"]["topical_anesthesia"]) | filled(e["ocular_procedures"]["ocular_lubrication"]), "W", "Ocular work without topical anesthesia or lubrication", True),
    ]


def signals(rows: DataFrame) -> DataFrame:
    """One row of feature flags for each experiment. has_analgesia is looked at only in invasive experiments of severity 3
    or more."""
    e = F.col("e")
    context = {name: contains_any(F.col("joined"), K[name]) for name in ("stereotaxic", "oncology", "diabetes", "biosafety", "nanomaterials", "ocular")}
    only_20 = F.col("he_text").contains("20%") & ~F.col("he_text").contains("10%") & ~contains_any(F.col("he_text"), K["clinical"])
    return rows.select(
        "protocol_id", "exp_idx", e["label"].alias("label"), "severity",
        ((F.coalesce("severity", F.lit(0)) >= 3) & contains_any(F.col("joined"), K["invasive"]) & has_analgesia(e)).alias("has_analgesia"),
        (F.col("anes_text") != "").alias("has_anesthesia"), (F.trim("he_text") != "").alias("has_humane_endpoints"), only_20.alias("humane_endpoints_20_percent_only"),
        e["euthanasia"]["primary"].alias("euthanasia_primary"), F.col("category").alias("pain_category"), F.col("species_key").alias("species_normalized"), F.col("status").alias("method_status"),
        F.struct(*[x.alias(f"{name}_context") for name, x in context.items()]).alias("specialty_flags"),
    )
