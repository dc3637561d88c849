"""Dimensions: rule registry, packs, keyword sets, aliases and the species-method matrix. All are small and fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULESET_VERSION = "1.2.0"

# Fixed values: (rule id, kind, jurisdiction), in registry order.
RULES: tuple[tuple[str, str, str], ...] = (
    ("required", "structural", "generic"),
    ("header", "structural", "generic"),
    ("research", "structural", "generic"),
    ("pi", "structural", "generic"),
    ("pi:training", "structural", "generic"),
    ("participant:training", "structural", "generic"),
    ("participant:certified-without-training", "advisory", "generic"),
    ("animals:totals-vs-exps", "structural", "generic"),
    ("continuation", "structural", "IL-form"),
    ("third-party", "structural", "IL-form"),
    ("colony:no-invasive", "structural", "IL-form"),
    ("colony:breeding-plan", "advisory", "generic"),
    ("term:track", "structural", "IL-form"),
    ("title:track", "law_critical", "IL-form"),
    ("title:pilot-label", "advisory", "IL-form"),
    ("scope:pilot-size", "advisory", "IL-form"),
    ("euthanasia:overdose-confirm", "law_critical", "generic"),
    ("euthanasia:CO2", "law_critical", "generic"),
    ("euthanasia:species-method", "law_critical", "generic"),
    ("euthanasia:conditions-missing", "law_critical", "generic"),
    ("euthanasia:displacement-rate", "law_critical", "generic"),
    ("euthanasia:secondary-method", "law_critical", "generic"),
    ("euthanasia:precharged-chamber", "law_critical", "generic"),
    ("euthanasia:cervical-weight", "law_critical", "generic"),
    ("special:neonatal-CO2", "law_critical", "generic"),
    ("severity:monitoring", "law_critical", "generic"),
    ("severity:analgesia", "law_critical", "generic"),
    ("endpoints:20%-only", "law_critical", "generic"),
    ("endpoints:death-only", "law_critical", "generic"),
    ("endpoints:generic-consult", "advisory", "generic"),
    ("postop:monitoring", "law_critical", "generic"),
    ("pain:category-consistency", "law_critical", "generic"),
    ("paralytic:without-anesthesia", "law_critical", "generic"),
    ("vet:consultation", "advisory", "generic"),
    ("surgery:multiple-survival", "advisory", "generic"),
    ("deprivation:protocol", "advisory", "generic"),
    ("restraint:duration", "advisory", "generic"),
    ("housing:density", "advisory", "generic"),
    ("reuse:justification", "law_critical", "generic"),
    ("permits:field-study", "law_critical", "generic"),
    ("alts:missing", "law_critical", "generic"),
    ("alts:engines", "law_critical", "IL-form"),
    ("alts:queries", "advisory", "generic"),
    ("alts:conclusion", "advisory", "generic"),
    ("cosmetics:ban", "law_critical", "generic"),
    ("N:justification-detail", "advisory", "generic"),
    ("N:power-analysis", "advisory", "generic"),
    ("sex:rationale", "advisory", "generic"),
    ("sex:sabv", "advisory", "generic"),
    ("special:stereotaxic", "advisory", "generic"),
    ("special:oncology", "advisory", "generic"),
    ("special:diabetes", "advisory", "generic"),
    ("special:biosafety", "advisory", "generic"),
    ("special:nanomaterials", "advisory", "generic"),
    ("special:ocular", "advisory", "generic"),
    ("gma:ibc", "advisory", "generic"),
    ("ascites:in-vitro", "advisory", "generic"),
    ("summaries:scientific-length", "advisory", "IL-form"),
    ("summaries:lay-length", "advisory", "IL-form"),
)

# The rule jurisdictions of each pack, and the themes it leaves out.
PACKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {"IL": (("IL-form", "generic"), ()), "generic": (("generic",), ("writing_quality",))}
DEFAULT_PACK = "IL"

# Keyword sets, matched on lower-cased text.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "pilot": ("פיילוט", "פילוט", "pilot"),
    "sex": ("sex", "זוויג", "זכרים", "נקבות", "male", "female", "males", "females"),
    "sabv_scientific": ("sex as a biological variable", "biological variable", "sex-specific", "estrous", "oestrous", "horm", "ovar", "testis", "pregnan", "prostate", "ovarian", "uter", "זוויג", "זכרים", "נקבות"),
    "sabv_convenience": ("convenien", "availability", "avoid variability", "less variable", "reduce variability", "easier", "easier handling", "זמינות", "נוחות", "להפחית שונות", "פחות שונות", "קל יותר"),
    "power": ("power", "pilot", "prior", "precedent", "published", "literature", "previous"),
    "standard_engines": ("good search practice on animal alternative-eu",),
    "colony": ("colony", "breeding", "surplus", "disposition"),
    "colony_invasive": ("surgery", "implant", "dbs", "tumor", "craniotomy"),
    "daily": ("daily", "every day", "24", "72"),
    "invasive": ("surgery", "operation", "incision", "crush", "optic nerve", "flap", "wound", "craniotomy", "laparotomy", "stereotax", "implant"),
    "paralytic": ("vecuronium", "rocuronium", "pancuronium", "cisatracurium", "atracurium", "succinylcholine", "neuromuscular blocker", "paraly", "muscle relaxant"),
    "anesthetic": ("isoflurane", "sevoflurane", "ketamine", "xylazine", "propofol", "pentobarbital", "anesthe", "general anesthesia", "general anaesthesia"),
    "moderate_more": ("fracture", "nerve crush", "tumor implant", "tumour implant", "xenograft", "restraint", "food deprivation", "water restriction"),
    "severe": ("thoracotomy", "amputation", "spinal cord", "burn", "sepsis", "stroke", "neuropathic pain", "ulceration", "death endpoint"),
    "cosmetic": ("cosmetic", "cosmetics", "makeup", "mascara", "lipstick", "skin cream", "shampoo", "toothpaste", "household cleaner", "cleaning product", "cleaning products", "personal care product", "personal care products", "קוסמט", "איפור", "שמפו", "משחת שיניים", "חומרי ניקוי", "מוצרי ניקוי", "מוצרי קוסמטיקה"),
    "quantified": ("score", "tumor", "ulcer", "necros", "cm", "mm", "%", "scale"),
    "clinical": ("tumor", "ulcer", "necros", "score", "scale", "hunch", "letharg", "posture", "moribund", "body condition", "piloerect", "dehydrat"),
    "neonatal": ("neonat", "postnatal", "post-natal", "newborn", "new-born"),
    "neonatal_secondary": ("secondary", "decapitat", "cervical", "thoracotomy", "exsanguination", "physical", "50 min", "50-min", "50min", "נקע צוואר", "עריפ"),
    "precharged": ("pre-charged", "precharged", "pre charged", "prefilled", "pre-filled", "pre filled"),
    "physical": ("cervical", "decapitat", "thoracotomy", "exsanguination", "bilateral thoracotomy", "נקע צוואר", "עריפ"),
    "conditions": ("trained", "justified", "anesthesia", "anesthe", "sedat"),
    "death": ("death", "moribund", "moribundity", "dying", "lethal"),
    "score": ("score", "scale", "weight", "%", "clinical", "behavior", "righting", "posture", "grooming"),
    "surgery": ("surgery", "operation", "incision", "laparotomy", "craniotomy", "implant", "flap", "laminectomy", "thoracotomy"),
    "recovery": ("recover", "post-op", "postop", "post op", "wound", "התאוששות"),
    "postop": ("post", "recover", "daily", "hour", "analges", "pain", "wound"),
    "social_species": ("mouse", "rat", "guinea_pig", "rabbit", "hamster", "gerbil", "pig", "zebrafish"),
    "restraint": ("restraint", "restrain", "immobiliz", "jacket", "tether", "tube restraint", "head fixation", "head restraint"),
    "field": ("field study", "field work", "wildlife", "wild-caught", "animal trapping", "animal capture", "live trapping", "live capture", "capture permit", "free-ranging", "free ranging"),
    "pathogen": ("pathogen", "zoonotic", "rabies", "influenza", "salmonella"),
    "vet": ("vet", "veterinar", "dvm", "consultation", "וטרינר", "התייעצות"),
    "deprivation": ("food deprivation", "water deprivation", "fasted", "fasting", "water restrict"),
    "weight": ("weight loss", "body weight", "intervention", "endpoint", "%"),
    "modified": ("transgenic", "knockout", "ko", "crispr", "ge", "gene edit", "knock-in", "ki", "genetically modified", "gm"),
    "stereotaxic": ("dbs", "stereotax", "stereotactic", "craniotomy", "headcap"),
    "oncology": ("tumor", "tumour", "melanoma", "xenograft", "metastasis", "metastases", "muspelheim neoplasm", "alfheim neoplasm", "nidavellir tumor"),
    "diabetes": ("diabetes", "bg ", "blood glucose", "hyperglycemia", "jotunheim metabolic condition", "skadi-zotocin"),
    "biosafety": ("virus", "viral", "reovirus", "lentivirus", "aav", "infectious", "niflheim-v7"),
    "nanomaterials": ("nanoparticle", "volatile organic compound", "rune-particle", "rune-particles", "norn-corona", "nano-ghost", "nano-ghosts"),
    "ocular": ("optic nerve", "bifrost nerve", "retina", "corneal", "ocular"),
}
KEYWORDS["moderate"] = KEYWORDS["invasive"] + KEYWORDS["moderate_more"]

# Aliases, lower-cased and stripped.
SPECIES_ALIASES: dict[str, tuple[str, ...]] = {
    "mouse": ("mouse", "mice", "mus musculus", "עכבר", "עכברים", "עכברי מעבדה"),
    "rat": ("rat", "rats", "rattus norvegicus", "חולדה", "חולדות", "חולדת מעבדה"),
    "guinea_pig": ("guinea pig", "guinea_pig", "guinea pigs", "cavia porcellus", "שפן ים", "שפני ים"),
    "rabbit": ("rabbit", "rabbits", "oryctolagus cuniculus", "ארנב", "ארנבות", "ארנבים", "ארנב מעבדה"),
    "hamster": ("hamster", "hamsters", "mesocricetus auratus", "golden hamster", "syrian hamster", "אוגר", "אוגרים"),
    "gerbil": ("gerbil", "gerbils", "meriones unguiculatus", "mongolian gerbil", "ג'רביל", "גרביל"),
    "zebrafish": ("zebrafish", "zebra fish", "danio rerio", "דג זברה", "דג-זברה", "דגי זברה"),
    "pig": ("pig", "pigs", "swine", "sus scrofa", "minipig", "mini-pig", "mini pig", "חזיר", "חזירים", "חזיר מעבדה"),
}
METHOD_ALIASES: dict[str, tuple[str, ...]] = {
    "CO2": ("co2", "co₂", "carbon dioxide"),
    "inhalant_overdose": ("inhalant_overdose", "inhalant overdose", "isoflurane overdose", "isoflurane", "חומר הרדמה בשאיפה", "sevoflurane", "sevoflurane overdose"),
    "barbiturate": ("barbiturate", "pentobarbital", "pentobarbital overdose", "sodium pentobarbital", "pentobarbitone"),
    "injectable_overdose": ("injectable_overdose", "injectable overdose", "ketamine overdose", "ketamine/xylazine overdose", "חומר הרדמה בהזרקה"),
    "cervical_dislocation": ("cervical_dislocation", "cervical dislocation"),
    "decapitation": ("decapitation",),
    "MS-222": ("ms-222", "ms-222 overdose", "ms222", "tricaine", "tricaine methanesulfonate", "tricaine overdose"),
    "exsanguination": ("exsanguination",),
    "electrocution": ("electrocution",),
    "captive_bolt": ("captive bolt", "captive_bolt"),
    "rapid_chilling": ("rapid chilling", "rapid_chilling", "hypothermia"),
}

# Of each species, acceptable methods; conditional ones, with whether a condition is left besides displacement
# rate, secondary method and weight; unacceptable ones. Methods that are not listed are unacceptable.
_RODENT = (("barbiturate", "inhalant_overdose", "injectable_overdose"), {"cervical_dislocation": True, "decapitation": True, "CO2": False}, ("pre-charged_CO2_chamber",))
SPECIES_METHODS: dict[str, tuple[tuple[str, ...], dict[str, bool], tuple[str, ...]]] = {
    "mouse": _RODENT,
    "rat": _RODENT,
    "guinea_pig": (_RODENT[0], {"decapitation": True, "CO2": False}, ("pre-charged_CO2_chamber", "cervical_dislocation")),
    "rabbit": (_RODENT[0], {"CO2": True, "cervical_dislocation": True, "decapitation": True, "exsanguination": True}, ("pre-charged_CO2_chamber",)),
    "hamster": _RODENT,
    "gerbil": _RODENT,
    "zebrafish": (("MS-222", "barbiturate"), {"rapid_chilling": True, "decapitation": True}, ("CO2", "pre-charged_CO2_chamber", "cervical_dislocation")),
    "pig": (("barbiturate", "injectable_overdose"), {"CO2": True, "electrocution": True, "captive_bolt": True, "exsanguination": True, "inhalant_overdose": True}, ("pre-charged_CO2_chamber", "cervical_dislocation", "decapitation")),
}
# CO2 displacement range (% of volume a minute), weight limits (g) of cervical dislocation, neonatal cutoffs (days).
CO2_RATES = {"mouse": (30, 70), "rat": (30, 70), "guinea_pig": (30, 70), "rabbit": (50, 60), "hamster": (30, 70), "gerbil": (30, 70), "pig": (30, 70)}
CERVICAL_LIMITS = {"rat": 200.0, "rabbit": 1000.0}
NEONATAL_DAYS = {"mouse": 10.0, "rat": 10.0}
DAYS_PER_UNIT = {"days": 1, "weeks": 7, "months": 30, "years": 365}

# Fixed values: (theme, prefixes of the rules it looks at, document types it is grounded on), in order.
_SECTIONS = ("guidance_section", "law_section", "prepare_section")
THEMES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("three_Rs_alternatives", ("alts:",), ("guidance_section", "law_section", "norina_record", "threer_guide", "prepare_section")),
    ("N_and_justification", ("animals:", "N:"), _SECTIONS),
    ("severity_monitoring_analgesia", ("severity:", "postop:", "surgery:"), _SECTIONS),
    ("euthanasia_and_endpoints", ("euthanasia:", "endpoints:", "postop:"), _SECTIONS),
    ("harm_benefit_analysis", ("severity:", "N:", "alts:"), _SECTIONS),
    ("sex_and_reuse", ("sex:", "colony", "reuse:"), _SECTIONS),
    ("housing_and_husbandry", ("housing:", "restraint:", "permits:field-study"), _SECTIONS),
    ("scientific_coherence", ("N:", "animals:"), _SECTIONS),
    ("personnel_and_training", ("pi:", "participant:"), _SECTIONS),
    ("surgical_standards", ("postop:", "surgery:"), _SECTIONS),
    ("hazardous_agents", ("special:biosafety", "gma:ibc", "hazard:ehs", "hazard:radiation"), _SECTIONS),
    ("writing_quality", (), ("guidance_section",)),
)


def rules(spark: SparkSession) -> DataFrame:
    """(rule_ord, rule_id, rule_kind, jurisdiction)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_ord int, rule_id string, rule_kind string, jurisdiction string")


def themes(spark: SparkSession) -> DataFrame:
    """(theme_ord, theme, prefixes, doc_types)."""
    return spark.createDataFrame([(i, t, list(p), list(d)) for i, (t, p, d) in enumerate(THEMES)], "theme_ord int, theme string, prefixes array<string>, doc_types array<string>")


def active_themes(pack: str = DEFAULT_PACK) -> list[str]:
    _, without = PACKS.get(pack, PACKS[DEFAULT_PACK])
    return [t for t, *_ in THEMES if t not in without]
