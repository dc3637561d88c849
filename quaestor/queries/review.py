"""The rule engine over protocols that are projected from conversations: a turn is an experiment, whose fields follow from
conv_id, turn and the text's length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..operators import reconcile, report
from ..plans import experiments as ex
from ..schema import read_protocols

STEPS = (
    "surgery under isoflurane", "fasting overnight", "tumor implant", "viral vector", "retina imaging", "rocuronium infusion", "behavior test", "ascites tap", "stereotaxic craniotomy", "diabetes model",
    "burn of the skin", "tumor necrosis factor assay", "leukemia virus reverse transcriptase", "nanoparticle gavage",
)
SPECIES = ("mouse", "rat", "zebrafish", "rabbit", "pig", "ferret", "Mice", "guinea pig")
METHODS = ("CO2", "isoflurane", "decapitation", "cervical dislocation", "pentobarbital", "ms-222")
CONFIRM = ("", "decapitation", "checked")
PARAMS = ("30% per min", "100%", "trained staff", "prefilled chamber")
NOTES = ("daily pain score", "", "vet consultation", "body weight and endpoint")
ENDPOINTS = ("death", "20% loss", "20% loss or score", "consult the vet", "10% loss")
FATES = ("euthanized", "released")
CATEGORIES = ("B", "C", "D", "E", "")

#: The projection, as (Spark, DuckDB) of the index into each list.
_AT = {
    "step": (STEPS, "conv_id * 7 + turn * 3"), "species": (SPECIES, "conv_id + turn * 4"), "method": (METHODS, "conv_id + turn"), "confirm": (CONFIRM, "turn + len"), "params": (PARAMS, "len"),
    "note": (NOTES, "conv_id + turn * 2"), "he": (ENDPOINTS, "conv_id + turn * 3"), "fate": (FATES, "turn + conv_id"), "category": (CATEGORIES, "conv_id"),
}


def _pick(name: str) -> Column:
    values, at = _AT[name]
    return F.get(F.array(*map(F.lit, values)), F.expr(f"cast(({at}) % {len(values)} as int)"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").cast("long").alias("len"))
    return rows.select("conv_id", "turn", "role", "len", *[_pick(n).alias(n) for n in _AT], (F.col("turn") % 5 + 1).cast("int").alias("sev"), (F.col("len") % 30).cast("int").alias("n"), F.expr("CASE WHEN conv_id % 3 = 1 AND turn % 2 = 1 THEN 'F' ELSE 'M' END").alias("sex"))


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical protocols, read from the JSON text that the projection writes."""
    e = F.struct(
        F.col("turn"), F.col("role").alias("label"), F.array(F.struct(F.col("step"))).alias("procedure_timeline"), F.col("sev").alias("severity_level_1_to_5"), F.col("category").alias("pain_category"), F.col("fate"),
        F.struct(F.col("species"), F.col("sex"), F.col("n"), F.lit("s").alias("strain"), F.lit("wt").alias("genetic_status")).alias("animals"),
        F.struct(F.col("method").alias("primary"), F.col("confirm").alias("confirmation"), F.col("params").alias("parameters")).alias("euthanasia"),
        F.struct(F.col("note").alias("documentation")).alias("monitoring"), F.struct(F.array(F.col("he")).alias("general")).alias("humane_endpoints"),
    )
    whole = turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(e)).alias("experiments"))
    # Totals: one row per species, one animal too many in each seventh protocol.
    sums = F.transform(F.array_sort(F.array_distinct(F.transform("experiments", lambda x: x["animals"]["species"]))), lambda s: F.struct(s.alias("species"), (F.aggregate(F.filter("experiments", lambda x: x["animals"]["species"] == s), F.lit(0), lambda a, x: a + x["animals"]["n"]) + F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0)).alias("n_total")))
    whole = whole.withColumn("animals_total", sums)
    engines = F.when(F.col("conv_id") % 3 > 0, F.array(F.lit("PubMed")))
    queries = F.when(F.col("conv_id") % 3 == 2, F.array(F.lit("q")))
    alternatives = F.struct(engines.alias("engines"), queries.alias("queries"), F.when(F.col("conv_id") % 3 == 2, "none").alias("conclusion"))
    text = F.to_json(F.struct("experiments", "animals_total", alternatives.alias("alternatives_search")))
    return read_protocols(whole.select(F.col("conv_id").cast("string").alias("protocol_id"), text.alias("text"))).drop("text")


def has(column: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _any(column: str, name: str) -> str:
    return has(column, *dims.KEYWORDS[name])


def _matrix() -> str:
    rows = []
    for s, (good, conditional, bad) in dims.SPECIES_METHODS.items():
        for m in dims.METHOD_ALIASES:
            status = "unacceptable" if m in bad else "conditional" if m in conditional else "acceptable" if m in good else "unacceptable"
            rows.append(f"('{s}', '{m}', '{status}', {str(conditional.get(m, False)).lower()})")
    return ", ".join(rows)


_MENTION = r"(^|[^\p{L}\p{N}_])(burn|flap)(s|ed|ing)?($|[^\p{L}\p{N}_])"
EXPERIMENTS = f"""
t AS (
  SELECT conv_id, turn, role, length(text) AS len FROM conversations
), p AS (
  SELECT *, {', '.join(f"{_sql_list(v)}[CAST(({at}) % {len(v)} AS INT) + 1] AS {n}" for n, (v, at) in _AT.items())},
         turn % 5 + 1 AS sev, len % 30 AS n, CASE WHEN conv_id % 3 = 1 AND turn % 2 = 1 THEN 'F' ELSE 'M' END AS sex,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx
  FROM t
), m(species_key, method_key, status, remaining) AS (VALUES {_matrix()}),
e AS (
  SELECT p.*, role || '  ' || step AS joined,
         CASE species WHEN 'Mice' THEN 'mouse' WHEN 'guinea pig' THEN 'guinea_pig' WHEN 'ferret' THEN NULL ELSE species END AS species_key,
         CASE method WHEN 'isoflurane' THEN 'inhalant_overdose' WHEN 'cervical dislocation' THEN 'cervical_dislocation' WHEN 'pentobarbital' THEN 'barbiturate' WHEN 'ms-222' THEN 'MS-222' ELSE method END AS method_key
  FROM p
), x AS (
  SELECT e.*, m.status, coalesce(m.remaining, false) AS remaining, params || ' ' || confirm AS eu FROM e LEFT JOIN m USING (species_key, method_key)
)"""
#: Of each rule that the projection can fire: severity, what it applies to, whether it holds, and whether passes show.
CHECKS = (
    ("euthanasia:CO2", "W/E", "method_key = 'CO2'", f"confirm <> '' OR {has('step', 'anesthe')}", False),
    ("euthanasia:overdose-confirm", "W/E", "method_key = 'inhalant_overdose'", "confirm <> ''", True),
    ("euthanasia:species-method", "E", "status = 'unacceptable'", "false", False),
    ("euthanasia:precharged-chamber", "E", "method_key = 'CO2'", f"NOT {_any('eu', 'precharged')}", False),
    ("euthanasia:displacement-rate", "W/E", "method_key = 'CO2' AND species_key IN ('mouse', 'rat', 'guinea_pig', 'rabbit', 'pig')", "params = '30% per min'", False),
    ("euthanasia:secondary-method", "W/E", "method_key IN ('CO2', 'inhalant_overdose') AND species_key IS NOT NULL", _any("eu", "physical"), False),
    ("euthanasia:cervical-weight", "W/E", "method_key = 'cervical_dislocation' AND species_key IN ('rat', 'rabbit')", "false", False),
    ("euthanasia:conditions-missing", "W/E", "status = 'conditional' AND remaining", _any("eu || ' ' || step", "conditions"), False),
    ("severity:monitoring", "E", "sev >= 4", "false", True),
    ("severity:analgesia", "E", f"sev >= 3 AND {_any('joined', 'invasive')}", "false", False),
    ("paralytic:without-anesthesia", "W/E", _any("joined", "paralytic"), _any("step", "anesthetic"), False),
    (
        "pain:category-consistency", "W/E", "true",
        f"""NOT (CASE WHEN category <> '' THEN (category IN ('B', 'C') AND (mod OR sev_w)) OR (category = 'D' AND sev_w) ELSE (sev <= 2 AND mod) OR (sev <= 3 AND sev_w) END)""", False,
    ),
    ("endpoints:generic-consult", "W", "contains(he, 'consult') AND contains(he, 'vet')", _any("he", "quantified"), False),
    ("endpoints:20%-only", "W/E", "contains(he, '20%') AND NOT contains(he, '10%')", _any("he", "clinical"), False),
    ("endpoints:death-only", "W/E", _any("he", "death"), _any("he", "score"), False),
    ("postop:monitoring", "W/E", f"NOT (fate = 'euthanized' AND NOT {_any('joined', 'recovery')}) AND {_any('joined', 'surgery')}", _any("note", "postop"), False),
    ("vet:consultation", "W", "sev >= 4", _any("note", "vet"), False),
    ("deprivation:protocol", "W", _any("step", "deprivation"), _any("note", "weight"), False),
    ("ascites:in-vitro", "W", "contains(step, 'ascites')", "false", False),
    ("special:stereotaxic", "W", _any("joined", "stereotaxic"), "false", True),
    ("special:oncology", "W", _any("replace(joined, 'tumor necrosis factor', ' ')", "oncology"), "false", True),
    ("special:diabetes", "W", _any("joined", "diabetes"), "false", True),
    ("special:biosafety", "W", f"step <> 'leukemia virus reverse transcriptase' AND {_any('joined', 'biosafety')}", "false", True),
    ("special:nanomaterials", "W", _any("joined", "nanomaterials"), "false", True),
    ("special:ocular", "W", _any("joined", "ocular"), "false", True),
)
_LONG = tuple(t for t in dims.KEYWORDS["moderate"] if len(t) >= 5), tuple(t for t in dims.KEYWORDS["severe"] if len(t) >= 5)
_FOUND = " UNION ALL ".join(
    f"SELECT conv_id, idx, '{r}' AS rule, '{s}' AS sev_kind, ({ok}) AS ok FROM y WHERE ({applies})" + ("" if shows else f" AND NOT ({ok})") for r, s, applies, ok, shows in CHECKS
)
FINDINGS = f"""{EXPERIMENTS}, y AS (
  SELECT *, {has('joined', *_LONG[0])} OR regexp_matches(joined, '{_MENTION.replace("burn|", "")}') AS mod, {has('joined', *_LONG[1])} OR regexp_matches(joined, '{_MENTION.replace("|flap", "")}') AS sev_w FROM x
), f AS ({_FOUND}), profiles(profile) AS (VALUES ('default'), ('strict_law')),
exp_rows AS (
  SELECT CAST(conv_id AS VARCHAR) AS protocol_id, profile, rule || ':exp-' || idx AS ref, rule AS rule_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status,
         CASE WHEN sev_kind = 'E' OR (sev_kind = 'W/E' AND profile = 'strict_law') THEN 'error' ELSE 'warning' END AS severity
  FROM f, profiles
)"""
WHOLE = f"""{FINDINGS}, c AS (
  SELECT conv_id, sum(n) AS n, count(DISTINCT sex) AS sexes, sum(CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END) FILTER (first_of) AS extra
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, species ORDER BY idx) = 1 AS first_of FROM x) GROUP BY conv_id
), alive AS (
  SELECT conv_id, species FROM x WHERE fate <> 'euthanized' GROUP BY conv_id, species HAVING count(*) > 1
), pr AS (
  SELECT conv_id, unnest(['header', 'research', 'pi']) AS rule, 'E' AS sev_kind, false AS ok FROM c
  UNION ALL SELECT conv_id, 'animals:totals-vs-exps', 'E', conv_id % 7 <> 0 FROM c
  UNION ALL SELECT conv_id, unnest(['sex:rationale', 'sex:sabv']), 'W', false FROM c WHERE sexes = 1
  UNION ALL SELECT conv_id, 'N:justification-detail', 'W', false FROM c WHERE n + coalesce(extra, 0) >= 500
  UNION ALL SELECT conv_id, 'N:power-analysis', 'W', false FROM c WHERE n + coalesce(extra, 0) > 50
  UNION ALL SELECT conv_id, 'alts:missing', 'W/E', false FROM c WHERE conv_id % 3 = 0
  UNION ALL SELECT conv_id, unnest(['alts:queries', 'alts:conclusion']), 'W', false FROM c WHERE conv_id % 3 = 1
  UNION ALL SELECT conv_id, 'surgery:multiple-survival', 'W', false FROM alive
), found AS (
  SELECT * FROM exp_rows UNION ALL
  SELECT CAST(conv_id AS VARCHAR), profile, rule, rule, CASE WHEN ok THEN 'pass' ELSE 'fail' END, CASE WHEN sev_kind = 'E' OR (sev_kind = 'W/E' AND profile = 'strict_law') THEN 'error' ELSE 'warning' END FROM pr, profiles
), rules(rule_id, kind, jurisdiction) AS (VALUES {', '.join(f"('{r}', '{k}', '{j}')" for r, k, j in dims.RULES)})"""


def _with(body: str, select: str) -> str:
    return f"WITH {body.strip()}\n{select}"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings(protocols(spark, sf_dir))


def findings_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings(protocols(spark, sf_dir), ("default",)).select("protocol_id", "ref", "rule_id", "status", "severity")


def findings_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings(protocols(spark, sf_dir), ("strict_law",)).select("protocol_id", "ref", "rule_id", "status", "severity")


def _counters(spark: SparkSession, sf_dir: str, pack: str) -> DataFrame:
    rows = protocols(spark, sf_dir)
    made = report.reports(rows, pack)
    return made.select("protocol_id", "profile", "status", "errors", "warnings", "structural_errors", "law_critical_errors", "advisory_warnings", F.size("checklist").cast("long").alias("n_rows"))


def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir, "IL")


def report_generic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir, "generic")


_COUNTERS = """SELECT protocol_id, profile, CASE WHEN count(*) FILTER (status = 'fail' AND severity = 'error') = 0 THEN 'pass' ELSE 'fail' END AS status,
  count(*) FILTER (status = 'fail' AND severity = 'error') AS errors, count(*) FILTER (status = 'fail' AND severity <> 'error') AS warnings,
  count(*) FILTER (status = 'fail' AND severity = 'error' AND kind = 'structural') AS structural_errors,
  count(*) FILTER (status = 'fail' AND severity = 'error' AND kind = 'law_critical') AS law_critical_errors,
  count(*) FILTER (status = 'fail' AND severity <> 'error' AND kind = 'advisory') AS advisory_warnings, count(*) AS n_rows
FROM found JOIN rules USING (rule_id) {where} GROUP BY ALL"""


def top_failing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(_found(spark, sf_dir), "ref", 15)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocols(spark, sf_dir)
    return report.reports(rows).groupBy("profile", "status").agg(F.count("*").alias("n"))


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(_found(spark, sf_dir), "rule_id", 10)


def top_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(_found(spark, sf_dir), "message", 10)


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage(_found(spark, sf_dir))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_gaps(_found(spark, sf_dir))


def base_refs_per_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.base_refs(_found(spark, sf_dir)).select("protocol_id", "profile", F.array_join("refs", "|").alias("refs"))


def theme_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows by theme, through the themes' reference prefixes."""
    failing = _found(spark, sf_dir).where("status = 'fail'").groupBy("ref").agg(F.count("*").alias("n"))
    themes = dims.themes(spark).where(F.col("theme").isin(dims.active_themes("generic")))
    hit = F.exists("prefixes", lambda p: F.startswith(F.col("ref"), p)) | (F.size("prefixes") == 0)
    return failing.join(F.broadcast(themes), hit).groupBy("theme").agg(F.sum("n").alias("n"))


def experiment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ex.signals(ex.experiments(protocols(spark, sf_dir)))
    return made.select(
        "protocol_id", F.col("exp_idx").cast("long").alias("exp_idx"), F.col("severity").cast("long").alias("severity"), "has_humane_endpoints", "humane_endpoints_20_percent_only", "species_normalized", "method_status",
        F.col("specialty_flags.oncology_context").alias("oncology_context"), F.col("specialty_flags.ocular_context").alias("ocular_context"),
    )


def species_method_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    species, method = tx.species_key(F.lit(None).cast("string"), F.col("species")), tx.method_key(F.lit(None).cast("string"), F.col("method"))
    return rows.select("species", "method", tx.method_status(species, method).alias("status")).groupBy("species", "method", "status").agg(F.count("*").alias("n"))


def totals_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocols(spark, sf_dir)
    exps = ex.experiments(rows).select("protocol_id", *[F.col(f"e.animals.{k}").alias(k) for k in reconcile.KEYS], F.col("e.animals.n").alias("n"))
    return reconcile.simplified_mismatches(rows.select("protocol_id", F.inline("animals_total")), exps)


def surviving_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.findings(protocols(spark, sf_dir), ("default",)).where("rule_id = 'surgery:multiple-survival'")
    return found.groupBy("protocol_id").agg(F.count("*").alias("n_groups"))


_FAIL = "FROM found WHERE status = 'fail'"
QUERIES = {
    f.__name__: f
    for f in (
        report_counters, findings_default, findings_strict, report_generic_pack, top_failing_refs, status_counts, top_rules, top_messages, rule_coverage, coverage_gaps, base_refs_per_protocol, theme_findings, experiment_signals,
        species_method_status, totals_simplified, surviving_groups,
    )
}
ORACLE_SQL = {
    "report_counters": _with(WHOLE, _COUNTERS.format(where="")),
    "report_generic_pack": _with(WHOLE, _COUNTERS.format(where="WHERE jurisdiction = 'generic'")),
    "findings_default": _with(WHOLE, "SELECT protocol_id, ref, rule_id, status, severity FROM found WHERE profile = 'default'"),
    "findings_strict": _with(WHOLE, "SELECT protocol_id, ref, rule_id, status, severity FROM found WHERE profile = 'strict_law'"),
    "top_failing_refs": _with(WHOLE, f"SELECT ref, count(*) AS n {_FAIL} GROUP BY ref ORDER BY n DESC, ref LIMIT 15"),
    "top_rules": _with(WHOLE, f"SELECT rule_id, count(*) AS n {_FAIL} GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10"),
    "status_counts": _with(WHOLE, f"SELECT profile, status, count(*) AS n FROM ({_COUNTERS.format(where='')}) GROUP BY ALL"),
    "rule_coverage": _with(WHOLE, "SELECT rule_id, count(DISTINCT protocol_id) FILTER (status = 'fail') AS n_fires, count(DISTINCT protocol_id) AS n_appears FROM rules LEFT JOIN found USING (rule_id) GROUP BY rule_id"),
    "coverage_gaps": _with(WHOLE, "SELECT rule_id FROM rules ANTI JOIN found USING (rule_id)"),
    "base_refs_per_protocol": _with(WHOLE, f"SELECT protocol_id, profile, array_to_string(list_sort(list_distinct(list(rule_id))), '|') AS refs {_FAIL} GROUP BY ALL"),
    "theme_findings": _with(
        WHOLE + f", themes(theme, prefix) AS (VALUES {', '.join(f"('{t}', '{p}')" for t, ps, _ in dims.THEMES if t != 'writing_quality' for p in ps)})",
        "SELECT theme, count(*) AS n FROM (SELECT DISTINCT theme, protocol_id, profile, ref, k FROM (SELECT *, row_number() OVER () AS k FROM found WHERE status = 'fail') AS g, themes WHERE starts_with(ref, prefix)) GROUP BY theme",
    ),
    "experiment_signals": _with(
        EXPERIMENTS,
        f"""SELECT CAST(conv_id AS VARCHAR) AS protocol_id, idx AS exp_idx, sev AS severity, true AS has_humane_endpoints, he = '20% loss' AS humane_endpoints_20_percent_only, species_key AS species_normalized, status AS method_status,
            {_any('joined', 'oncology')} AS oncology_context, {_any('joined', 'ocular')} AS ocular_context FROM x""",
    ),
    "species_method_status": _with(EXPERIMENTS, "SELECT species, method, status, count(*) AS n FROM x GROUP BY ALL"),
    "totals_simplified": _with(
        EXPERIMENTS,
        "SELECT CAST(conv_id AS VARCHAR) AS protocol_id, species, CAST(sum(n) + 1 AS BIGINT) AS n_total, CAST(sum(n) AS BIGINT) AS n_details FROM x WHERE conv_id % 7 = 0 GROUP BY conv_id, species",
    ),
    "surviving_groups": _with(WHOLE, "SELECT CAST(conv_id AS VARCHAR) AS protocol_id, count(*) AS n_groups FROM alive GROUP BY conv_id"),
}
