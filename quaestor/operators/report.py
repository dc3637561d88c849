"""From protocols to findings, and from findings to reports, packs and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..plans import experiments as ex
from ..plans import protocols as pr
from ..plans.spec import PROFILES, checks, compiled, let, profile_of
from ..schema import protocol_type
from .reconcile import totals_finding


def rule_id(ref: Column) -> Column:
    """A reference without its experiment; all required:<path> are one rule; what no rule is called is null."""
    base = F.regexp_replace(ref, r":exp-\d+$", "")
    base = F.when(base.startswith("required:"), "required").otherwise(base)
    return F.when(base.isin(*[r for r, _, _ in dims.RULES]), base)


def _all_checks() -> Column:
    """Of a protocol's row, the findings of all rules, whatever they are about: one array, worked out in one pass."""
    exps = F.transform(F.coalesce("experiments", F.array().cast(protocol_type()["experiments"].dataType)), ex.derived)
    about_experiments = lambda all_exps: F.flatten(F.transform(all_exps, lambda x, i: checks(ex.experiment_rules(x), i + 1)))
    people = F.transform(F.coalesce("participants", F.array().cast(protocol_type()["participants"].dataType)), lambda p, i: F.transform(checks(pr.participant_rules(p)), lambda c: c.withField("seq", c["seq"] + (i.cast("long") + 1) * 1000)))
    whole = let(pr.texts(), lambda x: checks(pr.protocol_rules(x)))
    return let(exps, lambda all_exps: F.concat(whole, F.flatten(people), about_experiments(all_exps), pr.survivors(all_exps), totals_finding(F.col("animals_total"), all_exps)))


def with_checks(protocols: DataFrame, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """(protocol_id, profile, checks): a row for each protocol and profile, with its findings (seq, ref, status, severity,
    message, rule_id). One scan, no join and no shuffle; rules are checked once for all profiles. Unknown profiles count as
    the default one."""
    made = protocols.select("protocol_id", compiled(protocols.sparkSession, "checks", _all_checks).alias("_all"))
    profiles = tuple(dict.fromkeys(map(profile_of, profiles)))
    rows = made.select("protocol_id", "_all", F.explode(F.array(*map(F.lit, profiles))).alias("profile"))
    chosen = F.transform("_all", lambda x: F.struct(x["seq"], x["ref"], x["status"], F.when(F.col("profile") == "strict_law", x["strict_law"]).otherwise(x["default"]).alias("severity"), x["message"], x["rule_id"]))
    return rows.select("protocol_id", "profile", chosen.alias("checks"))


def findings(protocols: DataFrame, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """(protocol_id, profile, seq, ref, status, severity, message, rule_id) of all rules. `seq` puts a protocol's rows in
    order; rows may share a reference."""
    return with_checks(protocols, profiles).select("protocol_id", "profile", F.inline("checks"))


def annotate(found: DataFrame) -> DataFrame:
    """Findings with their rule's kind and jurisdiction, null where there is no such rule."""
    return found.join(F.broadcast(dims.rules(found.sparkSession)), "rule_id", "left")


def in_pack(found: DataFrame, pack: str = dims.DEFAULT_PACK) -> DataFrame:
    """Annotated findings whose rule's jurisdiction belongs to the pack; rows without a rule stay. Unknown packs count as
    the default one."""
    jurisdictions, _ = dims.PACKS.get(pack, dims.PACKS[dims.DEFAULT_PACK])
    return found.where(F.col("jurisdiction").isNull() | F.col("jurisdiction").isin(*jurisdictions))


def reports(protocols: DataFrame, pack: str = dims.DEFAULT_PACK, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    """One row for each protocol and profile: status, counters, the ordered checklist and rules left out by the pack. All is
    worked out within the protocol's row."""
    pack = pack if pack in dims.PACKS else dims.DEFAULT_PACK
    used = dims.PACKS[pack][0]
    kind = F.create_map(*[F.lit(x) for r, k, _ in dims.RULES for x in (r, k)])
    outside = [r for r, _, j in dims.RULES if j not in used]
    kept = F.filter("checks", lambda x: ~F.coalesce(x["rule_id"].isin(*outside), F.lit(False))) if outside else F.col("checks")
    listed = F.array_sort(F.transform(kept, lambda x: F.struct(x["seq"], x["status"], x["message"], x["severity"], x["ref"], x["rule_id"], F.element_at(kind, x["rule_id"]).alias("rule_kind"))))
    rows = with_checks(protocols, profiles).select("protocol_id", "profile", listed.alias("checklist"))
    error = lambda x: (x["status"] == "fail") & (x["severity"] == "error")
    warned = lambda x: (x["status"] == "fail") & (x["severity"] != "error")
    # By category, structural and law-critical rows count as errors, advisory ones as no errors.
    tests = {
        "errors": error, "warnings": warned, "structural_errors": lambda x: error(x) & (x["rule_kind"] == "structural"), "law_critical_errors": lambda x: error(x) & (x["rule_kind"] == "law_critical"),
        "advisory_warnings": lambda x: warned(x) & (x["rule_kind"] == "advisory"),
    }
    made = rows.select("*", *[F.size(F.filter("checklist", test)).cast("long").alias(name) for name, test in tests.items()])
    return made.withColumns({"status": F.when(F.col("errors") == 0, "pass").otherwise("fail"), "jurisdiction": F.lit(pack), "ruleset_version": F.lit(dims.RULESET_VERSION), "rules_outside_pack": F.lit(len(outside))})


def base_refs(found: DataFrame) -> DataFrame:
    """(protocol_id, profile, refs): sorted distinct references of failing rows, without experiments."""
    base = F.regexp_replace("ref", r":exp-.*$", "")
    return found.where("status = 'fail'").groupBy("protocol_id", "profile").agg(F.array_sort(F.collect_set(base)).alias("refs"))


def top(found: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values among failing rows, ties by value."""
    return found.where("status = 'fail'").groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def coverage(found: DataFrame) -> DataFrame:
    """(rule_id, n_fires, n_appears): protocols on which a rule fails, and on which it gives any row, under any profile."""
    seen = found.where("rule_id is not null").groupBy("rule_id").agg(
        F.count_distinct(F.when(F.col("status") == "fail", F.col("protocol_id"))).alias("n_fires"), F.count_distinct("protocol_id").alias("n_appears")
    )
    return dims.rules(found.sparkSession).select("rule_id").join(seen, "rule_id", "left").fillna(0)


def coverage_gaps(found: DataFrame) -> DataFrame:
    """Rules that give no row at all."""
    return dims.rules(found.sparkSession).select("rule_id").join(found.select("rule_id").distinct(), "rule_id", "left_anti")


def with_prefixes(found: DataFrame, prefixes: list[str]) -> DataFrame:
    """Findings whose reference starts with one of the prefixes; an empty list keeps all."""
    if not prefixes:
        return found
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("ref").startswith(p)
    return found.where(keep)


def lint(protocols: DataFrame, profiles: tuple[str, ...] = PROFILES, pack: str = dims.DEFAULT_PACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, reports, signals) of protocols."""
    found = findings(protocols, profiles)
    return found, reports(protocols, pack, profiles), ex.signals(ex.experiments(protocols))


def feature_summary(protocols: DataFrame) -> DataFrame:
    """(protocol_id, n_total_all_experiments, num_experiments, sexes_seen, single_sex_design, is_colony, alternatives_present,
    engines_count, queries_count, conclusion_length): what prompts and dashboards ask of a protocol, within its row."""
    found = F.coalesce("experiments", F.array().cast(protocols.schema["experiments"].dataType))
    sexes = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda e: e["animals"]["sex"]), lambda x: x != "")))
    search = F.col("alternatives_search")
    counted = lambda name: F.coalesce(F.size(search[name]), F.lit(0))
    return protocols.select(
        "protocol_id", F.aggregate(found, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(e["animals"]["n"], F.lit(0))).alias("n_total_all_experiments"), F.size(found).alias("num_experiments"), sexes.alias("sexes_seen"),
        ((F.size(sexes) == 1) & F.get(sexes, F.lit(0)).isin("M", "F")).alias("single_sex_design"), F.coalesce("is_colony", F.lit(False)).alias("is_colony"),
        (F.to_json(search) != "{}").alias("alternatives_present"), counted("engines").alias("engines_count"), counted("queries").alias("queries_count"), F.length(F.trim(F.coalesce(search["conclusion"], F.lit("")))).alias("conclusion_length"),
    ).withColumns({"single_sex_design": F.coalesce("single_sex_design", F.lit(False)), "alternatives_present": F.coalesce("alternatives_present", F.lit(False))})
