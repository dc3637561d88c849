"""The canonical protocol: one row per request, with nested experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TRAINING = "ARRAY<STRUCT<cert_no: STRING, issuer: STRING, animal_scope: STRING, date: STRING>>"
_QUANTITY = "STRUCT<value: DOUBLE, unit: STRING>"

EXPERIMENT = f"""STRUCT<
  label: STRING, question: STRING,
  animals: STRUCT<species: STRING, species_standard: STRING, strain: STRING, genetic_status: STRING, sex: STRING, n: INT,
    age: {_QUANTITY}, weight: {_QUANTITY}, source: STRING, supplier: STRING,
    groups: ARRAY<STRUCT<species: STRING, strain: STRING, sex: STRING, n: INT, age: {_QUANTITY}, weight: {_QUANTITY},
      genetic_modification: STRING, source: STRING, supplier: STRING>>>,
  housing: STRUCT<group_housed: BOOLEAN, single_housing_reason: STRING, single_housing_duration_days: DOUBLE,
    enrichment: STRING, enrichment_custom: STRING>,
  housing_density: STRUCT<cage_floor_area_cm2: DOUBLE, animals_per_enclosure: INT, breeding_with_litter: BOOLEAN>,
  rationale_species_strain_sex: STRING,
  procedure_timeline: ARRAY<STRUCT<day_or_timepoint: STRING, step: STRING, route_or_site: STRING, volume_or_dose: STRING,
    device_or_material: STRING>>,
  restraint: STRUCT<used: BOOLEAN, method: STRING, max_duration_minutes: DOUBLE, sessions_per_animal: INT, acclimation: STRING,
    monitoring: STRING, humane_removal_criteria: STRING, food_water_plan: STRING, justification: STRING>,
  analgesia: ARRAY<STRUCT<phase: STRING, agent: STRING, dose: STRING, route: STRING, frequency: STRING>>,
  anesthesia: ARRAY<STRUCT<agent: STRING, rationale: STRING, dose: STRING, frequency: STRING, induction: STRING,
    maintenance: STRING, route: STRING, monitoring: STRING>>,
  anesthesia_drugs: ARRAY<STRUCT<agent: STRING, dose: STRING, route: STRING, frequency: STRING, rationale: STRING,
    induction: STRING, maintenance: STRING, monitoring: STRING, source_text: STRING>>,
  analgesia_used: BOOLEAN, anesthesia_used: BOOLEAN, analgesia_justification_for_omission: STRING,
  n_justification_detail: STRING, regulatory_requirement: BOOLEAN, severity_level_1_to_5: INT, pain_category: STRING,
  pain_category_structured: STRUCT<raw: STRING, parsed: STRING>,
  monitoring: STRUCT<initial_72h_daily: BOOLEAN, ongoing_per_week: INT, parameters: ARRAY<STRING>, documentation: STRING>,
  humane_endpoints: STRUCT<general: ARRAY<STRING>, specific: ARRAY<STRING>>,
  euthanasia: STRUCT<primary: STRING, method_standard: STRING, parameters: STRING, conditions_text: STRING,
    confirmation: STRING, confirmation_details: STRING>,
  reuse_or_prior_procedures: STRUCT<has_prior: BOOLEAN, prior_protocol_ids: ARRAY<STRING>>,
  reuse_review: STRUCT<prior_severity: STRING, fully_recovered: BOOLEAN, new_procedure_severity: STRING, vet_consulted: BOOLEAN>,
  field_study_permits: STRUCT<field_study: BOOLEAN, wildlife: BOOLEAN, collection_permit_ids: STRING, protected_species: BOOLEAN,
    cites_documentation: STRING, wildlife_pathogen_handling: BOOLEAN, biosafety_approval_id: STRING,
    field_euthanasia_method: STRING, field_euthanasia_details: STRING>,
  fate: STRING,
  stereotaxic_implant: STRUCT<used: BOOLEAN, craniotomy: BOOLEAN, implant_type: STRING, periop_antibiotics: STRING,
    warming_and_support: STRING, end_of_study_removal: STRING>,
  oncology: STRUCT<tumor_induction_method: STRING, measurement_method: STRING, measurement_frequency: STRING,
    tumor_burden_cap: STRING, ulceration_policy: STRING>,
  diabetes: STRUCT<measurement: STRING, bg_threshold_mg_dl: INT, frequency: STRING, ketone_or_urine_checks: STRING>,
  biosafety_infectious_agents: STRUCT<used: BOOLEAN, agent_name: STRING, BSL_level: STRING, shedding_risk: STRING, PPE: STRING,
    decontamination_SOP: STRING, waste_handling: STRING, facility_biosafety_approval_id: STRING>,
  nanomaterials: STRUCT<particle_type: STRING, size_distribution_nm: STRING, zeta_potential_mV: STRING, vehicle: STRING,
    exposure_route: STRING, aerosol_controls: STRING>,
  ocular_procedures: STRUCT<topical_anesthesia: STRING, mydriatic: STRING, ocular_lubrication: STRING,
    postop_analgesia_specifics: STRING, vision_function_tests: STRING>>"""

PROTOCOL = f"""
  header STRUCT<protocol_id: STRING, institution: STRING, subcommittee: STRING, export_version: STRING>,
  research STRUCT<title_he: STRING, title_en: STRING, request_type: STRING, is_continuation: BOOLEAN, continuation_reason: STRING,
    prior_protocol_id: STRING, third_party_service: BOOLEAN, approval_term_years: INT, primary_purpose: STRING,
    secondary_purpose: STRING, sites: ARRAY<STRUCT<name: STRING, steps: ARRAY<STRING>>>>,
  pi STRUCT<id_type: STRING, id_number: STRING, last_name_he: STRING, first_name_he: STRING, last_name_en: STRING,
    first_name_en: STRING, faculty: STRING, department: STRING, email: STRING, phone_primary: STRING, phone_secondary: STRING,
    institutional_cert_no: STRING, training: {_TRAINING}>,
  participants ARRAY<STRUCT<family_name: STRING, given_name: STRING, national_id_or_passport: STRING, role: STRING,
    certified: BOOLEAN, training: {_TRAINING}>>,
  third_party STRUCT<sponsor_org: STRING, ordering_investigator_name: STRING, sponsor_approver_name: STRING,
    declaration_url: STRING, contract_number: STRING, data_rights_note: STRING>,
  summaries STRUCT<`scientific_en_≤300w`: STRING, `lay_he_≤150w`: STRING, _sub_questions: MAP<STRING, STRING>>,
  alternatives_search STRUCT<engines: ARRAY<STRING>, date: STRING, queries: ARRAY<STRING>, conclusion: STRING,
    alternatives_checked: BOOLEAN, preliminary_experiments: STRUCT<had_alternative_methods: BOOLEAN, details: STRING>>,
  animals_total ARRAY<STRUCT<species: STRING, species_standard: STRING, strain: STRING, sex: STRING, genetic_status: STRING,
    source: STRING, supplier: STRING, age: STRING, n_total: INT>>,
  n_justification STRUCT<method: STRING, details: STRING, attachments: ARRAY<STRING>>,
  is_colony BOOLEAN,
  colony_block STRUCT<purpose: STRING, severity_level: INT, genotyping: STRUCT<method: STRING, age_days: STRING, notes: STRING>>,
  experiments ARRAY<{EXPERIMENT}>,
  postmortem_processing STRUCT<used: BOOLEAN, perfusion: STRING, fixation: STRING, clearing_or_special_technique: STRING,
    chemical_safety_notes: STRING>,
  pi_declaration STRUCT<name: STRING, date: STRING, affirmations: ARRAY<STRING>>,
  chair_statement STRUCT<decision: STRING, comments: STRING>"""

#: Blocks and keys whose absence is a finding (fixed values).
REQUIRED = {
    "header": ("protocol_id", "institution"),
    "research": ("title_he", "title_en", "request_type", "is_continuation", "third_party_service", "approval_term_years", "sites"),
    "pi": ("id_type", "id_number", "last_name_he", "first_name_he", "last_name_en", "first_name_en", "email", "phone_primary", "institutional_cert_no"),
}


def protocol_type() -> T.StructType:
    return T.StructType.fromDDL(PROTOCOL)


def missing_keys(json: str):
    """The blocks and required keys (block.key) that a JSON object lacks: absent, where null is not. A block of another kind
    than an object counts as lacking its keys."""
    found = []
    for block, keys in REQUIRED.items():
        inside = F.json_object_keys(F.get_json_object(json, f"$.{block}"))
        found.append(F.when(~F.coalesce(F.array_contains(F.json_object_keys(json), block), F.lit(False)), F.array(F.lit(block))).otherwise(F.array().cast("array<string>")))
        absent = F.array_except(F.array(*map(F.lit, keys)), F.coalesce(inside, F.array().cast("array<string>")))
        found.append(F.transform(absent, _prefixed(block)))
    return F.concat(*found)


def _prefixed(block: str):
    return lambda key: F.concat(F.lit(f"{block}."), key)


def read_protocols(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds the canonical columns and `missing_keys` to rows with a JSON text; what is not an object gives null blocks."""
    parsed = F.from_json(F.col(text), protocol_type(), {"mode": "PERMISSIVE"})
    rows = texts.withColumn("_p", parsed).withColumn("missing_keys", F.coalesce(missing_keys(text), F.array(*map(F.lit, REQUIRED))))
    return rows.select(*[f"`{c}`" for c in texts.columns], "missing_keys", "_p.*")


def skeleton(kind: T.DataType, required_only: bool = False) -> object:
    """The smallest value of a type: empty texts, zeros, empty arrays, structs of such."""
    if isinstance(kind, T.StructType):
        return {f.name: skeleton(f.dataType) for f in kind}
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return [] if isinstance(kind, T.ArrayType) else {}
    return {"string": "", "boolean": False}.get(kind.typeName(), 0)


def protocols_of(spark: SparkSession, instances: list[tuple[str, str]]) -> DataFrame:
    """Protocols from (protocol_id, JSON text) pairs."""
    return read_protocols(spark.createDataFrame(instances, "protocol_id string, text string"))
