"""Truth tables of the rules on minimal protocols, and invariants of reports."""

import json

import pytest

from quaestor import dims
from quaestor.operators import report
from quaestor.schema import protocols_of

E = "experiments"


def exp(**more):
    base = {
        "label": "a", "question": "b", "animals": {"species": "mouse", "strain": "x", "sex": "M", "genetic_status": "wt", "n": 10}, "severity_level_1_to_5": 2,
        "euthanasia": {"primary": "barbiturate", "confirmation": "cervical dislocation"}, "monitoring": {"documentation": "daily pain score, vet consultation"},
    }
    return base | more


def protocol(experiments=None, **more):
    return {E: [exp()] if experiments is None else experiments, "alternatives_search": {"engines": ["PubMed"], "queries": ["q"], "conclusion": "none"}} | more


CASES = [
    # (rule, protocol that fails it, protocol that does not)
    ("header", protocol(), protocol(header={})),
    ("required", protocol(header={"protocol_id": "1"}), protocol(header={"protocol_id": "1", "institution": ""})),
    ("title:track", protocol(research={"request_type": "regular", "title_en": "A Pilot"}), protocol(research={"request_type": "regular", "title_en": "A"})),
    ("title:pilot-label", protocol(research={"request_type": "pilot"}), protocol(research={"request_type": "pilot", "title_he": "פיילוט"})),
    ("term:track", protocol(research={"request_type": "regular", "approval_term_years": 7}), protocol(research={"request_type": "pilot", "approval_term_years": 1})),
    ("continuation", protocol(research={"is_continuation": True}), protocol(research={"is_continuation": True, "prior_protocol_id": "p", "continuation_reason": "r"})),
    ("third-party", protocol(research={"third_party_service": True}), protocol(research={"third_party_service": False})),
    ("pi:training", protocol(pi={"email": "x"}), protocol(pi={"email": "x", "training": [{"cert_no": "1"}]})),
    ("participant:training", protocol(participants=[{"role": "performs_procedures"}]), protocol(participants=[{"role": "participant"}])),
    ("participant:certified-without-training", protocol(participants=[{"certified": True}]), protocol(participants=[{"certified": True, "training": [{}]}])),
    ("animals:totals-vs-exps", protocol(animals_total=[{"species": "mouse", "n_total": 11}]), protocol(animals_total=[{"species": "mouse", "n_total": 10}])),
    ("scope:pilot-size", protocol(research={"request_type": "pilot"}, animals_total=[{"n_total": 501}]), protocol(research={"request_type": "pilot"}, animals_total=[{"n_total": 500}])),
    ("sex:rationale", protocol(), protocol([exp(rationale_species_strain_sex="only males: hormones")])),
    ("sex:sabv", protocol([exp(rationale_species_strain_sex="males for convenience, estrous")]), protocol([exp(rationale_species_strain_sex="estrous cycle")])),
    ("N:justification-detail", protocol(animals_total=[{"n_total": 600}]), protocol(animals_total=[{"n_total": 600}], n_justification={"details": "x" * 80})),
    ("N:power-analysis", protocol(animals_total=[{"n_total": 60}]), protocol(animals_total=[{"n_total": 60}], n_justification={"method": "power"})),
    ("euthanasia:CO2", protocol([exp(euthanasia={"primary": "CO2"})]), protocol([exp(euthanasia={"primary": "CO₂", "confirmation": "yes"})])),
    ("euthanasia:overdose-confirm", protocol([exp(euthanasia={"primary": "isoflurane"})]), protocol([exp(euthanasia={"primary": "isoflurane", "confirmation": "x"})])),
    ("special:neonatal-CO2", protocol([exp(label="P2 pups", euthanasia={"primary": "CO2"})]), protocol([exp(label="P2 pups", animals={"species": "mouse", "age": {"value": 3, "unit": "weeks"}}, euthanasia={"primary": "CO2"})])),
    ("euthanasia:species-method", protocol([exp(animals={"species": "zebrafish"}, euthanasia={"primary": "CO2"})]), protocol([exp(animals={"species": "dog"}, euthanasia={"primary": "CO2"})])),
    ("euthanasia:precharged-chamber", protocol([exp(euthanasia={"primary": "CO2", "parameters": "prefilled box"})]), protocol([exp(euthanasia={"primary": "CO2"})])),
    ("euthanasia:displacement-rate", protocol([exp(euthanasia={"primary": "CO2", "parameters": "100% CO2"})]), protocol([exp(euthanasia={"primary": "CO2", "parameters": "30% per minute"})])),
    ("euthanasia:secondary-method", protocol([exp(euthanasia={"primary": "CO2"})]), protocol([exp(euthanasia={"primary": "CO2", "confirmation": "decapitation"})])),
    ("euthanasia:cervical-weight", protocol([exp(animals={"species": "rat"}, euthanasia={"primary": "cervical dislocation"})]), protocol([exp(animals={"species": "rat", "weight": {"value": 0.2, "unit": "kg"}}, euthanasia={"primary": "cervical dislocation"})])),
    ("euthanasia:conditions-missing", protocol([exp(euthanasia={"primary": "decapitation"})]), protocol([exp(euthanasia={"primary": "decapitation", "parameters": "trained staff"})])),
    ("severity:monitoring", protocol([exp(severity_level_1_to_5=4)]), protocol([exp(severity_level_1_to_5=4, monitoring={"parameters": ["every 24 h"]})])),
    ("severity:analgesia", protocol([exp(severity_level_1_to_5=3, label="surgery")]), protocol([exp(severity_level_1_to_5=3, label="surgery", analgesia=[{"agent": "x"}])])),
    ("paralytic:without-anesthesia", protocol([exp(procedure_timeline=[{"step": "Rocuronium"}])]), protocol([exp(procedure_timeline=[{"step": "Rocuronium and isoflurane"}])])),
    ("pain:category-consistency", protocol([exp(pain_category="C", label="burn")]), protocol([exp(pain_category="E", label="burn")])),
    ("endpoints:generic-consult", protocol([exp(humane_endpoints={"general": ["Consult the vet"]})]), protocol([exp(humane_endpoints={"general": ["Consult the vet at score 3"]})])),
    ("endpoints:20%-only", protocol([exp(humane_endpoints={"general": ["20% loss"]})]), protocol([exp(humane_endpoints={"general": ["20% loss", "hunched"]})])),
    ("endpoints:death-only", protocol([exp(humane_endpoints={"specific": ["death"]})]), protocol([exp(humane_endpoints={"specific": ["death", "body weight"]})])),
    ("postop:monitoring", protocol([exp(label="surgery", monitoring={})]), protocol([exp(label="surgery", fate="euthanized", monitoring={})])),
    ("vet:consultation", protocol([exp(severity_level_1_to_5=5, monitoring={})]), protocol([exp(severity_level_1_to_5=5)])),
    ("surgery:multiple-survival", protocol([exp(), exp()]), protocol([exp(), exp(fate="euthanized")])),
    ("housing:density", protocol([exp(housing_density={"cage_floor_area_cm2": 500, "animals_per_enclosure": 10})]), protocol([exp(housing_density={"cage_floor_area_cm2": 800, "animals_per_enclosure": 10})])),
    ("restraint:duration", protocol([exp(restraint={"used": True})]), protocol([exp(restraint={"used": False})])),
    ("reuse:justification", protocol([exp(reuse_or_prior_procedures={"has_prior": True})]), protocol([exp(reuse_or_prior_procedures={"has_prior": True}, reuse_review={"prior_severity": "mild", "fully_recovered": True, "new_procedure_severity": "mild", "vet_consulted": True})])),
    ("permits:field-study", protocol([exp(label="wildlife")]), protocol([exp(label="wildlife", field_study_permits={"collection_permit_ids": "1", "field_euthanasia_method": "m"})])),
    ("deprivation:protocol", protocol([exp(procedure_timeline=[{"step": "Fasting"}])]), protocol([exp(procedure_timeline=[{"step": "Fasting"}], monitoring={"documentation": "body weight"})])),
    ("gma:ibc", protocol([exp(animals={"genetic_status": "KO"})]), protocol([exp(animals={"genetic_status": "non transgenic"})])),
    ("ascites:in-vitro", protocol([exp(procedure_timeline=[{"step": "ascites"}])]), protocol()),
    ("alts:missing", protocol(alternatives_search={}), protocol()),
    ("alts:engines", protocol(alternatives_search={"queries": ["q"]}), protocol()),
    ("alts:queries", protocol(alternatives_search={"engines": ["e"]}), protocol(alternatives_search={"engines": ["Good Search Practice on Animal Alternative-EU "]})),
    ("alts:conclusion", protocol(alternatives_search={"engines": ["e"]}), protocol()),
    ("cosmetics:ban", protocol(summaries={"scientific_en_≤300w": "a new shampoo"}), protocol(summaries={"scientific_en_≤300w": "after cosmetic surgery"})),
    ("colony:breeding-plan", protocol(is_colony=True), protocol(is_colony=True, n_justification={"details": "surplus"})),
    ("colony:no-invasive", protocol([exp(procedure_timeline=[{"step": "DBS"}])], is_colony=True), protocol(is_colony=True)),
    ("special:stereotaxic", protocol([exp(label="DBS")]), protocol([exp(label="DBS", stereotaxic_implant={"craniotomy": False})])),
    ("special:oncology", protocol([exp(label="tumor")]), protocol([exp(label="tumor necrosis factor")])),
    ("special:diabetes", protocol([exp(label="diabetes")]), protocol([exp(label="diabetes", diabetes={"measurement": "fasted"})])),
    ("special:biosafety", protocol([exp(label="AAV")]), protocol([exp(label="moloney murine leukemia virus reverse transcriptase")])),
    ("special:nanomaterials", protocol([exp(label="nanoparticle")]), protocol([exp(label="nanoparticle", nanomaterials={"particle_type": "x"})])),
    ("special:ocular", protocol([exp(label="retina")]), protocol([exp(label="retina", ocular_procedures={"ocular_lubrication": "x"})])),
    ("summaries:lay-length", protocol(summaries={"lay_he_≤150w": "מילה " * 151}), protocol(summaries={"lay_he_≤150w": "מילה " * 150})),
    ("summaries:scientific-length", protocol(summaries={"scientific_en_≤300w": "word " * 2501}), protocol(summaries={"scientific_en_≤300w": "word " * 2500})),
]


@pytest.fixture(scope="module")
def found(spark):
    instances = [(f"{i}-{kind}", json.dumps(p)) for i, (_, *both) in enumerate(CASES) for kind, p in zip(("bad", "good"), both)]
    protocols = protocols_of(spark, instances).cache()
    rows = report.findings(protocols).cache()
    return protocols, rows, rows.collect()


def test_each_rule_fires_and_spares(found):
    failing = {}
    for r in found[2]:
        if r.status == "fail" and r.profile == "default":
            failing.setdefault(r.protocol_id, set()).add(r.rule_id)
    wrong = [(rule, kind) for i, (rule, *_) in enumerate(CASES) for kind, want in (("bad", True), ("good", False)) if (rule in failing.get(f"{i}-{kind}", set())) != want]
    assert not wrong


def test_all_rules_are_known(found):
    assert {r for r, _, _ in dims.RULES} - {c[0] for c in CASES} <= {"research", "pi"}
    assert all(r.rule_id for r in found[2])


def test_strict_profile_has_all_findings_and_more_errors(found):
    by = {p: sorted((r.protocol_id, r.seq, r.ref, r.status) for r in found[2] if r.profile == p) for p in ("default", "strict_law")}
    assert by["default"] == by["strict_law"]
    errors = {p: sum(r.severity == "error" for r in found[2] if r.profile == p) for p in by}
    assert errors["strict_law"] > errors["default"]


def test_counters_are_those_of_the_checklist(found):
    protocols, rows, _ = found
    made = report.reports(protocols).collect()
    assert len(made) == 2 * 2 * len(CASES)
    for r in made:
        failing = [c for c in r.checklist if c.status == "fail"]
        assert (r.errors, r.warnings) == (sum(c.severity == "error" for c in failing), sum(c.severity != "error" for c in failing))
        assert r.status == ("pass" if not r.errors else "fail") and r.rules_outside_pack == 0
        assert [c.seq for c in r.checklist] == sorted(c.seq for c in r.checklist)
    generic = report.reports(protocols, "generic").collect()
    left_out = {r for r, _, j in dims.RULES if j == "IL-form"}
    assert all(c.rule_id not in left_out for r in generic for c in r.checklist) and {r.rules_outside_pack for r in generic} == {len(left_out)}


def test_order_does_not_depend_on_partitions(spark, found):
    protocols, _, rows = found
    again = report.findings(protocols.repartition(7)).collect()
    key = lambda r: (r.protocol_id, r.profile, r.seq, r.ref)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_coverage_and_refs(found):
    _, rows, plain = found
    cover = {r.rule_id: r for r in report.coverage(rows).collect()}
    assert len(cover) == len(dims.RULES) and all(cover[c[0]].n_fires >= 1 for c in CASES)
    assert report.coverage_gaps(rows).count() == sum(not c.n_appears for c in cover.values())
    refs = {(r.protocol_id, r.profile): r.refs for r in report.base_refs(rows).collect()}
    for k, own in refs.items():
        assert own == sorted({r.ref.split(":exp-")[0] for r in plain if (r.protocol_id, r.profile) == k and r.status == "fail"})
