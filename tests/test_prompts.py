import json

from quaestor.dims import THEMES
from quaestor.operators import prompts, report
from quaestor.schema import protocols_of

PROTOCOL = {
    "pi": {"email": "marker@x.y", "id_number": "MARKER", "training": [{"cert_no": "7"}]},
    "participants": [{"family_name": "MARKER", "national_id_or_passport": "MARKER", "role": "performs_procedures", "certified": True}],
    "experiments": [{"label": "MARKER", "question": "why", "euthanasia": {"primary": "CO2"}, "animals": {"species": "mouse"}}], "n_justification": {"details": "enough"},
}


def test_slices_hold_no_identity(spark):
    rows = prompts.slices(protocols_of(spark, [("p", json.dumps(PROTOCOL))])).collect()
    assert [r.theme for r in sorted(rows, key=lambda r: r.theme_ord)] == [t for t, *_ in THEMES]
    assert not any("MARKER" in r.slice or "marker@" in r.slice for r in rows)
    by = {r.theme: json.loads(r.slice) for r in rows}
    assert by["personnel_and_training"] == {"participants": [{"role": "performs_procedures", "certified": True}], "pi": {"training": [{"cert_no": "7"}]}, "experiments": [{}]}
    assert by["N_and_justification"]["n_justification"] == {"details": "enough"}


def test_prompts(spark):
    protocols = protocols_of(spark, [("p", json.dumps(PROTOCOL))])
    found = report.findings(protocols, ("default",))
    grounding = spark.createDataFrame([("[G1] law",)], "block string")
    informed = prompts.prompts(protocols, found, "euthanasia_and_endpoints", grounding).first().prompt
    blind = prompts.prompts(protocols, found, "euthanasia_and_endpoints", blind=True).first().prompt
    assert "euthanasia:CO2:exp-1" in informed and "[G1] law" in informed and "pi:" not in informed
    assert "euthanasia:CO2:exp-1" not in blind and informed.split("\n\n")[2] in blind
