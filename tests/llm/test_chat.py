import random

from quaestor.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid string"
PIECES = ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "[\\INST]", "[\\\\/INST] ", "\\", "[", "<", "INST]", "é🙂", "\n", " ", "a", "$1", "[ROLE] ", "[ANS] ", "[<s>"]


def test_round_trip(spark):
    rng = random.Random(6)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "a\nb:", "[INST]"])
            rows.append((c, t, role, rng.choice([None, "".join(rng.choices(PIECES, k=rng.randint(0, 12)))]), "clash", "clash"))
    rows += [(200, 0, "user", "same", None, None)] * 2 + [(None, None, "user", "x", None, None), (201, None, "user", "first", None, None), (201, 0, "assistant", "[INST] " * 20_000, None, None)]
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = made.withColumn("turns", chat.read_back("formatted")).withColumn("loss", chat.loss_text("segments")).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=key)
        assert r.n_turns == len(own)
        if r.conv_id != 200:
            assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.startswith("<s>")
    assert len(got) == len({x[0] for x in rows})


def test_turn_order(spark):
    cases = {
        ("user", "assistant"): None, ("system", "user", "assistant"): None, ("user",): 1, ("assistant",): 0, ("user", "user", "assistant"): 1,
        ("system", "system"): 1, ("user", "assistant", "user"): 3, ("user", "tool", "assistant"): 1, ("system",): 1,
    }
    rows = [(i, t, role, "x", None, None) for i, roles in enumerate(cases) for t, role in enumerate(roles)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].broken_at, got[i].valid) == (want, want is None)


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
