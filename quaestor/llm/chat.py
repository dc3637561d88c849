"""Chat formatting: turns become marked text segments with loss flags. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """How a role's turns are written, and whether their text is trained on."""

    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """A declarative template. Control strings start with one of `openers`, end with one of `closers`, and have neither in
    between; so no text can complete one, and an escaped text holds none. Prefixes and suffixes are control strings with
    blanks around. `other` writes turns of any further role; their text starts with the length of the role's name, a colon and
    the name.

    `steps` is the machine that validates turn order: from a state (the last turn's role, "" at the start) to the roles
    that may follow; a conversation may end in `final` states.
    """

    roles: dict[str, Role]
    other: Role
    steps: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    begin: str = "<s>"
    controls: tuple[str, ...] = field(default=())

    def all_controls(self) -> list[str]:
        marks = [x.strip() for r in (*self.roles.values(), self.other) for x in (r.prefix, r.suffix)]
        return sorted({self.begin, *marks, *self.controls})


INSTRUCT = Template(
    roles={"system": Role("<<SYS>> ", " <</SYS>>"), "user": Role("[INST] ", " [/INST]"), "assistant": Role("[ANS] ", " </s>", loss=True)},
    other=Role("[ROLE] ", " [/ROLE]"),
    steps={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _quote(mark: str) -> str:
    return re.sub(r"[\[\]]", r"\\\g<0>", mark)


def _tails(template: Template) -> str:
    return "|".join(sorted({_quote(c[1:]) for c in template.all_controls()}, key=len, reverse=True))


def escape(text: Column, template: Template) -> Column:
    r"""Control strings get a backslash after their first character; ones that have backslashes there get one more."""
    return F.regexp_replace(text, rf"([\[<])(\\*+)({_tails(template)})", r"$1$2\\$3")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*+)({_tails(template)})", "$1$2$3")


def _per_role(template: Template, role: Column, of) -> Column:
    out = None
    for name, r in template.roles.items():
        out = F.when(role == name, F.lit(of(r))) if out is None else out.when(role == name, F.lit(of(r)))
    return out.otherwise(F.lit(of(template.other)))


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, n_turns, segments, formatted, valid, broken_at.

    `segments` are (text, loss): for each turn its prefix, its escaped text and its suffix, after one that begins the
    conversation; loss is true for the texts of roles that are trained on. `formatted` is the segments' text joined.
    `valid` says whether the machine accepts the roles in turn order; `broken_at` is the place, from 0, of the first turn
    that it refuses, the number of turns if only the end is refused, else null. Invalid conversations are formatted too.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own. Null role and text
    count as empty; rows without a conv_id are one conversation of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = F.when(role.isin(list(template.roles)), text).otherwise(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select("conv_id", "turn", role.alias("role"), escape(plain, template).alias("body"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body"))).alias("turns"))

    def segments(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            part(_per_role(template, t["role"], lambda r: r.prefix), no),
            part(t["body"], _per_role(template, t["role"], lambda r: r.loss)),
            part(_per_role(template, t["role"], lambda r: r.suffix), no),
        )

    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in template.steps.items() for b in after])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("broken"))

    def step(acc: Column, t: Column) -> Column:
        ok = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), t["role"]))
        broken = F.coalesce(acc["broken"], F.when(~ok, acc["n"]))
        return F.struct(t["role"].alias("state"), (acc["n"] + 1).alias("n"), broken.alias("broken"))

    end = lambda acc: F.coalesce(acc["broken"], F.when(~acc["state"].isin(list(template.final)), acc["n"]))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    made = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat(begin, F.flatten(F.transform("turns", segments))).alias("segments"), F.aggregate("turns", start, step, end).alias("broken_at"))
    return made.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("broken_at").isNull().alias("valid"), "broken_at")


def read_back(formatted: str, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    names = {r.prefix: name for name, r in template.roles.items()} | {template.other.prefix: None}
    ends = {_quote(r.suffix) for r in (*template.roles.values(), template.other)}
    pattern = rf"(?s)({'|'.join(map(_quote, names))})(.*?)({'|'.join(sorted(ends))})"
    starts, bodies = (F.regexp_extract_all(F.col(formatted), F.lit(pattern), F.lit(k)) for k in (1, 2))

    def turn(x: Column) -> Column:
        text, other = unescape(x["body"], template), x["start"] == template.other.prefix
        cut = F.instr(text, F.lit(":"))
        n = F.substring(text, F.lit(1), cut - 1).cast("int")
        role = F.when(other, F.substring(text, cut + 1, n))
        for prefix, name in names.items():
            if name is not None:
                role = role.when(x["start"] == prefix, F.lit(name))
        return F.struct(role.alias("role"), F.when(other, F.substring(text, cut + 1 + n, F.length(text))).otherwise(text).alias("text"))

    return F.transform(F.arrays_zip(starts.alias("start"), bodies.alias("body")), turn)


def loss_text(segments: str, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
