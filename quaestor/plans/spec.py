"""Rules as declarations, and their compilation to one array of findings for each protocol."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PROFILES = ("default", "strict_law")


@dataclass(frozen=True)
class Rule:
    """One check of a row. `ok` is tested where `applies`; `severity` is E (error), W (warning) or W/E (error in the strict
    profile only), or a column; `passes` tells whether a fulfilled check gives a row too. `order` is (block, loop, position):
    findings go by block, loop, experiment and position."""

    id: str
    order: tuple[int, int, int]
    applies: Column
    ok: Column
    severity: str | Column
    message: str | Column
    passes: bool = False
    ref: Column | None = field(default=None)


#: A finding before its profile is chosen; seq puts a protocol's findings in order.
CHECK = "struct<seq:bigint,ref:string,status:string,default:string,strict_law:string,message:string,rule_id:string>"


def severities(kind: str | Column) -> tuple[Column, Column]:
    """Under the default and the strict profile."""
    if isinstance(kind, Column):
        return kind, kind
    return F.lit({"E": "error", "W": "warning", "W/E": "warning"}[kind]), F.lit({"E": "error", "W": "warning", "W/E": "error"}[kind])


def finding(rule_id: str, seq: Column, ref: Column, ok: Column, severity: str | Column, message: Column) -> Column:
    default, strict = severities(severity)
    status, said = F.when(ok, "pass").otherwise("fail"), F.when(~ok, message).otherwise("")
    return F.struct(seq.alias("seq"), ref.alias("ref"), status.alias("status"), default.alias("default"), strict.alias("strict_law"), said.alias("message"), F.lit(rule_id).alias("rule_id"))


def checks(rules: list[Rule], place: Column | None = None) -> Column:
    """The findings of all rules about one thing, as one array. `place` is its number among its like, from 1."""
    at, suffix, made = F.lit(0) if place is None else place, F.lit("") if place is None else F.concat(F.lit(":exp-"), place.cast("string")), []
    for r in rules:
        block, loop, position = r.order
        ok = F.coalesce(r.ok, F.lit(False))
        shown = F.coalesce(r.applies, F.lit(False)) & (F.lit(True) if r.passes else ~ok)
        seq = F.lit((block * 100 + loop) * 10**9 + position) + at.cast("long") * 1000
        ref = r.ref if r.ref is not None else F.concat(F.lit(r.id), suffix)
        made.append(F.when(shown, finding(r.id, seq, ref, ok, r.severity, r.message if isinstance(r.message, Column) else F.lit(r.message))))
    if not made:
        return F.array().cast(f"array<{CHECK}>")
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(f"array<{CHECK}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value as a variable, which is worked out once."""
    return F.transform(F.array(value), body)[0]


#: Compiled columns by session and name: they refer to names only, and making thousands of them takes seconds.
_COMPILED: WeakKeyDictionary = WeakKeyDictionary()


def compiled(session: SparkSession, name: object, make: Callable[[], Column]) -> Column:
    own = _COMPILED.setdefault(session, {})
    if name not in own:
        own[name] = make()
    return own[name]


def profile_of(name: str) -> str:
    """Names that are no profile count as the default one."""
    return name if name in PROFILES else PROFILES[0]
