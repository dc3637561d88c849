"""Personal data: exact base spans, and further spans from candidates that boosted trees score. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, frozen
from .trees import Tree, as_sql, read_tree

#: The base kinds, in the order in which they are listed. Quantifiers are possessive and starts guarded where that
#: changes no match, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators, of high recall: (kind, what a text needs to be searched at all, pattern). No quantifier gives back
#: what it took, so that no text makes them recurse or go over it twice.
GENERATORS = {
    "spelled": (
        "email",
        r"(?i)[\[({]at[\])}]|\x20at\x20.{1,80}?\x20dot\x20",
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    ),
    "number": ("phone", r"[0-9][0-9\x20().-]{5}", r"(?<![0-9A-Za-z])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"),
    "secret": ("secret", r"[A-Za-z0-9_+/-]{20}", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"),
}
KINDS = (*PATTERNS, "secret")
#: Shapes that examples are made of: # a digit, % a hexadecimal digit, & a letter or digit, ~ a word of six letters. Of each
#: generator: personal shapes, look-alikes, and the words before each; shapes after the bar are held out from the trees.
SHAPES = {
    "spelled": (
        ("~ [at] ~.com", "~(at)~.org", "~ at ~ dot com", "~.~ (at) ~ (dot) net", "~## [at] ~ [dot] de", "|", "~(at)~(dot)fr", "~_~ [at] ~-~.com", "~ at ~ dot ~ dot uk"),
        ("~ (at) ##.##", "~ (at) #.###", "~ [at] p.##", "~ {at} #.#", "|", "~ (at) ###.#", "~ [at] #.##"),
        ("mail", "contact", "write to", "e-mail:", "or", ""), ("price", "sold", "see", "of", "the", ""),
    ),
    "number": (
        ("(###) ###-####", "###-###-####", "0## #### ####", "0### #######", "1-###-###-####", "0# ## ## ## ##", "|", "###.###.####", "(0##) ########", "0##-#######"),
        ("################", "#### #### #### ####", "##.##.####", "####-##-##", "########", "978-#-##-######-#", "#.###.###.###", "##############", "|", "############", "20##.##.## ##", "978-####-###-##-#"),
        ("call", "tel.", "phone:", "mobile", "fax", "Telefon", "reach us at", "call us on"), ("order", "invoice", "ISBN", "id", "ref.", "of", "in", "the", ""),
    ),
    "secret": (
        ("%" * 40, "%" * 32, "&" * 40, "&" * 24, "key_" + "&" * 28, "|", "%" * 64, "&" * 32, "sk_live_" + "&" * 24),
        ("~" * 4, "~" * 6, "~/~/~/~", "~-~-~-~", "~_~_~_~_~", "/usr/~/~/~-#", "%" * 40, "####-##-##-~-~", "|", "~/~_~/~/##", "~+~+~+~", "%" * 64),
        ('token = "', "api_key: ", "password=", "secret: ", "Authorization: Bearer", 'key = "'), ("commit", "sha1", "file", "path", "checksum", "of", "the", ""),
    ),
}
#: Documents, at most about, whose texts examples are set into, and examples of each; boosting rounds and depth.
TRAINING_DOCS, EXAMPLES, ROUNDS, DEPTH = 2_000, 6, 6, 4
#: Precision on examples of held-out shapes that a threshold has to reach.
PRECISION = 0.98
FEATURES = (
    *(f"is_{g}" for g in GENERATORS), "length", "digits", "letters", "capitals", "marks", "mixed", "hexadecimal", "vowels", "distinct", "groups", "longest_group", "zero_first", "bracketed", "assigned", "quoted", "named_phone", "named_mail", "named_secret", "named_other",
)
_SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass
class SpanModel:
    trees: list[tuple[float, Tree]] = field(default_factory=list)
    #: Of each generator: the score from which a candidate counts. Generators that are not here add nothing.
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Of each generator: (precision, recall) on held-out shapes at its threshold; what it did not propose counts as missed.
    report: dict[str, tuple[float, float]] = field(default_factory=dict)


#: Elements of a block of `_scan`.
_BLOCK = 128


def _let(value: Column, body) -> Column:
    """The body with the value as a variable, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _scan(values: Column, step, zero: int) -> Column:
    """The running sums (or maxima, as `step` says) of an array of ints. Block by block: an array that grows by an element at
    a time is copied each time, which only blocks and starts of blocks here are."""
    grown = lambda array, first: F.slice(F.aggregate(array, F.array(first), lambda acc, v: F.array_append(acc, step(F.element_at(acc, -1), v))), 2, 1 << 30)

    def by_block(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK))
        starts = lambda bs: F.concat(F.array(F.lit(zero)), grown(F.transform(bs, lambda b: F.aggregate(b, F.lit(zero), step)), F.lit(zero)))
        return _let(blocks, lambda bs: _let(starts(bs), lambda st: F.flatten(F.transform(bs, lambda b, k: grown(b, F.get(st, k))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(by_block(v)))


def _sums(values: Column) -> Column:
    return _scan(values, lambda a, b: a + b, 0)


def _maxima(values: Column) -> Column:
    return _scan(values, lambda a, b: F.greatest(a, b), 0)


def _matches(text: Column, pattern: str, needs: Column) -> Column:
    """The pattern's matches from left to right, as structs (start, end, value, before, after) in code points; `before` and
    `after` are the 24 and 2 characters around it, as far as no other match lies there."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = _let(F.split(text, pattern, -1), lambda piece: F.arrays_zip(value.alias("value"), piece.alias("piece"), F.slice(piece, 2, F.greatest(F.size(piece) - 1, F.lit(1))).alias("rest")))
    both = F.filter(zipped, lambda x: x["value"].isNotNull())

    def placed(x: Column, end: Column) -> Column:
        return F.struct(
            (end - F.length(x["value"])).alias("start"), end.alias("end"), x["value"].alias("value"), F.substring(x["piece"], -24, 24).alias("before"), F.substring(F.coalesce(x["rest"], F.lit("")), 1, 2).alias("after")
        )

    found = _let(both, lambda m: F.zip_with(m, _sums(F.transform(m, lambda x: F.length(x["piece"]) + F.length(x["value"]))), placed))
    return F.when(needs, found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.ltrim(p, F.lit("0")).cast("string").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda v: _luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
_NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}


def _with_candidates(docs: DataFrame) -> DataFrame:
    """docs with `_t` (the text, null as empty) and, of each generator, its candidates `_c_<generator>`."""
    docs = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    t = F.col("_t")
    found = {g: _matches(t, p, _NEEDS[g](t)) for g, p in PATTERNS.items()} | {g: _matches(t, p, t.rlike(needs)) for g, (_, needs, p) in GENERATORS.items()}
    return docs.select("*", *[x.alias(f"_c_{g}") for g, x in found.items()])


def _base(generator: str) -> Column:
    return F.filter(f"_c_{generator}", lambda x: _VALID[generator](x["value"]))


def _features(generator: str, x: Column) -> Column:
    """A candidate's format and context as a struct of doubles, named as FEATURES."""
    value, before, after = x["value"], x["before"], x["after"]
    count = lambda p: F.regexp_count(value, F.lit(p))
    named = lambda words: before.rlike(rf"(?i)(?<![\p{{L}}])(?:{words})\W{{0,4}}(?:(?:us|me|at|on|to|is)\W{{1,3}}){{0,2}}$")
    groups = F.filter(F.split(value, "[^0-9]+", -1), lambda g: g != "")
    flags = {
        "length": F.length(value), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "capitals": count("[A-Z]"), "marks": count("[^A-Za-z0-9]"),
        "mixed": count("[a-zA-Z][0-9]|[0-9][a-zA-Z]"), "hexadecimal": value.rlike("^[0-9a-fA-F]+$"), "vowels": count("[aeiouAEIOU]"), "distinct": F.size(F.array_distinct(F.split(value, ""))),
        "groups": F.size(groups), "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), "zero_first": value.rlike(r"^\(?0"), "bracketed": value.rlike(r"^\([0-9]+\)"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$"), "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "named_phone": named("tel|phone|telephone|telefon|tel[eé]fono|t[eé]l[eé]phone|mobile|cell|handy|fax|call|ring|sms|reach|whatsapp"), "named_mail": named("e-?mail|mailto|contact|write|courriel|correo|kontakt"),
        "named_secret": before.rlike(r"(?i)(?:token|key|secret|passw\w*|pwd|auth\w*|bearer|credential)\W{0,5}$"), "named_other": named("commit|sha\\w*|md5|checksum|hash|file|path|order|invoice|isbn|issn|id|no|nr|ref|date|page|version|price|serial"),
    }
    ones = {f"is_{g}": F.lit(g == generator) for g in GENERATORS}
    return F.struct(*[(ones | flags)[name].cast("double").alias(name) for name in FEATURES])


def _templates() -> list[tuple[str, float, bool, str, str]]:
    """(generator, label, held_out, cue, shape) of every shape with every word before it."""
    made = []
    for g, (personal, alike, cues, other) in SHAPES.items():
        for label, shapes, own in ((1.0, personal, cues), (0.0, alike, other)):
            bar = shapes.index("|")
            made += [(g, label, i > bar, cue, s) for i, s in enumerate(shapes) if s != "|" for cue in own]
    return made


def examples(docs: DataFrame, each: int = EXAMPLES) -> DataFrame:
    """(generator, label, held_out, shape, proposed, FEATURES...): shapes of SHAPES, filled with random characters, set into
    each document's text after one of their words; label 1 says that the shape is personal data. `proposed` tells whether
    the generator finds it at all. All follows from hashes of doc_id and text."""
    made = _templates()
    by = {(g, label): [t for t in made if t[0] == g and t[1] == label] for g in SHAPES for label in (1.0, 0.0)}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows_of = lambda own: ", ".join(f"named_struct('generator', {quoted(g)}, 'label', {label}D, 'held_out', {str(h).lower()}, 'cue', {quoted(c)}, 'shape', {quoted(s)})" for g, label, h, c, s in own)
    kinds = F.expr(f"array({', '.join(f'array({rows_of(own)})' for own in by.values())})")
    text = F.coalesce("text", F.lit(""))
    seed = F.xxhash64(F.lit("example"), F.col("doc_id").cast("string"), text)
    roll = lambda n, *key: F.pmod(F.xxhash64("seed", "k", *key), F.lit(n) if isinstance(n, int) else n.cast("long")).cast("int")
    rows = docs.select(seed.alias("seed"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    rows = rows.withColumn("at", roll(F.greatest(F.length("text") - 60, F.lit(1)), F.lit("at")))
    rows = rows.withColumn("kind", F.get(kinds, roll(len(by), F.lit("kind"))))
    rows = rows.select("seed", "k", F.substring("text", F.col("at") + 1, F.lit(40)).alias("left"), F.substring("text", F.col("at") + 41, F.lit(20)).alias("right"), F.get("kind", roll(F.size("kind"), F.lit("shape"))).alias("t")).select("*", "t.*")
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    sign = lambda alphabet, i: F.substring(F.lit(alphabet), roll(len(alphabet), i) + 1, F.lit(1))
    word = lambda i: F.substring(F.translate(F.lower(F.hex(F.xxhash64("seed", "k", i))), "0123456789", "ghijklmnop"), 1, 6)
    filled = F.transform(F.split("shape", ""), lambda c, i: F.when(c == "#", sign("0123456789", i)).when(c == "%", sign("0123456789abcdef", i)).when(c == "&", sign(signs, i)).when(c == "~", word(i)).otherwise(c))
    rows = rows.withColumn("value", F.array_join(filled, "")).withColumn("lead", F.concat("left", F.lit(" "), "cue", F.when(F.col("cue") == "", "").when(F.col("cue").rlike('[=" ]$'), "").otherwise(" ")))
    rows = rows.select("generator", "label", "held_out", "shape", F.length("lead").alias("start"), F.length("value").alias("length"), F.concat("lead", "value", F.when(F.col("cue").endswith('"'), '" ').otherwise(" "), "right").alias("text"))
    found = F.lit(None)
    for g, (_, _, pattern) in GENERATORS.items():
        over = F.filter(_matches(F.col("text"), pattern, F.lit(True)), lambda x: (x["start"] < F.col("start") + F.col("length")) & (x["end"] > F.col("start")))
        found = F.when(F.col("generator") == g, F.get(F.transform(over, partial(_features, g)), F.lit(0))).otherwise(found)
    rows = rows.select("generator", "label", "held_out", "shape", found.alias("x"))
    return rows.select("generator", "label", "held_out", "shape", F.col("x").isNotNull().alias("proposed"), "x.*")


def fit(docs: DataFrame, docs_bound: int = TRAINING_DOCS, each: int = EXAMPLES, rounds: int = ROUNDS, depth: int = DEPTH, precision: float = PRECISION) -> SpanModel:
    """Boosted trees over candidates in examples: no one marked spans, so personal shapes and look-alikes are set into the
    texts of at most about `docs_bound` documents, chosen by a hash (see `examples`); that is what the labels say, no
    feature is. Some shapes are held out whole: a generator's threshold is the lowest score from which their candidates
    reach `precision`. A generator none of whose scores does, and an empty table, add nothing to the base spans."""
    some = bounded_sample(docs.select("doc_id", "text"), "doc_id", docs_bound)
    rows = frozen(examples(some, each))
    known = rows.where("proposed and not held_out")
    if known.select("label").distinct().count() < 2:
        return SpanModel()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.4, seed=5).fit(vectors.coalesce(2))
    model = SpanModel([(w, read_tree(t.toDebugString)) for w, t in zip(fitted.treeWeights, fitted.trees)])
    held = rows.where("held_out").select("generator", "label", F.when(F.col("proposed"), F.expr(_score(model))).alias("score"))
    # One row for each distinct score: the trees have a bounded number of them.
    levels = held.groupBy("generator", "score").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    above = Window.partitionBy("generator").orderBy(F.desc_nulls_last("score"))
    whole = F.sum("good").over(Window.partitionBy("generator"))
    cuts = levels.select("generator", "score", F.sum("good").over(above).alias("good"), F.sum("n").over(above).alias("n"), whole.alias("all")).where((F.col("score") >= 0.5) & (F.col("good") >= precision * F.col("n")))
    for r in cuts.groupBy("generator").agg(F.min_by(F.struct("score", "good", "n", "all"), "score").alias("c")).collect():
        model.thresholds[r.generator] = r.c.score
        model.report[r.generator] = (r.c.good / r.c.n, r.c.good / r.c["all"])
    return model


def _score(model: SpanModel, at: str = "") -> str:
    """The boosted trees' probability as SQL over features named `at` + name: text, as that is parsed at once."""
    total = " + ".join(f"{w!r}D * {as_sql(t, lambda k: at + FEATURES[k])}" for w, t in model.trees) or "0D"
    return f"1D / (1D + exp(-2D * ({total})))"


def _base_spans(generator: str) -> Column:
    return F.transform(_base(generator), lambda x: F.struct(F.lit(generator).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _with_further(rows: DataFrame, model: SpanModel) -> DataFrame:
    """rows with `_more`, the candidates that reach their generator's threshold: (start, end, rank, kind); the rank is minus the score."""
    own = [g for g in GENERATORS if g in model.thresholds]
    known = F.concat(*[F.transform(f"_c_{g}", partial(_candidate, g, F.lit(-model.thresholds[g]))) for g in own])
    rank = f"transform(_known, c -> named_struct('start', c.start, 'end', c.end, 'rank', -({_score(model, 'c.x.')}), 'kind', c.kind, 'most', c.most))"  # one expression for all
    rows = rows.withColumn("_known", known)
    return rows.withColumn("_more", F.expr(f"transform(filter({rank}, c -> c.rank <= c.most), c -> named_struct('start', c.start, 'end', c.end, 'rank', c.rank, 'kind', c.kind))"))


def _candidate(generator: str, most: Column, x: Column) -> Column:
    return F.struct(_features(generator, x).alias("x"), x["start"].alias("start"), x["end"].alias("end"), F.lit(GENERATORS[generator][0]).alias("kind"), most.alias("most"))


def _chosen(ranked: Column) -> Column:
    """Of spans (start, end, rank, kind), sorted: those of rank -2, and of the others those that overlap neither one of these
    nor a chosen one of lower rank. Runs of spans that overlap are settled run by run."""
    apart = lambda taken, c: ~F.exists(taken, lambda y: (y["start"] < c["end"]) & (c["start"] < y["end"]))
    by_rank = lambda run: F.array_sort(F.transform(F.filter(run, lambda s: s["rank"] > -2), lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"))
    settled = lambda run: F.when(F.size(run) == 1, run).otherwise(F.aggregate(by_rank(run), F.filter(run, lambda s: s["rank"] == -2), lambda acc, c: F.when(apart(acc, c), F.array_append(acc, plain(c))).otherwise(acc)))

    def runs(spans: Column, reach: Column) -> Column:
        firsts = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        return _let(firsts, lambda at: F.transform(at, lambda a, k: F.slice(spans, a + 1, F.coalesce(F.get(at, k + 1), F.size(spans)) - a)))

    return _let(ranked, lambda spans: _let(_maxima(F.transform(spans, lambda s: s["end"])), lambda reach: F.flatten(F.transform(runs(spans, reach), settled))))


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, start, end) in code points, end exclusive, by kind as in KINDS, then
    start. `base` are the matches of the base formats that pass their checks; `spans` are these and the model's further
    candidates, of which none overlaps a base span or another one that scores higher or, at the same score, starts earlier.

    All is worked out within a row, so nothing is shuffled, in time in proportion to text and spans (but for runs of
    candidates that all overlap). Null and empty texts have no spans; repeated rows count each; no rows give no rows.
    Columns named base or spans are replaced.
    """
    docs = docs.drop("base", "spans")
    columns = docs.columns
    rows = _with_candidates(docs)
    rows = rows.withColumn("base", F.concat(*map(_base_spans, PATTERNS)).cast(_SPAN))
    if model.thresholds:
        rows = _with_further(rows, model)
        sure = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-2.0).alias("rank"), s["kind"].alias("kind")))
        place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
        ordered = F.array_sort(F.transform(_chosen(F.array_sort(F.concat(sure, "_more"))), lambda s: F.struct(place(s).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        whole = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(_SPAN)
        rows = rows.withColumn("spans", F.when(F.size("_more") == 0, F.col("base")).otherwise(whole))
    else:
        rows = rows.withColumn("spans", F.col("base"))
    return rows.select(*[f"`{c}`" for c in columns], "base", "spans")


def count_of(kind: str) -> Column:
    """The number of base spans of a kind."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def digest(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with `base`, `spans` and `redacted`: the text with [KIND] for each span. Of spans that overlap, the first names
    the whole. A null text stays null; a column named redacted is replaced."""
    found = find(docs.drop("redacted"), model)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cut = lambda bits, a, b: F.decode(F.substring(bits, a * 4 + 1, (b - a) * 4), "UTF-32")

    def parts(bits: Column, spans: Column, reach: Column) -> Column:
        """Each span's part: the text since what the spans before it reach, and its kind."""
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        made = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(bits, before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        last = F.element_at(reach, -1)
        return F.concat(F.array_join(made, ""), cut(bits, last, F.greatest(last, F.floor(F.octet_length(bits) / 4).cast("int"))))

    # Code points are four bytes each here, so that a part is cut without a walk through the text.
    whole = _let(F.encode("text", "UTF-32"), lambda bits: _let(by_start, lambda spans: _let(_maxima(F.transform(spans, lambda s: s["end"])), lambda reach: parts(bits, spans, reach))))
    return found.withColumn("redacted", F.when(F.col("text").isNotNull(), F.when(F.size("spans") == 0, F.col("text")).otherwise(whole)))
