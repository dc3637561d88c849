"""Sections of guidance texts and statutes, each found within the text's row: headings by marks, by their shape, or by number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..plans.spec import let
from .chunks import WINDOW, pack_windows

# Words and patterns of the texts.
OPEN_ENDS = (" in", " and", " of", " -", " –", ",", " for", " the")
OWN_HEADINGS = ("Part", "Subsection", "[")
SHORT_TAIL = 3
BIDI = "[‎‏‪-‮⁦-⁩]"
PREFACE = "הקדמה"
HEADING_HE = r"^(תת סעיף|חלק [א-ת]|סעיף \d|הקדמה|כללי|דברי הסבר)"
PAGE_MARK = r"^[–\-—\s]*עמוד[–\-—\s]*\d+[–\-—\s]*$"
#: Addresses and Latin words. No quantifier gives back what it took, so a long Latin text makes none recurse.
PROTECTED = r"https?://\S++|[A-Za-z][A-Za-z0-9@._/'-]*+(?:\s++[A-Za-z][A-Za-z0-9@._/'-]*+)*+"
LONGEST_HEADING, LEAST_SECTION, LEAST_BODY = 45, 120, 40
CHAPTER_HE, SECTION_HE = r"^== (.*) ==$", r"^סעיף ([^\s:]+):?\s*(.*)$"
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
_HELD = "\x00"


def _lines(text: Column) -> Column:
    """The lines of a text; an end of line at its very end opens no further one."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?:{_LINE_END})\z", ""), _LINE_END, -1)


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s++|(?=\s)(?<!\s)\s++$", "")  # most places fail at the look ahead


def normalised_he(line: Column) -> Column:
    """A line of right-to-left text in logical order: parentheses turned, no blank before punctuation and one after it, digits
    apart from letters. Addresses and Latin words stay as they are: a character holds their place meanwhile."""
    turned = F.regexp_replace(F.translate(F.replace(line, F.lit(_HELD), F.lit("")), "()", ")("), r"\(\)([A-Za-z][A-Za-z0-9 ._'-]*[A-Za-z0-9])", r"($1)")
    pattern = "(?U)" + PROTECTED

    def ruled(turned: Column) -> Column:
        made = F.regexp_replace(turned, pattern, _HELD)
        for rule, by in ((r"(?U)(?<!\s)\s++([.,;:!?])", "$1"), (r"(?U)([.,;:!?])(?=[^\s\d.,;:!?)\]\x00])", "$1 "), (r"(?U)(\d)(?=[א-ת])", "$1 ")):
            made = F.regexp_replace(made, rule, by)
        # Pieces between the held places, and what is held, in turn.
        held = F.regexp_extract_all(turned, F.lit(pattern), F.lit(0))
        both = F.zip_with(F.split(made, _HELD, -1), held, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.array_join(both, "")

    return _strip(F.regexp_replace(let(turned, ruled), r"(?U)\s{2,}+", " "))


def _numbered(rows: Column) -> Column:
    return F.transform(rows, lambda x, i: x.withField("i", i))


def _until_next(marks: Column, size: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Each mark with `body` of (mark, place of the next one)."""
    return F.transform(marks, lambda m, k: body(m, F.coalesce(F.get(marks, k + 1)["i"], size)))


def marked(text: Column) -> Column:
    """Sections of a text whose headings begin with # marks: array of (path, heading, body), the body as lines.

    Headings of one level that follow each other, with blank lines between at most, are one heading if the first ends in the
    middle of a phrase, or the next one is a short tail that is no part or subsection of its own. The path is the last heading
    of the first level (before any, the first heading) and the section's own."""
    lines = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"(?U)(?<!\s)\s++$", ""))
    level = lambda x: F.length(F.regexp_extract(x, "^(#*)", 1))
    told = lambda ls: F.filter(_numbered(F.transform(ls, lambda x: F.struct(x.alias("line")))), lambda x: F.regexp_replace(x["line"], r"(?U)\s", "") != "")
    start = F.expr("named_struct('done', cast(array() as array<struct<i:int,last:int,level:int,title:string>>), 'open', cast(null as struct<i:int,last:int,level:int,title:string>), 'k', cast(-2 as int))")

    def heads(ls: Column) -> Column:
        """Heading lines with their place among the lines that are not blank."""
        own = F.transform(told(ls), lambda x, k: F.struct(x["i"].alias("i"), k.alias("k"), level(x["line"]).alias("level"), _strip(F.regexp_replace(x["line"], "^#+", "")).alias("title")))
        return F.filter(own, lambda x: x["level"] > 0)

    def step(acc: Column, x: Column) -> Column:
        open_ = acc["open"]
        dangling = F.lit(False)
        for end in OPEN_ENDS:
            dangling = dangling | open_["title"].endswith(end)
        own = F.lit(False)
        for word in OWN_HEADINGS:
            own = own | x["title"].startswith(word)
        short = (F.size(F.filter(F.split(x["title"], r"(?U)\s+"), lambda w: w != "")) <= SHORT_TAIL) & ~own & ~x["title"].endswith(":")
        wrapped = open_.isNotNull() & (x["k"] == acc["k"] + 1) & (x["level"] == open_["level"]) & (dangling | short)
        fresh = F.struct(x["i"].alias("i"), x["i"].alias("last"), x["level"].alias("level"), x["title"].alias("title"))
        longer = F.struct(open_["i"].alias("i"), x["i"].alias("last"), open_["level"].alias("level"), F.concat(open_["title"], F.lit(" "), x["title"]).alias("title"))
        done = F.when(open_.isNull() | wrapped, acc["done"]).otherwise(F.array_append(acc["done"], open_))
        return F.struct(done.alias("done"), F.when(wrapped, longer).otherwise(fresh).alias("open"), x["k"].alias("k"))

    def cut(ls: Column, found: Column) -> Column:
        tops = F.filter(found, lambda h: h["level"] == 1)

        def one(h: Column, end: Column) -> Column:
            above = F.coalesce(F.try_element_at(F.filter(tops, lambda t: t["i"] < h["i"]), F.lit(-1))["title"], F.when(F.get(found, F.lit(0))["i"] < h["i"], F.get(found, F.lit(0))["title"]))
            path = F.when((h["level"] == 1) | above.isNull(), F.array(h["title"])).otherwise(F.array(above, h["title"]))
            return F.struct(path.alias("path"), h["title"].alias("heading"), F.slice(ls, h["last"] + 2, end - h["last"] - 1).alias("body"))

        return _until_next(found, F.size(ls), one)

    whole = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
    return let(lines, lambda ls: let(F.aggregate(heads(ls), start, step, whole), lambda found: cut(ls, found)))


def shaped(text: Column) -> Column:
    """Sections, as of `marked`, of a text whose headings are told by their shape: known words, or a short line that does not
    end like a sentence nor begin with a digit. Page numbers, page marks and rules go; a heading without a body gives way to
    the next one, and a section of few characters joins the one before, heading and all."""
    lines = F.transform(_lines(F.regexp_replace(text, BIDI, "")), normalised_he)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"(?U)^\d+$") & ~x.rlike("(?U)" + PAGE_MARK) & ~x.rlike("^[—–_ -]+$"))
    ends = lambda x: x.endswith(".") | x.endswith(",") | x.endswith(";")
    heading = lambda x: x.rlike("(?U)" + HEADING_HE) | ((F.length(x) <= LONGEST_HEADING) & ~ends(x) & ~x.rlike(r"(?U)^\d"))

    def cut(ls: Column) -> Column:
        marks = F.concat(F.array(F.struct(F.lit(PREFACE).alias("heading"), F.lit(-1).alias("i"))), F.filter(F.transform(ls, lambda x, i: F.when(heading(x), F.struct(x.alias("heading"), i.alias("i")))), lambda m: m.isNotNull()))
        filled = lambda ms: F.filter(_until_next(ms, F.size(ls), lambda m, end: F.struct(m["heading"].alias("heading"), F.slice(ls, m["i"] + 2, end - m["i"] - 1).alias("body"))), lambda s: F.size(s["body"]) > 0)
        size = lambda s: F.aggregate(s["body"], F.lit(0), lambda n, x: n + F.length(x))
        starts = lambda ss: F.filter(F.transform(ss, lambda s, k: F.when((k == 0) | (size(s) >= LEAST_SECTION), F.struct(s["heading"].alias("heading"), s["body"].alias("body"), k.alias("i")))), lambda s: s.isNotNull())
        added = lambda ss, s, end: F.flatten(F.transform(F.slice(ss, s["i"] + 2, end - s["i"] - 1), lambda x: F.concat(F.array(x["heading"]), x["body"])))
        joined = lambda ss: let(starts(ss), lambda st: _until_next(st, F.size(ss), lambda s, end: F.struct(F.array(s["heading"]).alias("path"), s["heading"].alias("heading"), F.concat(s["body"], added(ss, s, end)).alias("body"))))
        return let(let(marks, filled), joined)

    return let(kept, cut)


def statute(text: Column) -> Column:
    """Sections of a statute, array of (number, title, chapter, body): lines `== chapter ==`, and section lines with a number;
    what stands before the first section is left out."""

    def cut(ls: Column) -> Column:
        marks = F.filter(F.transform(ls, lambda x, i: F.struct(x.alias("line"), i.alias("i"), x.rlike(CHAPTER_HE).alias("chapter"), (x.rlike("(?U)" + SECTION_HE) & ~x.rlike(CHAPTER_HE)).alias("section"))), lambda m: m["chapter"] | m["section"])
        own = lambda ms: F.filter(ms, lambda m: m["section"])

        def one(ms: Column, m: Column, end: Column) -> Column:
            chapter = F.try_element_at(F.filter(ms, lambda c: c["chapter"] & (c["i"] < m["i"])), F.lit(-1))["line"]
            part = lambda k: F.regexp_extract(m["line"], "(?U)" + SECTION_HE, k)
            body = F.filter(F.transform(F.slice(ls, m["i"] + 2, end - m["i"] - 1), lambda x: F.when(~x.rlike(CHAPTER_HE), _strip(x))), lambda x: x != "")
            return F.struct(part(1).alias("number"), _strip(part(2)).alias("title"), F.coalesce(_strip(F.regexp_extract(chapter, CHAPTER_HE, 1)), F.lit("")).alias("chapter"), body.alias("body"))

        return let(marks, lambda ms: let(own(ms), lambda at: _until_next(at, F.size(ls), lambda m, end: one(ms, m, end))))

    return let(_lines(text), cut)


def paragraphs(body: Column) -> Column:
    """Lines of a body as paragraphs: those between blank lines, joined by blanks."""
    joined = F.array_join(F.transform(body, lambda x: let(_strip(x), lambda y: F.when(y == "", F.lit("\n\n")).otherwise(y))), " ")
    return F.filter(F.transform(F.split(joined, r"\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def guidance(docs: DataFrame, key: str, text: str, lang: str, most: int = WINDOW) -> DataFrame:
    """(key, section_no, chunk_no, id, title, section_path, text, sha): the windows of all sections with a body of 40 characters
    or more, `en` by marks and `he` by shape. An id is the heading's slug (of the whole path for a `general` one), or the
    digest's start where slugs say nothing, with the window's number if there are several, and with an ordinal from its second
    use on, in the order of key and place."""

    def pieces(s: Column, no: Column) -> Column:
        numbered = lambda ws: F.transform(ws, lambda w, k: F.struct(no.alias("section_no"), s["path"].alias("path"), s["heading"].alias("heading"), F.size(ws).alias("_n"), k.alias("_k"), w.alias("text")))
        return let(paragraphs(s["body"]), lambda ps: F.when(F.length(F.array_join(ps, "\n")) >= LEAST_BODY, let(pack_windows(ps, most), numbered)))

    # Within one generator: a filter or a second generator over its columns would have them worked out anew.
    cut = F.transform((marked if lang == "en" else shaped)(F.col(text)), pieces)
    rows = docs.select(key, F.inline(F.flatten(F.filter(cut, lambda x: x.isNotNull())))).withColumn("sha", F.sha2("text", 256))
    whole = (F.size("path") > 1) & (F.lower("heading") == "general")
    base = F.when(whole, slug(F.array_join("path", " "))).otherwise(slug(F.col("heading"))) if lang == "en" else F.substring(F.sha1("text"), 1, 8)
    rows = rows.withColumns({"_base": F.concat(F.lit(f"il-guidance-{lang}-"), base), "_window": F.when(F.col("_n") > 1, F.concat(F.lit("-"), (F.col("_k") + 1).cast("string"))).otherwise("")})
    rows = rows.withColumn("_use", F.row_number().over(Window.partitionBy("_base", "_window").orderBy(key, "section_no", "_k")))
    made = F.concat("_base", F.when(F.col("_use") > 1, F.concat(F.lit("-"), F.col("_use").cast("string"))).otherwise(""), "_window")
    return rows.select(key, "section_no", (F.col("_k") + 1).alias("chunk_no"), made.alias("id"), F.array_join("path", " › ").alias("title"), F.col("path").alias("section_path"), "text", "sha")
