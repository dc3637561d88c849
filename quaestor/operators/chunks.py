"""Cutting texts into sections and windows, and naming the pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug

WINDOW = 1600
_SENTENCE_END = r"(?<=[.!?:;])\s+"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("_n", "line")).select(key, (F.col("_n") + 1).alias("line_no"), "line")


def section_ids(rows: DataFrame, key: str, is_heading: Column) -> DataFrame:
    """Lines with the number of headings up to them: section 0 comes before the first."""
    return rows.withColumn("section", F.sum(is_heading.cast("int")).over(Window.partitionBy(key).orderBy("line_no")))


def sections(docs: DataFrame, key: str, text: str, heading: str = r"^#{1,2}\s") -> DataFrame:
    """(key, section, title, body): lines in order, a section's heading apart. Sections without a body are left out."""
    rows = section_ids(lines(docs, key, text), key, F.col("line").rlike(heading)).withColumn("is_heading", F.col("line").rlike(heading))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    made = rows.groupBy(key, "section").agg(F.max(F.when(F.col("is_heading"), F.regexp_replace("line", heading, ""))).alias("title"), F.trim(body).alias("body"))
    return made.where("body <> ''")


def pack_windows(paragraphs: Column, most: int = WINDOW) -> Column:
    """Greedy windows of at most `most` characters: paragraphs joined by newlines, ones that are longer cut after sentence
    ends, with sentences joined by blanks. A fold over the pieces of one text."""
    clean = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda p: p != "")
    pieces = F.flatten(F.transform(clean, lambda p: F.when(F.length(p) <= most, F.array(F.struct(p.alias("text"), F.lit("\n").alias("by")))).otherwise(F.transform(F.split(p, _SENTENCE_END), lambda s: F.struct(s.alias("text"), F.lit(" ").alias("by"))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.concat(acc["open"], x["by"], x["text"])
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), x["text"].alias("open")))
            .when(F.length(longer) <= most, F.struct(acc["done"].alias("done"), longer.alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x["text"].alias("open")))
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def ordinal_ids(rows: DataFrame, base: Column, order: list[Column | str]) -> DataFrame:
    """rows with `id`: the base's slug; from its second use on with -2, -3, ..."""
    rows = rows.withColumn("_base", slug(base)).withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(*order)))
    return rows.withColumn("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def records(docs: DataFrame, key: str, text: str, doc_type: str, least: int = 40) -> DataFrame:
    """(id, doc_type, title, chunk_no, text, sha): the windows of all sections; pieces of under `least` characters go."""
    cut = sections(docs, key, text).select(key, "section", "title", F.posexplode(pack_windows(F.split("body", r"\n"))).alias("chunk_no", "text"))
    cut = cut.where(F.length("text") >= least).withColumn("_name", F.concat_ws("-", F.col(key).cast("string"), "title"))
    return ordinal_ids(cut, F.col("_name"), [key, "section", "chunk_no"]).select("id", F.lit(doc_type).alias("doc_type"), "title", "chunk_no", "text", F.sha2("text", 256).alias("sha"))


def stale(built: DataFrame, published: DataFrame) -> DataFrame:
    """Rows that only one of two builds has, with `side`."""
    return built.exceptAll(published).withColumn("side", F.lit("built")).union(published.exceptAll(built).withColumn("side", F.lit("published")))


#: Steps that turn wiki text into plain text, line by line.
WIKI_STEPS = ((r"<!--.*?-->", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), (r"\[https?://\S+\s+([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"^=+\s*(.*?)\s*=+$", "# $1"), (r"<[^>]+>", ""))


def wiki_text(text: Column, sentinel: str | None = None) -> Column:
    """Plain text of wiki text, up to the first line that holds the sentinel."""
    kept = F.split(text, "\n", -1)
    if sentinel:
        cut = F.array_position(F.transform(kept, lambda x: x.contains(sentinel)), F.lit(True))
        kept = F.when(cut > 0, F.slice(kept, F.lit(1), F.greatest(cut.cast("int") - 1, F.lit(0)))).otherwise(kept)

    def clean(line: Column) -> Column:
        for pattern, by in WIKI_STEPS:
            line = F.regexp_replace(line, pattern, by)
        return F.trim(line)

    return F.array_join(F.filter(F.transform(kept, clean), lambda x: x != ""), "\n")

