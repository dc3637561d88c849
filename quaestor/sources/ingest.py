"""Readers: files to texts, texts to protocols, and writers of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import read_protocols
from . import forms

ADAPTERS = {"html": (".html", ".htm"), "json": (".json",)}


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, text, error): whole files as text, a byte order mark dropped; bytes that are not UTF-8 give an error."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    raw = F.col("content")
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.regexp_replace(raw.cast("string"), "^﻿", "")
    return reader.load(path).select("path", F.when(valid, text).alias("text"), F.when(~valid, "not UTF-8").alias("error"))


def adapter_of(path: Column, text: Column) -> Column:
    """By the file's extension, else by how the text starts; null if neither tells."""
    by_name = F.when(F.lower(path).rlike(r"\.html?$"), "html").when(F.lower(path).endswith(".json"), "json")
    head = F.lower(F.substring(F.ltrim(text), 1, 512))
    return F.coalesce(by_name, F.when(head.startswith("{") | head.startswith("["), "json").when(head.rlike("<!doctype html|<html|<body|<div|<table"), "html"))


def ingest(files: DataFrame) -> DataFrame:
    """(path, adapter, error, protocol columns): JSON files and HTML form exports as protocols. What can't be read gives a row
    with an error that never holds the file's content."""
    rows = files.withColumn("adapter", adapter_of(F.col("path"), F.col("text")))
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("adapter").isNull(), "unknown format").when((F.col("adapter") == "json") & F.try_parse_json("text").isNull(), "not JSON").when(
        (F.col("adapter") == "json") & F.json_object_keys("text").isNull(), "not an object"
    )
    rows = rows.select("path", "adapter", bad.alias("_bad"), F.when(bad.isNull() & (F.col("adapter") == "json"), F.col("text")).alias("_json"), F.when(F.col("adapter") == "html", F.col("text")).alias("_html"))
    found = forms.extract(rows, "path", "_html", ("path", "adapter", "_bad", "_json"))
    error = F.coalesce("_bad", F.when(F.col("adapter") == "html", F.col("error")))
    text = F.when(error.isNotNull(), "{}").when(F.col("adapter") == "html", F.to_json(F.struct(*forms.BLOCKS))).otherwise(F.col("_json"))
    return read_protocols(found.select("path", "adapter", error.alias("error"), text.alias("text"))).drop("text")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, one for each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines in one folder for each profile."""
    reports.write.mode("overwrite").partitionBy("profile").json(path)


def write_review_sheet(cases: DataFrame, path: str) -> None:
    """Cases as CSV, arrays joined by |."""
    flat = [F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in cases.dtypes]
    cases.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def escaped(value: Column) -> Column:
    """Text for HTML: the five characters that mean something there."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def render(reports: DataFrame) -> DataFrame:
    """(protocol_id, profile, html): a right-to-left page of each report's checklist, every value escaped."""
    line = F.transform("checklist", lambda c: F.concat(F.lit('<li data-ref="'), escaped(c["ref"]), F.lit('" class="'), escaped(c["severity"]), F.lit('">'), escaped(c["message"]), F.lit("</li>")))
    page = F.concat(F.lit('<html dir="rtl"><body><h1>'), escaped(F.col("protocol_id")), F.lit("</h1><ul>"), F.array_join(line, ""), F.lit("</ul></body></html>"))
    return reports.select("protocol_id", "profile", page.alias("html"))
