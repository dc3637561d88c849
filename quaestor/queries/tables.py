"""Queries over the driver's tables for the operators besides the rule engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as tx
from ..operators import catalog, chunks, evaluation, feedback, reconcile, report, search, sections, sessions, verdicts
from ..schema import REQUIRED
from ..sources import form_experiments, html
from .review import protocols

WORD = r"[\p{L}\p{N}_]"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Texts

TERMS = ("la", "ver", "with", "token", "idiot")


@_query(rf"""SELECT lang, count(*) FILTER (regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])(la|ver|with)(s|ed|ing)?($|[^\p{{L}}\p{{N}}_])|token|idiot')) AS n_mentions, count(*) AS n FROM documents GROUP BY lang""")
def mentions_short_terms(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(tx.mentions(F.lower(tx.text("text")), TERMS)).alias("n_mentions"), F.count("*").alias("n"))


@_query(r"""SELECT doc_id, n AS n_words, n > 150 AS over_lay, n > 2500 AS over_scientific FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents)""")
def word_limits(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", tx.word_count(tx.text("text")).cast("long").alias("n_words"))
    return rows.select("doc_id", "n_words", (F.col("n_words") > 150).alias("over_lay"), (F.col("n_words") > 2500).alias("over_scientific"))


@_query(r"""SELECT source, count(*) FILTER (contains(regexp_replace(lower(text), 'the\s+th[\p{L}]*', ' ', 'g'), 'the')) AS n_banned FROM documents GROUP BY source""")
def ban_after_phrase_removal(spark, sf_dir):
    kept = F.regexp_replace(F.lower(tx.text("text")), r"the\s+th[\p{L}]*", " ")
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(tx.contains_any(kept, ("the",))).alias("n_banned"))


@_query("SELECT event_type, count(*) FILTER (user_id < 100) AS n_below FROM events GROUP BY event_type")
def percent_below_100(spark, sf_dir):
    text = F.concat(F.lit("fill at "), F.col("user_id").cast("string"), F.lit(" % of 250"))
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(tx.percent_below(text, 100)).alias("n_below"))


@_query("SELECT event_id, array_to_string(list_filter(['id', 'k', 'unit'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events")
def required_keys(spark, sf_dir):
    wanted = F.array(F.lit("id"), F.lit("k"), F.lit("unit"))
    return _t(spark, sf_dir, "events").select("event_id", F.array_join(F.array_except(wanted, F.json_object_keys("props")), ",").alias("missing"))


@_query("SELECT p_partkey, concat_ws(', ', CASE WHEN p_size < 10 THEN 'size' END, CASE WHEN p_retailprice < 1000 THEN 'price' END, CASE WHEN NOT contains(p_type, 'STEEL') THEN 'type' END) AS missing FROM part")
def missing_parts_list(spark, sf_dir):
    parts = {"size": F.col("p_size") < 10, "price": F.col("p_retailprice") < 1000, "type": ~F.col("p_type").contains("STEEL")}
    names = F.filter(F.array(*[F.when(absent, F.lit(n)) for n, absent in parts.items()]), lambda x: x.isNotNull())
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(names, ", ").alias("missing"))


# Totals and groups

_TOTALS = """SELECT l_orderkey, l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY ALL"""


@_query(f"SELECT l_orderkey AS protocol_id, l_returnflag AS species, l_linestatus AS strain, n + 1 AS n_total, n AS n_details FROM ({_TOTALS}) WHERE l_orderkey % 7 = 0")
def totals_strict(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("protocol_id"), F.col("l_returnflag").alias("species"), F.col("l_linestatus").alias("strain"), F.lit("M").alias("sex"), F.lit("wt").alias("genetic_status"), F.col("l_quantity").cast("long").alias("n"))
    totals = lines.groupBy("protocol_id", *reconcile.KEYS).agg((F.sum("n") + F.when(F.col("protocol_id") % 7 == 0, 1).otherwise(0)).alias("n_total"))
    return reconcile.strict_mismatches(totals, lines).select("protocol_id", "species", "strain", "n_total", "n_details")


@_query("SELECT l_orderkey, l_returnflag, array_to_string(list_sort(list(l_linenumber)), ',') AS lines FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL HAVING count(*) > 1")
def multi_survival_groups(spark, sf_dir):
    alive = _t(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    return alive.where(F.size("x") > 1).select("l_orderkey", "l_returnflag", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("lines"))


@_query("SELECT l_orderkey, min(l_returnflag) AS only_flag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1 AND min(l_returnflag) IN ('A', 'R')")
def single_value_groups(spark, sf_dir):
    flags = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("x"))
    return flags.where((F.size("x") == 1) & F.get("x", F.lit(0)).isin("A", "R")).select("l_orderkey", F.get("x", F.lit(0)).alias("only_flag"))


SEGMENTS = {"auto": ("automobile",), "home": ("household", "furniture")}


@_query("SELECT c_mktsegment AS raw, CASE lower(trim(c_mktsegment)) WHEN 'automobile' THEN 'auto' WHEN 'household' THEN 'home' WHEN 'furniture' THEN 'home' ELSE c_mktsegment END AS canonical, count(*) AS n FROM customer GROUP BY ALL")
def vocab_normalise(spark, sf_dir):
    return _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("raw"), F.coalesce(tx.by_alias(F.col("c_mktsegment"), SEGMENTS), "c_mktsegment").alias("canonical")).agg(F.count("*").alias("n"))


@_query("""SELECT p_brand, count(*) FILTER (p_retailprice < l_quantity * CASE WHEN p_size > 25 THEN 96.8 ELSE 77.4 END) AS n_dense, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def density_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    required = F.col("l_quantity") * F.when(F.col("p_size") > 25, 96.8).otherwise(77.4)
    return rows.groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") < required).alias("n_dense"), F.count("*").alias("n"))


@_query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ', ') AS kinds FROM lineitem GROUP BY l_orderkey")
def backfill_sets(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kinds"))
    return reconcile.backfill(rows, "l_orderkey", "kinds")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_work(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return evaluation.pending(_t(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


# Search

_TOKENS = r"list_transform(list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1), lambda x: lower(x))"
_COUNTS = f"""d AS (SELECT doc_id, lang, {_TOKENS.format("text")} AS w FROM documents), c AS (SELECT doc_id, lang, term, len(w) AS dl, count(*) AS tf FROM d, unnest(w) AS u(term) GROUP BY ALL)"""


@_query(f"WITH {_COUNTS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM c GROUP BY term")
def term_stats(spark, sf_dir):
    return search.term_counts(_t(spark, sf_dir, "documents"), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@_query(f"WITH {_COUNTS} SELECT doc_id, len(w) AS dl FROM d")
def doc_lengths(spark, sf_dir):
    return search.doc_lengths(_t(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _bm25_sql(where: str) -> str:
    return f"""WITH {_COUNTS}, s AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM d), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TOKENS.format("text")} AS w FROM benchmark), unnest(w) AS u(term) GROUP BY ALL),
    scored AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score FROM q JOIN c USING (term) JOIN df USING (term), s {where} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM scored WHERE score > 0)
    SELECT item_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 5"""


def _hits(spark, sf_dir, keep=None) -> DataFrame:
    found = search.bm25(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark").withColumnRenamed("text", "q"), "doc_id", F.col("text"), "item_id", F.col("q"), 5, keep)
    return found.select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@_query(_bm25_sql(""))
def bm25_topk(spark, sf_dir):
    return _hits(spark, sf_dir)


@_query(_bm25_sql("WHERE lang IN ('en', 'de')"))
def bm25_topk_filtered(spark, sf_dir):
    return _hits(spark, sf_dir, F.col("lang").isin("en", "de"))


_COSINE = """SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) /
   (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 9) AS score
   FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 100 = 0"""
_RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM ({})"


def _vectors(spark, sf_dir, keep=None) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return search.cosine(vectors, asked, "vec_id", "embedding", "query_id", "asked", 5, keep)


@_query(f"SELECT query_id, vec_id, rank, round(score, 4) AS score FROM ({_RANKED.format(_COSINE)}) WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return _vectors(spark, sf_dir).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@_query(f"SELECT query_id, vec_id, rank, round(score, 4) AS score FROM ({_RANKED.format(_COSINE + ' AND v.label IN (1, 2, 3)')}) WHERE rank <= 5")
def cosine_topk_filtered(spark, sf_dir):
    return _vectors(spark, sf_dir, F.col("label").isin(1, 2, 3)).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@_query(
    f"""WITH h AS (SELECT * FROM ({_RANKED.format(_COSINE)}) WHERE rank <= 5), f AS (SELECT *, row_number() OVER (PARTITION BY query_label, vec_id ORDER BY query_id, rank) AS n FROM h),
    o AS (SELECT query_label, vec_id, row_number() OVER (PARTITION BY query_label ORDER BY query_id, rank) AS place FROM f WHERE n = 1) SELECT CAST(query_label AS BIGINT) AS query_label, vec_id, place FROM o WHERE place <= 5"""
)
def multi_query_merge(spark, sf_dir):
    labels = _t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("query_label"))
    merged = search.merge(_vectors(spark, sf_dir).join(labels, "query_id"), "query_label", "query_id", "vec_id")
    return merged.select("query_label", "vec_id", F.col("place").cast("long").alias("place"))


@_query("""SELECT doc_id, CASE WHEN length(text) <= 700 THEN length(text) WHEN contains(left(text, 700), ' ') THEN length(regexp_replace(left(text, 700), ' [^ ]*$', '')) + 2 ELSE 702 END AS n_cut FROM documents""")
def snippet_cut(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(tx.snippet(F.col("text"))).cast("long").alias("n_cut"))


# Chunks and pages


@_query("SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS id FROM documents")
def slug_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.slug(F.col("text")).alias("id"))


@_query("""SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS id FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM
   (SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s FROM part))""")
def ordinal_suffix(spark, sf_dir):
    return chunks.ordinal_ids(_t(spark, sf_dir, "part"), F.concat_ws(" ", "p_brand", "p_type"), ["p_partkey"]).select("p_partkey", "id")


_HEADING = r"^.{1,30}$"


@_query(f"""SELECT doc_id, section, count(*) AS n_lines FROM (SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(line, '{_HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS section
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) GROUP BY ALL""")
def section_ids(spark, sf_dir):
    rows = chunks.section_ids(chunks.lines(_t(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", F.col("line").rlike(_HEADING))
    return rows.groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("n_lines"))


@_query()
def window_chunks(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.pack_windows(F.split("text", "\n"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


@_query()
def corpus_records(spark, sf_dir):
    return chunks.records(_t(spark, sf_dir, "documents"), "doc_id", "text", "guidance_section").select("id", "doc_type", "chunk_no", "sha")


@_query()
def page_cells(spark, sf_dir):
    cells = html.with_cells(_t(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.inline("cells"))
    return cells.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@_query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def page_title_fields(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


# Catalogue


@_query("""SELECT lang, source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, source) AS place FROM (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL)) WHERE place <= 3""")
def field_samples(spark, sf_dir):
    return catalog.first_distinct(_t(spark, sf_dir, "documents"), "lang", "source", ["doc_id"]).select("lang", "source", "doc_id", F.col("place").cast("long").alias("place"))


@_query(
    "SELECT path, 'required' AS rule, count(DISTINCT conv_id) AS protocols FROM conversations, (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in ("header", "research", "pi", *(f"{b}.{k}" for b, ks in REQUIRED.items() for k in ks)))
    + "]) AS path) GROUP BY path"
)
def schema_violations(spark, sf_dir):
    return catalog.conformance(catalog.violations(protocols(spark, sf_dir), 40)).select("path", "rule", "protocols")


# Feedback and evaluation

_VOTES = "SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS key, CASE WHEN value > 100 THEN 'up' ELSE 'down' END AS verdict, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at FROM events"
_NOISE = f"""SELECT kind, key, count(*) FILTER (verdict = 'up') AS up, count(*) FILTER (verdict = 'down') AS down, count(*) AS total, round(count(*) FILTER (verdict = 'down') / count(*), 3) AS down_rate FROM ({_VOTES}) {{}} GROUP BY ALL"""
SINCE = "2024-01-04T00:00:00+00:00"


def _votes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.when(F.col("value") > 100, "up").otherwise("down").alias("verdict"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("created_at")
    )


@_query(_NOISE.format(""))
def noise_report(spark, sf_dir):
    return feedback.noise_report(_votes(spark, sf_dir))


@_query(_NOISE.format(f"WHERE created_at >= '{SINCE}'"))
def noise_report_since(spark, sf_dir):
    return feedback.noise_report(_votes(spark, sf_dir), SINCE)


@_query(
    """SELECT event_id, CASE WHEN kind = 'x' THEN 'kind' WHEN verdict NOT IN ('up', 'down') THEN 'verdict' WHEN key = 'nothing' OR (kind = 'lint' AND key <> 'header') OR (kind = 'llm' AND key <> 'writing_quality') THEN 'key' WHEN profile = 'loose' THEN 'profile' WHEN version = '9.9.9' THEN 'version' END AS problem
    FROM (SELECT event_id, ['lint', 'llm', 'x'][CAST(user_id % 3 AS INT) + 1] AS kind, ['header', 'writing_quality', 'nothing'][CAST(event_id % 3 AS INT) + 1] AS key, CASE WHEN value > 20 THEN 'up' ELSE 'sideways' END AS verdict,
    CASE WHEN event_id % 5 = 0 THEN 'loose' END AS profile, CASE WHEN event_id % 7 = 0 THEN '9.9.9' ELSE '1.2.0' END AS version FROM events)"""
)
def feedback_validate(spark, sf_dir):
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.expr(f"cast({at} % {len(values)} as int)"))
    rows = _t(spark, sf_dir, "events")
    found = feedback.problem(
        pick(("lint", "llm", "x"), "user_id"), pick(("header", "writing_quality", "nothing"), "event_id"), F.when(F.col("value") > 20, "up").otherwise("sideways"), F.when(F.col("event_id") % 5 == 0, "loose"),
        F.when(F.col("event_id") % 7 == 0, "9.9.9").otherwise("1.2.0"), [r for r, _, _ in dims.RULES], [t for t, _, _ in dims.THEMES],
    )
    return rows.select("event_id", found.alias("problem"))


_EVAL = """SELECT doc_id % 50 AS case_id, source AS theme, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS variant, CASE WHEN doc_id % 2 = 0 THEN 'grounded' ELSE 'plain' END AS condition, doc_id AS seq,
  CASE WHEN doc_id % 11 > 0 THEN n_chars % 4 END AS score, doc_id % 11 > 0 AS json_ok, doc_id % 4 AS citations, CAST(n_chars AS DOUBLE) / 1000 AS seconds FROM documents JOIN labels USING (doc_id)"""


def _graded(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        (F.col("doc_id") % 50).alias("case_id"), F.col("source").alias("theme"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("variant"), F.when(F.col("doc_id") % 2 == 0, "grounded").otherwise("plain").alias("condition"),
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 11 > 0, F.col("n_chars") % 4).alias("score"), (F.col("doc_id") % 11 > 0).alias("json_ok"), (F.col("doc_id") % 4).alias("citations"), (F.col("n_chars").cast("double") / 1000).alias("seconds"),
    )


_METRICS = """m AS (SELECT {g}, count(*) AS calls, avg(CAST(json_ok AS INT)) AS json_ok, avg(CASE WHEN variant = 'bad' AND score IS NOT NULL THEN CAST(score <= 1 AS INT) END) AS bad_hit,
  avg(CASE WHEN variant = 'good' AND score IS NOT NULL THEN CAST(score >= 2 AS INT) END) AS good_clean, avg(score) FILTER (variant = 'good') - avg(score) FILTER (variant = 'bad') AS gap,
  CASE WHEN condition = 'grounded' THEN avg(CAST(citations > 0 AS INT)) END AS cited, avg(seconds) AS sec FROM e GROUP BY {g}),
p AS (SELECT {g}, count(*) FILTER (good IS NOT NULL AND bad IS NOT NULL) AS n_pairs, avg(CAST(bad < good AS INT)) FILTER (good IS NOT NULL AND bad IS NOT NULL) AS pair_acc
  FROM (SELECT condition, theme, case_id, arg_max(score, seq) FILTER (variant = 'good') AS good, arg_max(score, seq) FILTER (variant = 'bad') AS bad FROM s GROUP BY ALL) GROUP BY {g})
"""
# A row without a score may be a pair's last one: struct-wrapped, since arg_max skips nulls.
_LAST = """s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY condition, theme, case_id, variant ORDER BY seq DESC) = 1)"""
_SELECT = "SELECT condition, {t} AS theme, calls, round(json_ok, 6) AS json_ok, n_pairs, round(pair_acc, 6) AS pair_acc, round(bad_hit, 6) AS bad_hit, round(good_clean, 6) AS good_clean, round(gap, 6) AS gap, round(cited, 6) AS cited, round(sec, 6) AS sec FROM m JOIN p USING ({g})"


def _metrics_sql(by_theme: bool) -> str:
    g = "condition, theme" if by_theme else "condition"
    return f"WITH e AS ({_EVAL}), {_LAST}, {_METRICS.format(g=g)} {_SELECT.format(g=g, t='theme' if by_theme else 'CAST(NULL AS VARCHAR)')}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("condition", F.col("theme"), "calls", "n_pairs", *[F.round(c, 6).alias(c) for c in ("json_ok", "pair_acc", "bad_hit", "good_clean", "gap", "cited", "sec")])


@_query(_metrics_sql(False))
def pair_metrics(spark, sf_dir):
    return _rounded(evaluation.pair_metrics(_graded(spark, sf_dir), ["theme", "case_id"], "seq", []).withColumn("theme", F.lit(None).cast("string")))


@_query(f"SELECT * FROM ({_metrics_sql(False)}) UNION ALL SELECT * FROM ({_metrics_sql(True)})")
def pair_metrics_grouping_sets(spark, sf_dir):
    return _rounded(evaluation.pair_metrics(_graded(spark, sf_dir), ["case_id"], "seq", ["theme"]))


@_query(
    """WITH r AS (SELECT event_type, user_id, value > 5 AS parse_ok, CASE WHEN value > 10 THEN CAST(floor(value) AS BIGINT) % 4 END AS score FROM events),
    g AS (SELECT event_type, user_id, count(DISTINCT score) AS kinds, count(score) AS scores FROM r GROUP BY ALL)
    SELECT event_type, round(avg(CAST(NOT parse_ok AS INT)), 6) AS parse_fail, round(avg(CAST(score IS NULL AS INT)), 6) AS no_score, round(avg(score), 6) AS mean_score, any_value(n) AS groups, any_value(f) AS flips, round(any_value(f) / any_value(n), 6) AS flip_rate
    FROM r JOIN (SELECT event_type, count(*) AS n, count(*) FILTER (kinds > 1) AS f FROM g WHERE scores >= 2 GROUP BY event_type) USING (event_type) GROUP BY event_type"""
)
def flip_rate(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", "user_id", (F.col("value") > 5).alias("parse_ok"), F.when(F.col("value") > 10, F.floor("value").cast("long") % 4).alias("score"))
    made = evaluation.flip_rate(rows, ["user_id"], "event_type")
    return made.select("event_type", *[F.round(c, 6).alias(c) for c in ("parse_fail", "no_score", "mean_score")], "groups", "flips", F.round("flip_rate", 6).alias("flip_rate"))


_GOLDEN = "SELECT doc_id AS case_id, [source, lang, 'src' || (doc_id % 40)] AS tags FROM documents"


@_query(f"SELECT case_id, 'tags' AS field, value FROM ({_GOLDEN}), unnest(tags) AS u(value) WHERE value NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def golden_validate(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), F.array("source", "lang", F.concat(F.lit("src"), (F.col("doc_id") % 40).cast("string"))).alias("tags"))
    return evaluation.unknown_values(cases, "case_id", "tags", docs.select("source").distinct(), "source")


@_query("""SELECT lang, count(*) AS n_cases, count(DISTINCT source) AS n_sources, array_to_string(list_sort(list_distinct(list(source) FILTER (doc_id % 3 = 0))), ',') AS blocked FROM documents GROUP BY lang""")
def golden_coverage(spark, sf_dir):
    blocked = F.array_join(F.array_sort(F.collect_set(F.when(F.col("doc_id") % 3 == 0, F.col("source")))), ",")
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_cases"), F.count_distinct("source").alias("n_sources"), blocked.alias("blocked"))


@_query(
    """WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS got, list_sort(list_distinct(list(CASE WHEN l_orderkey % 5 = 0 THEN 'N' ELSE l_returnflag END))) AS want FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, array_to_string(list_filter(want, lambda x: NOT list_contains(got, x)), ',') AS missing, array_to_string(list_filter(got, lambda x: NOT list_contains(want, x)), ',') AS extra, got = want AS exact FROM a"""
)
def expected_vs_actual(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    refs = lambda c: rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(c)).alias("refs"))
    made = evaluation.expected_against_actual(refs(F.when(F.col("l_orderkey") % 5 == 0, "N").otherwise(F.col("l_returnflag"))), refs(F.col("l_returnflag")), "l_orderkey")
    return made.select("l_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "exact")


@_query(r"SELECT doc_id, len(regexp_extract_all('[G' || doc_id || '] ' || lang || ' [G2] [Gx]', '\[G\d+\]')) AS n FROM documents")
def citation_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[G"), F.col("doc_id").cast("string"), F.lit("] "), F.col("lang"), F.lit(" [G2] [Gx]")).alias("x"))
    return rows.select("doc_id", evaluation.citations("x").cast("long").alias("n"))


# Sessions


@_query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf_dir):
    return sessions.sessions(_t(spark, sf_dir, "events"), "user_id", "ts")


@_query("""SELECT user_id, event_type, minute, n, n - most AS n_over FROM (SELECT user_id, event_type, date_trunc('hour', ts) AS minute, count(*) AS n, CASE event_type WHEN 'click' THEN 2 ELSE 1 END AS most FROM events GROUP BY ALL) WHERE n > most""")
def rate_limit_hits(spark, sf_dir):
    made = sessions.rate_hits(_t(spark, sf_dir, "events"), "user_id", "event_type", "ts", {"click": 2}, 1, "1 hour")
    return made.withColumn("n_over", F.col("n_over").cast("long"))


@_query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def session_cap(spark, sf_dir):
    return sessions.newest(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.desc("event_id")], 100).select("event_id", "user_id")


@_query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def first_event_per_code(spark, sf_dir):
    return sessions.first_of(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events")
def progress_counter(spark, sf_dir):
    return sessions.progress(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", F.col("done").cast("long").alias("done"))


# Verdicts

_RAW = ("0", "3", "7", "Good", "partially adequate", "not-addressed", "", "nonsense")
_RAW_SQL = "[" + ", ".join(f"'{x}'" for x in _RAW) + "][CAST((conv_id + turn) % 8 AS INT) + 1]"
_SCORE_SQL = f"[0, 3, 1, 3, 2, 0, 1, 1][CAST((conv_id + turn) % 8 AS INT) + 1]"
_LABEL_SQL = f"CASE (conv_id + turn) % 8 WHEN 4 THEN 'partially_adequate' WHEN 5 THEN 'not_addressed' ELSE ['not_addressed', 'inadequate', 'partially_adequate', 'adequate'][{_SCORE_SQL} + 1] END"


def _answers(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.get(F.array(*map(F.lit, _RAW)), F.expr("cast((conv_id + turn) % 8 as int)")).alias("raw"))


@_query(f"SELECT conv_id, turn, CAST({_SCORE_SQL} AS BIGINT) AS score FROM conversations")
def score_normalise(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", verdicts.score_of(F.col("raw")).cast("long").alias("score"))


@_query(f"SELECT conv_id, turn, {_LABEL_SQL} AS label FROM conversations")
def label_normalise(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", verdicts.label_of(F.col("raw"), verdicts.score_of(F.col("raw"))).alias("label"))


@_query("""SELECT conv_id, q, n_first AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY n_first) AS place FROM (SELECT conv_id, role || (turn % 3) AS q, min(turn) AS n_first FROM conversations GROUP BY ALL)""")
def question_dedupe(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", (F.col("turn") % 3).cast("string")).alias("q"))
    return verdicts.distinct_questions(rows, "conv_id", ["q"], ["turn"]).select("conv_id", "q", "turn", F.col("place").cast("long").alias("place"))


def _passes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scored = _answers(spark, sf_dir).select("conv_id", "turn", verdicts.score_of(F.col("raw")).alias("score"), F.lit(None).cast("string").alias("label"), F.array("role").alias("questions"))
    second = scored.where("turn % 3 <> 1").withColumn("score", F.when(F.col("conv_id") % 4 == 0, F.lit(3)).otherwise(F.col("score"))).withColumn("questions", F.when(F.col("turn") % 5 == 0, F.array(F.lit("more"))).otherwise(F.col("questions")))
    return scored.where("turn % 4 <> 2"), second


@_query(
    f"""SELECT conv_id, turn, CAST(CASE WHEN turn % 3 <> 1 THEN CASE WHEN conv_id % 4 = 0 THEN 3 ELSE s END ELSE s END AS BIGINT) AS score, turn % 3 <> 1 AS reconciled, CASE WHEN turn % 3 <> 1 THEN 'second' ELSE 'first' END AS origin
    FROM (SELECT conv_id, turn, {_SCORE_SQL} AS s FROM conversations) WHERE turn % 3 <> 1 OR turn % 4 <> 2"""
)
def two_pass_reconcile(spark, sf_dir):
    first, second = _passes(spark, sf_dir)
    return verdicts.reconcile(first, second, ["conv_id", "turn"]).select("conv_id", "turn", F.col("score").cast("long").alias("score"), "reconciled", "origin")


@_query(
    f"""SELECT conv_id, count(*) FILTER (ch) AS n_changed, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (ch), '') AS themes
    FROM (SELECT conv_id, turn, (conv_id % 4 = 0 AND {_SCORE_SQL} <> 3) OR turn % 5 = 0 AS ch FROM conversations WHERE turn % 3 <> 1 AND turn % 4 <> 2) GROUP BY conv_id"""
)
def disagreement_summary(spark, sf_dir):
    first, second = _passes(spark, sf_dir)
    rows = verdicts.changed(first, second, ["conv_id", "turn"]).withColumn("theme", F.col("turn").cast("string"))
    return verdicts.disagreements(rows, "conv_id", "turn", "theme")


@_query(
    """SELECT conv_id, ['approve', 'approve', 'revise_minor', 'revise_major', 'reject'][w + 1] AS verdict, ['low', 'low', 'medium', 'high', 'critical'][w + 1] AS risk FROM (SELECT conv_id, max(CAST((conv_id * 3 + turn) % 5 AS INT)) AS w FROM conversations GROUP BY conv_id)"""
)
def worst_severity(spark, sf_dir):
    names = F.array(*map(F.lit, ("none", "Recommendation", "Minor", "Major", "Critical")))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.get(names, F.expr("cast((conv_id * 3 + turn) % 5 as int)")).alias("severity"))
    return verdicts.holistic(rows, "conv_id")


@_query()
def json_recovery(spark, sf_dir):
    answer = F.concat(F.lit("<think>{x}</think> Answer: "), F.when(F.col("turn") % 2 == 0, "```json\n").otherwise(""), F.to_json(F.struct("conv_id", "role")), F.when(F.col("turn") % 2 == 0, "\n```").otherwise(" done }"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", verdicts.recovered(answer).alias("found"))


@_query("SELECT doc_id, CASE WHEN n_chars // 4 > 800 THEN 'overflow' WHEN (n_chars // 4) * 100 >= 800 * 85 THEN 'warn' ELSE 'ok' END AS budget FROM documents")
def context_budget(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", verdicts.context_budget(F.col("n_chars"), 800).alias("budget"))


# Sections, fingerprints and aggregates of round three


@_query()
def shaped_sections(spark, sf_dir):
    """Sections by the shape of their headings; tested against a plain twin."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(sections.shaped(F.col("text"))).alias("section_no", "s"))
    return rows.select("doc_id", "section_no", "s.heading", F.size("s.body").alias("n_lines"), F.sha2(F.array_join("s.body", "\n"), 256).alias("sha"))


@_query()
def guidance_records(spark, sf_dir):
    return sections.guidance(_t(spark, sf_dir, "documents"), "doc_id", "text", "he").select("doc_id", "section_no", "chunk_no", "id", "sha")


_PART = "CAST(sum(CAST('0x' || h[{}:{}] AS UBIGINT)) AS VARCHAR)"


@_query(f"""SELECT sha256(concat_ws(',', {', '.join(_PART.format(16 * i + 1, 16 * i + 16) for i in range(4))}, CAST(count(*) AS VARCHAR)))[1:16] AS fingerprint
   FROM (SELECT sha256(concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id, coalesce(length(source) || ':' || source, '-'), coalesce(length(text) || ':' || text, '-'))) AS h FROM documents)""")
def corpus_fingerprint(spark, sf_dir):
    return search.fingerprint(_t(spark, sf_dir, "documents"), "doc_id", "source", "text")


@_query("""SELECT CAST(conv_id AS VARCHAR) AS protocol_id, CAST(sum(length(text) % 30) AS BIGINT) AS n_total_all_experiments, CAST(count(*) AS INTEGER) AS num_experiments,
   string_agg(DISTINCT s, '|' ORDER BY s) AS sexes_seen, count(DISTINCT s) = 1 AS single_sex_design, false AS is_colony, conv_id % 3 > 0 AS alternatives_present,
   CAST(conv_id % 3 > 0 AS INTEGER) AS engines_count, CAST(conv_id % 3 = 2 AS INTEGER) AS queries_count, CASE WHEN conv_id % 3 = 2 THEN 4 ELSE 0 END AS conclusion_length
   FROM (SELECT *, CASE WHEN conv_id % 3 = 1 AND turn % 2 = 1 THEN 'F' ELSE 'M' END AS s FROM conversations) GROUP BY conv_id""")
def feature_summary(spark, sf_dir):
    return report.feature_summary(protocols(spark, sf_dir)).withColumn("sexes_seen", F.array_join("sexes_seen", "|"))


_AGE_WORDS = {"יום": ("days", 1), "שבועות": ("weeks", 7), "חודשים": ("months", 30), "?": ("?", None)}


@_query("""WITH g AS (
   SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_linenumber AS line, l_linestatus AS species, l_returnflag AS strain, l_linenumber % 2 AS male, CAST(l_quantity AS INTEGER) AS n, CAST(l_partkey % 50 AS DOUBLE) AS age,
     ['days', 'weeks', 'months', '?'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS unit, [1, 7, 30, NULL][CAST(l_suppkey % 4 AS INTEGER) + 1] * CAST(l_partkey % 50 AS DOUBLE) AS days, l_partkey % 3 AS w
   FROM lineitem
 ) SELECT o AS l_orderkey, string_agg(DISTINCT species, ', ' ORDER BY species) AS species, string_agg(DISTINCT strain, ', ' ORDER BY strain) AS strain,
   CASE WHEN count(DISTINCT male) = 2 THEN 'both' WHEN max(male) = 1 THEN 'M' ELSE 'F' END AS sex, CAST(sum(n) AS INTEGER) AS n,
   coalesce(arg_min(age, days * 100 + k) FILTER (days IS NOT NULL), arg_max(age, k)) AS age_value, coalesce(arg_min(unit, days * 100 + k) FILTER (days IS NOT NULL), arg_max(unit, k)) AS age_unit,
   arg_max(CAST(line AS DOUBLE), k) FILTER (w > 0) AS weight_value, arg_max(CASE w WHEN 1 THEN 'g' ELSE 'kg' END, k) FILTER (w > 0) AS weight_unit, CAST(CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS INTEGER) AS n_groups
 FROM g GROUP BY o""")
def animal_groups(spark, sf_dir):
    """The groups of an experiment's animals as one: joined sets, the sum, the least age over units, the last weight that is given."""
    word = F.get(F.array(*map(F.lit, _AGE_WORDS)), F.expr("cast(l_suppkey % 4 as int)"))
    weight = F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber").cast("string")).otherwise("")
    values = {
        "species": F.col("l_linestatus"), "strain": F.col("l_returnflag"), "sex": F.when(F.col("l_linenumber") % 2 == 1, "זכר").otherwise("נקבה"), "n": F.col("l_quantity").cast("int").cast("string"),
        "age": (F.col("l_partkey") % 50).cast("string"), "age_unit": word, "weight": weight, "weight_unit": F.when(F.col("l_partkey") % 3 == 1, "גרם").otherwise('ק"ג'), "genetic_modification": F.lit("לא"), "source": F.lit("אחר"), "supplier": F.lit(""),
    }
    group = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(*[values[k].alias(k) for k in form_experiments.GROUP]).alias("g"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(group)).alias("own"))
    made = rows.select("l_orderkey", form_experiments.aggregated(F.transform("own", lambda x: x["g"])).alias("a"))
    return made.select(
        "l_orderkey", "a.species", "a.strain", "a.sex", "a.n", F.col("a.age.value").alias("age_value"), F.col("a.age.unit").alias("age_unit"), F.col("a.weight.value").alias("weight_value"), F.col("a.weight.unit").alias("weight_unit"),
        F.coalesce(F.size("a.groups"), F.lit(0)).alias("n_groups"),
    )
