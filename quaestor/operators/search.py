"""Ranked search over a corpus: BM25 over words, cosine over vectors, merging and snippets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, snippet

K1, B = 1.5, 0.75
#: Bytes of the queries that are sent to every task at once, and records that a task scores at once.
BROADCAST_BYTES, ROWS_AT_ONCE = 64 << 20, 512


def tokens(text: Column) -> Column:
    """Words of over one character, lower-cased; the length is that before lower-casing."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0)), lambda x: F.length(x) > 1), lambda x: F.lower(x))


def term_counts(corpus: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf), one row for each word of a record."""
    return corpus.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_lengths(corpus: DataFrame, key: str, text: Column) -> DataFrame:
    return corpus.select(key, F.size(tokens(text)).cast("long").alias("dl"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def top_k(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best rows of each query; of equal scores, the higher key wins. Scores are compared to nine places, so that the
    order in which a sum was made doesn't matter. Spark cuts each partition to k rows before it shuffles them."""
    scored = scored.withColumn("score", F.round("score", 9))
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, query: str, size: Column, most: int) -> list[DataFrame]:
    """The queries in blocks by a hash, each of about `most` bytes at most: a block goes to every task."""
    total = queries.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // most))
    return [queries.where(F.pmod(F.xxhash64(query), F.lit(n)) == b) if n > 1 else queries for b in range(n)]


def _best(hits: pd.DataFrame, query: str, key: str, k: int) -> pd.DataFrame:
    return hits.sort_values([query, "score", key], ascending=[True, False, False]).groupby(query, sort=False).head(k)


def _in_tasks(rows: DataFrame, score, schema: str, query: str, key: str, k: int) -> DataFrame:
    """The k best hits of each query in each partition of `rows`: `score` gives the hits of a batch, of which no more are kept.
    So a partition sends k rows for each query, however many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for a in range(0, len(batch), ROWS_AT_ONCE):
                hits = score(batch.slice(a, ROWS_AT_ONCE))
                hits["score"] = hits["score"].round(9)
                kept = _best(hits if kept is None else pd.concat([kept, hits]), query, key, k)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept[[query, key, "score"]], preserve_index=False)

    return rows.mapInArrow(run, schema)


def bm25(corpus: DataFrame, queries: DataFrame, key: str, text: Column, query: str, query_text: Column, k: int, keep: Column | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query, key, score, rank): Okapi BM25. Counts, frequencies and the average length are those of the whole corpus,
    `keep` filters candidates only; a word that a query repeats counts again; only positive scores are hits.

    One scan counts the queries' words; a second one scores each record where it lies, against the queries' weights, which
    are sent to the tasks in blocks of bounded size. No pair of query and record is shuffled but the k best of a partition.
    """
    spark, kinds = corpus.sparkSession, {query: queries.schema[query].dataType.simpleString(), key: corpus.schema[key].dataType.simpleString()}
    asked = queries.select(query, F.explode(tokens(query_text)).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    terms = asked.select("term").union(spark.range(1).select(F.lit("").alias("term"))).distinct()
    seen = corpus.select(tokens(text).alias("w")).select(F.size("w").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("term"))
    counts = seen.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")).persist()  # a row for each word asked for
    whole = counts.where("term = ''").first()  # the empty word stands for the record itself
    n, average = (whole["df"], whole["dl"] / whole["df"] or 1.0) if whole else (0, 1.0)
    weights = asked.join(counts, "term").select(query, "term", (F.col("qtf") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    rows = corpus.where(keep) if keep is not None else corpus
    rows = rows.select(F.col(key), tokens(text).alias("_words"))
    out = None
    for block in _blocks(weights, query, F.octet_length("term") + 32, broadcast_bytes):
        shared = spark.sparkContext.broadcast(_Weights(block.toArrow(), query, average))
        found = _in_tasks(rows, lambda batch, shared=shared: shared.value.score(batch, query, key), f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, score double", query, key, k)
        out = found if out is None else out.union(found)
    return top_k(out, query, key, k)


class _Weights:
    """Weights of a block of queries by word: word t has those of the entries first[t] to first[t + 1]."""

    def __init__(self, table: pa.Table, query: str, average: float):
        words, ids = table.column("term").combine_chunks(), table.column(query).combine_chunks().dictionary_encode()
        self.words = pc.unique(words)
        self.queries, self.average = ids.dictionary.to_pandas().to_numpy(), average
        at = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        self.owner, self.weight = ids.indices.to_numpy()[order], table.column("w").to_numpy()[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.words))))).astype(np.int64)

    def score(self, batch: pa.RecordBatch, query: str, key: str) -> pd.DataFrame:
        words, keys = batch.column("_words"), batch.column(key).to_pandas().to_numpy()
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(words.flatten(), value_set=self.words)
        doc, hit = np.repeat(np.arange(len(words)), lengths), found.is_valid().to_numpy(zero_copy_only=False)
        term = found.drop_null().to_numpy().astype(np.int64)
        pairs, tf = np.unique(doc[hit] * max(len(self.words), 1) + term, return_counts=True)
        doc, term = pairs // max(len(self.words), 1), pairs % max(len(self.words), 1)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / self.average))
        many = self.first[term + 1] - self.first[term]
        entry = np.arange(int(many.sum())) + np.repeat(self.first[term] - np.cumsum(many) + many, many)
        total = np.bincount(np.repeat(doc, many) * len(self.queries) + self.owner[entry], weights=np.repeat(part, many) * self.weight[entry], minlength=len(words) * len(self.queries))
        at = np.flatnonzero(total > 0)
        width = max(len(self.queries), 1)
        return pd.DataFrame({query: self.queries[at % width], key: keys[at // width], "score": total[at]})


def cosine(corpus: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, keep: Column | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query, key, score, rank): exact cosine of each query with each candidate; vectors of zeros count as of length 1e-9,
    and null vectors, or ones of another dimension, are no candidates. Queries are a stated set: blocks of them, of bounded
    size, go to the tasks, which multiply matrices batch by batch and send on their k best rows for each query."""
    spark = corpus.sparkSession
    candidates = corpus.where(keep) if keep is not None else corpus
    candidates = candidates.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query), F.col(query_vector).cast("array<double>").alias("_q"))
    schema = f"`{query}` {queries.schema[query].dataType.simpleString()}, `{key}` {corpus.schema[key].dataType.simpleString()}, score double"
    out = None
    for block in _blocks(asked, query, F.size("_q") * 8 + 16, broadcast_bytes):
        for dimension in [r[0] for r in block.select(F.size("_q")).distinct().collect()]:  # one, as a rule
            some = block.where(F.size("_q") == dimension).toArrow()
            ids, matrix = some.column(query).to_pandas().to_numpy(), _matrix(some.column("_q").combine_chunks(), dimension)
            shared = spark.sparkContext.broadcast((ids, matrix))

            def score(batch: pa.RecordBatch, shared=shared) -> pd.DataFrame:
                ids, asked = shared.value
                made = _matrix(batch.column("_v"), asked.shape[1]) @ asked.T
                keys = batch.column(key).to_pandas().to_numpy()
                return pd.DataFrame({query: np.tile(ids, len(keys)), key: np.repeat(keys, len(ids)), "score": made.ravel()})

            found = _in_tasks(candidates.where(F.size("_v") == dimension), score, schema, query, key, k)
            out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top_k(out, query, key, k)


def _matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of one dimension as rows of length one."""
    made = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    norms = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return made / np.where(norms == 0, 1e-9, norms)


def species_filter(species: Column, wanted: list[str]) -> Column:
    """Records of one of the species, and records about none."""
    return (F.coalesce(F.size(species), F.lit(0)) == 0) | F.arrays_overlap(species, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def search(corpus: DataFrame, queries: DataFrame, key: str, text: Column, query: str, query_text: Column, k: int, vector: str | None = None, query_vector: str | None = None, keep: Column | None = None) -> DataFrame:
    """By vectors where both sides have them, else by words; `method` says which."""
    if vector in corpus.columns and query_vector in queries.columns:
        return cosine(corpus, queries, key, vector, query, query_vector, k, keep).withColumn("method", F.lit("embedding"))
    return bm25(corpus, queries, key, text, query, query_text, k, keep).withColumn("method", F.lit("lexical"))


def merge(hits: DataFrame, group: str, query: str, key: str, k: int = 5) -> DataFrame:
    """(group, key, score, place): the hits of a group's queries in query and rank order, each record once, cut to k."""
    first = Window.partitionBy(group, key).orderBy(query, "rank")
    place = Window.partitionBy(group).orderBy(query, "rank")
    once = hits.withColumn("_first", F.row_number().over(first)).where("_first = 1").withColumn("place", F.row_number().over(place))
    return once.where(F.col("place") <= k).select(group, key, "score", "place")


def notice(method: Column, n: Column) -> Column:
    return F.when(n == 0, "unavailable").when(method == "lexical", "degraded").otherwise("")


def grounding(hits: DataFrame, corpus: DataFrame, group: str, key: str, text: str, most: int = 700) -> DataFrame:
    """(group, block): the merged hits' texts, numbered [G1], [G2], ... and cut."""
    line = F.concat(F.lit("[G"), F.col("place").cast("string"), F.lit("] "), snippet(F.col(text), most))
    return hits.join(corpus.select(key, text), key).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines")).select(group, F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("block"))


def fingerprint(corpus: DataFrame, key: str, *columns: str, place: str | None = None) -> DataFrame:
    """One row: a digest of all records, of 16 hexadecimal digits. Records count as often as they stand there, and by their
    place, if a column gives it; that the rows lie in other partitions changes nothing. A null differs from an empty text.

    Four sums over 64-bit parts of each record's SHA-256, so nothing is sorted and sums combine before the shuffle."""
    own = [F.col(key).cast("string"), *[F.col(c).cast("string") for c in columns], *([F.col(place).cast("string")] if place else [])]
    each = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in own]), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(4)]
    return corpus.select(each.alias("_h")).agg(F.substring(F.sha2(F.concat_ws(",", *sums, F.count("*").cast("string")), 256), 1, 16).alias("fingerprint"))
