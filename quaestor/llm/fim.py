"""Fill-in-middle: documents cut in three and reordered, by DuckDB SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle. A text that holds one stays as it is, so marks in an output are never text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are cut, and of a hundred of these that have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text that DuckDB holds at once (a longer text is handled alone): a list of code points takes some 16 bytes each.
SLICE = 2 << 20
#: What a task's DuckDB may hold: enough for a text of some 30 million code points.
MEMORY = "2GB"

_TRANSFORM = r"""
WITH units AS (
  SELECT place, coalesce(id, '') AS id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s).') AS u, sha256($seed || ':' || coalesce(id, '')) AS h FROM batch
), drawn AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM units
), cuts AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR d[3] % 100 >= $cut THEN 'plain'
         WHEN d[4] % 100 < $first THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM cuts
)
SELECT place, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat($p, prefix, $s, suffix, $m, middle) ELSE concat($s, suffix, $p, prefix, $m, middle) END AS output
FROM parts ORDER BY place
"""

#: A mark is found where it first stands: the parts hold none, and no mark begins as another one, or itself, ends.
_RESTORE = """
SELECT place, CASE form WHEN 'psm' THEN concat(head[4:], split_part(rest, $m, 2), split_part(rest, $m, 1))
                     WHEN 'spm' THEN concat(split_part(rest, $m, 1), split_part(rest, $m, 2), head[4:]) ELSE output END AS restored
FROM (SELECT place, form, output, split_part(output, mark, 1) AS head, split_part(output, mark, 2) AS rest
      FROM (SELECT place, form, coalesce(output, '') AS output, CASE form WHEN 'psm' THEN $s ELSE $p END AS mark FROM batch)) ORDER BY place
"""


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about SLICE bytes of a column each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > SLICE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def _by_sql(sql: str, column: str, kept: int, **given: str | int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's batches through a DuckDB statement. The first `kept` columns go past it; the others are its `batch`, with the
    row number `place`, by which it orders its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for whole in batches:
            for batch in _slices(whole, column):
                columns = {batch.schema.names[i]: batch.column(i) for i in range(kept, batch.num_columns)}
                con.register("batch", pa.table({"place": pa.array(range(len(batch)), pa.int64()), **columns}))
                made = con.sql(sql, params=given).to_arrow_table().combine_chunks()
                con.unregister("batch")
                fields = {batch.schema.names[i]: batch.column(i) for i in range(kept)} | {c: made.column(c) for c in made.column_names[1:]}
                yield from pa.table(fields).combine_chunks().to_batches()
        con.close()

    return run


def _kept(df: DataFrame, keep: tuple[str, ...]) -> tuple[Column, str]:
    """Kept columns as one struct, so that no name of theirs meets one of the statement's, and its type."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    return kept.alias("kept"), df.select(kept.alias("kept")).schema["kept"].dataType.simpleString()


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The columns of `keep`, then n (the text's code points), form, prefix_chars, middle_chars (null if plain) and output.

    What is drawn for a document depends on `seed` and its doc_id alone: four numbers of the sha256 of "seed:doc_id" say where
    prefix and middle end, whether it is cut and which form it takes: `psm` (prefix, suffix, middle), `spm` (suffix, prefix,
    middle) or `plain` (the text as it is). A text counts in code points. Null and empty texts are plain and give the empty
    output; texts that hold a mark are plain. A null doc_id counts as the empty string; repeated rows count each, and those of
    one doc_id and text are cut alike. An empty table stays empty; columns outside `keep` are left out; `keep` may name
    any, but one with the name of a result gives way to it.
    """
    kept, kind = _kept(docs, keep)
    run = _by_sql(_TRANSFORM, "text", 1, seed=str(seed), cut=cut, first=suffix_first, p=PREFIX, s=SUFFIX, m=MIDDLE)
    made = docs.select(kept, F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return _opened(made.mapInArrow(run, f"kept {kind}, n long, form string, prefix_chars long, middle_chars long, output string"), keep)


def restore(made: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then restored: the exact text, rebuilt from output and form alone. A null output counts as
    empty, a null or unknown form as plain."""
    kept, kind = _kept(made, keep)
    run = _by_sql(_RESTORE, "output", 1, p=PREFIX, s=SUFFIX, m=MIDDLE)
    return _opened(made.select(kept, "form", "output").mapInArrow(run, f"kept {kind}, restored string"), keep)


def _opened(made: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return made.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c not in made.columns[1:]], *made.columns[1:])
