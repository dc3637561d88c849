"""Each registered query of the library gives the rows of its SQL."""

from collections import Counter

import duckdb
import pytest

from quaestor.operators import report
from quaestor.queries import ORACLE_SQL, QUERIES, review

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value)


def test_top_messages(spark):
    said = Counter(r.message for r in report.findings(review.protocols(spark, SF)).where("status = 'fail'").collect())
    want = sorted(said.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [(r.message, r.n) for r in review.top_messages(spark, SF).collect()] == want


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall()) == got
