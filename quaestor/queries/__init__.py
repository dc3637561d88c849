"""Registered queries over the driver's tables, each with the SQL that checks it."""

from . import review, tables

QUERIES = {**review.QUERIES, **tables.QUERIES}
ORACLE_SQL = {**review.ORACLE_SQL, **tables.ORACLE_SQL}
