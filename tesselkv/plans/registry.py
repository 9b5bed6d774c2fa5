"""All queries of the core and the SQL that checks them."""

from tesselkv.plans import problems, store_queries

QUERIES = {**store_queries.QUERIES, **problems.QUERIES}
ORACLE = {**store_queries.ORACLE, **problems.ORACLE}
