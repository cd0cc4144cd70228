"""All registered queries over the driver tables, and the SQL that gives the same rows."""

from quillon.plans import function_queries, io_queries, relational_queries, stream_queries, ts_queries  # noqa: F401
from quillon.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "join_agg_having_sort"
