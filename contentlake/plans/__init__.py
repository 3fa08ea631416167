"""All registered queries: QUERIES and ORACLE."""

from contentlake.plans import catalog, filtering, ingest, keyspace, monitor, peers, search, streams, text
from contentlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog", "filtering", "ingest", "keyspace", "monitor", "peers", "search", "streams", "text"]
