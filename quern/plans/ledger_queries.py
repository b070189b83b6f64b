"""All queries of the ledger; importing this module registers them."""

from quern.plans import flow_queries, report_queries, series_queries, taxonomy_queries  # noqa: F401
