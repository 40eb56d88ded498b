"""The core's queries by name, with the SQL that checks them."""

from __future__ import annotations

from weftline.operators import drift
from weftline.plans import queries_data, queries_events, queries_shapes, queries_work, registry  # noqa: F401

QUERIES = {"p3_found": drift.p3_found, "p3_scripts": drift.p3_scripts, "p3_table": drift.p3_table} | registry.QUERIES
SQL = registry.SQL
flagship = queries_data.flagship
