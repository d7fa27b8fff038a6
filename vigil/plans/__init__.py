"""Registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from . import alerts, domain, geo, records, reports, snapshots

QUERIES = {**alerts.QUERIES, **domain.QUERIES, **geo.QUERIES, **records.QUERIES, **snapshots.QUERIES, **reports.QUERIES}
ORACLE = {**alerts.ORACLE, **domain.ORACLE, **geo.ORACLE, **records.ORACLE, **snapshots.ORACLE, **reports.ORACLE}
