"""The query catalogue: ``QUERIES`` and the SQL of each, ``ORACLE_SQL``."""

from . import approvals, catalogue, forms, records, reports
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "approvals", "catalogue", "forms", "records", "reports"]
