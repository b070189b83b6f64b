"""Tenancy: tables are reached through a context that carries the organisation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TenantContext:
    """The only way to a tenant's tables; a context without an organisation cannot be made."""

    def __init__(self, org_id, tables: Mapping[str, Callable[[], DataFrame]], shared: frozenset[str] = frozenset()):
        if org_id is None or org_id == "":
            raise ValueError("a tenant context needs an organisation")
        self.org_id, self._tables, self._shared = org_id, tables, shared

    def table(self, name: str) -> DataFrame:
        """The organisation's rows; of a shared table also the rows that belong to nobody."""
        rows = self._tables[name]()
        own = F.col("org_id") == F.lit(self.org_id)
        return rows.where(own | F.col("org_id").isNull()) if name in self._shared else rows.where(own)
