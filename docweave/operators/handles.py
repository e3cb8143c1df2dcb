"""One table by its keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..plans.layout import Layout, TableLayout


@dataclass(frozen=True)
class Handle:
    """The rows of a table, by its own key and by its parent's."""

    rows: DataFrame
    table: TableLayout

    def get(self, id_: object) -> DataFrame:
        """The row with this key, or none."""
        return self.rows.where(F.col("id") == F.lit(id_))

    def of_parent(self, id_: object) -> DataFrame:
        """The rows of one parent's collection, in their order."""
        by = {f.role: f.name for f in self.table.fields}
        if "parent" not in by:
            raise Refused("configuration", self.table.name, "the table has no parent")
        return self.rows.where(F.col(f"`{by['parent']}`") == F.lit(id_)).orderBy(f"`{by['position']}`")


def handles(tables: dict[str, DataFrame], layout: Layout) -> dict[str, Handle]:
    return {n: Handle(tables[n], t) for n, t in layout.by_name().items()}
