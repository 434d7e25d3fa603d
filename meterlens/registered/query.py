"""One registered query: a name, its Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from meterlens.functions.shape import flat
from meterlens.registered.inputs_sql import with_inputs
from meterlens.sources.fixtures import FixtureTables


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[FixtureTables], DataFrame]
    sql: str | None = None
    #: Decimals shown.  Short decimals times or over small numbers often end in an exact 5 right after the fourth.
    digits: int = 4

    def rows(self, tables: FixtureTables) -> DataFrame:
        """The result as plain columns."""
        return flat(self.plan(tables), self.digits)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_inputs(self.sql)


def scratch(t: FixtureTables) -> str:
    """A folder for written marts: shared storage on a cluster, a fresh local one where none is named."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        return tempfile.mkdtemp(prefix="meterlens-marts-")
    return f"{shared}/meterlens-marts-{uuid.uuid4().hex}"


def num(expression: str, name: str, digits: int = 4) -> str:
    """A rounded double column."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {name}"


def whole(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def stamp(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


DBUS, SPEND = num("sum(qty)", "total_dbus"), num("sum(spend)", "total_spend")
SUMS = f"{DBUS}, {SPEND}"
