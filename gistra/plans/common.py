"""Shared pieces of the named queries and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistra.sources.tables import table  # noqa: F401


def folder(s) -> str:
    """A folder that executors share: under the checkpoint folder where one is named."""
    named = s.conf.get("spark.checkpoint.dir", None)
    return f"{named or s.conf.get('spark.sql.warehouse.dir')}/gistra-streams/{uuid.uuid4().hex}"


def H(seed: int, x: str) -> str:
    """SQL of the canonical hash."""
    return f"('0x' || substr(md5('{seed}:' || {x}), 1, 15))::BIGINT"


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def r4(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 4).alias(name or c)


def rho_sql(rest: str, width: int) -> str:
    return f"({width + 1} - length(ltrim(bin({rest}), '0')))"


def positions_sql(x: str, k: int, m: int) -> str:
    """A SQL list of the k positions of double hashing."""
    return f"list_transform(range({k}), lambda i: (({H(1, x)} % {m}) + i * ({H(2, x)} % {m})) % {m})"
