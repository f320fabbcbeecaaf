"""Required fields of requests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The required fields of each kind of request.
REQUIRED_FIELDS = {
    "seal": ("name", "sequence"),
    "sync": ("object_id", "fco_root"),
    "turn": ("role", "content"),
    "chat": ("message",),
    "chunk": ("text",),
}


def _filled(name: str) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def missing_fields(fields: Sequence[str]) -> Column:
    """Names of required fields that are null or empty, comma separated."""
    return F.concat_ws(",", *[F.when(~_filled(f), F.lit(f)) for f in fields])


def all_filled(fields: Sequence[str]) -> Column:
    return reduce(and_, [_filled(f) for f in fields])


def split_required(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with a ``reason`` column."""
    complete = all_filled(fields)
    reason = F.concat(missing_fields(fields), F.lit(" required"))
    return df.where(complete), df.where(~complete).withColumn("reason", reason)


def split_any_required(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same where one filled field of several is enough."""
    complete = F.coalesce(*[F.when(_filled(f), F.lit(True)) for f in fields], F.lit(False))
    reason = F.lit(" or ".join(fields) + " required")
    return df.where(complete), df.where(~complete).withColumn("reason", reason)
