"""Packed values as column functions: expressions where there is one (``packed``), Arrow batches for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake.functions.packed import client_state, ipv6, member_details, resolver_address, sid, sockaddr
from tracelake.operators import objects

__all__ = ["client_state", "decoded", "ipv6", "location_state", "member_details", "resolver_address", "service_binding", "sid", "sockaddr", "state"]


@F.pandas_udf(StringType())
def _decoded(annotation: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else objects.decoded(a, v) for a, v in zip(annotation, value, strict=True)])


@F.pandas_udf(StringType())
def _state(kind: pd.Series, title: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([objects.state(k, t, bytes(d)) for k, t, d in zip(kind, title, data, strict=True)])


def decoded(annotation: str | Column, value: Column) -> Column:
    """The value as an annotation (``network:sockaddr`` and the like) wants it shown; empty if no decoder is named."""
    return _decoded(F.lit(annotation) if isinstance(annotation, str) else annotation, value)


def state(kind: Column, title: Column, data: Column) -> Column:
    """A state dump's payload as text."""
    return _state(kind, title, data)


def service_binding(value: Column) -> Column:
    return decoded("mdns:rd.svcb", value)


def location_state(value: Column) -> Column:
    return decoded("location:_CLLocationManagerStateTrackerState", value)
