"""Source adapters: external tables in, canonical raw events out, by registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Adapter = Callable[..., DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(name: str) -> Callable[[Adapter], Adapter]:
    """Register a `DataFrame -> DataFrame` mapping; a taken name is an error."""

    def add(fn: Adapter) -> Adapter:
        if name in _ADAPTERS:
            raise ValueError(f"adapter name {name!r} is already registered")
        _ADAPTERS[name] = fn
        return fn

    return add


def get_adapter(name: str) -> Adapter:
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name!r}; registered: {sorted(_ADAPTERS)}")
    return _ADAPTERS[name]


RAW_COLUMNS = ("event_id", "customer_id", "session_id", "ts", "type", "payload", "source")


@register_adapter("simulator")
def canonical(records: DataFrame) -> DataFrame:
    """Records already in canonical form; only the source stamp is set."""
    return records.withColumn("source", F.lit("simulator")).select(*RAW_COLUMNS)


@register_adapter("shop_orders")
def shop_orders(records: DataFrame) -> DataFrame:
    """Orders with nested lines (see `fixtures.order_events`), stamped as adapter rows."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return records.withColumn("ts", iso).withColumn("source", F.lit("adapter")).select(*RAW_COLUMNS)
