"""Candidate actions of a context, kept as one array per row until someone needs rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import candidate_rows

CANDIDATE_TYPE = ("struct<catalog_order:bigint,candidate_id:string,archetype:string,"
                  "contact:boolean,cost_cents:bigint,discount_bps:bigint,"
                  "params:map<string,string>>")

Provider = Callable[[], Column]
_PROVIDERS: dict[str, Provider] = {}


def register_provider(name: str) -> Callable[[Provider], Provider]:
    """Register a function returning an array of candidates (it may read context columns)."""

    def add(fn: Provider) -> Provider:
        if name in _PROVIDERS:
            raise ValueError(f"action provider {name!r} is already registered")
        _PROVIDERS[name] = fn
        return fn

    return add


def candidate(candidate_id: str, archetype: str, contact: bool, cost_cents: int,
              params: dict[str, str] | None = None, order: int = 1000,
              discount_bps: Column | int | None = None) -> Column:
    """One candidate as a struct; `discount_bps` may be a context column."""
    params = params or {}
    bps = discount_bps if discount_bps is not None else int(params.get("discount_bps", 0))
    bps = bps if isinstance(bps, Column) else F.lit(bps)
    pairs = [F.lit(x) for kv in sorted(params.items()) for x in kv]
    return F.struct(
        F.lit(order).cast("long").alias("catalog_order"),
        F.lit(candidate_id).alias("candidate_id"), F.lit(archetype).alias("archetype"),
        F.lit(contact).alias("contact"), F.lit(cost_cents).cast("long").alias("cost_cents"),
        bps.cast("long").alias("discount_bps"),
        F.create_map(*pairs).cast("map<string,string>").alias("params"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


@lru_cache
def _rows(archetypes: tuple[str, ...] | None = None) -> str:
    """The fixed catalog as one SQL array literal (a single call into the JVM)."""
    items = []
    for r in candidate_rows():
        if archetypes is not None and r["archetype"] not in archetypes:
            continue
        pairs = ", ".join(_text(x) for kv in sorted(r["params"].items()) for x in kv)
        items.append(
            f"named_struct('catalog_order', {r['catalog_order']}L, "
            f"'candidate_id', {_text(r['candidate_id'])}, 'archetype', {_text(r['archetype'])}, "
            f"'contact', {str(r['contact']).lower()}, 'cost_cents', {r['cost_cents']}L, "
            f"'discount_bps', {r['discount_bps']}L, "
            f"'params', cast(map({pairs}) as map<string,string>))")
    return f"array({', '.join(items)})"


@register_provider("catalog")
def catalog_candidates() -> Column:
    """Every archetype and variant of the action catalog."""
    return F.expr(_rows())


def all_candidates(providers: Iterable[str] | None = None) -> Column:
    """Candidates of the named providers, first seen wins per id; restraint always present."""
    names = sorted(_PROVIDERS) if providers is None else list(providers)
    if names == ["catalog"]:
        return catalog_candidates()  # holds every id once, restraint included
    restraint = F.expr(_rows(("none", "wait")))
    merged = F.concat(*[_PROVIDERS[n]() for n in names], restraint)
    ids = F.transform(merged, lambda c: c["candidate_id"])
    return F.filter(merged, lambda c, i: F.array_position(ids, c["candidate_id"]) == i + 1)


def with_candidates(contexts: DataFrame, providers: Iterable[str] | None = ("catalog",)) -> DataFrame:
    return contexts.withColumn("candidates", all_candidates(providers))
