"""Evidence-state ranks, lookups on fixed tables and three-valued predicates as Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from mxposture.constants import STATE_RANK, UNUSABLE_STATES


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Fixed table as one literal map: a constant in the plan, small generated code."""
    entries = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items())
    found = F.try_element_at(F.expr(f"map({entries})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def state_rank(state: Column) -> Column:
    return lookup(state, STATE_RANK)


def state_from_rank(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in STATE_RANK.items()})


def weakest(states: Iterable[Column]) -> Column:
    """Weakest of several state columns in one row; nulls do not take part."""
    ranks = [state_rank(s) for s in states]
    return state_from_rank(F.least(*ranks) if len(ranks) > 1 else ranks[0])


def weakest_in_array(states: Column) -> Column:
    return state_from_rank(F.array_min(F.transform(states, state_rank)))


def weakest_agg(state: Column) -> Column:
    """Group form: min over ranks merges map-side and moves one int per group."""
    return state_from_rank(F.min(state_rank(state)))


def predicate(op: str, value: Column, literal, dtype: str, state: Column | None = None) -> Column:
    """True / false / null (unusable) for one predicate; null also for a type mismatch."""
    result = _compare(op, value, literal, dtype)
    unusable = value.isNull()
    if state is not None:
        unusable = unusable | F.coalesce(state.isin(UNUSABLE_STATES), F.lit(False))
    return F.when(unusable, F.lit(None).cast("boolean")).otherwise(result)


def _compare(op: str, value: Column, literal, dtype: str) -> Column:
    if op in ("contains_any", "contains_none"):
        wanted = [x for x in literal]
        if dtype.startswith("array"):
            hit = F.arrays_overlap(value, F.array(*[F.lit(x) for x in wanted]))
            hit = F.coalesce(hit, F.lit(False))
        elif dtype == "string":
            low = F.lower(value)
            hit = F.lit(False)
            for item in wanted:
                if isinstance(item, str):
                    hit = hit | low.contains(item.lower())
        else:
            hit = F.lit(False)
        return ~hit if op == "contains_none" else hit
    if op in ("lt", "lte", "gt", "gte"):
        if dtype not in ("int", "bigint", "smallint", "tinyint") or isinstance(literal, bool):
            return F.lit(None).cast("boolean")
        return {
            "lt": value < literal,
            "lte": value <= literal,
            "gt": value > literal,
            "gte": value >= literal,
        }[op]
    if op in ("in", "not_in"):
        same = [x for x in literal if _same_type(x, dtype)]
        hit = value.isin(same) if same else F.lit(False)
        return ~hit if op == "not_in" else hit
    hit = (value == F.lit(literal)) if _same_type(literal, dtype) else F.lit(False)
    return ~hit if op == "not_eq" else hit


def _same_type(literal, dtype: str) -> bool:
    if isinstance(literal, bool):
        return dtype == "boolean"
    if isinstance(literal, int):
        return dtype in ("int", "bigint", "smallint", "tinyint")
    return isinstance(literal, str) and dtype == "string"


def conjunction(parts: list[Column]) -> Column:
    """Kleene AND: false beats null beats true; empty is true."""
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out
