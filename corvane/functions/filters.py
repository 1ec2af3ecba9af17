"""A filter language of nested dicts, compiled to a Column.

``{"lang": "en", "n": {"$gte": 3}}``: all keys have to hold. Operators: $eq $ne $in
$nin $gt $gte $lt $lte $exists $contains, and $and $or with lists. Anything unknown is
an error, never a filter that lets all through.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def _one(column: Column, operator: str, value) -> Column:
    if operator == "$eq":
        return F.coalesce(column == F.lit(value), F.lit(False)) if value is not None else column.isNull()
    if operator == "$ne":
        return ~_one(column, "$eq", value)
    if operator == "$in":
        return F.coalesce(column.isin(*value), F.lit(False)) if value else F.lit(False)
    if operator == "$nin":
        return ~_one(column, "$in", value)
    if operator == "$exists":
        return column.isNotNull() if value else column.isNull()
    if operator == "$contains":
        return F.coalesce(F.contains(column.cast("string"), F.lit(str(value))), F.lit(False))
    if operator in _COMPARE:
        return F.coalesce(_COMPARE[operator](column, F.lit(value)), F.lit(False))
    raise ValueError(f"unknown operator {operator}")


def compiled(condition: dict) -> Column:
    """The Column of a condition; rows where it cannot be decided are out."""
    if not condition:
        raise ValueError("an empty filter is no filter")
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            if not value:
                raise ValueError(f"{key} without conditions")
            parts.append(reduce(and_ if key == "$and" else or_, map(compiled, value)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict):
            if not value:
                raise ValueError(f"no condition on {key}")
            parts.extend(_one(F.col(key), op, v) for op, v in value.items())
        else:
            parts.append(_one(F.col(key), "$eq", value))
    return reduce(and_, parts)


def merged(first: dict | None, second: dict | None) -> dict | None:
    """Both conditions, or the one that there is."""
    return {"$and": [first, second]} if first and second else first or second


def search_filter(filters: dict) -> dict | None:
    """Equality on the usual fields and containment of the first tag; blank values do not count."""
    fields = ("doc_type", "project_name", "visibility", "author", "research_direction")
    out = {k: filters[k] for k in fields if filters.get(k)}
    if tags := filters.get("tags"):
        out["tags"] = {"$contains": tags[0] if isinstance(tags, list) else tags}
    return out or None
