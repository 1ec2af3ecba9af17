"""Row-level access rules as Columns. ``today`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import restriction_values

# Levels in ascending order, and what each role may see.
LEVELS = ("public", "internal", "confidential", "secret")
ROLE_LEVEL = {
    "employee": "internal", "student": "internal", "assistant": "internal", "lab_admin": "confidential",
    "teacher": "confidential", "senior_student": "confidential", "pi": "secret", "hr": "confidential",
    "it_support": "confidential", "manager": "secret", "admin": "secret",
}
ROLE_VISIBILITY = {
    "admin": ("public", "project", "restricted"), "pi": ("public", "project", "restricted"),
    "teacher": ("public", "project"), "lab_admin": ("public", "project"), "senior_student": ("public", "project"),
    "editor": ("public", "project"), "manager": ("public", "project"), "hr": ("public", "project"),
    "it_support": ("public", "project"), "student": ("public",), "assistant": ("public",), "viewer": ("public",),
    "employee": ("public",),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in values.items() for x in pair))


def level_rank(level: Column | str) -> Column:
    """0 to 3; null for an unknown level."""
    return (F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), _col(level)), F.lit(0).cast("long")) - 1).cast("int")


def role_rank(role: Column | str) -> Column:
    """Highest level of a role; unknown roles have that of ``internal``."""
    return level_rank(F.coalesce(F.element_at(_map(ROLE_LEVEL), _col(role)), F.lit("internal")))


def role_visibilities(role: Column | str) -> Column:
    """Visibilities of a role; unknown roles see what is public."""
    return F.coalesce(F.element_at(_map(ROLE_VISIBILITY), _col(role)), F.array(F.lit("public")))


def metadata_date(value: Column | str) -> Column:
    """Struct (day, invalid): absent values are unbounded, malformed ones invalid."""
    c = F.trim(_col(value).cast("string"))
    day = F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    absent = c.isNull() | (c == "")
    return F.struct(F.when(~absent, day).alias("day"), (~absent & day.isNull()).alias("invalid"))


def in_effect(effective: Column | str, expiry: Column | str, today: Column, include_expired: bool = False) -> Column:
    """Whether ``today`` lies between both dates; malformed dates deny, also with ``include_expired``."""
    a, b = metadata_date(effective), metadata_date(expiry)
    inside = F.coalesce(a["day"] <= today, F.lit(True))
    if not include_expired:
        inside = inside & F.coalesce(b["day"] >= today, F.lit(True))
    return ~a["invalid"] & ~b["invalid"] & inside


def prefilter(role: Column | str, confidentiality: Column | str, visibility: Column | str) -> Column:
    """The rule that can be pushed to a scan: both fields have to equal an allowed value."""
    return F.coalesce((level_rank(confidentiality) <= role_rank(role)) & F.array_contains(role_visibilities(role), _col(visibility)), F.lit(False))


def may_read(
    role: Column, department: Column, active: Column, confidentiality: Column, visibility: Column, departments: Column,
    roles: Column, effective: Column, expiry: Column, today: Column, include_expired: bool = False,
) -> Column:
    """The whole rule for one document and one user.

    A null role is nobody and reads nothing, like an inactive user. Documents without
    a level are internal and without a visibility public; unknown levels deny. Lists
    of departments and roles that are not empty have to hold the user's.
    """
    level = level_rank(F.coalesce(F.nullif(confidentiality, F.lit("")), F.lit("internal")))
    shown = F.coalesce(F.nullif(visibility, F.lit("")), F.lit("public"))
    own = lambda allowed, value: (F.size(restriction_values(allowed)) == 0) | F.array_contains(restriction_values(allowed), value)
    rule = active & in_effect(effective, expiry, today, include_expired) & (level <= role_rank(role)) & F.array_contains(role_visibilities(role), shown)
    return F.coalesce(role.isNotNull() & rule & own(departments, department) & own(roles, role), F.lit(False))


def is_published(state: Column | str) -> Column:
    """Rows without a state count as active; any state but active is hidden."""
    return F.coalesce(_col(state), F.lit("active")) == "active"


def may_write_project(role: Column, user: Column, creator: Column, lead: Column, members: Column) -> Column:
    """Administrators, leaders, the creator, the lead and members."""
    return F.coalesce(role.isin("admin", "pi") | (user == creator) | (user == lead) | F.array_contains(members, user), F.lit(False))
