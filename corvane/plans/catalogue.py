"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from .answers import catalogue as answers
from .base import Query
from .corpus import catalogue as corpus
from .details import catalogue as details
from .evaluations import catalogue as evaluations
from .reading import catalogue as reading
from .records import catalogue as records
from .relations import catalogue as relations
from .retrieval import catalogue as retrieval
from .services import catalogue as services


def queries() -> dict[str, Query]:
    return retrieval.queries | corpus.queries | answers.queries | details.queries | records.queries | relations.queries | evaluations.queries | services.queries | reading.queries


def oracle_sql() -> dict[str, str]:
    return retrieval.sql | corpus.sql | answers.sql | details.sql | records.sql | relations.sql | evaluations.sql | services.sql | reading.sql
