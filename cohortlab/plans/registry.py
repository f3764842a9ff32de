"""All queries of the core, by name, with SQL for those that SQL can express."""

from __future__ import annotations

from cohortlab.plans import candidate_queries, diversity_queries, hierarchy_queries, persona_queries, stage_queries, survey_queries, text_queries

MODULES = (hierarchy_queries, persona_queries, survey_queries, diversity_queries, candidate_queries, text_queries, stage_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
