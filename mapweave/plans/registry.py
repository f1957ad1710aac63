"""All registered queries and their expected SQL, collected from the query modules."""

from __future__ import annotations

from mapweave.plans import (decision_queries, match_queries, output_queries, report_queries, taxonomy_queries,
                             text_queries)

MODULES = [text_queries, taxonomy_queries, match_queries, decision_queries, report_queries, output_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.S.items()}
