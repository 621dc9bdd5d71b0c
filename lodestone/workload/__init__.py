"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries by name, SQL by name)."""
    from lodestone.workload import answering, chunking, evaluation, profiling, relational, retrieval

    queries: dict = {}
    sql: dict = {}
    for m in (relational, profiling, chunking, retrieval, answering, evaluation):
        for name, (run, check) in m.QUERIES.items():
            queries[name] = run
            if check is not None:
                sql[name] = check
    return queries, sql
