"""Registry of the queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: put ``fn(spark, sf_dir)`` under ``name``, with the SQL that must give the same rows."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return put


from weftline.plans import q_algos, q_comm, q_control, q_mesh, q_scalar  # noqa: E402, F401
