"""All registered queries and the SQL that each must equal."""

from __future__ import annotations

from quern.plans import aqp, extras, relational, scalar, surfaces, tpch, updates

FLAGSHIP = "q1_swr_with_ci"
MODULES = (aqp, extras, relational, scalar, surfaces, tpch, updates)


def queries() -> dict:
    return {q.__name__: q for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
