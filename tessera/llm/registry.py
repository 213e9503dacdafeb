"""Names of the queries of this subpackage."""

from __future__ import annotations

from . import queries as q


def pipeline(spark, sf_dir):
    from .pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    found = {name: getattr(q, name) for name in dir(q) if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": q.OP5_SQL, "op6_near_duplicates": q.OP6_SQL, "op8_mixing": q.OP8_SQL}
