"""Planners as table functions: a request gives the rows of a plan, in SQL by LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from planlens.workspace import ship_package

#: A planner's rows: a node's key and module and what it depends on, or the code of a refusal.
PLAN_ROW = "key string, module_id string, dependencies array<string>, refusal string"


def register_planner(spark: SparkSession, name: str, plan: Callable[[str], Iterable[tuple[str, str, list[str]]]], max_nodes: int) -> None:
    """Register ``plan`` (request text -> key, module, dependencies of each node) as the table function ``name(request)``.

    It is called once for each request, in tasks, and its rows are passed on as they
    come. A null request gives no rows. A plan refuses a request with ValueError, one of
    more than ``max_nodes`` nodes or with a repeated key is refused where that shows; a refusal is
    the plan's last row, and the plan is none.
    """
    ship_package(spark)

    @udtf(returnType=PLAN_ROW)
    class Planner:
        def eval(self, request: str):
            if request is None:
                return
            keys: set[str] = set()
            try:
                for key, module, dependencies in plan(request):
                    if len(keys) == max_nodes:
                        yield None, None, None, "PLAN_LIMIT_EXCEEDED"
                        return
                    if key in keys:
                        yield None, None, None, "PLAN_DUPLICATE_KEY"
                        return
                    keys.add(key)
                    yield key, module, list(dependencies), None
            except ValueError:
                yield None, None, None, "PLAN_REQUEST_REFUSED"

    spark.udtf.register(name, Planner)


def planned(spark: SparkSession, name: str, view: str, request: str, keep: tuple[str, ...]):
    """Rows of the table function for each row of ``view``, beside its columns ``keep``."""
    return spark.sql(f"SELECT {', '.join('r.' + c for c in keep)}, p.* FROM {view} r, LATERAL {name}(r.{request}) p")
