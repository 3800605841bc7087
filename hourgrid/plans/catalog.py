"""All registered queries and their comparison SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourgrid.plans import queries_activity, queries_rules, queries_serving, queries_store, queries_trees
from hourgrid.plans.fixtures import Workspace
from hourgrid.plans.oracle import assemble
from hourgrid.plans.present import present

ENTRIES = {**queries_activity.QUERIES, **queries_rules.QUERIES, **queries_serving.QUERIES, **queries_store.QUERIES, **queries_trees.QUERIES}


def _runner(build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: present(build(Workspace(spark, folder)))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, (build, _) in ENTRIES.items()}


def comparison_sql() -> dict[str, str]:
    return {name: assemble(sql) for name, (_, sql) in ENTRIES.items() if sql}
