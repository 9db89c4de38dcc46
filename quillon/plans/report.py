"""What a DataFrame's plan is and what its operators did."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explain_text(rows: DataFrame, mode: str = "formatted") -> str:
    """The plan as text; nothing runs. mode: simple, extended, codegen, cost or formatted."""
    jvm = rows.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), mode)


def _nodes(plan) -> list:
    """The operators of a physical plan from the top; of an adaptive plan those that run."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        found.append(node)
        children = node.children()
        todo += [children.apply(k) for k in reversed(range(children.size()))]
    return found


def operators(rows: DataFrame) -> list[str]:
    """Names of the physical operators, from the top."""
    plan = rows._jdf.queryExecution().executedPlan()
    return [re.sub(r"^Execute ", "", n.nodeName()).strip() for n in _nodes(plan)]


def scans(rows: DataFrame) -> list[str]:
    """The scans of the plan with the columns that they read and the filters that they push."""
    plan = rows._jdf.queryExecution().executedPlan()
    return [n.toString() for n in _nodes(plan) if "Scan" in n.nodeName()]


def metrics(rows: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Runs the plan, throwing the rows away, and returns (operator, its counters) from the top."""
    plan = rows._jdf.queryExecution().executedPlan()
    plan.execute().count()
    out = []
    for node in _nodes(plan):
        names = node.metrics().keys().toSeq()
        own = {names.apply(k): node.metrics().apply(names.apply(k)).value() for k in range(names.size())}
        out.append((node.nodeName(), own))
    return out
