"""Saved pipelines, a plain-language front end, and verdicts on results."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualispark.operators import wrangle

STEPS: dict[str, Callable] = {
    "compute": wrangle.compute, "filter": wrangle.filter_rows, "recode": wrangle.recode, "retype": wrangle.retype, "rename": wrangle.rename,
    "drop": wrangle.drop, "impute": wrangle.impute, "stack": wrangle.stack, "unstack": wrangle.unstack, "log": wrangle.log,
    "standardize": wrangle.standardize, "bin": wrangle.bin_column, "set_cell": wrangle.set_cell, "boxcox": wrangle.boxcox,
}


def run_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Fold {op, params} steps over a table; one lazy plan."""
    for step in steps:
        if step["op"] not in STEPS:
            raise ValueError(f"no such step: {step['op']}")
        df = STEPS[step["op"]](df, **step.get("params", {}))
    return df


def provenance(params: dict, result: dict) -> str:
    """SHA-256 of the canonical JSON of what was asked and what came out."""
    return hashlib.sha256(json.dumps({"params": params, "result": result}, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


_ASK = (
    (r"(?:is|are) (?P<a>\w+) (?:stable|in control)|control chart (?:of|for) (?P<b>\w+)", "imr"),
    (r"capab\w+ (?:of|for) (?P<a>\w+)", "capability"),
    (r"compare (?P<a>\w+) (?:by|across|between) (?P<g>\w+)", "anova"),
    (r"(?:correlat\w+|relation\w*) (?:between|of) (?P<a>\w+) (?:and|with) (?P<g>\w+)", "correlation"),
    (r"(?:predict|model|explain) (?P<a>\w+) (?:from|by|with|using) (?P<g>\w+)", "regression"),
    (r"pareto (?:of|for|by) (?P<a>\w+)", "pareto"),
    (r"(?:distribution|histogram) (?:of|for) (?P<a>\w+)", "histogram"),
    (r"outliers? (?:in|of) (?P<a>\w+)", "outliers"),
)


def ask(text: str, columns: list[str]) -> dict | None:
    """The analysis a question asks for: the first pattern that fits, with known columns; else None."""
    known = {c.lower(): c for c in columns}
    for pattern, kind in _ASK:
        if m := re.search(pattern, text.lower()):
            named = {k: v for k, v in m.groupdict().items() if v}
            column, group = named.get("a") or named.get("b"), named.get("g")
            if column in known and (group is None or group in known):
                return {"kind": kind, "column": known[column]} | ({"group": known[group]} if group else {})
    return None


def verdicts(results: DataFrame) -> DataFrame:
    """``verdict`` for rows of kind, p, effect, power: act, consider, underpowered or none."""
    small, strong = F.col("p") < 0.05, F.abs("effect") >= 0.5
    v = F.when(small & strong, "act").when(small, "consider").when(F.col("power") < 0.5, "underpowered").otherwise("none")
    band = F.when(F.abs("effect") >= 0.8, "large").when(strong, "medium").when(F.abs("effect") >= 0.2, "small").otherwise("negligible")
    return results.withColumns({"verdict": v, "effect_band": band})
