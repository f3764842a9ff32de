"""Genomes: normalisation, mutation, audit of edits. A genome is a JSON text; its numeric part is three maps of numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlab.functions.scalars import clip

c = F.col
# Limits of the numeric parts; modules of a structured genome with their options; mutation modes in turn.
LIMITS = {"quota_weights": (0.02, 0.6), "axis_bias": (-0.35, 0.35), "axis_stretch": (0.55, 1.75)}
SPREAD = {"quota_weights": 0.20, "axis_bias": 0.15, "axis_stretch": 0.25}
DEFAULT = {"quota_weights": 0.1667, "axis_bias": 0.0, "axis_stretch": 1.0}
MODES = ("prompt_only", "operator_only", "mixed", "numeric_only")
MODE_SCALE = {"prompt_only": 0.55, "operator_only": 0.70, "mixed": 1.0, "numeric_only": 0.80}
AXES = ("cognitive_core", "motivation_core", "regulation_core")
MODULES = {
    "probe_assignment": ("ambiguous_task", "peer_pressure", "failure_feedback", "deadline"),
    "axis_realization": ("behaviour", "tradeoff", "boundary"),
    "interaction_mode": ("additive", "compensating", "conflicting"),
    "echo_graph": ("chain", "star", "ring"),
    "context_modulation": ("stable", "sensitive", "contrasting"),
    "repair_control": ("schema", "coherence", "evidence"),
}
#: Families of the catalogue: id numbers, name and what each entry of the family works on.
FAMILIES = ((1, 15, "legacy"), (16, 21, "v3"), (22, 27, "v4"))
METRICS = ("alignment", "coverage", "consistency", "schema", "diversity", "axis_target", "shadow_mae")


def catalogue(spark: SparkSession) -> DataFrame:
    """The 27 operators: id, family, the metric whose best parent they prefer, and their effect on axes or a module."""
    modules = list(MODULES)
    rows = []
    for low, high, family in FAMILIES:
        for k in range(low, high + 1):
            axis = AXES[k % 3]
            rows.append((f"op{k:02d}", family, METRICS[k % len(METRICS)], axis, round(0.92 + 0.04 * (k % 5), 4), round(0.03 * ((k % 3) - 1), 4), modules[k - low] if family == "v4" else None))
    return spark.createDataFrame(rows, "operator_id string, family string, preferred_metric string, axis string, stretch double, bias double, module string")


def family(ops: DataFrame, which: str) -> DataFrame:
    """Operators of a family: ``legacy``, ``v3``, ``v4``, or ``free`` for all but v4."""
    return ops.where(c("family") != "v4") if which == "free" else ops.where(c("family") == which)


def mode_of(child: Column) -> Column:
    """Mutation modes in turn over children from 0."""
    return F.element_at(F.array(*map(F.lit, MODES)), (F.pmod(child, F.lit(len(MODES))) + 1).cast("int"))


def mutation_scale(base: float, stagnation: Column, generation: Column) -> Column:
    """base * (1 + 0.15 min(stagnation, 4)) * (1 + 0.08 min(generation, 4))."""
    return base * (1.0 + 0.15 * F.least(stagnation, F.lit(4))) * (1.0 + 0.08 * F.least(generation, F.lit(4)))


def normalized(part: str, values: Column) -> Column:
    """A numeric map held to its limits; quotas then share 1, equally if all are zero."""
    low, high = LIMITS[part]
    held = F.transform_values(values, lambda k, v: clip(F.coalesce(v, F.lit(DEFAULT[part])), low, high))
    if part != "quota_weights":
        return held
    total = F.aggregate(F.map_values(held), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(held, lambda k, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(F.map_keys(held))))


def _mutate_one(genome: dict, rng: np.random.Generator, scale: float, mode: str, op: dict) -> dict:
    out = json.loads(json.dumps(genome))
    if op.get("module") and op.get("family") == "v4":
        module = op["module"]
        options = [x for x in MODULES[module] if x != out.get(module)]
        out[module] = str(rng.choice(options))
    else:
        for part, (low, high) in LIMITS.items():
            values = out.setdefault(part, {})
            if mode in ("mixed", "numeric_only"):
                for k in sorted(values):
                    values[k] = float(np.clip(values[k] + rng.normal(0.0, scale * SPREAD[part]), low, high))
        if mode in ("mixed", "operator_only"):
            axis = op["axis"]
            s, b = out["axis_stretch"], out["axis_bias"]
            if axis in s:
                s[axis] = float(np.clip(s[axis] * op["stretch"] + rng.normal(0.0, scale * 0.04), *LIMITS["axis_stretch"]))
            if axis in b:
                b[axis] = float(np.clip(b[axis] + op["bias"] + rng.normal(0.0, scale * 0.02), *LIMITS["axis_bias"]))
        if mode in ("mixed", "prompt_only") and rng.random() < min(0.55, 0.18 + scale):
            out["style"] = str(rng.choice(["plain", "vivid", "terse", "warm"]))
        quotas = out["quota_weights"]
        total = sum(quotas.values())
        for k in quotas:
            quotas[k] = quotas[k] / total if total > 0 else 1.0 / len(quotas)
    out["last_mutation"] = {"mode": mode if op.get("family") != "v4" else "structured", "scale": scale}
    out["last_evolution_operator"] = {"id": op["operator_id"]}
    return out


def mutate(jobs: DataFrame, seed: int) -> DataFrame:
    """Adds ``child`` to rows of ``genome, island_id, child_idx, generation, mode, scale`` and an operator's columns.

    Each row has its own generator from (seed, generation, island, child), so results don't depend on partitioning.
    """
    kinds = StructType([*jobs.schema.fields, StructField("child", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                rng = np.random.default_rng([seed, int(r["generation"]), int(r["island_id"]), int(r["child_idx"])])
                out.append(json.dumps(_mutate_one(json.loads(r["genome"]), rng, float(r["scale"]), r["mode"], r), sort_keys=True))
            yield f.assign(child=out)

    return jobs.mapInPandas(run, kinds)


def mutate_with(jobs: DataFrame, responder, seed: int, *, repairs: int = 1, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """:func:`mutate` by a responder: adds ``child``, ``by`` (``responder`` or ``rules``) and ``error``.

    The responder gets the genome, operator and mode as JSON and answers with a genome. An answer that is no JSON object,
    lacks a numeric part of its parent or changes nothing is asked for again with what was wrong; what still fails, after
    retries of errors that may pass, is mutated by the rules, and ``error`` says why.
    """
    from cohortlab.operators.responders import Retry, repaired

    retry = Retry(tries, pause)
    kinds = StructType([*jobs.schema.fields, StructField("child", StringType()), StructField("by", StringType()), StructField("error", StringType())])

    def asked(parent: dict, request: str) -> dict:
        said, text = "", request
        for _ in range(repairs + 1):
            try:
                child = repaired(retry.call(responder, text)[0])
            except ValueError as e:
                said = str(e)
            else:
                gone = [k for k in LIMITS if k in parent and not isinstance(child.get(k), dict)]
                same = all(child.get(k) == parent.get(k) for k in {*parent, *child} if not k.startswith("last_"))
                if not gone and not same:
                    return child
                said = f"{', '.join(gone)} missing" if gone else "nothing was changed"
            text = f"{request}\n\nThe last reply was wrong: {said}"
        raise ValueError(said)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, by, errors = [], [], []
            for r in f.to_dict("records"):
                parent = json.loads(r["genome"])
                try:
                    child = asked(parent, json.dumps({"genome": parent, "operator_id": r["operator_id"], "mode": r["mode"], "scale": float(r["scale"])}, sort_keys=True))
                    child["last_mutation"], child["last_evolution_operator"] = {"mode": r["mode"], "scale": float(r["scale"])}, {"id": r["operator_id"]}
                    by.append("responder"), errors.append(None)
                except Exception as e:  # noqa: BLE001 - a failure is a row, and the rules take over
                    rng = np.random.default_rng([seed, int(r["generation"]), int(r["island_id"]), int(r["child_idx"])])
                    child = _mutate_one(parent, rng, float(r["scale"]), r["mode"], r)
                    by.append("rules"), errors.append(f"{type(e).__name__}: {e}"[:500])
                out.append(json.dumps(child, sort_keys=True))
            yield f.assign(child=out, by=by, error=errors)

    return jobs.mapInPandas(run, kinds)


def audit(parent: Column, child: Column, declared: Column) -> dict[str, Column]:
    """Edits of a child against its parent, both maps of JSON values by key: actual, undeclared and phantom edits."""
    keys = F.array_union(F.map_keys(parent), F.map_keys(child))
    actual = F.array_sort(F.filter(keys, lambda k: ~F.element_at(parent, k).eqNullSafe(F.element_at(child, k))))
    return {"actual": actual, "undeclared": F.array_sort(F.array_except(actual, declared)), "phantom": F.array_sort(F.array_except(declared, actual))}


def patch(base: Column, change: Column) -> Column:
    """Keys of a patch replace or join those of a map; null values of the patch keep the base's."""
    keys = F.array_union(F.map_keys(base), F.map_keys(change))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(change, k), F.element_at(base, k))))


def factorial(ops: DataFrame, modes: tuple[str, ...], replicates: int, excluded: list[tuple[str, str]]) -> DataFrame:
    """Design of operators x modes x replicates without the excluded (mode, family), numbered. Three short fixed lists."""
    m = F.explode(F.array(*[F.struct(F.lit(x).alias("mode"), F.lit(i).alias("mode_no")) for i, x in enumerate(modes)])).alias("m")
    design = ops.select("operator_id", "family", m).select("operator_id", "family", "m.*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    for mode, fam in excluded:
        design = design.where(~((c("mode") == mode) & (c("family") == fam)))
    order = Window.orderBy("mode_no", "operator_id", "replicate")
    return design.withColumn("run_no", F.row_number().over(order).cast("bigint")).drop("mode_no")
