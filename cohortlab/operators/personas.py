"""Personas as flat rows of traits, their axes and their target slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import clip, missing_to

AXES = ("cognitive_core", "motivation_core", "regulation_core")
#: Numeric traits by path; a missing one counts as 0.5.
NUMBERS = {
    "abstraction": "cognitive_motivation_profile.thinking_style.abstraction_level",
    "ambiguity": "cognitive_motivation_profile.thinking_style.ambiguity_tolerance",
    "intrinsic": "cognitive_motivation_profile.motivation_system.intrinsic_motivation",
    "external": "cognitive_motivation_profile.motivation_system.external_pressure_sensitivity",
    "failure": "cognitive_motivation_profile.motivation_system.failure_sensitivity",
    "persistence": "cognitive_motivation_profile.self_regulation.persistence",
    "emotional": "cognitive_motivation_profile.self_regulation.emotional_regulation",
    "metacognition": "cognitive_motivation_profile.self_regulation.metacognition",
    "habit": "cognitive_motivation_profile.self_regulation.habit_stability",
    "energy": "social_creative_profile.social_energy",
    "expressiveness": "social_creative_profile.expressiveness",
    "peer_influence": "social_creative_profile.peer_influence_sensitivity",
    "stress_load": "mental_health_context.stress_load",
    "resilience": "mental_health_context.resilience",
}
WORDS = {
    "stage": "demographics.grade_or_stage",
    "region": "demographics.region_type",
    "family_context": "demographics.family_context",
    "drive": "cognitive_motivation_profile.motivation_system.primary_drive",
    "reward": "cognitive_motivation_profile.motivation_system.reward_preference",
    "goal": "cognitive_motivation_profile.learning_orientation.goal_orientation",
    "attention": "cognitive_motivation_profile.learning_orientation.attention_pattern",
    "planning": "cognitive_motivation_profile.self_regulation.planning_style",
    "narrative": "cognitive_motivation_profile.narrative",
    "collaboration": "social_creative_profile.collaboration_style",
    "coping": "mental_health_context.coping_style",
    "performance": "derived_academic_tendency.likely_performance_band",
    "reasoning": "derived_academic_tendency.reasoning",
    "identity_anchor": "values_identity.identity_anchor",
    "moral_tension": "values_identity.moral_tension",
}


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null key: the one that came last."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def traits(personas: DataFrame) -> DataFrame:
    """One flat row per persona, from its last delivery."""
    keep = [F.col(p).alias(n) for n, p in (NUMBERS | WORDS).items()]
    flat = personas.select("persona_id", "run_id", "source", F.col("demographics.age").alias("age"), F.col("mental_health_context.protective_factors").alias("protective"), F.col("mental_health_context.risk_factors").alias("risks"), F.col("values_identity.core_values").alias("core_values"), "ingested_at", *keep)
    return latest(flat, "persona_id", "ingested_at")


def filled(t: DataFrame) -> DataFrame:
    """Traits with 0.5 for missing numbers."""
    return t.withColumns({n: missing_to(n) for n in NUMBERS})


def regulation() -> Column:
    return (F.col("persistence") + F.col("emotional") + F.col("metacognition") + F.col("habit") + F.col("resilience")) / 5.0


def axes(t: DataFrame) -> DataFrame:
    """Adds the three core axes of each persona."""
    return t.withColumns({"cognitive_core": F.col("abstraction"), "motivation_core": (F.col("intrinsic") + (1.0 - F.col("external"))) / 2.0, "regulation_core": regulation()})


def bound_axes(t: DataFrame, roles: dict[str, str], names: list[str]) -> DataFrame:
    """Axes under a schema binding: a bound name has its role's value, any other name 0.5."""
    by_name = {v: k for k, v in roles.items()}
    legacy = {"cognitive_abstraction": AXES[0], "motivation_autonomy": AXES[1], "self_regulation_resilience": AXES[2]}
    return axes(t).withColumns({f"axis_{n}": F.col(role) if (role := legacy.get(n) or by_name.get(n)) else F.lit(0.5) for n in names})


def axis_value(axis_map: str | Column, name: str) -> Column:
    """A value of an axis map whose keys may be spelled with blanks or capitals; out of range counts as missing."""
    m = F.col(axis_map) if isinstance(axis_map, str) else axis_map
    own = F.filter(F.map_entries(m), lambda e: (F.lower(F.trim(e["key"])) == name) & (e["value"] >= 0) & (e["value"] <= 1))
    return F.array_max(F.transform(own, lambda e: e["value"]))


def slots(df: DataFrame) -> DataFrame:
    """One row per slot: its quota, run, constraints and the three target axes (null where missing)."""
    flat = df.select("slot_id", "run_id", "quota_label", "constraints", "adaptive_constraints", *[axis_value("target_axes", a).alias(f"target_{a}") for a in AXES])
    return flat.dropDuplicates(["slot_id"])


def alignment(t: DataFrame, s: DataFrame) -> DataFrame:
    """Personas left-joined with their slots: ``axis_alignment`` = 1 - mean |axis - target| over the axes that the slot has.

    A persona without a slot, or with a slot without axes, has alignment 1.
    """
    joined = axes(filled(t)).join(s.select(F.col("slot_id").alias("persona_id"), *[f"target_{a}" for a in AXES]), "persona_id", "left")
    gaps = F.filter(F.array(*[F.abs(F.col(a) - F.col(f"target_{a}")) for a in AXES]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x), F.size(gaps))
    return joined.withColumn("axis_alignment", F.coalesce(clip(1.0 - mean), F.lit(1.0)))
