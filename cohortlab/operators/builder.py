"""Rule-based personas from slots: every field is the first rung of a ladder that fits, or an option picked in turn.

A ladder is data: rungs of (condition, options); conditions are conjunctions of comparisons on the slot's axes, drive and
index. :func:`ladder` gives its column and :func:`ladder_sql` the same as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import clip, lookup, pick

c = F.col
#: Base levels of bands, age ranges of stages.
STRESS = {"low": 0.2, "low_mid": 0.38, "mid": 0.52, "mid_high": 0.68, "high": 0.8}
ENERGY = {"low": 0.22, "low_mid": 0.38, "mid": 0.52, "mid_high": 0.68, "high": 0.82}
AGES = {"middle_school": (12, 15), "high_school": (15, 18), "vocational": (16, 20), "undergraduate": (18, 23), "graduate": (22, 28), "early_career": (22, 30)}
#: Rungs as ([(column, operator, value), ...], options); the last rung has no condition.
LADDERS: dict[str, list[tuple[list[tuple[str, str, object]], tuple[str, ...]]]] = {
    "dominant_mode": [([("cog", ">=", 0.72)], ("analytical", "reflective", "exploratory")), ([("cog", "<=", 0.32)], ("practical", "intuitive", "associative")), ([], ("practical", "reflective", "analytical", "associative"))],
    "evidence": [([("cog", ">=", 0.7)], ("data", "personal_values", "peer_consensus")), ([("mot", ">=", 0.7)], ("experience", "personal_values", "data")), ([], ("experience", "authority", "peer_consensus"))],
    "reward": [([("drive", "in", ("recognition",))], ("praise",)), ([("drive", "in", ("achievement",))], ("grades",)), ([("drive", "in", ("autonomy",))], ("independence",)), ([("mot", ">=", 0.72)], ("independence",)), ([("drive", "in", ("belonging",))], ("praise",)), ([], ("progress",))],
    "goal": [([("drive", "in", ("avoidance",))], ("avoidance",)), ([("drive", "in", ("achievement", "recognition")), ("reg", ">=", 0.5)], ("performance",)), ([("drive", "in", ("mastery", "curiosity", "autonomy"))], ("mastery",)), ([], ("mixed",))],
    "attention": [([("reg", ">=", 0.75)], ("sustained",)), ([("reg", ">=", 0.45)], ("bursty",)), ([], ("easily_shifted",))],
    "curiosity": [([("cog", ">=", 0.7), ("mot", ">=", 0.55)], ("narrow_deep",)), ([("mot", ">=", 0.7)], ("broad_shallow",)), ([("mot", "<=", 0.25)], ("low",)), ([], ("situational",))],
    "help_seeking": [([("reg", ">=", 0.7)], ("proactive",)), ([("energy", ">=", 0.65)], ("peer_first",)), ([("reg", "<=", 0.3)], ("reluctant",)), ([], ("adult_first",))],
    "planning": [([("reg", ">=", 0.78)], ("structured",)), ([("reg", ">=", 0.55)], ("deadline_driven",)), ([("reg", ">=", 0.35)], ("reactive",)), ([], ("chaotic",))],
    "under_difficulty": [([("reg", ">=", 0.7)], ("reframes",)), ([("energy", ">=", 0.6)], ("seeks_help",)), ([("reg", "<=", 0.25)], ("freezes",)), ([], ("doubles_down",))],
    "under_criticism": [([("mot", ">=", 0.65), ("reg", ">=", 0.5)], ("curious",)), ([("reg", "<=", 0.3)], ("ashamed",)), ([("mot", "<=", 0.3)], ("defensive",)), ([], ("motivated",))],
    "under_success": [([("cog", ">=", 0.7)], ("exploratory",)), ([("mot", ">=", 0.65)], ("confident",)), ([], ("anxious_to_maintain",))],
    "tradeoff": [([("drive", "in", ("belonging",))], ("maintain_relationships",)), ([("mot", ">=", 0.7)], ("seek_growth",)), ([("reg", "<=", 0.35)], ("safe_choice",)), ([], ("optimize_score",))],
    "value": [([("drive", "in", ("autonomy", "curiosity"))], ("autonomy",)), ([("drive", "in", ("belonging",))], ("loyalty",)), ([("drive", "in", ("security", "avoidance"))], ("stability",)), ([], ("competence",))],
    "collaboration": [([("energy", ">=", 0.75), ("mot", ">=", 0.55)], ("leader",)), ([("energy", ">=", 0.6)], ("mediator",)), ([("mot", ">=", 0.7)], ("challenger",)), ([("energy", "<=", 0.3)], ("observer",)), ([], ("supporter",))],
    "creative": [([("cog", ">=", 0.7), ("mot", ">=", 0.6)], ("original",)), ([("cog", ">=", 0.55)], ("strategic",)), ([("mot", ">=", 0.55)], ("remixing",)), ([], ("practical", "aesthetic", "low_expression"))],
    "coping": [([("reg", ">=", 0.7)], ("problem_solving",)), ([("mot", ">=", 0.65)], ("control",)), ([("reg", "<=", 0.3)], ("avoidance",)), ([], ("emotional_support",))],
}


def _test(name: str, op: str, value) -> Column:
    if op == "in":
        return F.coalesce(c(name).isin(*value), F.lit(False))
    return c(name) >= value if op == ">=" else c(name) <= value


def ladder(name: str, index: str = "i") -> Column:
    """The column of a ladder."""
    out = None
    for tests, options in reversed(LADDERS[name]):
        choice = pick(options, index) if len(options) > 1 else F.lit(options[0])
        condition = F.lit(True)
        for t in tests:
            condition = condition & _test(*t)
        out = choice if out is None else F.when(condition, choice).otherwise(out)
    return out


def ladder_sql(name: str, index: str = "i") -> str:
    """The same ladder as SQL for DuckDB."""
    rungs = []
    for tests, options in LADDERS[name]:
        quoted = ", ".join(f"'{o}'" for o in options)
        choice = f"[{quoted}][cast(({index} - 1) % {len(options)} as int) + 1]"
        text = [f"{n} in ({', '.join(repr(v) for v in value)})" if op == "in" else f"{n} {op} {value}" for n, op, value in tests]
        rungs.append(f"when {' and '.join(text)} then {choice}" if text else f"else {choice}")
    return f"case {' '.join(rungs)} end"


def levels(slots: DataFrame) -> DataFrame:
    """Adds ``cog, mot, reg`` (0.5 where missing), ``drive``, ``stress``, ``energy`` and ``age`` to slots with an index ``i`` from 1."""
    out = slots.withColumns({n: F.coalesce(c(f"target_{a}"), F.lit(0.5)) for n, a in (("cog", "cognitive_core"), ("mot", "motivation_core"), ("reg", "regulation_core"))})
    low, high = lookup({k: v[0] for k, v in AGES.items()}, "constraints.grade_or_stage", 15), lookup({k: v[1] for k, v in AGES.items()}, "constraints.grade_or_stage", 22)
    return out.withColumns(
        {
            "drive": c("constraints.primary_drive"),
            "stress": clip(lookup(STRESS, "constraints.stress_band", 0.52) + 0.1 * (1.0 - c("reg"))),
            "energy": clip(lookup(ENERGY, "constraints.social_energy_band", 0.52) + ((c("i") % 3) - 1) * 0.04),
            "age": (low + c("i") % (high - low + 1)).cast("bigint"),
        }
    )


#: The narrative of a built persona, of 250 to 1800 characters as the rules ask, and what it tells.
NARRATIVE = (
    "This person works in a %s way, trusts %s most and is moved by %s. Plans are %s, attention is %s and curiosity %s. "
    "When something proves hard the first answer is: %s; criticism leaves them %s, success %s. In doubt they choose what will %s, "
    "and in a group they are the %s, whose way of coping is %s."
)
TOLD = ("dominant_mode", "evidence", "drive", "planning", "attention", "curiosity", "under_difficulty", "under_criticism", "under_success", "tradeoff", "collaboration", "coping")


def build(slots: DataFrame) -> DataFrame:
    """One persona per slot: all ladders, distinct core values and a narrative that passes the length rule."""
    out = levels(slots).withColumns({k: ladder(k) for k in LADDERS})
    out = out.withColumn("core_values", F.array_distinct(F.array(pick(("curiosity", "fairness", "growth", "care", "craft"), "i"), F.lit("growth"), c("value"))))
    return out.withColumn("narrative", F.format_string(NARRATIVE, *[F.coalesce(c(n), F.lit("no clear drive")) for n in TOLD]))


# Hints for a slot, as (rule, conditions on target axes and constraints).
HINTS = {
    "abstract_unstable": [("cog", ">=", 0.75), ("reg", "<=", 0.35)],
    "autonomy_tension": [("mot", ">=", 0.75), ("drive", "in", ("recognition", "security"))],
    "ground_resilience": [("reg", ">=", 0.75), ("stress_band", "in", ("high",))],
    "external_structure": [("reg", "<=", 0.25), ("performance_band", "in", ("high",))],
    "concrete_agency": [("cog", "<=", 0.25), ("mot", ">=", 0.7)],
    "reserved_not_passive": [("energy_band", "in", ("low",)), ("mot", "<=", 0.3)],
}


def hints() -> Column:
    """Array of the hints that a slot with ``cog, mot, reg, drive`` and its bands calls for."""
    out = []
    for name, tests in HINTS.items():
        condition = F.lit(True)
        for t in tests:
            condition = condition & _test(*t)
        out.append(F.when(condition, F.lit(name)))
    return F.array_compact(F.array(*out))


def hints_sql() -> str:
    """The same hints as SQL for DuckDB: a list."""
    parts = []
    for name, tests in HINTS.items():
        text = " and ".join(f"{n} in ({', '.join(repr(v) for v in value)})" if op == "in" else f"{n} {op} {value}" for n, op, value in tests)
        parts.append(f"case when {text} then '{name}' end")
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


#: The constraints of a slot that each writing stage is bound to.
STAGES = {"cognition": ("grade_or_stage", "primary_drive"), "values": ("primary_drive",), "social": ("social_energy_band",), "health": ("stress_band",), "outcome": ("derived_performance_band",)}


def stage_constraints() -> Column:
    """Array of (stage, text): what a slot demands of each writing stage."""

    def text(fields: tuple[str, ...]) -> Column:
        own = [F.concat(F.lit(f"{f}="), F.coalesce(c(f"constraints.{f}"), F.lit("free"))) for f in fields]
        return F.concat_ws("; ", *own, F.when(c("constraints.avoid_all_high_profile"), F.lit("not all high")), F.when(c("constraints.avoid_all_low_profile"), F.lit("not all low")))

    return F.array(*[F.struct(F.lit(s).alias("stage"), text(f).alias("text")) for s, f in STAGES.items()])


def stage_view(stage: str) -> list[str]:
    """Nested fields of a persona that the writers of a later stage see; the scan reads no others."""
    core = ["persona_id", "demographics.age", "demographics.grade_or_stage"]
    more = {
        "values": ["cognitive_motivation_profile.motivation_system.primary_drive"],
        "social": ["cognitive_motivation_profile.motivation_system.primary_drive", "values_identity.core_values"],
        "health": ["cognitive_motivation_profile.self_regulation.persistence", "social_creative_profile.social_energy"],
        "outcome": ["cognitive_motivation_profile.self_regulation.planning_style", "mental_health_context.stress_load", "mental_health_context.resilience"],
    }
    return core + more.get(stage, [])


def genome_addendum(genome: str) -> Column:
    """A genome's style, scenario and signed axis shifts as one line for a writer; null for a genome without style."""
    g = F.from_json(c(genome), "style string, scenario string, bias map<string,double>")
    signed = F.transform(F.array_sort(F.map_entries(g["bias"])), lambda e: F.concat(e["key"], F.when(e["value"] < 0, " lower").when(e["value"] > 0, " higher").otherwise(" as is")))
    shifts = F.when(F.size(F.map_keys(g["bias"])) > 0, F.array_join(signed, ", "))
    return F.when(g["style"].isNotNull(), F.concat_ws("; ", F.concat(F.lit("style "), g["style"]), F.concat(F.lit("scenario "), g["scenario"]), shifts))
