"""Declarative rules: a list of (id, severity, predicate) becomes one array column of issues per row.

The predicates are plain column expressions, so all rules of a row run inside one generated loop. A null predicate
counts as not met. Penalties, scores and population summaries follow from the issue array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import any_word, clip
from cohortlab.operators.personas import NUMBERS, regulation

c = F.col
#: Penalties by severity and their ceiling for one row; fixed values.
PENALTY = {"error": 0.08, "warning": 0.035}
CEILING = 0.65


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    when: Column


def issues(rules: list[Rule]) -> Column:
    """Array of structs (rule_id, severity) of the rules that a row breaks, in rule order."""
    return F.array_compact(F.array(*[F.when(r.when, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]))


def valid(issue_array: str = "issues") -> Column:
    """No issue is an error."""
    return ~F.exists(issue_array, lambda i: i["severity"] == "error")


def penalty(issue_array: str = "issues") -> Column:
    return F.aggregate(issue_array, F.lit(0.0), lambda a, i: a + F.when(i["severity"] == "error", PENALTY["error"]).otherwise(PENALTY["warning"]))


# Ranges, allowed words and lengths of a persona, as far as the table has the fields.
AGE = (10, 30)
ALLOWED = {
    "stage": ("middle_school", "high_school", "vocational", "undergraduate", "graduate", "early_career"),
    "region": ("urban", "suburban", "rural", "migrant", "international"),
    "drive": ("mastery", "achievement", "belonging", "autonomy", "security", "recognition", "curiosity", "avoidance"),
    "reward": ("praise", "progress", "grades", "independence", "social_status", "usefulness"),
    "goal": ("mastery", "performance", "avoidance", "mixed"),
    "attention": ("sustained", "bursty", "easily_shifted", "hyperfocused"),
    "planning": ("structured", "reactive", "deadline_driven", "ritual_based", "chaotic"),
    "collaboration": ("leader", "supporter", "observer", "challenger", "mediator", "solo"),
    "coping": ("problem_solving", "emotional_support", "avoidance", "humor", "control", "withdrawal"),
    "performance": ("poor", "low", "mid", "high"),
}
LENGTHS = {"family_context": (20, 1000), "narrative": (250, 1800), "identity_anchor": (20, 480), "moral_tension": (20, 600), "reasoning": (40, 900)}
SIZES = {"core_values": (2, 6), "protective": (1, 5), "risks": (1, 5)}
# Fixed values, too, down to the scenarios.
TENSION = ("fear", "avoid", "pressure", "shame", "protect")
EFFORT = ("deadline", "ritual", "burst", "crisis", "external structure")
GROUNDING = ("habit", "strategy", "resource", "practice", "feedback", "motivation", "planning", "support")
DEFICIT = ("low iq", "stupid", "lazy by nature", "incapable", "unintelligent")
SCENARIOS = {
    "ambiguous_task": ("ambiguous", "uncertain", "unclear", "instruction", "task"),
    "peer_pressure": ("peer", "group", "classmate", "comparison", "social"),
    "failure_feedback": ("failure", "feedback", "mistake", "criticism", "setback"),
    "deadline": ("deadline", "schedule", "late", "time", "rush"),
}


def schema_gate() -> Column:
    """Whether a flat persona keeps all ranges, word lists and lengths; a missing value breaks its rule."""
    ok = c("age").between(*AGE)
    for n in NUMBERS:
        ok = ok & c(n).between(0.0, 1.0)
    for n, words in ALLOWED.items():
        ok = ok & c(n).isin(*words)
    for n, (low, high) in LENGTHS.items():
        ok = ok & F.char_length(c(n)).between(low, high)
    for n, (low, high) in SIZES.items():
        ok = ok & F.size(c(n)).between(low, high)
    return F.coalesce(ok, F.lit(False))


def extra_keys(text: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """Paths of the keys of a JSON text that a schema doesn't have; null for null and for broken texts.

    ``allowed`` maps the path of an object (``$``, ``$.demographics``) to its keys; objects that are missing have none.
    """
    parts = []
    for path, keys in allowed.items():
        prefix = path + "."
        own = F.json_object_keys(text if path == "$" else F.get_json_object(text, path))
        parts.append(F.transform(F.array_except(F.coalesce(own, F.array().cast("array<string>")), F.array(*map(F.lit, keys))), lambda k: F.concat(F.lit(prefix), k)))
    return F.when(F.json_object_keys(text).isNotNull(), F.array_sort(F.concat(*parts)))


def near_all(test) -> Column:
    """All numeric traits but at most one meet a test."""
    values = F.array(*[c(n) for n in NUMBERS])
    return F.size(F.filter(values, test)) >= len(NUMBERS) - 1


def validation_rules() -> list[Rule]:
    """Rules R1 to R9 over flat traits."""
    high, low = (near_all(lambda x: x >= 0.8), near_all(lambda x: x <= 0.2))
    outside = ~(c("abstraction").between(0, 1) & ((c("intrinsic") + 1 - c("external")) / 2).between(0, 1) & regulation().between(0, 1))
    return [
        Rule("R1", "error", (c("intrinsic") >= 0.75) & (c("goal") == "avoidance") & ~any_word("narrative", TENSION)),
        Rule("R2", "warning", (c("persistence") >= 0.75) & (c("planning") == "chaotic") & ~any_word("narrative", EFFORT)),
        Rule("R3", "error", (c("stress_load") >= 0.7) & (c("resilience") >= 0.7) & (F.coalesce(F.size("protective"), F.lit(0)) <= 0)),
        Rule("R4", "warning", (c("external") >= 0.75) & (c("peer_influence") <= 0.2) & c("reward").isin("praise", "grades", "social_status")),
        Rule("R5", "error", high),
        Rule("R6", "error", low),
        Rule("R7", "error", (c("performance") == "high") & ~any_word("reasoning", GROUNDING)),
        Rule("R8", "error", c("performance").isin("poor", "low") & any_word("reasoning", DEFICIT)),
        Rule("R9", "error", outside),
    ]


def consistency_rules() -> list[Rule]:
    """Rules C1 to C19 over filled traits with axes; ``difficulty`` is the response under difficulty."""
    reg, auto = c("regulation_core"), c("motivation_core")
    return [
        Rule("C1", "error", (c("planning") == "structured") & (reg < 0.42)),
        Rule("C2", "warning", (c("planning") == "chaotic") & (reg > 0.72)),
        Rule("C3", "warning", (c("attention") == "sustained") & (reg < 0.45)),
        Rule("C4", "warning", (c("attention") == "easily_shifted") & (reg > 0.72)),
        Rule("C5", "error", c("drive").isin("mastery", "autonomy", "curiosity") & (c("intrinsic") < 0.35)),
        Rule("C6", "warning", c("drive").isin("recognition", "achievement") & (c("external") < 0.20)),
        Rule("C7", "warning", (c("reward") == "independence") & (c("external") > 0.78)),
        Rule("C8", "warning", (c("difficulty") == "reframes") & (reg < 0.35)),
        Rule("C9", "warning", (c("difficulty") == "freezes") & (reg > 0.72)),
        Rule("C10", "warning", (c("coping") == "problem_solving") & (reg < 0.35)),
        Rule("C11", "warning", c("coping").isin("avoidance", "withdrawal") & (reg > 0.72)),
        Rule("C12", "error", (c("collaboration") == "leader") & (c("energy") < 0.45)),
        Rule("C13", "warning", (c("collaboration") == "solo") & (c("energy") > 0.78)),
        Rule("C14", "warning", (c("expressiveness") > 0.82) & (c("energy") < 0.25)),
        Rule("C15", "error", (c("performance") == "high") & (reg < 0.38) & (auto < 0.45)),
        Rule("C16", "warning", (c("performance") == "poor") & (reg > 0.76) & (auto > 0.65) & (c("stress_load") < 0.45)),
        Rule("C17", "warning", (c("goal") == "avoidance") & (c("performance") == "high") & (reg < 0.55)),
        Rule("C18", "warning", (c("stress_load") > 0.78) & (c("resilience") > 0.78) & (reg < 0.42)),
        Rule("C19", "warning", (c("stress_load") < 0.25) & (F.coalesce(F.size("risks"), F.lit(0)) > 0) & (c("resilience") < 0.25)),
    ]


def validate(t: DataFrame) -> DataFrame:
    """Adds ``issues``, ``is_valid`` and ``hard_errors``; a row that fails the schema has that one issue only."""
    bad = F.array(F.struct(F.lit("SCHEMA").alias("rule_id"), F.lit("error").alias("severity")))
    out = t.withColumn("issues", F.when(~schema_gate(), bad).otherwise(issues(validation_rules())))
    return out.withColumn("is_valid", valid()).withColumn("hard_errors", F.size(F.filter("issues", lambda i: i["severity"] == "error")).cast("bigint"))


def consistency(aligned: DataFrame) -> DataFrame:
    """Adds ``issues``, ``rule_score`` and ``score`` to rows with axes, ``axis_alignment`` and ``difficulty``."""
    out = aligned.withColumn("issues", issues(consistency_rules())).withColumn("penalty", penalty())
    out = out.withColumn("rule_score", clip(1.0 - F.least(F.lit(CEILING), F.col("penalty"))))
    return out.withColumn("score", clip(0.7 * c("axis_alignment") + 0.3 * c("rule_score")))


def population(scored: DataFrame, by: list[str]) -> DataFrame:
    """Summary per population of :func:`consistency` rows; without rows (and without ``by``) the pessimistic constants."""
    n = F.count("*")
    a = scored.groupBy(*by).agg(
        n.cast("bigint").alias("sample_size"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.avg("axis_alignment"), F.lit(0.0)).alias("axis_alignment_mean"),
        F.coalesce(F.avg("rule_score"), F.lit(0.0)).alias("rule_score_mean"),
        F.coalesce(F.avg(1.0 - c("axis_alignment")), F.lit(1.0)).alias("axis_target_mae"),
        F.coalesce(clip(F.try_divide(F.sum("penalty"), n)), F.lit(1.0)).alias("weighted_issue_rate"),
        F.coalesce(F.try_divide(F.sum(F.size("issues")).cast("double"), n), F.lit(1.0)).alias("issue_rate"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("bigint").alias("issue_count"),
    )
    return a.withColumn("strict_error", clip(0.7 * c("axis_target_mae") + 0.3 * c("weighted_issue_rate")))


def rule_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Issues per rule and severity."""
    return scored.select(*by, F.explode("issues").alias("i")).groupBy(*by, c("i.rule_id").alias("rule_id"), c("i.severity").alias("severity")).agg(F.count("*").cast("bigint").alias("n"))


def missing_scenarios(text: str) -> Column:
    """Scenarios of which a text holds no keyword; three or more make a ``BLUEPRINT`` error."""
    return F.array_compact(F.array(*[F.when(~any_word(text, words), F.lit(name)) for name, words in SCENARIOS.items()]))
