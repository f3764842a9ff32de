"""Queries over personas and slots: axes, validation, consistency, states, builder and sampling targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions import scalars as S
from cohortlab.operators import builder, personas, rules, sampling, scoring, similarity, student
from cohortlab.operators.personas import AXES
from cohortlab.plans import expected
from cohortlab.plans import sqltext as T
from cohortlab.workspace import materialize

c = F.col


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(*names: str):
    """Columns rounded to six places under their own names."""
    return [F.round(c(n), 6).alias(n) for n in names]


def _m(*names: str):
    """The same for means and sums: a nudge settles halves, which the order of adding decides otherwise."""
    return [F.round(c(n) + 1e-9, 6).alias(n) for n in names]


def _traits(spark, sf):
    return personas.traits(_t(spark, sf, "personas"))


def _aligned(spark, sf):
    return personas.alignment(_traits(spark, sf), personas.slots(_t(spark, sf, "slots")))


def _scored(spark, sf):
    at = _aligned(spark, sf)
    levels = at.withColumns({"reg": c("regulation_core")})
    return rules.consistency(levels.withColumn("difficulty", builder.ladder("under_difficulty")))


def persona_axes(spark: SparkSession, sf: str) -> DataFrame:
    """The three core axes of every persona."""
    return personas.axes(personas.filled(_traits(spark, sf))).select("persona_id", *_r(*AXES))


BINDING = {"cognitive_core": "openness", "motivation_core": "ownership"}


def persona_bound_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Axes under other names: bound ones, a legacy one and one that no role has."""
    names = ["openness", "ownership", "self_regulation_resilience", "unbound"]
    return personas.bound_axes(personas.filled(_traits(spark, sf)), BINDING, names).select("persona_id", *_r(*[f"axis_{n}" for n in names]))


def persona_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Axis matrix: one array per persona."""
    return persona_axes(spark, sf).select("persona_id", "cognitive_core", "motivation_core", "regulation_core", F.array_join(F.transform(F.array(*AXES), lambda v: F.floor(v * 1000).cast("bigint").cast("string")), ",").alias("row"))


def _issue_text():
    return F.array_join(F.transform("issues", lambda i: F.concat(i["rule_id"], F.lit(":"), i["severity"])), ",")


def validation(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of every persona by schema and rules R1 to R9."""
    return rules.validate(_traits(spark, sf)).select("persona_id", _issue_text().alias("issues"), "is_valid", "hard_errors")


def validity_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Valid personas per run, and personas per slot of the run."""
    v = rules.validate(_traits(spark, sf)).groupBy("run_id").agg(F.count("*").cast("bigint").alias("sample_size"), F.count_if("is_valid").cast("bigint").alias("valid_count"), F.round(F.avg(c("is_valid").cast("double")), 6).alias("validity_rate"))
    n = _t(spark, sf, "slots").where("run_id is not null").groupBy("run_id").agg(F.count_distinct("slot_id").cast("bigint").alias("n_slots"))
    return v.join(n, "run_id", "left").withColumn("generation_rate", F.round(c("sample_size") / c("n_slots"), 6))


def consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment with the slot, issues by rules C1 to C19 and scores of every persona."""
    return _scored(spark, sf).select("persona_id", _issue_text().alias("issues"), *_r("axis_alignment", "rule_score", "score"))


def population_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Consistency per run."""
    p = rules.population(_scored(spark, sf), ["run_id"])
    return p.select("run_id", "sample_size", "issue_count", *_m("mean_score", "min_score", "axis_alignment_mean", "rule_score_mean", "axis_target_mae", "weighted_issue_rate", "issue_rate", "strict_error"))


def consistency_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Issues per rule, in order of the rules."""
    return rules.rule_counts(_scored(spark, sf), []).orderBy("rule_id", "severity")


TEXTS = ("family_context", "narrative", "identity_anchor", "moral_tension", "reasoning")


def blueprint_critic(spark: SparkSession, sf: str) -> DataFrame:
    """Scenarios that no text of a persona reflects; three or more are an error."""
    t = _traits(spark, sf).withColumn("blob", F.concat_ws(" ", *TEXTS)).withColumn("missing", rules.missing_scenarios("blob"))
    return t.select("persona_id", F.array_join("missing", ",").alias("missing"), (F.size("missing") >= 3).alias("is_error"))


STATES = ("stress", "fatigue", "perceived_autonomy", "perceived_competence", "social_safety", "task_interest", "avoidance", "recovery_capacity", "cognitive_flexibility", "autonomous_orientation", "defensive_orientation", "self_regulation_capacity", "social_confidence", "growth_readiness", "pressure_reactivity", "reflective_accuracy", "stress2", "fatigue2", "perceived_autonomy2", "perceived_competence2", "social_safety2", "task_interest2", "avoidance2", "recovery_capacity2", "honest_self_access", "state_variability", "acquiescence", "social_desirability", "uncertainty_preference", "extremity_preference", "fatigue_compression")


def _contexts(spark, sf):
    """Context features per survey: a cue counts if the survey's context or any of its items has it."""
    i = _t(spark, sf, "survey_items").where("survey_id is not null")
    cues = {}
    for name, (strong, weak, weight) in student.CUES.items():
        text = F.concat_ws(" ", "context", "text")
        v = S.flag(S.any_word(text, strong))
        cues[name] = F.greatest(v, weight * S.flag(S.any_word(text, weak))) if weak else v
    per = i.withColumns(cues).groupBy("survey_id").agg(*[F.max(n).alias(n) for n in cues])
    return student._stages(per, (student.CONTEXT,)).drop(*cues)


def survey_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The seven context features of every survey."""
    return _contexts(spark, sf).select("survey_id", *_r(*student.CONTEXT))


def student_states(spark: SparkSession, sf: str) -> DataFrame:
    """Latent states, traits and response style of every persona in every survey that it answered."""
    pairs = _t(spark, sf, "simulations").select("persona_id", "survey_id").distinct()
    rows = pairs.join(personas.filled(_traits(spark, sf)), "persona_id").join(_contexts(spark, sf), "survey_id")
    return student.states(rows).select("persona_id", "survey_id", *_r(*STATES))


def item_mechanisms(spark: SparkSession, sf: str) -> DataFrame:
    """Mechanism labels and scoring hint of every item."""
    i = scoring.items(_t(spark, sf, "survey_items"))
    return i.select("item_id", F.array_join(student.mechanisms("text"), "|").alias("mechanisms"), student.mechanism_hint("axis_weights", "direction").alias("hint"))


# Warnings on low evidence.
WARNINGS = {
    "low_cognition": ("cognitive_core", "<", 0.35),
    "low_motivation": ("motivation_core", "<", 0.35),
    "low_intrinsic": ("intrinsic", "<", 0.40),
    "high_external": ("external", ">", 0.60),
    "high_failure": ("failure", ">", 0.60),
    "low_regulation": ("regulation_core", "<", 0.35),
    "unstable_habits": ("habit", "<", 0.45),
    "high_stress": ("stress_load", ">", 0.60),
    "peer_pressure": ("peer_influence", ">", 0.60),
}
OUTER_DRIVES = ("achievement", "belonging", "security", "recognition", "avoidance")


def calibration_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Low-evidence warnings of every persona."""
    f = personas.axes(personas.filled(_traits(spark, sf)))
    found = [F.when(c(n) < v if op == "<" else c(n) > v, F.lit(k)) for k, (n, op, v) in WARNINGS.items()]
    return f.select("persona_id", F.array_join(F.array_compact(F.array(*found, F.when(c("drive").isin(*OUTER_DRIVES), F.lit("outer_drive")))), ",").alias("flags"))


def memory_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Personas as numbered memory lines: an unpivot of their fields into text."""
    f = _traits(spark, sf)
    lines = F.filter(F.array(*[F.concat(F.lit(f"{n}: "), c(n)) for n in personas.WORDS]), lambda x: x.isNotNull())
    return f.select("persona_id", F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", c("line_no").cast("bigint"))


def _slots(spark, sf):
    """Slots with their place from 1 in the order of ids, by which options are picked in turn."""
    return sampling.numbered(personas.slots(_t(spark, sf, "slots")), ["slot_id"], "i").withColumn("i", c("i") + 1)


def built_personas(spark: SparkSession, sf: str) -> DataFrame:
    """A rule-based persona for every slot."""
    b = builder.build(_slots(spark, sf))
    return b.select("slot_id", "age", *_r("stress", "energy"), *builder.LADDERS, F.array_join("core_values", ",").alias("core_values"), "narrative")


def slot_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Hints that each slot calls for."""
    b = builder.levels(_slots(spark, sf)).withColumns({"stress_band": c("constraints.stress_band"), "energy_band": c("constraints.social_energy_band"), "performance_band": c("constraints.derived_performance_band")})
    return b.select("slot_id", F.array_join(builder.hints(), ",").alias("hints"))


def slot_blueprints(spark: SparkSession, sf: str) -> DataFrame:
    """Band of each axis, strongest and weakest axis (the first on ties) of every slot."""
    s = builder.levels(_slots(spark, sf))
    low, high = F.least("cog", "mot", "reg"), F.greatest("cog", "mot", "reg")
    first = lambda x: F.when(c("cog") == x, AXES[0]).when(c("mot") == x, AXES[1]).otherwise(AXES[2])
    return s.select("slot_id", S.band("cog").alias("cognitive_band"), S.band("mot").alias("motivation_band"), S.band("reg").alias("regulation_band"), first(high).alias("strongest"), first(low).alias("weakest"))


def scenario_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Axes by the scenario that a structured program gives to their band: the inverse index, per quota."""
    s = builder.levels(_slots(spark, sf))
    scenario = lambda x: F.when(S.band(x) == "low", "failure_feedback").when(S.band(x) == "high", "ambiguous_task").otherwise("deadline")
    e = s.select("quota_label", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), scenario(n).alias("scenario")) for a, n in zip(AXES, ("cog", "mot", "reg"), strict=True)])).alias("e"))
    return e.groupBy("quota_label", "e.scenario").agg(F.array_join(F.sort_array(F.collect_set("e.axis")), ",").alias("axes"), F.count("*").cast("bigint").alias("n"))


STRETCH, BIAS = {"cognitive_core": 1.2, "motivation_core": 0.9, "regulation_core": 1.4}, {"cognitive_core": 0.05, "motivation_core": -0.1, "regulation_core": 0.0}


def conditioned_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Target axes under a genome's stretch and bias."""
    s = personas.slots(_t(spark, sf, "slots"))
    return s.select("slot_id", *[F.round(sampling.condition(F.coalesce(c(f"target_{a}"), F.lit(0.5)), F.lit(STRETCH[a]), F.lit(BIAS[a])), 6).alias(a) for a in AXES])


def _strata(spark, sf):
    s = _t(spark, sf, "slots").dropDuplicates(["slot_id"]).where("quota_label is not null")
    return s.groupBy("quota_label").agg(F.count("*").alias("w"), F.sort_array(F.collect_set("constraints.grade_or_stage")).alias("stages"), F.sort_array(F.collect_set("constraints.primary_drive")).alias("drives"))


def quota_allocation(spark: SparkSession, sf: str, n: int = 997) -> DataFrame:
    """Places of 997 by largest remainder over the shares of the quotas."""
    return sampling.quota(_strata(spark, sf), "quota_label", "w", "quota_label", n).select("quota_label", "n_slots")


def quota_sampled_slots(spark: SparkSession, sf: str, n: int = 997) -> DataFrame:
    """New slots: quotas, low-discrepancy points and drawn constraints."""
    strata = sampling.quota(_strata(spark, sf), "quota_label", "w", "quota_label", n).withColumnRenamed("quota_label", "label")
    return sampling.slots(strata, spark, n, 7).select("slot_id", "quota_label", *_r("x0", "x1", "x2"), "grade_or_stage", "primary_drive")


def halton_points(spark: SparkSession, sf: str, n: int = 4096) -> DataFrame:
    """Low-discrepancy points in three dimensions."""
    return sampling.points(spark, n, 3).select("i", *_r("x0", "x1", "x2"))


def persona_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tokens of every persona's texts."""
    t = _traits(spark, sf).withColumn("tokens", S.tokens(F.concat_ws(" ", *TEXTS)))
    return t.select("persona_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_min("tokens").alias("first_token"))


def _dup_rows(spark, sf):
    last = personas.latest(_t(spark, sf, "personas").select("persona_id", "source", c(personas.WORDS["narrative"]).alias("narrative"), "ingested_at"), "persona_id", "ingested_at")
    v = last.where("source is not null and narrative is not null")
    rows = v.select(c("source").alias("grp"), c("persona_id").alias("id"), S.tokens("narrative").alias("tokens"))
    return materialize(rows, "tokens")


def near_duplicate_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate pairs of narratives per source, exactly."""
    rows = _dup_rows(spark, sf)
    d = similarity.duplicate_rate(rows, similarity.pair_counts(rows, 0.8))
    return d.select(c("grp").alias("source"), "n", "n_pairs", F.round("rate", 8).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        *(persona_axes, persona_bound_axes, persona_matrix, validation, validity_by_run, consistency, population_consistency),
        *(consistency_rule_counts, blueprint_critic, survey_contexts, student_states, item_mechanisms, calibration_flags, memory_lines),
        *(built_personas, slot_hints, slot_blueprints, scenario_axes, conditioned_slots, quota_allocation, quota_sampled_slots),
        *(halton_points, persona_tokens, near_duplicate_rates),
    )
}

# SQL ----------------------------------------------------------------------------------------------------------------
_axes = ", ".join(f"{T.r6(a)} as {a}" for a in AXES)


def _issues_sql(pairs: list[tuple[str, str, str]]) -> str:
    parts = ", ".join(f"case when coalesce({cond}, false) then '{i}:{sev}' end" for i, sev, cond in pairs)
    return f"array_to_string(list_filter([{parts}], lambda x: x is not null), ',')"


_gate = " and ".join(
    ["age between 10 and 30"]
    + [f"{n} between 0 and 1" for n in personas.NUMBERS]
    + [f"{n} in {w!r}" for n, w in rules.ALLOWED.items()]
    + [f"length({n}) between {a} and {b}" for n, (a, b) in rules.LENGTHS.items()]
    + [f"len({n}) between {a} and {b}" for n, (a, b) in rules.SIZES.items()]
)
_traits_list = "[" + ", ".join(personas.NUMBERS) + "]"
_R = [
    ("R1", "error", f"intrinsic >= 0.75 and goal = 'avoidance' and not {T.contains('narrative', rules.TENSION)}"),
    ("R2", "warning", f"persistence >= 0.75 and planning = 'chaotic' and not {T.contains('narrative', rules.EFFORT)}"),
    ("R3", "error", "stress_load >= 0.7 and resilience >= 0.7 and coalesce(len(protective), 0) = 0"),
    ("R4", "warning", "external >= 0.75 and peer_influence <= 0.2 and reward in ('praise', 'grades', 'social_status')"),
    ("R5", "error", f"len(list_filter({_traits_list}, lambda x: x >= 0.8)) >= {len(personas.NUMBERS) - 1}"),
    ("R6", "error", f"len(list_filter({_traits_list}, lambda x: x <= 0.2)) >= {len(personas.NUMBERS) - 1}"),
    ("R7", "error", f"performance = 'high' and not {T.contains('reasoning', rules.GROUNDING)}"),
    ("R8", "error", f"performance in ('poor', 'low') and {T.contains('reasoning', rules.DEFICIT)}"),
]
_validated = f"{T.TRAITS}, v as (select *, case when not coalesce({_gate}, false) then 'SCHEMA:error' else {_issues_sql(_R)} end as issues from t)"
_C = [
    ("C1", "error", "planning = 'structured' and regulation_core < 0.42"),
    ("C2", "warning", "planning = 'chaotic' and regulation_core > 0.72"),
    ("C3", "warning", "attention = 'sustained' and regulation_core < 0.45"),
    ("C4", "warning", "attention = 'easily_shifted' and regulation_core > 0.72"),
    ("C5", "error", "drive in ('mastery', 'autonomy', 'curiosity') and intrinsic < 0.35"),
    ("C6", "warning", "drive in ('recognition', 'achievement') and external < 0.20"),
    ("C7", "warning", "reward = 'independence' and external > 0.78"),
    ("C8", "warning", "difficulty = 'reframes' and regulation_core < 0.35"),
    ("C9", "warning", "difficulty = 'freezes' and regulation_core > 0.72"),
    ("C10", "warning", "coping = 'problem_solving' and regulation_core < 0.35"),
    ("C11", "warning", "coping in ('avoidance', 'withdrawal') and regulation_core > 0.72"),
    ("C12", "error", "collaboration = 'leader' and energy < 0.45"),
    ("C13", "warning", "collaboration = 'solo' and energy > 0.78"),
    ("C14", "warning", "expressiveness > 0.82 and energy < 0.25"),
    ("C15", "error", "performance = 'high' and regulation_core < 0.38 and motivation_core < 0.45"),
    ("C16", "warning", "performance = 'poor' and regulation_core > 0.76 and motivation_core > 0.65 and stress_load < 0.45"),
    ("C17", "warning", "goal = 'avoidance' and performance = 'high' and regulation_core < 0.55"),
    ("C18", "warning", "stress_load > 0.78 and resilience > 0.78 and regulation_core < 0.42"),
    ("C19", "warning", "stress_load < 0.25 and coalesce(len(risks), 0) > 0 and resilience < 0.25"),
]
_difficulty = "case when regulation_core >= 0.7 then 'reframes' when energy >= 0.6 then 'seeks_help' when regulation_core <= 0.25 then 'freezes' else 'doubles_down' end"
_consistent = f"""{T.ALIGNED}, d as (select *, {_difficulty} as difficulty from a), x as (select *, {_issues_sql(_C)} as issues from d),
    y as (select *, case when issues = '' then [] else string_split(issues, ',') end as il from x),
    z as (select *, 0.08::double * len(list_filter(il, lambda q: q like '%:error')) + 0.035::double * len(list_filter(il, lambda q: q like '%:warning')) as penalty from y),
    k as (select *, greatest(0.0, 1.0 - least(0.65, penalty)) as rule_score from z),
    w as (select *, 0.7 * axis_alignment + 0.3 * rule_score as score from k)"""
_ctx = f"u as (select survey_id, concat_ws(' ', context, text) as tx from survey_items where survey_id is not null), q as (select survey_id, {expected.cues('tx', 'max({})')} from u group by survey_id), {expected.steps('q', expected.CONTEXTS, 'ctx')[0]}"
_ctx_last = expected.steps("q", expected.CONTEXTS, "ctx")[1]
_context_names = [x.split()[0] for x in expected.lines(expected.CONTEXTS)]
_gap = "greatest(growth_readiness, defensive_orientation) - least(growth_readiness, defensive_orientation)"
_st1, _n1 = expected.steps("st", expected.STATES.replace("1*growth_gap", f"1*({_gap})".replace(" ", "")), "g")
_states = f"""{T.FILLED}, {_ctx}, pr as (select distinct persona_id, survey_id from simulations),
    st as (select pr.survey_id, f.*, {", ".join(f"x.{n}" for n in _context_names)}, {", ".join(expected.drive(x) for x in expected.lines(expected.DRIVES))} from pr join f using (persona_id) join {_ctx_last} x on x.survey_id = pr.survey_id), {_st1}"""
_levels = f"""{T.SLOTS}, ix as (select *, row_number() over (order by slot_id) as i from s),
    lv as (select *, coalesce(target_cognitive_core, 0.5) as cog, coalesce(target_motivation_core, 0.5) as mot, coalesce(target_regulation_core, 0.5) as reg, constraints.primary_drive as drive,
        constraints.stress_band as stress_band, constraints.social_energy_band as energy_band, constraints.derived_performance_band as performance_band,
        case constraints.stress_band when 'low' then 0.2 when 'low_mid' then 0.38 when 'mid' then 0.52 when 'mid_high' then 0.68 when 'high' then 0.8 else 0.52 end as sb,
        greatest(0.0, least(1.0, case constraints.social_energy_band when 'low' then 0.22::double when 'low_mid' then 0.38 when 'mid' then 0.52 when 'mid_high' then 0.68 when 'high' then 0.82 else 0.52 end + ((i % 3) - 1) * 0.04)) as energy,
        case constraints.grade_or_stage when 'middle_school' then 12 when 'high_school' then 15 when 'vocational' then 16 when 'undergraduate' then 18 when 'graduate' then 22 when 'early_career' then 22 else 15 end as lo,
        case constraints.grade_or_stage when 'middle_school' then 15 when 'high_school' then 18 when 'vocational' then 20 when 'undergraduate' then 23 when 'graduate' then 28 when 'early_career' then 30 else 22 end as hi from ix)"""
_band = lambda x: f"case when {x} <= 0.34 then 'low' when {x} >= 0.66 then 'high' else 'mid' end"
_scen = lambda x: f"case when {x} <= 0.34 then 'failure_feedback' when {x} >= 0.66 then 'ambiguous_task' else 'deadline' end"
_radical = lambda b: "round(list_sum(list_transform(range(1, 21), lambda k: (cast(floor(i / pow(" + str(b) + ".0, k - 1)) as bigint) % " + str(b) + ") / pow(" + str(b) + ".0, k))), 6)"
_quota = """st as (select quota_label, count(distinct slot_id) as w from slots where quota_label is not null group by quota_label),
    qq as (select *, w / sum(w) over () * 997 as raw from st), fl as (select *, floor(raw) as fl from qq),
    rk as (select *, row_number() over (order by round(raw - fl, 12) desc, quota_label desc) as rk, 997 - sum(fl) over () as lft from fl)"""
_tok = "list_distinct(regexp_extract_all(lower(concat_ws(' ', " + ", ".join(TEXTS) + ")), '[a-zA-Z][a-zA-Z_''\\-]{2,}'))"
_tok1 = "list_distinct(regexp_extract_all(lower(narrative), '[a-zA-Z][a-zA-Z_''\\-]{2,}'))"
_lines = ", ".join(f"'{n}: ' || {n}" for n in "stage region family_context drive reward goal attention planning narrative collaboration coping performance reasoning identity_anchor moral_tension".split())
SQL = {
    "persona_axes": f"with {T.FILLED} select persona_id, {_axes} from f",
    "persona_bound_axes": f"with {T.FILLED} select persona_id, round(cognitive_core, 6) as axis_openness, round(motivation_core, 6) as axis_ownership, round(regulation_core, 6) as axis_self_regulation_resilience, 0.5::double as axis_unbound from f",
    "persona_matrix": f"with {T.FILLED}, m as (select persona_id, {_axes} from f) select *, concat_ws(',', cast(floor(cognitive_core * 1000) as bigint), cast(floor(motivation_core * 1000) as bigint), cast(floor(regulation_core * 1000) as bigint)) as row from m",
    "validation": f"with {_validated} select persona_id, issues, not contains(issues, ':error') as is_valid, cast((length(issues) - length(replace(issues, ':error', ''))) / 6 as bigint) as hard_errors from v",
    "validity_by_run": f"with {_validated}, vr as (select run_id, count(*) as sample_size, cast(count(*) filter (where not contains(issues, ':error')) as bigint) as valid_count, round(avg(case when contains(issues, ':error') then 0.0 else 1.0 end), 6) as validity_rate from v group by run_id), sn as (select run_id, count(distinct slot_id) as n_slots from slots where run_id is not null group by run_id) select vr.*, n_slots, round(sample_size / n_slots, 6) as generation_rate from vr left join sn using (run_id)",
    "consistency": f"with {_consistent} select persona_id, issues, round(axis_alignment, 6) as axis_alignment, round(rule_score, 6) as rule_score, round(score, 6) as score from w",
    "population_consistency": f"""with {_consistent}, p as (select run_id, count(*) as sample_size, cast(sum(len(il)) as bigint) as issue_count, avg(score) as mean_score, min(score) as min_score, avg(axis_alignment) as axis_alignment_mean,
        avg(rule_score) as rule_score_mean, avg(1 - axis_alignment) as axis_target_mae, least(1.0, sum(penalty) / count(*)) as weighted_issue_rate, sum(len(il)) / count(*) as issue_rate from w group by run_id)
        select run_id, sample_size, issue_count, {", ".join(f"round({x} + 1e-9, 6) as {x}" for x in ("mean_score", "min_score", "axis_alignment_mean", "rule_score_mean", "axis_target_mae", "weighted_issue_rate", "issue_rate"))}, round(least(1.0, 0.7 * axis_target_mae + 0.3 * weighted_issue_rate) + 1e-9, 6) as strict_error from p""",
    "consistency_rule_counts": f"with {_consistent}, e as (select unnest(il) as q from w) select string_split(q, ':')[1] as rule_id, string_split(q, ':')[2] as severity, count(*) as n from e group by all",
    "blueprint_critic": f"""with {T.TRAITS}, b as (select persona_id, concat_ws(' ', {", ".join(TEXTS)}) as blob from t), m as (select persona_id, list_filter([{", ".join(f"case when not {T.contains('blob', w)} then '{n}' end" for n, w in rules.SCENARIOS.items())}], lambda x: x is not null) as l from b)
        select persona_id, array_to_string(l, ',') as missing, len(l) >= 3 as is_error from m""",
    "survey_contexts": f"with {_ctx} select survey_id, {', '.join(f'round({n}, 6) as {n}' for n in _context_names)} from {_ctx_last}",
    "student_states": f"with {_states} select persona_id, survey_id, {', '.join(f'round({n}, 6) as {n}' for n in STATES)} from {_n1}",
    "item_mechanisms": f"""with {T.ITEMS}, m as (select *, list_filter([{", ".join(f"case when {expected.has('text', x.split(':')[1])} then '{x.split(':')[0]}' end" for x in expected.lines(expected.MECHANISMS))}], lambda x: x is not null) as l from i)
        select item_id, case when len(l) = 0 then 'no special one' else array_to_string(l, '|') end as mechanisms,
            case when direction = -1 then 'reverse' else 'forward' end || '; ' || case when cardinality(axis_weights) = 0 then 'none' else array_to_string(list_transform(list_sort(map_keys(axis_weights)), lambda k: k || ':' || format('{{:.2f}}', axis_weights[k])), ', ') end || '; ' ||
            case when list_contains(map_keys(axis_weights), 'motivation_core') then 'motivation' when list_contains(map_keys(axis_weights), 'regulation_core') then 'regulation' when list_contains(map_keys(axis_weights), 'cognitive_core') then 'cognition' else 'context' end as hint from m""",
    "calibration_flags": f"""with {T.FILLED} select persona_id, array_to_string(list_filter([{", ".join(f"case when {n} {op} {v} then '{k}' end" for k, (n, op, v) in WARNINGS.items())}, case when drive in {OUTER_DRIVES!r} then 'outer_drive' end], lambda x: x is not null), ',') as flags from f""",
    "memory_lines": f"with {T.TRAITS}, l as (select persona_id, list_filter([{_lines}], lambda x: x is not null) as l from t) select persona_id, cast(n - 1 as bigint) as line_no, l[n] as line from (select persona_id, l, unnest(range(1, len(l) + 1)) as n from l)",
    "built_personas": f"""with {_levels}, b as (select *, {", ".join(f"{builder.ladder_sql(k)} as {k}" for k in builder.LADDERS)} from lv)
        select slot_id, cast(lo + i % (hi - lo + 1) as bigint) as age, round(greatest(0.0, least(1.0, sb + 0.1 * (1.0 - reg))), 6) as stress, round(energy, 6) as energy, {", ".join(builder.LADDERS)},
            case when v = 'growth' then 'growth,' || value else v || ',growth,' || value end as core_values,
            'This person works in a ' || dominant_mode || ' way, trusts ' || evidence || ' most and is moved by ' || coalesce(drive, 'no clear drive') || '. Plans are ' || planning || ', attention is ' || attention || ' and curiosity ' || curiosity || '. ' ||
            'When something proves hard the first answer is: ' || under_difficulty || '; criticism leaves them ' || under_criticism || ', success ' || under_success || '. In doubt they choose what will ' || tradeoff || ', and in a group they are the ' || collaboration || ', whose way of coping is ' || coping || '.' as narrative
        from (select *, ['curiosity', 'fairness', 'growth', 'care', 'craft'][cast((i - 1) % 5 as int) + 1] as v from b)""",
    "slot_hints": f"with {_levels} select slot_id, array_to_string({builder.hints_sql()}, ',') as hints from lv",
    "slot_blueprints": f"""with {_levels} select slot_id, {_band("cog")} as cognitive_band, {_band("mot")} as motivation_band, {_band("reg")} as regulation_band,
        case greatest(cog, mot, reg) when cog then 'cognitive_core' when mot then 'motivation_core' else 'regulation_core' end as strongest,
        case least(cog, mot, reg) when cog then 'cognitive_core' when mot then 'motivation_core' else 'regulation_core' end as weakest from lv""",
    "scenario_axes": f"""with {_levels}, e as (select quota_label, 'cognitive_core' as axis, {_scen("cog")} as scenario from lv union all select quota_label, 'motivation_core', {_scen("mot")} from lv union all select quota_label, 'regulation_core', {_scen("reg")} from lv)
        select quota_label, scenario, string_agg(distinct axis, ',' order by axis) as axes, count(*) as n from e group by all""",
    "conditioned_slots": f"with {T.SLOTS} select slot_id, {', '.join(f'round(greatest(0.0, least(1.0, 0.5 + (coalesce(target_{a}, 0.5) - 0.5) * {STRETCH[a]} + {BIAS[a]})), 6) as {a}' for a in AXES)} from s",
    "quota_allocation": f"with {_quota} select quota_label, cast(fl + case when rk <= lft then 1 else 0 end as bigint) as n_slots from rk",
    "quota_sampled_slots": f"""with {_quota}, al as (select quota_label, cast(fl + case when rk <= lft then 1 else 0 end as bigint) as n from rk), sp as (select *, coalesce(sum(n) over (order by quota_label rows between unbounded preceding and 1 preceding), 0) as start from al),
        ek as (select quota_label, unnest(range(cast(start as bigint), cast(start + n as bigint))) as k from sp), dl as (select quota_label, (k * 616 + 7) % 997 + 1 as i from ek),
        op as (select quota_label, list_sort(list(distinct constraints.grade_or_stage) filter (where constraints.grade_or_stage is not null)) as stages, list_sort(list(distinct constraints.primary_drive) filter (where constraints.primary_drive is not null)) as drives from slots where quota_label is not null group by quota_label)
        select printf('slot_%06d', i) as slot_id, quota_label, {_radical(2)} as x0, {_radical(3)} as x1, {_radical(5)} as x2, stages[cast((i * 7919 + 7 * 104729 + i // 7) % len(stages) as int) + 1] as grade_or_stage, drives[cast((i * 7919 + 8 * 104729 + i // 7) % len(drives) as int) + 1] as primary_drive from dl join op using (quota_label)""",
    "halton_points": f"with g as (select unnest(range(1, 4097)) as i) select i, {_radical(2)} as x0, {_radical(3)} as x1, {_radical(5)} as x2 from g",
    "persona_tokens": f"with {T.TRAITS}, k as (select persona_id, {_tok} as l from t) select persona_id, len(l) as n_tokens, list_min(l) as first_token from k",
    "near_duplicate_rates": f"""with {T.TRAITS}, k as (select source, persona_id, {_tok1} as l from t where source is not null and narrative is not null), n as (select source, count(*) as n from k group by source),
        p as (select a.source, count(*) as n_pairs from k a join k b on a.source = b.source and a.persona_id < b.persona_id where len(list_intersect(a.l, b.l))::double / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l))) >= 0.8 group by a.source)
        select source, n, coalesce(n_pairs, 0) as n_pairs, round(case when n < 2 then 0.0 else coalesce(n_pairs, 0) / (n * (n - 1) / 2.0) end, 8) as rate from n left join p using (source)""",
}
