"""Queries for staged writers: constraints per stage, pruned views of personas, lines for genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import builder, personas
from cohortlab.plans import sqltext as T
from cohortlab.plans.persona_queries import _t

c = F.col


def slot_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """What each slot demands of each writing stage."""
    s = personas.slots(_t(spark, sf, "slots"))
    return s.select("slot_id", F.explode(builder.stage_constraints()).alias("e")).select("slot_id", "e.stage", "e.text")


def stage_views(spark: SparkSession, sf: str) -> DataFrame:
    """What the health stage sees of each persona: only these leaves are read."""
    p = _t(spark, sf, "personas").select(*[c(f).alias(f.rsplit(".", 1)[-1]) for f in builder.stage_view("health")]).dropDuplicates(["persona_id"])
    return p.withColumn("age", c("age").cast("bigint"))


def genome_addenda(spark: SparkSession, sf: str) -> DataFrame:
    """Every genome's line for a writer and how many candidates have it."""
    t = _t(spark, sf, "candidates").select("candidate_id", builder.genome_addendum("genome").alias("line")).where("line is not null and candidate_id is not null").distinct()
    return t.groupBy("line").agg(F.count("*").cast("bigint").alias("n"))


QUERIES = {f.__name__: f for f in (slot_constraints, stage_views, genome_addenda)}


def _stage(stage: str, fields: tuple[str, ...]) -> str:
    own = ", ".join(f"'{x}=' || coalesce(constraints.{x}, 'free')" for x in fields)
    return f"select slot_id, '{stage}' as stage, concat_ws('; ', {own}, case when constraints.avoid_all_high_profile then 'not all high' end, case when constraints.avoid_all_low_profile then 'not all low' end) as text from s"


SQL = {
    "slot_constraints": f"with {T.SLOTS} " + " union all ".join(_stage(k, v) for k, v in builder.STAGES.items()),
    "stage_views": "select distinct persona_id, cast(demographics.age as bigint) as age, demographics.grade_or_stage as grade_or_stage, cognitive_motivation_profile.self_regulation.persistence as persistence, social_creative_profile.social_energy as social_energy from personas",
    "genome_addenda": """with g as (select distinct candidate_id, cast(genome as json) as g from candidates where json_valid(genome) and candidate_id is not null),
        b as (select candidate_id, json_extract_string(g, '$.style') as style, json_extract_string(g, '$.scenario') as scenario, cast(json_extract(g, '$.bias') as map(varchar, double)) as bias from g),
        l as (select candidate_id, concat_ws('; ', 'style ' || style, 'scenario ' || scenario, case when cardinality(bias) > 0 then array_to_string(list_transform(list_sort(map_keys(bias)), lambda k: k || case when bias[k] < 0 then ' lower' when bias[k] > 0 then ' higher' else ' as is' end), ', ') end) as line from b where style is not null)
        select line, count(distinct candidate_id) as n from l group by line""",
}
