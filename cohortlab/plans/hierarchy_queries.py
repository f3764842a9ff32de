"""Queries over parent-child links and nested run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import dewey, hierarchy


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _key(c: Column) -> Column:
    """Ids are compared without outer blanks and case; a blank id is none."""
    return F.when(F.trim(c) != "", F.lower(F.trim(c)))


def _forest(spark: SparkSession, sf: str, with_path: bool = False) -> DataFrame:
    return hierarchy.resolve(_t(spark, sf, "candidates"), "candidate_id", "parent_id", key=_key, locality=("island_id", "generation"), with_path=with_path)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every candidate; -1 and the loop's smallest id for candidates on or below a loop."""
    return _forest(spark, sf).select(F.col("node").alias("candidate_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path of every candidate, root first; null on or below a loop."""
    return _forest(spark, sf, True).select(F.col("node").alias("candidate_id"), F.array_join("path", "/").alias("path"), "depth")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All (ancestor, descendant) pairs with their distance."""
    return hierarchy.descendants(_forest(spark, sf, True)).select(F.col("ancestor").alias("candidate_id"), F.col("descendant").alias("descendant_id"), "distance")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "experiment_runs")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Answers 1..5 and axis scores of all simulations of all runs."""
    return dewey.run_values(_runs(spark, sf))


def p3_simulations(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of simulations, tied to their run."""
    return dewey.simulations(_runs(spark, sf)).select("run_id", "sim_no", "persona_id", "survey_id", "backend", "fatigue").distinct()


def _entries(spark: SparkSession, sf: str, kind: str, name: str, number: str) -> DataFrame:
    e = dewey.entries(_runs(spark, sf)).where(F.col("kind") == kind)
    return e.select("run_id", "sim_no", F.col("sim").alias("sim_label"), F.col("entry").alias("label"), F.col("name").alias(name), F.col("number").alias(number)).distinct()


def p3_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of answers, tied to their simulation; ``answer`` is null where none can be read."""
    return _entries(spark, sf, "response", "item_id", "answer")


def p3_axis_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of axis scores, tied to their simulation; ``score`` is null where none can be read."""
    return _entries(spark, sf, "axis", "axis", "score")


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of runs: the scalars of a run outside its lists and simulations."""
    runs = _runs(spark, sf).select(F.concat(F.lpad(F.hex(F.xxhash64("payload")), 16, "0"), F.col("run_id")).alias("doc"), "payload")
    n = dewey.tables(runs, "doc", "payload", ("$",)).where(F.size("fields") > 0)
    own = {"mode": ("mode",), "seed": ("seed",), "n_requested": ("n_requested",), "experiment_score": ("experiment_score",), "sample_size": ("schema_evaluation", "sample_size"), "coverage": ("schema_evaluation", "diversity_metrics", "coverage"), "avg_dist": ("slot_diversity_metrics", "avg_dist")}
    kinds = {"mode": "string", "seed": "bigint", "n_requested": "bigint", "sample_size": "bigint"}
    return n.select(F.expr("substring(doc, 17)").alias("run_id"), *[dewey.plain(dewey.field(*p)).try_cast(kinds.get(name, "double")).alias(name) for name, p in own.items()]).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_simulations, p3_answers, p3_axis_scores, p3_runs)}

_LINKS = """
        with recursive ids as (select candidate_id, lower(trim(min(parent_id))) as k from candidates where candidate_id is not null group by candidate_id),
        links as (select a.candidate_id as node, b.candidate_id as parent from ids a left join ids b on lower(trim(b.candidate_id)) = nullif(a.k, ''))"""


def _number_sql(v: str) -> str:
    """A JSON value, perhaps wrapped in an object, as a number; null for all else."""
    w = f"case when json_type({v}) = 'OBJECT' then json_extract({v}, '$.value') else {v} end"
    return f"case when json_type({w}) in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast({w} as double) when json_type({w}) = 'VARCHAR' then try_cast(trim(json_extract_string({w}, '$')) as double) end"


_PAYLOADS = f"""
        with p as (select run_id, cast(payload as json) as j from experiment_runs where json_valid(payload)),
        s0 as (select run_id, json_extract(j, '$.shadow_simulations') as x, '0.' || (list_position(json_keys(j), 'shadow_simulations') - 1) as root from p),
        s1 as (select run_id, root, case when json_type(x) = 'VARCHAR' then cast(json_extract_string(x, '$') as json) else x end as x from s0),
        s2 as (select run_id, root, json_type(x) = 'ARRAY' as many, case json_type(x) when 'OBJECT' then [x] when 'ARRAY' then cast(x as json[]) end as l from s1),
        s3 as (select *, unnest(range(0, len(l))) as sim_no from s2),
        s as (select run_id, sim_no, l[sim_no + 1] as x, case when many then root || '.' || sim_no else root end as sim from s3),
        v as (
            select run_id, sim_no, sim, 'response' as kind, json_extract(x, '$.responses') as m, sim || '.' || (list_position(json_keys(x), 'responses') - 1) as loc from s where json_type(x) = 'OBJECT'
            union all select run_id, sim_no, sim, 'axis', json_extract(x, '$.axis_scores'), sim || '.' || (list_position(json_keys(x), 'axis_scores') - 1) from s where json_type(x) = 'OBJECT'),
        b as (select run_id, sim_no, sim, kind, case when kind = 'axis' and json_type(json_extract(m, '$.axes')) = 'OBJECT' then loc || '.' || (list_position(json_keys(m), 'axes') - 1) else loc end as loc,
            case when kind = 'axis' and json_type(json_extract(m, '$.axes')) = 'OBJECT' then json_extract(m, '$.axes') else m end as m from v),
        k as (select *, json_keys(m) as keys, unnest(range(0, len(json_keys(m)))) as i from b where json_type(m) = 'OBJECT'),
        r as (select *, cast(m as json[]) as els, unnest(range(0, len(cast(m as json[])))) as i from b where json_type(m) = 'ARRAY'),
        e as (
            select run_id, sim_no, sim, kind, loc || '.' || i as label, keys[i + 1] as name, map_extract(cast(m as map(varchar, json)), keys[i + 1])[1] as v from k
            union all select run_id, sim_no, sim, kind, loc || '.' || i, case kind when 'axis' then json_extract_string(els[i + 1], '$.axis') else coalesce(json_extract_string(els[i + 1], '$.item'), json_extract_string(els[i + 1], '$.item_id')) end,
                case kind when 'axis' then json_extract(els[i + 1], '$.score') else coalesce(json_extract(els[i + 1], '$.answer'), json_extract(els[i + 1], '$.response')) end from r),
        n as (select run_id, sim_no, sim, kind, label, name, case when isfinite(n) then n end as n from (select *, {_number_sql("v")} as n from e where name is not null))"""

SQL = {
    "p2_found": f"""{_LINKS},
        walk as (select node, node as root, cast(0 as bigint) as depth from links where parent is null
            union all select l.node, w.root, w.depth + 1 from walk w join links l on l.parent = w.node),
        rest as (select node, parent from links where node not in (select node from walk)),
        steps as (select node as start, node as at, [node] as path from rest
            union all select s.start, r.parent, list_append(s.path, r.parent) from steps s join rest r on r.node = s.at where not list_contains(s.path, r.parent))
        select node as candidate_id, root as root_id, depth from walk
        union all select s.start, list_min(s.path[list_position(s.path, r.parent):]), cast(-1 as bigint) from steps s join rest r on r.node = s.at where list_contains(s.path, r.parent)""",
    "p3_found": f"""{_PAYLOADS}
        select distinct run_id, sim_no, kind, name, cast(case when kind = 'axis' then round(n * 1000) else n end as bigint) as value from n where n is not null and (kind = 'axis' or (n between 1 and 5 and n = floor(n)))""",
    "p3_answers": f"{_PAYLOADS} select distinct run_id, sim_no, sim as sim_label, label, name as item_id, n as answer from n where kind = 'response'",
    "p3_axis_scores": f"{_PAYLOADS} select distinct run_id, sim_no, sim as sim_label, label, name as axis, n as score from n where kind = 'axis'",
    "p3_simulations": f"""{_PAYLOADS} select distinct run_id, sim_no, json_extract_string(x, '$.persona_id') as persona_id, json_extract_string(x, '$.survey_id') as survey_id, json_extract_string(x, '$.metadata.simulator_backend') as backend,
        cast(json_extract(x, '$.metadata.student_state.fatigue') as double) as fatigue from s where json_type(x) = 'OBJECT'""",
    "p3_runs": """with p as (select run_id, cast(payload as json) as j from experiment_runs where json_valid(payload))
        select distinct run_id, json_extract_string(j, '$.mode') as mode, try_cast(json_extract_string(j, '$.seed') as bigint) as seed, try_cast(json_extract_string(j, '$.n_requested') as bigint) as n_requested, try_cast(json_extract_string(j, '$.experiment_score') as double) as experiment_score,
            try_cast(json_extract_string(j, '$.schema_evaluation.sample_size') as bigint) as sample_size, try_cast(json_extract_string(j, '$.schema_evaluation.diversity_metrics.coverage') as double) as coverage, try_cast(json_extract_string(j, '$.slot_diversity_metrics.avg_dist') as double) as avg_dist from p""",
    "p2_paths": f"""{_LINKS},
        walk as (select node, node as path, cast(0 as bigint) as depth from links where parent is null
            union all select l.node, w.path || '/' || l.node, w.depth + 1 from walk w join links l on l.parent = w.node)
        select node as candidate_id, path, depth from walk
        union all select node, null, cast(-1 as bigint) from links where node not in (select node from walk)""",
    "p2_descendants": f"""{_LINKS},
        walk as (select node as anc, node, cast(0 as bigint) as distance from links where parent is null
            union all select w.anc, l.node, w.distance + 1 from walk w join links l on l.parent = w.node),
        tree as (select node from walk),
        up as (select node as descendant_id, parent as candidate_id, cast(1 as bigint) as distance from links where parent is not null and node in (select node from tree)
            union all select u.descendant_id, l.parent, u.distance + 1 from up u join links l on l.node = u.candidate_id where l.parent is not null)
        select candidate_id, descendant_id, distance from up""",
}
