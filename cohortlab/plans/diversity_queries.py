"""Queries over point populations: the three axes of personas per run, and embeddings per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.scalars import cell, clip
from cohortlab.operators import diversity, personas, reports, scoring
from cohortlab.operators.personas import AXES
from cohortlab.plans import sqltext as T
from cohortlab.plans.persona_queries import _m, _t, _traits
from cohortlab.plans.survey_queries import _sim_axes

c = F.col


def _points(spark, sf):
    """``pop`` (source), ``id`` and the axes of each persona."""
    return personas.axes(personas.filled(_traits(spark, sf))).select(F.coalesce("source", F.lit("none")).alias("pop"), c("persona_id").alias("id"), F.array(*AXES).alias("point"))


def _vectors(spark, sf):
    """``pop`` (label), ``id`` and the whole embedding."""
    e = _t(spark, sf, "embeddings").where("embedding is not null")
    return e.select(F.coalesce("label", F.lit(-1)).alias("pop"), c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("point"))


def pairwise_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, mean and least distance per source, over blocks of points."""
    return diversity.pairwise(_points(spark, sf)).select(c("pop").alias("source"), "n_pairs", *_m("avg_dist", "min_dist"))


def vector_distances(spark: SparkSession, sf: str) -> DataFrame:
    """The same for embeddings per label."""
    return diversity.pairwise(_vectors(spark, sf)).select(c("pop").alias("label"), "n_pairs", *_m("avg_dist", "min_dist"))


def kl_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """Divergence from uniform per source."""
    return diversity.kl_uniform(_points(spark, sf), 3).select(c("pop").alias("source"), "n", "bins", *_m("kl"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a thousand reference points within 0.2 of a persona, per source."""
    return diversity.coverage(_points(spark, sf), 3, 0.2).select(c("pop").alias("source"), *_m("coverage"))


def dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """Largest gap of a reference point to the personas of a source."""
    return diversity.dispersion(_points(spark, sf), 3).select(c("pop").alias("source"), *_m("dispersion"))


def hull_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Volume of the convex hull per source."""
    return diversity.hull(_points(spark, sf)).select(c("pop").alias("source"), *_m("hull"))


def diversity_fitness(spark: SparkSession, sf: str) -> DataFrame:
    """All measures per source with negative signs for gaps and divergence, and both composite scores."""
    p = _points(spark, sf)
    j = diversity.pairwise(p).join(diversity.kl_uniform(p, 3), "pop").join(diversity.coverage(p, 3, 0.2), "pop").join(diversity.dispersion(p, 3), "pop")
    j = j.withColumns({"balanced": diversity.balanced(c("coverage"), c("kl"), c("avg_dist"), c("min_dist")), "combined": diversity.combined(F.lit(1.0), F.lit(0.0), c("coverage"), c("avg_dist"), c("min_dist"), 3), "dispersion": -c("dispersion"), "kl": -c("kl")})
    return j.select(c("pop").alias("source"), *_m("coverage", "dispersion", "kl", "avg_dist", "min_dist", "balanced", "combined"))


def recorded_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded diversity of runs: both composite scores, with defaults for missing measures."""
    e = _t(spark, sf, "evaluations").groupBy("run_id").agg(F.max_by(F.struct("diversity_metrics", "validity_rate", "near_duplicate_rate"), "evaluated_at").alias("r")).select("run_id", "r.*")
    m = lambda k, d: F.coalesce(F.element_at("diversity_metrics", F.lit(k)), F.lit(d))
    dup = clip(F.coalesce("near_duplicate_rate", F.lit(0.0)))
    return e.select("run_id", F.round(diversity.balanced(m("coverage", 0.0), m("kl_divergence", 10.0), m("avg_dist", 0.0), m("min_dist", 0.0)) + 1e-9, 6).alias("balanced"), F.round(diversity.combined(clip(F.coalesce("validity_rate", F.lit(0.0))), dup, m("coverage", 0.0), m("avg_dist", 0.0), m("min_dist", 0.0), 3) + 1e-9, 6).alias("combined"))


def radar_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every diversity metric of a run's last evaluation in its fixed range."""
    e = _t(spark, sf, "evaluations").groupBy("run_id").agg(F.max_by("diversity_metrics", "evaluated_at").alias("m")).select("run_id", F.explode("m").alias("metric", "value"))
    return reports.finite(e, "value").select("run_id", "metric", F.round(reports.radar(c("metric"), c("value")) + 1e-9, 6).alias("scaled"))


def mean_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of each recorded measure over runs, empty maps and missing values skipped."""
    e = _t(spark, sf, "evaluations").select("run_id", "diversity_metrics", "evaluated_at").groupBy("run_id").agg(F.max_by("diversity_metrics", "evaluated_at").alias("m"))
    return reports.finite(e.select("run_id", F.explode("m").alias("metric", "value")), "value").groupBy("metric").agg(F.count("*").cast("bigint").alias("n"), F.round(F.avg("value") + 1e-9, 6).alias("mean"))


def _cells(spark, sf, buckets: int = 4):
    """Persona with its target cell, its realised cell and quality 1 - MAE between both."""
    s = personas.slots(_t(spark, sf, "slots"))
    m = scoring.behaviour(_sim_axes(spark, sf), AXES).select("persona_id", *[F.round(a, 9).alias(a) for a in AXES])
    j = m.join(s.select(c("slot_id").alias("persona_id"), *[f"target_{a}" for a in AXES]), "persona_id").join(_traits(spark, sf).select("persona_id", "source", "run_id"), "persona_id")
    target = {a: F.coalesce(c(f"target_{a}"), F.lit(0.5)) for a in AXES}
    gap = sum((F.abs(F.coalesce(c(a), F.lit(0.5)) - t) for a, t in list(target.items())[1:]), F.abs(F.coalesce(c(AXES[0]), F.lit(0.5)) - target[AXES[0]])) / 3
    return j.select("persona_id", "source", "run_id", *[cell(c(a), buckets).alias(f"r_{a}") for a in AXES], *[cell(target[a], buckets).alias(f"t_{a}") for a in AXES], (1.0 - gap).alias("quality"), *[c(a).alias(a) for a in AXES], *[c(f"target_{a}") for a in AXES])


def _name(prefix: str):
    return F.concat_ws("-", *[c(f"{prefix}_{a}") for a in AXES])


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Target and realised grid cell and quality of every persona."""
    return _cells(spark, sf).select("persona_id", _name("t").alias("target_cell"), _name("r").alias("realised_cell"), *_m("quality"))


def grid_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied cells per source with the footprints of its runs."""
    k = _cells(spark, sf).where("run_id is not null").select(F.coalesce("source", F.lit("none")).alias("source"), c("run_id").alias("owner"), _name("r").alias("cell"))
    return reports.occupancy(k, ["source"], 64).select("source", "n_cells", "foot_min", "foot_median", "foot_max", *_m("share"))


def grid_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Best persona of each realised cell, the best first; the smallest id on ties."""
    k = _cells(spark, sf).select(_name("r").alias("cell"), F.round("quality", 9).alias("q"), "persona_id")
    return k.groupBy("cell").agg(F.min(F.struct((-c("q")).alias("q"), "persona_id")).alias("b"), F.count("*").cast("bigint").alias("n")).select("cell", c("b.persona_id").alias("persona_id"), F.round(-c("b.q") + 1e-9, 6).alias("quality"), "n").orderBy(F.desc("quality"), "cell")


def cumulative_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Realised cells that a source reached first on each day, and all that it had reached by then."""
    day = _t(spark, sf, "personas").groupBy("persona_id").agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("day"))
    k = _cells(spark, sf).join(day, "persona_id").where("day is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "day", _name("r").alias("cell"))
    return reports.cumulative_cells(k, ["source"], "day")


def grid_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Realised cells per pair of axes, whatever the third, by grouping sets."""
    names = {f"r_{a}": a for a in AXES}
    p = reports.projections(_cells(spark, sf), list(names))
    return p.select(*[c(k).cast("bigint").alias(v) for k, v in names.items()], "n_cells")


def grid_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and differences of target and realised cells."""
    k = _cells(spark, sf)
    t, r = k.select(_name("t").alias("cell")).distinct(), k.select(_name("r").alias("cell")).distinct()
    count = lambda d, n: d.agg(F.lit(n).alias("set"), F.count("*").cast("bigint").alias("n_cells"))
    return count(t.union(r).distinct(), "union").unionByName(count(t.intersect(r), "both")).unionByName(count(t.subtract(r), "target_only")).unionByName(count(r.subtract(t), "realised_only"))


def axis_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Sample deviation of targets and behaviour per axis and their ratio, null without spread of the targets."""
    k = _cells(spark, sf)
    out = None
    for a in AXES:
        t, r = F.stddev_samp(f"target_{a}"), F.stddev_samp(a)
        own = k.agg(F.lit(a).alias("axis"), t.alias("target_std"), r.alias("realised_std"), F.when(t > 0, r / t).alias("ratio"))
        out = own if out is None else out.unionByName(own)
    return out.select("axis", *_m("target_std", "realised_std", "ratio"))


QUERIES = {
    f.__name__: f
    for f in (
        *(pairwise_distances, vector_distances, kl_uniform, coverage, dispersion, hull_volume, diversity_fitness, recorded_diversity),
        *(mean_diversity, radar_values, grid_cells, grid_occupancy, grid_archive, cumulative_cells, grid_projections, grid_sets, axis_spread),
    )
}

from cohortlab.plans.survey_queries import _beh  # noqa: E402

_dist = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_pts = f"{T.FILLED}, pt as (select coalesce(source, 'none') as pop, persona_id as id, cognitive_core as x, motivation_core as y, regulation_core as z from f)"
_vec = "pt as (select coalesce(label, -1) as pop, vec_id as id, cast(embedding as double[64]) as e from embeddings where embedding is not null)"
_pairs = lambda name: f"select n.pop as {name}, count(b.id) as n_pairs, round(coalesce(avg({_dist}), 0) + 1e-9, 6) as avg_dist, round(coalesce(min({_dist}), 0) + 1e-9, 6) as min_dist from (select distinct pop from pt) n join pt a on a.pop = n.pop left join pt b on a.pop = b.pop and a.id < b.id group by n.pop"
_bin = lambda v: f"least(greatest(cast(floor({v} * b) as bigint), 0), b - 1)"
_step = lambda v: f"least(greatest(cast(floor(coalesce({v}, 0.5) * 4) as bigint), 0), 3)"
_cellsql = f"""{_beh}, {T.SLOTS}, {T.TRAITS}, j as (select bm.persona_id, {", ".join(f"round(bm.{a}, 9) as {a}" for a in AXES)}, {", ".join(f"s.target_{a}" for a in AXES)}, t.source, t.run_id from bm join s on s.slot_id = bm.persona_id join t on t.persona_id = bm.persona_id),
    k as (select *, {", ".join(f"{_step(a)} as r_{a}, {_step(f'target_{a}')} as t_{a}" for a in AXES)}, 1 - ({" + ".join(f"abs(coalesce({a}, 0.5) - coalesce(target_{a}, 0.5))" for a in AXES)}) / 3 as quality from j),
    kc as (select *, concat_ws('-', {", ".join(f"t_{a}" for a in AXES)}) as target_cell, concat_ws('-', {", ".join(f"r_{a}" for a in AXES)}) as realised_cell from k)"""
_div = "e as (select run_id, arg_max({'m': diversity_metrics, 'v': validity_rate, 'd': near_duplicate_rate}, evaluated_at) as r from evaluations group by run_id)"
_g = lambda k, d: f"coalesce(r.m['{k}'], {d})"
_cl = lambda x: f"greatest(0.0, least(1.0, {x}))"
_refs = lambda salt: "r as (select * from (values " + ", ".join(f"({i}, {x!r}::double, {y!r}::double, {z!r}::double)" for i, (x, y, z) in enumerate(diversity.reference_points(3, salt).tolist())) + ") v (ref, x, y, z)), nr as (select b.pop, a.ref, min(" + _dist + ") as d from r a, pt b group by all)"
SQL = {
    "coverage": f"with {_pts}, {_refs(1)} select pop as source, round(avg(case when d <= 0.2 then 1.0 else 0.0 end) + 1e-9, 6) as coverage from nr group by pop",
    "dispersion": f"with {_pts}, {_refs(2)} select pop as source, round(max(d) + 1e-9, 6) as dispersion from nr group by pop",
    "cumulative_cells": f"""with {_cellsql}, dy as (select persona_id, strftime(min(created_at), '%Y-%m-%d') as day from personas group by persona_id),
        f as (select source, cell, min(day) as day from (select coalesce(source, 'none') as source, realised_cell as cell, day from kc join dy using (persona_id) where day is not null) group by all), n as (select source, day, count(*) as new_cells from f group by all)
        select source, day, new_cells, cast(sum(new_cells) over (partition by source order by day) as bigint) as cells_so_far from n""",
    "pairwise_distances": f"with {_pts} {_pairs('source')}",
    "vector_distances": f"with {_vec} {_pairs('label').replace(_dist, 'array_distance(a.e, b.e)')}",
    "kl_uniform": f"""with {_pts}, n as (select pop, count(*) as n, greatest(3, cast(floor(pow(count(*), 1.0 / 3)) as bigint)) as b from pt group by pop),
        h as (select pop, n, b, {_bin("x")} as i, {_bin("y")} as j, {_bin("z")} as k, count(*) as c from pt join n using (pop) group by all)
        select pop as source, n, cast(b * b * b as bigint) as bins, round(sum((c + 1e-10) / (n + b * b * b * 1e-10) * ln((c + 1e-10) / (n + b * b * b * 1e-10) * b * b * b)) + (b * b * b - count(*)) * (1e-10 / (n + b * b * b * 1e-10)) * ln(1e-10 / (n + b * b * b * 1e-10) * b * b * b) + 1e-9, 6) as kl from h group by pop, n, b""",
    "recorded_diversity": f"""with {_div} select run_id, round(0.45 * {_cl(_g("coverage", 0.0))} + 0.25 * {_cl(f"exp(-{_g('kl_divergence', 10.0)})")} + 0.2 * {_cl(_g("avg_dist", 0.0) + " / sqrt(3.0)")} + 0.1 * {_cl(_g("min_dist", 0.0) + " / 0.25")} + 1e-9, 6) as balanced,
        round({_cl("coalesce(r.v, 0.0)")} * (1 - {_cl("coalesce(r.d, 0.0)")}) * (0.65 * {_cl(_g("coverage", 0.0))} + 0.25 * {_cl(_g("avg_dist", 0.0) + " / sqrt(3.0)")} + 0.1 * {_cl(_g("min_dist", 0.0) + " / sqrt(3.0)")}) + 1e-9, 6) as combined from e""",
    "radar_values": f"""with {_div}, m as (select run_id, unnest(map_entries(r.m)) as x from e), v as (select run_id, x.key as metric, x.value as v from m where x.value is not null and isfinite(x.value))
        select run_id, metric, round(greatest(0.0, least(1.0, case metric when 'convex_hull' then v / 0.5 when 'min_dist' then v / 0.5 when 'dispersion' then 1 - abs(v) / 2.0 when 'kl_divergence' then 1 - abs(v) / 3.0 else v end)) + 1e-9, 6) as scaled from v""",
    "mean_diversity": f"with {_div}, m as (select unnest(map_entries(r.m)) as x from e) select x.key as metric, count(*) as n, round(avg(x.value) + 1e-9, 6) as mean from m where x.value is not null and isfinite(x.value) group by x.key",
    "grid_cells": f"with {_cellsql} select persona_id, target_cell, realised_cell, round(quality + 1e-9, 6) as quality from kc",
    "grid_occupancy": f"""with {_cellsql}, o as (select coalesce(source, 'none') as source, run_id, realised_cell from kc where run_id is not null), ft as (select source, run_id, count(distinct realised_cell) as k from o group by all)
        select source, n_cells, foot_min, foot_median, foot_max, round(n_cells / 64.0 + 1e-9, 6) as share from (select source, count(distinct realised_cell) as n_cells from o group by source) join
            (select source, min(k) as foot_min, list_sort(list(k))[cast(floor(count(*) / 2.0) as bigint) + 1] as foot_median, max(k) as foot_max from ft group by source) using (source)""",
    "grid_archive": f"with {_cellsql}, b as (select *, round(quality, 9) as q, row_number() over (partition by realised_cell order by round(quality, 9) desc, persona_id) as rn, count(*) over (partition by realised_cell) as n from kc) select realised_cell as cell, persona_id, round(q + 1e-9, 6) as quality, n from b where rn = 1",
    "grid_projections": f"with {_cellsql}, d as (select distinct {', '.join(f'r_{a} as {a}' for a in AXES)} from kc) select {', '.join(AXES)}, count(*) as n_cells from d group by grouping sets (({AXES[0]}, {AXES[1]}), ({AXES[0]}, {AXES[2]}), ({AXES[1]}, {AXES[2]}))",
    "grid_sets": f"""with {_cellsql}, t1 as (select distinct target_cell as cell from kc), r1 as (select distinct realised_cell as cell from kc)
        select 'union' as set, count(*) as n_cells from (select * from t1 union select * from r1) union all select 'both', count(*) from (select * from t1 intersect select * from r1)
        union all select 'target_only', count(*) from (select * from t1 except select * from r1) union all select 'realised_only', count(*) from (select * from r1 except select * from t1)""",
    "axis_spread": f"with {_cellsql} " + " union all ".join(f"select '{a}' as axis, round(stddev_samp(target_{a}) + 1e-9, 6) as target_std, round(stddev_samp({a}) + 1e-9, 6) as realised_std, round(stddev_samp({a}) / nullif(stddev_samp(target_{a}), 0) + 1e-9, 6) as ratio from kc" for a in AXES),
}
