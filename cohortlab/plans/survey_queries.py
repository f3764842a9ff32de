"""Queries over surveys and simulations: scoring, behaviour, response quality, repeats, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.operators import personas, reports, sampling, scoring
from cohortlab.operators.personas import AXES
from cohortlab.plans import sqltext as T
from cohortlab.plans.persona_queries import _m, _t, _traits
from cohortlab.sources import artifacts

c = F.col


def _items(spark, sf):
    return scoring.items(_t(spark, sf, "survey_items"))


def _answers(spark, sf):
    return scoring.answers(_t(spark, sf, "simulations"))


def _scored(spark, sf):
    return scoring.item_scores(_answers(spark, sf), _items(spark, sf))


def _sims(spark, sf):
    s = _t(spark, sf, "simulations")
    return s.groupBy("sim_id").agg(F.max_by(F.struct("persona_id", "survey_id", "responses", "axis_scores", "backend", "run_id"), "ingested_at").alias("r")).select("sim_id", "r.*")


def _sim_axes(spark, sf):
    """Scores of all simulations on all axes, with the persona."""
    sims = _sims(spark, sf)
    return scoring.axis_scores(_scored(spark, sf), sims, AXES).join(sims.select("sim_id", "persona_id", "survey_id"), "sim_id")


def construct_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Mean item score per simulation and construct."""
    return scoring.construct_scores(_scored(spark, sf)).select("sim_id", "construct", *_m("score"), "n_items")


def survey_axis_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted axis scores of every simulation, 0.5 where no answer weighs on an axis."""
    return scoring.axis_scores(_scored(spark, sf), _sims(spark, sf), AXES).select("sim_id", "axis", *_m("score"))


def behaviour_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean behaviour of every persona per axis over its simulations; 0.5 for personas without any."""
    means = scoring.behaviour(_sim_axes(spark, sf), AXES)
    p = _traits(spark, sf).select("persona_id")
    return p.join(means, "persona_id", "left").select("persona_id", *[F.round(F.coalesce(c(a), F.lit(0.5)) + 1e-9, 6).alias(a) for a in AXES])


def element_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the recorded axis scores per persona with 0.5 for each missing element, before the mean."""
    s = _sims(spark, sf)
    return s.groupBy("persona_id").agg(*[F.round(F.avg(F.coalesce(personas.axis_value("axis_scores", a), F.lit(0.5))) + 1e-9, 6).alias(a) for a in AXES], F.count_distinct("survey_id").cast("bigint").alias("n_surveys"))


def behaviour_report(spark: SparkSession, sf: str) -> DataFrame:
    """Error between personas' own axes and their behaviour, per run: the flagship query."""
    p = personas.axes(personas.filled(_traits(spark, sf))).select("persona_id", "run_id", *AXES)
    r = scoring.behaviour_report(p, scoring.behaviour(_sim_axes(spark, sf), AXES), AXES, ["run_id"])
    return r.select("run_id", "n_personas", *_m(*[f"mae_{a}" for a in AXES], "mae", "alignment"))


def split_simulations(spark: SparkSession, sf: str) -> DataFrame:
    """Simulations of surveys that have items of a split, per split: a semi join."""
    i = _t(spark, sf, "survey_items").select("survey_id", F.lower(F.trim("split")).alias("split")).where(c("split").isin("train", "validation", "test")).distinct()
    sims = _sims(spark, sf)
    out = None
    for split in ("train", "validation", "test"):
        own = sims.join(i.where(c("split") == split), "survey_id", "left_semi").agg(F.lit(split).alias("split"), F.count("*").cast("bigint").alias("n_simulations"), F.count_distinct("persona_id").cast("bigint").alias("n_personas"))
        out = own if out is None else out.unionByName(own)
    return out


def remapped_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Item weights under other axis names; two axes that share a name add up."""
    roles = {"cognitive_core": "mind", "motivation_core": "will", "regulation_core": "will"}
    i = _items(spark, sf).withColumn("w", scoring.remapped_weights("axis_weights", roles))
    return i.select("item_id", F.round(F.element_at("w", F.lit("mind")), 6).alias("mind"), F.round(F.element_at("w", F.lit("will")), 6).alias("will"))


def response_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness, histogram, entropy, neutral and extreme rates of the answers, per backend."""
    expected = _sims(spark, sf).select("sim_id", "survey_id", F.coalesce("backend", F.lit("none")).alias("backend")).join(_items(spark, sf).select("survey_id", "item_id"), "survey_id").drop("survey_id")
    q = scoring.quality(_answers(spark, sf), expected, ["backend"])
    return q.select("backend", "expected", "present", "valid", *[f"n{k}" for k in range(1, 6)], *_m("completeness", "entropy", "neutral_rate", "extreme_rate"))


def repeat_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of repeated simulations of one persona and survey."""
    return scoring.stability(_answers(spark, sf)).select("persona_id", "survey_id", "sim_a", "sim_b", "n_items", *_m("stability"))


def axis_stability(spark: SparkSession, sf: str) -> DataFrame:
    """1 - mean axis difference of repeated simulations."""
    a = _sim_axes(spark, sf)
    x, y = (a.select("persona_id", "survey_id", "axis", c("sim_id").alias(f"sim_{k}"), c("score").alias(f"s_{k}")) for k in "ab")
    j = x.join(y, ["persona_id", "survey_id", "axis"]).where("sim_a < sim_b")
    return j.groupBy("persona_id", "survey_id", "sim_a", "sim_b").agg(F.round(1.0 - F.avg(F.abs(c("s_a") - c("s_b"))) + 1e-9, 6).alias("stability"))


def axis_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of own axes with behaviour, per axis."""
    p = personas.axes(personas.filled(_traits(spark, sf))).select("persona_id", *AXES)
    m = scoring.behaviour(_sim_axes(spark, sf), AXES).select("persona_id", *[c(a).alias(f"m_{a}") for a in AXES])
    j = p.join(m, "persona_id").select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c(a).alias("x"), c(f"m_{a}").alias("y")) for a in AXES])).alias("e")).select("e.*")
    return scoring.correlation(j, "x", "y", ["axis"]).select("axis", "n", *_m("r"))


def discrimination(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of behaviour over personas: mean population deviation of the axes, per backend."""
    sims = _sims(spark, sf).select("sim_id", F.coalesce("backend", F.lit("none")).alias("backend"))
    a = _sim_axes(spark, sf).join(sims, "sim_id")
    per = a.groupBy("backend", "persona_id", "axis").agg(F.avg("score").alias("m")).groupBy("backend", "axis").agg(F.stddev_pop("m").alias("sd"), F.count("*").cast("bigint").alias("n"))
    return per.groupBy("backend").agg(F.round(F.avg("sd") + 1e-9, 6).alias("mean_std"), F.max("n").alias("n_personas"))


def backend_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Mean answer and completeness of each backend against the first backend as reference."""
    q = response_quality(spark, sf)
    mean = (c("n1") + 2 * c("n2") + 3 * c("n3") + 4 * c("n4") + 5 * c("n5")) / c("valid")
    r = q.select("backend", F.round(mean, 6).alias("mean_answer"), "completeness")
    first = F.first(F.struct("backend", "mean_answer", "completeness")).over(Window.orderBy("backend"))  # a handful of rows
    return r.withColumn("ref", first).select("backend", c("ref.backend").alias("reference"), F.round(c("mean_answer") - c("ref.mean_answer"), 5).alias("answer_delta"), F.round(c("completeness") - c("ref.completeness"), 5).alias("completeness_delta"))


def survey_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Surveys from the item bank in circular windows, for three splits with seeds 17, 10017 and 20017."""
    bank = sampling.numbered(_items(spark, sf).select("item_id", "axis_weights"), ["item_id"], "no")
    out = None
    for split, offset in (("train", 0), ("validation", 10_000), ("test", 20_000)):
        own = sampling.surveys(bank, 12, 12, 17 + offset, split, list(AXES))
        out = own if out is None else out.unionByName(own)
    return out.select("split", c("survey_no").cast("bigint").alias("survey_no"), "pos", "item_id")


def survey_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """All tasks of a run: each persona with each survey that anybody of its run answers, in order."""
    p = _traits(spark, sf).where("run_id is not null").select("persona_id", "run_id")
    s = _sims(spark, sf).join(p, "persona_id", "left_semi").select("persona_id", "survey_id").join(p, "persona_id").select("run_id", "survey_id").distinct()
    w = Window.partitionBy("run_id", "persona_id").orderBy("survey_id")
    return p.join(s, "run_id").select("run_id", "persona_id", "survey_id", F.row_number().over(w).cast("bigint").alias("task_no"))


def all_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Every persona with every survey, in order."""
    return sampling.tasks(_traits(spark, sf), "persona_id", _items(spark, sf), "survey_id")


def split_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Items and digest per split, by which a frozen split is recognised."""
    i = _items(spark, sf).withColumn("split", F.coalesce(F.lower(F.trim("split")), F.lit("none")))
    each = F.sha2(F.concat_ws("|", "item_id", F.coalesce("survey_id", F.lit("")), c("item_pos").cast("string"), F.coalesce("text", F.lit("")), c("direction").cast("string")), 256)
    return artifacts.combined_digest(i.select("split", each.alias("d")), ["split"])


def validation_vs_test(spark: SparkSession, sf: str) -> DataFrame:
    """Mean axis scores on the surveys of the validation split beside those of the test split."""
    split = _items(spark, sf).where("survey_id is not null").groupBy("survey_id").agg(F.min(F.lower(F.trim("split"))).alias("split"))
    a = _sim_axes(spark, sf).join(_sims(spark, sf).select("sim_id", "survey_id"), "sim_id").join(split, "survey_id").groupBy("split", "axis").agg(F.avg("score").alias("score"))
    both = reports.paired(*(a.where(c("split") == s).select("axis", "score") for s in ("validation", "test")), "axis", "score")
    return both.select("axis", *[F.round(c(x) + 1e-9, 6).alias(n) for x, n in (("a", "validation"), ("b", "test"), ("delta", "delta"))])


def expected_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Expected, present and missing answers of every simulation: a left join from the items."""
    e = _sims(spark, sf).select("sim_id", "survey_id").join(_items(spark, sf).select("survey_id", "item_id"), "survey_id")
    return e.join(_answers(spark, sf).select("sim_id", "item_id", "response"), ["sim_id", "item_id"], "left").groupBy("sim_id").agg(F.count("*").cast("bigint").alias("expected"), F.count("response").cast("bigint").alias("present"), F.count_if(c("response").isNull()).cast("bigint").alias("missing"))


def shared_items(spark: SparkSession, sf: str) -> DataFrame:
    """Surveys by answered items in every simulation (intersection) and in any (union)."""
    a = _answers(spark, sf).select("survey_id", "sim_id", "item_id").distinct()
    n = a.groupBy("survey_id").agg(F.count_distinct("sim_id").alias("sims"))
    per = a.groupBy("survey_id", "item_id").agg(F.count("*").alias("k")).join(n, "survey_id")
    return per.groupBy("survey_id").agg(F.count_if(c("k") == c("sims")).cast("bigint").alias("in_all"), F.count("*").cast("bigint").alias("in_any"))


def uncovered_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Axes that no item of a survey weighs: a difference of sets."""
    have = _items(spark, sf).where("survey_id is not null").groupBy("survey_id").agg(F.flatten(F.collect_set(F.map_keys("axis_weights"))).alias("have"))
    return have.select("survey_id", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, AXES)), c("have"))), ",").alias("missing"))


def seed_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Repeat summary of alignment over the simulations of each run: n, mean, sample deviation, standard error."""
    a = _sim_axes(spark, sf).groupBy("sim_id").agg(F.avg(F.abs(c("score") - 0.5)).alias("v")).join(_sims(spark, sf).select("sim_id", "run_id"), "sim_id").where("run_id is not null")
    s = reports.summary(a, ["run_id"], "v")
    return s.select("run_id", "n", *_m("mean", "std", "sem"))


def frozen_split(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of each split over its items' canonical JSON."""
    i = _items(spark, sf).withColumn("split", F.coalesce(F.lower(F.trim("split")), F.lit("none")))
    return artifacts.split_hash(i, "split", ["item_id", "text", "direction", "construct"])


QUERIES = {
    f.__name__: f
    for f in (
        *(construct_scores, survey_axis_scores, behaviour_means, element_defaults, behaviour_report, split_simulations, remapped_weights),
        *(response_quality, repeat_stability, axis_stability, axis_correlation, discrimination, backend_deltas, survey_windows),
        *(survey_tasks, all_tasks, split_digests, validation_vs_test, expected_answers, shared_items, uncovered_axes, seed_repeats, frozen_split),
    )
}

_ax_sums = ", ".join(f"sum(score * axis_weights['{a}']) as s_{a}, sum(abs(axis_weights['{a}'])) as w_{a}" for a in AXES)
_ax_rows = " union all ".join(f"select sim_id, persona_id, survey_id, run_id, backend, '{a}' as axis, coalesce(case when w_{a} <> 0 then s_{a} / w_{a} end, 0.5) as score from wd" for a in AXES)
_simax = f"{T.SCORED}, ag as (select sim_id, {_ax_sums} from sc group by sim_id), wd as (select sim.*, ag.* exclude (sim_id) from sim left join ag using (sim_id)), sx as ({_ax_rows})"
_beh = f"{_simax}, bm as (select persona_id, {', '.join(f'''avg(score) filter (where axis = '{a}') as {a}''' for a in AXES)} from sx group by persona_id)"
_plain = T.SIMS
_qual = f"""{T.ITEMS}, {T.ANSWERS}, ex as (select sim_id, coalesce(backend, 'none') as backend, i.item_id from sim join i on i.survey_id = sim.survey_id),
    h as (select backend, count(*) as expected, count(response) as present, count(*) filter (where response between 1 and 5) as valid, {", ".join(f"count(*) filter (where response = {k}) as n{k}" for k in range(1, 6))} from ex left join ans using (sim_id, item_id) group by backend)"""
_ent = " + ".join(f"case when n{k} > 0 then -(n{k} / valid::double) * ln(n{k} / valid::double) else 0 end" for k in range(1, 6))
_win = """b as (select *, row_number() over (order by item_id) - 1 as no, (select count(*) from i) as size from i),
    pl as (select sp.split, sp.off, s.s, p.p from (values ('train', 0), ('validation', 10000), ('test', 20000)) sp(split, off), (select unnest(range(0, 12)) as s) s, (select unnest(range(0, 12)) as p) p),
    ch as (select pl.split, pl.s, pl.p, b.item_id, b.axis_weights from pl join b on b.no = (pl.s * 5 + 17 + pl.off + pl.p) % b.size),
    hv as (select split, s, flatten(list(map_keys(axis_weights))) as have from ch group by split, s),
    ms as (select split, s, list_sort(list_filter(['cognitive_core', 'motivation_core', 'regulation_core'], lambda a: not list_contains(have, a))) as l from hv),
    mx as (select split, s, unnest(range(1, len(l) + 1)) as r, l from ms), fi as (select axis, arg_min(item_id, no) as first from (select no, item_id, unnest(map_keys(axis_weights)) as axis from b) group by axis),
    sw as (select split, s, 12 - r as p, first from mx join fi on fi.axis = l[r])"""
SQL = {
    "all_tasks": "with p as (select persona_id, row_number() over (order by persona_id) - 1 as i from (select distinct persona_id from personas where persona_id is not null)), s as (select survey_id, row_number() over (order by survey_id) - 1 as j, count(*) over () as n from (select distinct survey_id from survey_items where survey_id is not null and item_id is not null)) select persona_id, survey_id, cast(i * n + j as bigint) as task_no from p, s",
    "construct_scores": f"with {T.SCORED} select sim_id, construct, round(avg(score) + 1e-9, 6) as score, count(*) as n_items from sc where construct is not null group by all",
    "survey_axis_scores": f"with {_simax} select sim_id, axis, round(score + 1e-9, 6) as score from sx",
    "behaviour_means": f"with {_beh}, {T.TRAITS} select t.persona_id, {', '.join(f'round(coalesce(bm.{a}, 0.5) + 1e-9, 6) as {a}' for a in AXES)} from t left join bm using (persona_id)",
    "element_defaults": f"with {_plain} select persona_id, {', '.join(f'round(avg(coalesce({T.axis('axis_scores', a)}, 0.5)) + 1e-9, 6) as {a}' for a in AXES)}, count(distinct survey_id) as n_surveys from sim group by persona_id",
    "behaviour_report": f"""with {_beh}, {T.FILLED}, e as (select f.run_id, {", ".join(f"abs(f.{a} - coalesce(bm.{a}, 0.5)) as e_{a}" for a in AXES)} from f left join bm using (persona_id)),
        g as (select run_id, count(*) as n_personas, {", ".join(f"avg(e_{a}) as mae_{a}" for a in AXES)} from e group by run_id), m as (select *, ({" + ".join(f"mae_{a}" for a in AXES)}) / 3 as mae from g)
        select run_id, n_personas, {", ".join(f"round(mae_{a} + 1e-9, 6) as mae_{a}" for a in AXES)}, round(mae + 1e-9, 6) as mae, round(greatest(0, least(1, 1 - mae)) + 1e-9, 6) as alignment from m""",
    "split_simulations": f"""with {_plain}, sp as (select distinct survey_id, lower(trim(split)) as split from survey_items where lower(trim(split)) in ('train', 'validation', 'test'))
        select v.split, count(sim_id) as n_simulations, count(distinct persona_id) as n_personas from (values ('train'), ('validation'), ('test')) v(split) left join (select split, sim.* from sim join sp using (survey_id)) x using (split) group by v.split""",
    "remapped_weights": f"with {T.ITEMS} select item_id, round(axis_weights['cognitive_core'], 6) as mind, round(case when axis_weights['motivation_core'] is null and axis_weights['regulation_core'] is null then null else coalesce(axis_weights['motivation_core'], 0) + coalesce(axis_weights['regulation_core'], 0) end, 6) as will from i",
    "response_quality": f"""with {_qual} select backend, expected, present, valid, n1, n2, n3, n4, n5, round(valid / expected::double + 1e-9, 6) as completeness, round(case when valid > 0 then ({_ent}) / ln(5.0) else 0 end + 1e-9, 6) as entropy,
        round(coalesce(n3 / nullif(valid, 0)::double, 0) + 1e-9, 6) as neutral_rate, round(coalesce((n1 / nullif(valid, 0)::double) + (n5 / nullif(valid, 0)::double), 0) + 1e-9, 6) as extreme_rate from h""",
    "repeat_stability": f"with {T.ANSWERS}, k as (select * from ans where response between 1 and 5) select a.persona_id, a.survey_id, a.sim_id as sim_a, b.sim_id as sim_b, count(*) as n_items, round(avg(1 - abs(a.response - b.response) / 4.0) + 1e-9, 6) as stability from k a join k b on a.persona_id = b.persona_id and a.survey_id = b.survey_id and a.item_id = b.item_id and a.sim_id < b.sim_id group by all",
    "axis_stability": f"with {_simax} select a.persona_id, a.survey_id, a.sim_id as sim_a, b.sim_id as sim_b, round(1 - avg(abs(a.score - b.score)) + 1e-9, 6) as stability from sx a join sx b on a.persona_id = b.persona_id and a.survey_id = b.survey_id and a.axis = b.axis and a.sim_id < b.sim_id group by all",
    "axis_correlation": f"with {_beh}, {T.FILLED}, e as ({' union all '.join(f'''select '{a}' as axis, f.{a} as x, bm.{a} as y from f join bm using (persona_id)''' for a in AXES)}) select axis, count(*) as n, round(coalesce(corr(x, y), 0) + 1e-9, 6) as r from e group by axis",
    "discrimination": f"with {_simax}, p as (select coalesce(backend, 'none') as backend, persona_id, axis, avg(score) as m from sx group by all), q as (select backend, axis, stddev_pop(m) as sd, count(*) as n from p group by all) select backend, round(avg(sd) + 1e-9, 6) as mean_std, max(n) as n_personas from q group by backend",
    "backend_deltas": f"""with {_qual}, r as (select backend, round((n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5) / valid::double, 6) as mean_answer, round(valid / expected::double + 1e-9, 6) as completeness from h), f as (select * from r order by backend limit 1)
        select r.backend, f.backend as reference, round(r.mean_answer - f.mean_answer, 5) as answer_delta, round(r.completeness - f.completeness, 5) as completeness_delta from r, f""",
    "survey_windows": f"with {T.ITEMS}, {_win} select ch.split, cast(ch.s + 1 as bigint) as survey_no, ch.p as pos, coalesce(sw.first, ch.item_id) as item_id from ch left join sw on sw.split = ch.split and sw.s = ch.s and sw.p = ch.p",
    "survey_tasks": f"with {_plain}, {T.TRAITS}, p as (select persona_id, run_id from t where run_id is not null), s as (select distinct p.run_id, sim.survey_id from sim join p using (persona_id)) select p.run_id, p.persona_id, s.survey_id, row_number() over (partition by p.run_id, p.persona_id order by s.survey_id) as task_no from p join s using (run_id)",
    "frozen_split": f"""with {T.ITEMS}, j as (select coalesce(lower(trim(split)), 'none') as split, '{{' || concat_ws(',', '"construct":' || to_json(construct), '"direction":' || direction, '"item_id":' || to_json(item_id), '"item_pos":' || item_pos, '"survey_id":' || to_json(survey_id), '"text":' || to_json(text)) || '}}' as t from i),
        d as (select split, sha256(t) as d from j) select split, count(*) as n_items, sha256(concat_ws(':', count(*), sum(cast('0x' || substring(d, 1, 15) as bigint)), sum(cast('0x' || substring(d, 16, 15) as bigint)))) as digest from d group by split""",
    "split_digests": f"with {T.ITEMS}, d as (select coalesce(lower(trim(split)), 'none') as split, survey_id, item_pos, item_id, sha256(concat_ws('|', item_id, coalesce(survey_id, ''), item_pos, coalesce(text, ''), direction)) as d from i) select split, count(*) as n_items, sha256(concat_ws(':', count(*), sum(cast('0x' || substring(d, 1, 15) as bigint)), sum(cast('0x' || substring(d, 16, 15) as bigint)))) as digest from d group by split",
    "validation_vs_test": f"""with {_simax}, sp as (select survey_id, min(lower(trim(split))) as split from i where survey_id is not null group by survey_id), m as (select split, axis, avg(score) as v from sx join sp using (survey_id) group by all)
        select a.axis, round(a.v + 1e-9, 6) as validation, round(b.v + 1e-9, 6) as test, round(b.v - a.v + 1e-9, 6) as delta from m a join m b on a.axis = b.axis and a.split = 'validation' and b.split = 'test'""",
    "expected_answers": f"with {T.ITEMS}, {T.ANSWERS}, e as (select sim_id, i.item_id from sim join i on i.survey_id = sim.survey_id) select sim_id, count(*) as expected, count(response) as present, count(*) - count(response) as missing from e left join ans using (sim_id, item_id) group by sim_id",
    "shared_items": f"with {T.ANSWERS}, n as (select survey_id, count(distinct sim_id) as sims from ans group by 1), k as (select survey_id, item_id, count(distinct sim_id) as k from ans group by 1, 2) select survey_id, count(*) filter (where k = sims) as in_all, count(*) as in_any from k join n using (survey_id) group by survey_id",
    "uncovered_axes": f"with {T.ITEMS}, h as (select survey_id, flatten(list(map_keys(axis_weights))) as h from i where survey_id is not null group by 1) select survey_id, array_to_string(list_filter(['cognitive_core', 'motivation_core', 'regulation_core'], lambda a: not list_contains(h, a)), ',') as missing from h",
    "seed_repeats": f"with {_simax}, v as (select sim_id, run_id, avg(abs(score - 0.5)) as v from sx where run_id is not null group by all) select run_id, count(*) as n, round(avg(v) + 1e-9, 6) as mean, round(coalesce(stddev_samp(v), 0) + 1e-9, 6) as std, round(coalesce(stddev_samp(v), 0) / sqrt(count(*)) + 1e-9, 6) as sem from v group by run_id",
}
