"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import dispersion, leakage, lookalike, neardup, overlap, packing, topn, truncation
from cohortlab.workspace import materialize


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """The ``n`` fittest evaluated candidates of every (island, generation), by each candidate's latest record."""
    c = topn.latest(_t(spark, sf, "candidates"), "candidate_id", ["island_id", "generation", "fitness", "evaluated"], ["recorded_at", "ingested_at"])
    items = c.where("evaluated and island_id is not null").select(F.col("island_id").cast("bigint").alias("island_id"), F.col("generation").cast("bigint").alias("generation"), "fitness", "candidate_id")
    return topn.top_n(items, ["island_id", "generation"], "fitness", "candidate_id", n).select("island_id", "generation", "candidate_id")


AXES = ["cognitive_core", "motivation_core", "regulation_core"]


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all slots and simulations; a repeated row counts once."""
    slots = _t(spark, sf, "slots").select(F.col("slot_id").alias("id"), F.lit("slots").alias("kind"), dispersion.axis_point(F.col("target_axes"), AXES).alias("point"))
    sims = _t(spark, sf, "simulations").select(F.col("sim_id").cast("string").alias("id"), F.lit("simulations").alias("kind"), dispersion.axis_point(F.col("axis_scores"), AXES).alias("point"))
    return slots.unionByName(sims)


def p4_varied(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """``k`` varied slots and ``k`` varied simulations."""
    chosen = dispersion.varied(_points(spark, sf), k, len(AXES))
    return chosen.select("kind", "id", F.col("cell").alias("region"), *[F.col("point")[i].alias(a) for i, a in enumerate(AXES)])


def p4_report(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """Rows against selected points per region."""
    points = _points(spark, sf)
    return dispersion.variety_report(points, dispersion.varied(points, k, len(AXES)), len(AXES), k // 2)


def p4_quality(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """Regions covered and distances of the varied points, beside those of as many points taken by hash."""
    points = materialize(_points(spark, sf), "points")
    return dispersion.quality(points, materialize(dispersion.varied(points, k, len(AXES)), "varied"), len(AXES), k // 2)


def _persona_texts(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"narrative": F.col("cognitive_motivation_profile.narrative"), "moral_tension": F.col("values_identity.moral_tension"), "family_context": F.col("demographics.family_context")}
    return truncation.values(_t(spark, sf, "personas"), "persona_id", "source", fields)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Persona texts that lost their tail."""
    return truncation.scored(_persona_texts(spark, sf)).where("cut").select(F.col("id").alias("persona_id"), "field").distinct()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source truncates each field."""
    return truncation.cut_report(truncation.scored(_persona_texts(spark, sf)))


def _near_rows(spark: SparkSession, sf: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("space"), F.col(c).alias("text")) for k, c in (("narrative", "cognitive_motivation_profile.narrative"), ("family_context", "demographics.family_context"))]))
    return _t(spark, sf, "personas").select(F.col("persona_id").alias("id"), each.alias("v")).select("id", "v.space", "v.text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of personas with nearly the same narrative or family context."""
    return neardup.near_pairs(_near_rows(spark, sf)).select(F.col("id_a").alias("persona_id_a"), F.col("id_b").alias("persona_id_b"), F.col("space").alias("field"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Group and number of links of every persona text that has a near copy."""
    return neardup.linked(_near_rows(spark, sf)).select(F.col("space").alias("field"), F.col("id").alias("persona_id"), "class_id", "links")


def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of near-duplicate pairs of narratives within each run, beside the rate that its evaluations report."""
    ids, similar = neardup.near_profiles(_near_rows(spark, sf).where("space = 'narrative'"))
    runs = _t(spark, sf, "personas").where("cognitive_motivation_profile.narrative is not null").select("persona_id", "run_id").distinct()
    held = ids.join(runs, F.col("id") == F.col("persona_id")).where("run_id is not null")
    copies = materialize(held.groupBy("run_id", "profile").agg(F.count("*").alias("n")), "copies")
    spread = copies.groupBy("profile").agg(F.count("*").alias("runs"))
    own = similar.where("p = q").join(copies, F.col("p") == F.col("profile")).select("run_id", F.expr("n * (n - 1) div 2").alias("pairs"))
    # Each pair goes to the runs of the profile that is in fewer of them.
    one = lambda x: spread.select(F.col("profile").alias(x), F.col("runs").alias(f"runs_{x}"))
    turned = similar.where("p <> q").join(one("p"), "p").join(one("q"), "q").select(F.expr("if(runs_p <= runs_q, p, q)").alias("x"), F.expr("if(runs_p <= runs_q, q, p)").alias("y"))
    at = lambda x: copies.select("run_id", F.col("profile").alias(x), F.col("n").alias(f"n_{x}"))
    across = turned.join(at("x"), "x").join(at("y"), ["run_id", "y"]).select("run_id", F.expr("n_x * n_y").alias("pairs"))
    pairs = own.unionByName(across).groupBy("run_id").agg(F.sum("pairs").alias("pairs"))
    sizes = runs.groupBy("run_id").agg(F.count("*").cast("bigint").alias("n_personas"))
    told = _t(spark, sf, "evaluations").groupBy("run_id").agg(F.max_by("near_duplicate_rate", "evaluated_at").alias("reported"))
    n = F.col("n_personas")
    return sizes.join(pairs, "run_id", "left").join(told, "run_id", "left").select("run_id", "n_personas", F.coalesce("pairs", F.lit(0)).cast("bigint").alias("n_pairs"), F.round(F.coalesce(F.try_divide(F.coalesce("pairs", F.lit(0)).cast("double"), n * (n - 1) / 2), F.lit(0.0)), 6).alias("rate"), F.round("reported", 6).alias("reported"))


def _overlap(spark: SparkSession, sf: str, cover: bool = True) -> DataFrame:
    return overlap.across(_t(spark, sf, "survey_items"), "item_id", "text", "split", cover=cover)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Survey items of train and of a held-out split that are alike or nearly alike."""
    return _overlap(spark, sf, False).select(F.least("id_train", "id_held").alias("item_id_a"), F.greatest("id_train", "id_held").alias("item_id_b"))


def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every overlap with the share of either item that the aligned chain covers."""
    return _overlap(spark, sf).select("id_train", "id_held", *[F.round(c, 6).alias(c) for c in ("similarity", "cover_train", "cover_held")])


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out items, and those that occur in train, per split and instrument."""
    return overlap.overlap_report(_t(spark, sf, "survey_items"), _overlap(spark, sf, False), "item_id", "split", "instrument", False)


def p7_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Mean coverage of the overlapping items per split and instrument."""
    return overlap.overlap_report(_t(spark, sf, "survey_items"), _overlap(spark, sf), "item_id", "split", "instrument").select("split", "source", "mean_cover")


def p8_containers(spark: SparkSession, sf: str, capacity: int = 2048, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """Container of every document (or part of one that is larger than a container)."""
    sizes = packing.token_counts(_t(spark, sf, "documents"), "doc_id", "text", vocabulary)
    return packing.pack(sizes, "item", "tokens", capacity).select(F.col("item").cast("bigint").alias("doc_id"), "part", "tokens", "container", "room")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens, the share of capacity in use and the least containers that these tokens need, by level of packing and over all."""
    one = p8_containers(spark, sf).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items")).withColumn("level", F.substring_index("container", "-", 1))
    by = one.rollup("level").agg(F.count("*").cast("bigint").alias("n_containers"), F.sum("items").cast("bigint").alias("n_items"), F.sum("tokens").cast("bigint").alias("n_tokens"))
    return by.select(F.coalesce("level", F.lit("all")).alias("level"), "n_containers", "n_items", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * 2048.0), 6).alias("fill"), F.ceil(F.col("n_tokens") / 2048.0).cast("bigint").alias("least_containers"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a held-out item."""
    return leakage.contains(_t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "heldout_items"), "item_id", "text").select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many documents of which source."""
    docs = _t(spark, sf, "documents")
    found = leakage.contains(docs, "doc_id", "text", _t(spark, sf, "heldout_items"), "item_id", "text")
    return leakage.leak_report(found, docs, "doc_id", "source", "item_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that look the same but differ in their characters."""
    return lookalike.alike(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id_a", "doc_id_b")


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's consistent form."""
    return lookalike.consistent(_t(spark, sf, "documents"), "doc_id", "text")


def p10_report(spark: SparkSession, sf: str) -> DataFrame:
    """Texts changed and distinct texts before and after, per source."""
    return lookalike.report(_t(spark, sf, "documents"), "doc_id", "text", "source")


QUERIES = {
    f.__name__: f
    for f in (
        *(p1_found, p4_varied, p4_report, p4_quality, p5_found, p5_report, p6_found, p6_groups, p6_rates, p7_found, p7_coverage),
        *(p7_report, p7_sources, p8_containers, p8_fill, p9_found, p9_items, p10_found, p10_forms, p10_report),
    )
}


#: Look-alikes that these tables hold, by code point, typed here on their own so that the operator's table is tested.
_TYPED = (
    "0430a 0441c 0501d 0435e 04BBh 0456i 0458j 043Eo 0440p 0455s 0445x 0443y 0410A 0412B 0421C 0415E 041DH 0406I 0408J 041AK 041CM 041EO 0420P 0405S 0422T 0425X 0423Y "
    "03BFo 03BDv 03C1p 03B1a 03B9i 0391A 0392B 0395E 0396Z 0397H 0399I 039AK 039CM 039DN 039FO 03A1P 03A4T 03A5Y 03A7X 0261g 0251a"
)


def _form_sql(text: str) -> str:
    """The consistent form in SQL, as far as single characters and composition go: enough for these tables."""
    wide = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
    spaces = dict.fromkeys([*map(chr, range(0x2000, 0x200B)), "\u00a0", "\u202f", "\u205f", "\u3000"], " ")
    table = wide | spaces | {chr(int(x[:4], 16)): x[4] for x in _TYPED.split()} | {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è"}
    unseen = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
    quote = lambda x: x.replace("'", "''")
    out = f"translate(regexp_replace({text}, '{unseen}', '', 'g'), '{quote(''.join(table))}', '{quote(''.join(table.values()))}')"
    for k, v in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{k}', '{v}')"
    return f"nfc_normalize({out})"


_GRAMS = "list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))"
_PASSAGES = f"""
        with d as (select doc_id, regexp_extract_all(lower({_form_sql("text")}), '[\\p{{L}}\\p{{N}}]+') as w from documents where length(text) > 0),
        i as (select item_id, regexp_extract_all(lower({_form_sql("text")}), '[\\p{{L}}\\p{{N}}]+') as w from heldout_items where length(text) > 0),
        dg as (select doc_id, unnest({_GRAMS}) as g from d where len(w) >= 13), ig as (select item_id, unnest({_GRAMS}) as g from i where len(w) >= 13),
        hits as (select doc_id, item_id, count(distinct g) as windows from dg join ig using (g) group by all)"""
_SETS = """
        with v as (select distinct persona_id, 'narrative' as field, cognitive_motivation_profile.narrative as t from personas
            union select distinct persona_id, 'family_context', demographics.family_context from personas),
        w as (select persona_id, field, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') as l from v where t is not null),
        s as (select persona_id, field, list_distinct(l) as u, len(list_distinct(l)) as n from w where len(l) >= 12),
        x as (select persona_id, field, n, unnest(u) as word from s),
        o as (select a.persona_id as pa, b.persona_id as pb, a.field, a.n as na, b.n as nb, count(*) as c
            from x a join x b on a.word = b.word and a.field = b.field and a.persona_id < b.persona_id group by all),
        near as (select pa, pb, field from o where c::double / (na + nb - c) >= 0.8 group by all)"""
_SPLITS = """
        with v as (select distinct item_id, lower(trim(split)) as side, text from survey_items where text is not null),
        s as (select item_id, side, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as u from v),
        x as (select item_id, side, len(u) as n, unnest(u) as word from s),
        o as (select a.item_id as ia, b.item_id as ib, a.n as na, b.n as nb, count(*) as c
            from x a join x b on a.word = b.word and a.side = 'train' and b.side in ('validation', 'test') group by all),
        near as (select ia, ib from o where c::double / (na + nb - c) >= 0.75 group by all)"""
SQL = {
    "p9_found": f"{_PASSAGES} select doc_id, item_id from hits",
    "p9_items": f"{_PASSAGES} select item_id, source, count(distinct doc_id) as n_docs, max(windows) as most_windows from hits join documents using (doc_id) group by item_id, source",
    "p6_groups": f"""{_SETS.replace("with v as", "with recursive v as", 1)},
        edges as (select field, pa as a, pb as b from near union select field, pb, pa from near),
        reach as (select field, a, a as b from edges union select r.field, r.a, e.b from reach r join edges e on e.field = r.field and e.a = r.b)
        select field, a as persona_id, min(b) as class_id, (select count(*) from edges e where e.field = reach.field and e.a = reach.a) as links from reach group by field, a""",
    "p6_rates": f"""{_SETS},
        runs as (select distinct persona_id, run_id from personas where cognitive_motivation_profile.narrative is not null),
        sizes as (select run_id, count(*) as n from runs group by run_id),
        k as (select a.run_id, count(*) as pairs from near join runs a on a.persona_id = pa join runs b on b.persona_id = pb and b.run_id = a.run_id where field = 'narrative' group by a.run_id),
        told as (select run_id, arg_max_null(near_duplicate_rate, evaluated_at) as reported from evaluations group by run_id)
        select sizes.run_id, n as n_personas, coalesce(pairs, 0) as n_pairs, round(case when n > 1 then coalesce(pairs, 0) / (n * (n - 1) / 2) else 0 end, 6) as rate, round(reported, 6) as reported
        from sizes left join k using (run_id) left join told using (run_id)""",
    "p7_report": f"""{_SPLITS},
        items as (select item_id, min({{'split': lower(trim(split)), 'source': instrument}}) as r from survey_items where lower(trim(split)) in ('validation', 'test') and item_id is not null group by item_id)
        select r.split, r.source, count(*) as n_items, count(h.ib) as n_overlapping, round(count(h.ib) / count(*), 6) as share from items left join (select distinct ib from near) h on h.ib = item_id group by r.split, r.source""",
    "p10_forms": f"with f as (select doc_id, text, {_form_sql('text')} as form from documents) select doc_id, form, text <> form as changed from f",
    "p10_report": f"with f as (select source, text, {_form_sql('text')} as form from documents where text is not null) select source, count(*) as n_texts, count(*) filter (where text <> form) as n_changed, count(distinct text) as n_distinct_before, count(distinct form) as n_distinct_after from f group by source",
    "p10_found": f"""
        with f as (select distinct doc_id, text, {_form_sql("text")} as form from documents where length(text) > 0)
        select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text""",
    "p6_found": f"{_SETS} select pa as persona_id_a, pb as persona_id_b, field from near",
    "p7_found": f"{_SPLITS} select least(ia, ib) as item_id_a, greatest(ia, ib) as item_id_b from near group by all",
    "p1_found": """
        with last as (select candidate_id, arg_max({'i': island_id, 'g': generation, 'f': fitness, 'e': evaluated}, (recorded_at, ingested_at)) as r from candidates group by candidate_id),
        ok as (select candidate_id, cast(r.i as bigint) as island_id, cast(r.g as bigint) as generation, r.f as fitness from last where r.e and r.i is not null and r.f is not null and not isnan(r.f)),
        ranked as (select *, row_number() over (partition by island_id, generation order by fitness desc, candidate_id) as k from ok)
        select island_id, generation, candidate_id from ranked where k <= 5""",
}
