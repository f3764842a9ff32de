"""Queries over raw texts and replies: trimming, counting, salvage and parsing of answers, text of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions import scalars, texts
from cohortlab.operators import rules, student
from cohortlab.plans import expected
from cohortlab.plans.persona_queries import _m, _t
from cohortlab.sources.artifacts import count_patterns

c = F.col
PATTERNS = {"coverage": "overage", "seeds": "seed", "persona": "ersona", "questions": "?", "colons": ": ", "survey": "urvey"}


def log_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of six literal patterns in the documents of each source."""
    return count_patterns(_t(spark, sf, "documents"), "text", PATTERNS, ["source"])


def shortened_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut to 80 characters with an ellipsis, white space squeezed before."""
    d = _t(spark, sf, "documents").where("text is not null")
    short = scalars.shorten(scalars.squeeze("text"), 80)
    return d.select("doc_id", F.md5(short).alias("digest"), F.length(short).cast("bigint").alias("n_chars"))


def trimmed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents trimmed to 400 characters at a sentence where that keeps enough."""
    d = _t(spark, sf, "documents").where("text is not null")
    t = scalars.smart_trim("text", 400)
    return d.select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("bigint").alias("n_chars"))


def document_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Context features of every document."""
    return student.appraise(_t(spark, sf, "documents"), "text").select("doc_id", *_m(*student.CONTEXT))


def document_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Scenarios without a keyword in each document."""
    return _t(spark, sf, "documents").select("doc_id", F.array_join(rules.missing_scenarios("text"), ",").alias("missing"))


def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tokens per document."""
    return _t(spark, sf, "documents").select("doc_id", F.size(scalars.tokens("text")).cast("bigint").alias("n_tokens"))


def _replies(spark, sf):
    """Replies, every third one broken off."""
    e = _t(spark, sf, "events")
    return e.select("event_id", F.when(c("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(c("props")).alias("reply"))


def salvaged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers 1..5 to item ``k`` from replies that may be broken; 3 where none can be read."""
    return _replies(spark, sf).select("event_id", texts.salvage(c("reply"), "k").cast("bigint").alias("answer"))


def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers by type: numbers are cut and held to 1..5, whole-number texts likewise, all else and broken replies 3."""
    v = F.try_parse_json("reply")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    kind = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "number").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").otherwise("none")
    return _replies(spark, sf).select("event_id", texts.answer(kind, F.try_variant_get(v, "$.k", "string")).cast("bigint").alias("answer"))


def reply_objects(spark: SparkSession, sf: str) -> DataFrame:
    """First complete object of each payload, if any, and the text that it holds."""
    r = _t(spark, sf, "experiment_runs").where("payload is not null")
    o = r.select("run_id", F.xxhash64("payload").alias("delivery"), texts.first_object("payload").alias("o"))
    return o.select("run_id", "delivery", F.length("o").cast("bigint").alias("n_chars"), F.length(texts.text_blob("o")).cast("bigint").alias("n_text"))


QUERIES = {f.__name__: f for f in (log_counts, shortened_texts, trimmed_texts, document_contexts, document_scenarios, token_statistics, salvaged_answers, parsed_answers, reply_objects)}


def _has(words) -> str:
    return "(" + (" or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) or "false") + ")"


_cue = expected.cues("text")
_sum = ", ".join(f"round({sql} + 1e-9, 6) as {name}" for name, sql in map(expected.formula, expected.lines(expected.CONTEXTS)))
_rep = "r as (select event_id, case when event_id % 3 = 0 then substring(props, 1, length(props) - 1) else props end as reply from events)"
SQL = {
    "log_counts": "select source, " + ", ".join(f"cast(sum((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{p}', ''))) / {len(p)}) as bigint) as {n}" for n, p in PATTERNS.items()) + " from documents group by source",
    "shortened_texts": r"with s as (select doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) as t from documents where text is not null), c as (select doc_id, case when length(t) > 80 then substring(t, 1, 80) || '…' else t end as t from s) select doc_id, md5(t) as digest, length(t) as n_chars from c",
    "document_contexts": f"with q as (select doc_id, {_cue} from documents) select doc_id, {_sum} from q",
    "document_scenarios": "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when not {_has(w)} then '{n}' end" for n, w in rules.SCENARIOS.items()) + "], lambda x: x is not null), ',') as missing from documents",
    "token_statistics": "select doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z][a-zA-Z_''\\-]{2,}'))) as n_tokens from documents",
    "salvaged_answers": f"""with {_rep} select event_id, coalesce(try_cast(nullif(regexp_extract(coalesce(reply, ''), '"k"\\s*[:=]?\\s*"?([1-5])', 1), '') as bigint), 3) as answer from r""",
    "parsed_answers": f"""with {_rep}, k as (select event_id, case when json_valid(reply) then json_extract(reply, '$.k') end as k from r),
        n as (select event_id, case when json_type(k) in ('UBIGINT', 'BIGINT', 'DOUBLE') then trunc(cast(k as double)) when json_type(k) = 'BOOLEAN' then cast(cast(k as boolean) as int) when json_type(k) = 'VARCHAR' then try_cast(json_extract_string(k, '$') as int) end as n from k)
        select event_id, cast(case when n is null then 3 when n < 1 then 1 when n > 5 then 5 else n end as bigint) as answer from n""",
}
