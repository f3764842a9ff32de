"""JSON artifacts of runs: candidate files, evaluations, splits, stores, logs, configuration; and report exporters."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
CANDIDATE = "candidate_id string, parent_id string, island_id int, generation int, fitness double, evaluated boolean, metrics map<string,double>, genome string, last_evolution_operator string, last_mutation struct<mode:string,scale:double>"
EVALUATION = "candidate struct<candidate_id:string,parent_id:string,generation:int>, fitness double, metrics map<string,double>, per_seed array<struct<seed:int,score:double,personas:array<string>>>, status string"


def candidates(spark: SparkSession, path: str, engine: str = "engine_mutation") -> DataFrame:
    """Candidate files of a folder with defaults for missing parts; unreadable files and those without fitness drop out.

    ``engine`` names the field in which the search engine keeps the mutation that made a candidate.
    """
    raw = spark.read.schema(f"{CANDIDATE}, {engine} string, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = raw.where("_corrupt_record is null and fitness is not null").drop("_corrupt_record")
    return rows.withColumns({"generation": F.coalesce("generation", F.lit(0)), "evaluated": F.coalesce("evaluated", F.lit(True)), "metrics": F.coalesce("metrics", F.create_map().cast("map<string,double>")), "operator_id": operator_id(engine, "last_evolution_operator"), "mode": F.coalesce("last_mutation.mode", F.lit(""))})


def operator_id(mutation: str, operator: str) -> Column:
    """The operator of a candidate: the engine's entry, else the last operator's id, else its text, else empty."""
    return F.coalesce(F.get_json_object(mutation, "$.operator_id"), F.get_json_object(operator, "$.id"), F.when(~F.coalesce(c(operator), F.lit("")).startswith("{"), c(operator)), F.lit(""))


def evaluations(spark: SparkSession, path: str, aliases: bool = False) -> DataFrame:
    """Evaluation files below a folder; folders named ``alias_*`` are copies and are left out unless asked for."""
    rows = spark.read.schema(EVALUATION).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("file", F.input_file_name()).withColumn("is_alias", c("file").rlike(r"/alias_[^/]*/"))
    return rows if aliases else rows.where(~c("is_alias"))


def latest_payload(rows: DataFrame, key: str, payload: str, rank: str, alias: str | None = None) -> DataFrame:
    """The last payload per key; aliases come after all others."""
    order = F.struct(F.coalesce(c(alias), F.lit(False)), c(rank)) if alias else F.struct(c(rank))
    return rows.where(c(key).isNotNull()).groupBy(key).agg(F.max_by(payload, order).alias(payload))


def write_store(df: DataFrame, path: str, by: list[str]) -> None:
    """Appends to a partitioned store; Spark's committer makes each write whole or absent."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_split(items: DataFrame, path: str) -> None:
    """A survey split as JSON lines in item order."""
    items.orderBy("survey_id", "item_pos").write.mode("overwrite").json(path)


def combined_digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by..., n_items, digest`` from hex digests ``d``: a digest of a multiset by count and sums, so it merges anywhere.

    What matters in an item, its place included, must be part of its own digest.
    """
    part = lambda at: F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count("*").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1).cast("string"), part(16).cast("string")), 256).alias("digest"))


def split_hash(items: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """``split, n_items, digest`` over the items' canonical JSON (fields in name order, with survey and position)."""
    each = F.sha2(F.to_json(F.struct(*[c(x) for x in sorted({*fields, "survey_id", "item_pos", "item_id"})])), 256)
    return combined_digest(items.select(c(split).alias("split"), each.alias("d")), ["split"])


def count_patterns(lines: DataFrame, text: str, patterns: dict[str, str], by: list[str]) -> DataFrame:
    """Occurrences of literal patterns per group."""
    quote = lambda p: F.lit(re.escape(p))
    return lines.groupBy(*by).agg(*[F.sum(F.regexp_count(F.coalesce(c(text), F.lit("")), quote(p))).cast("bigint").alias(n) for n, p in patterns.items()])


class Settings:
    """Nested settings with dotted access."""

    def __init__(self, tree: dict):
        self.tree = tree

    @classmethod
    def load(cls, path: str) -> Settings:
        """From JSON, or from YAML where a reader is installed."""
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            return cls(json.loads(text))
        import yaml

        return cls(yaml.safe_load(text) or {})

    def get(self, key: str, default=None):
        at = self.tree
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at


def unify(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several result kinds under one schema, with their kind."""
    out = None
    for kind, df in frames.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def to_markdown(df: DataFrame, limit: int = 100) -> str:
    """A small report as a Markdown table."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def to_html(reports: dict[str, DataFrame], title: str, limit: int = 500) -> str:
    """Small reports as one HTML page with the data embedded as JSON; closing tags inside the data are escaped."""
    data = {k: [r.asDict(True) for r in df.limit(limit).collect()] for k, df in reports.items()}
    body = "".join(f"<h2>{html.escape(k)}</h2><pre>{html.escape(to_markdown(df, limit))}</pre>" for k, df in reports.items())
    blob = json.dumps(data, default=str).replace("</", "<\\/")
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}<script type='application/json' id='data'>{blob}</script>"
