"""Text functions that need a scanner or an object model; vectorised over Arrow batches."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortlab.functions.scalars import clip


def balanced(text: str | None) -> str | None:
    """The first complete ``{...}`` of a reply, outside of strings; code fences around it don't matter."""
    if text is None:
        return None
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(text):
        if quoted:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """:func:`balanced` for a column."""
    return text.map(balanced, na_action="ignore")


def lineage(key: str) -> bool:
    """Whether a genome's key tells where it comes from, not what it is: the last steps and any engine's mutation entry."""
    return key.startswith("last_") or key.endswith("_mutation")


def canonical(text: str | None, whole: bool = True) -> str | None:
    """JSON with sorted keys and no spare blanks, perhaps without lineage keys; None for text that isn't JSON."""
    if text is None:
        return None
    try:
        x = json.loads(text)
    except ValueError:
        return None
    if isinstance(x, dict) and not whole:
        x = {k: v for k, v in x.items() if not lineage(k)}
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def genome_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical JSON; null if there is none."""
    return text.map(lambda t: None if (c := canonical(t)) is None else hashlib.sha256(c.encode()).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def phenotype_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical JSON without its lineage keys."""
    return text.map(lambda t: None if (c := canonical(t, False)) is None else hashlib.sha256(c.encode()).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def text_blob(text: pd.Series) -> pd.Series:
    """All text values of a JSON document, lower-cased, in order, joined by blanks."""

    def blob(t: str) -> str | None:
        try:
            todo, out = [json.loads(t)], []
        except ValueError:
            return None
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x, dict):
                todo += [*x.values()][::-1]
            elif isinstance(x, list):
                todo += x[::-1]
        return " ".join(out).lower()

    return text.map(blob, na_action="ignore")


def salvage(reply: Column, item: str) -> Column:
    """The answer 1..5 that follows an item's id in a broken reply; 3 if there is none."""
    found = F.regexp_extract(F.coalesce(reply, F.lit("")), rf'"{item}"\s*[:=]?\s*"?([1-5])', 1)
    return F.coalesce(found.try_cast("int"), F.lit(3))


def answer(kind: Column, value: Column) -> Column:
    """A parsed answer as 1..5: JSON numbers are cut, true counts as 1, text must be a whole number; all else is 3."""
    n = F.when(kind == "number", F.floor(F.abs(value.try_cast("double"))) * F.signum(value.try_cast("double"))).when(kind == "boolean", F.when(value == "true", 1.0).otherwise(0.0)).when(kind == "string", F.trim(value).try_cast("int").cast("double"))
    return F.coalesce(clip(n, 1.0, 5.0), F.lit(3.0)).cast("int")
