"""Rows made by responders: a registry of backends, retries, repair, fallback, and failures as rows.

A responder turns the text of a request into the text of a reply; a remote model would be one, the deterministic ones
here are others. Requests run in Arrow batches inside ``mapInArrow``: rows keep their request's number, a failure is a
row with its error, and nothing stops the batch. Retries wait longer each time, for errors that a second try may mend.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.operators.student import respond

Responder = Callable[[str], str]
RESULT = "request_no bigint, status string, reply string, error string, tries int, fallback boolean"
#: What an error says when a second try may succeed.
TRANSIENT = ("timeout", "timed out", "rate limit", "temporarily", "connection", "overloaded", "429", "502", "503", "504")

_backends: dict[str, Callable[..., Responder]] = {}


def register(name: str, make: Callable[..., Responder]) -> None:
    """Adds a backend; ``make`` gets the settings given to :func:`backend`."""
    _backends[name] = make


def backend(name: str, **settings) -> Responder:
    if name not in _backends:
        raise ValueError(f"no backend {name!r}; there are {', '.join(sorted(_backends))}")
    return _backends[name](**settings)


def backends() -> list[str]:
    return sorted(_backends)


def transient(error: str) -> bool:
    return any(t in error.lower() for t in TRANSIENT)


@dataclass(frozen=True)
class Retry:
    """``tries`` calls at most; the pause doubles from ``pause`` seconds."""

    tries: int = 3
    pause: float = 0.5

    def call(self, responder: Responder, request: str, wait: Callable[[float], None] = time.sleep) -> tuple[str, int]:
        for k in range(1, self.tries + 1):
            try:
                return responder(request), k
            except Exception as e:
                if k == self.tries or not transient(f"{type(e).__name__} {e}"):
                    raise
                wait(self.pause * 2 ** (k - 1))
        raise ValueError("tries must be positive")


def repaired(reply: str) -> dict:
    """The JSON object of a reply: as it is, out of a fence, or from the first brace to the last, without trailing commas."""
    inner = re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)
    text = (inner.group(1) if inner else reply).strip()
    a, b = text.find("{"), text.rfind("}")
    for t in (text, text[a : b + 1] if a >= 0 else "", re.sub(r",\s*([}\]])", r"\1", text[a : b + 1] if a >= 0 else "")):
        try:
            out = json.loads(t)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    raise ValueError("no JSON object in the reply")


def run(requests: DataFrame, responder: Responder, *, check: Callable[[dict], str | None] | None = None, fallback: Responder | None = None, retry: Retry = Retry(), repairs: int = 1) -> DataFrame:
    """:data:`RESULT` for rows of ``request_no, request``: one row per request, whatever happens to it.

    ``check`` gives what is wrong with a reply's object, or None; the request is then asked again with that, at most
    ``repairs`` times. What still fails goes to ``fallback``, which needs no model, or is a row of status ``failed``.
    Null requests fail with an error of their own; the order is that of ``request_no``.
    """

    def ask(request: str, use: Responder) -> tuple[str, int]:
        said, tries, text = None, 0, request
        for _ in range(repairs + 1):
            reply, n = retry.call(use, text)
            tries += n
            if check is None:
                return reply, tries
            try:
                made = repaired(reply)
                said = check(made)
            except ValueError as e:
                said = str(e)
            else:
                if said is None:
                    return json.dumps(made, sort_keys=True), tries
            text = f"{request}\n\nThe last reply was wrong: {said}"
        raise ValueError(said)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for no, request in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if request is None:
                        raise ValueError("no request")
                    reply, tries = ask(request, responder)
                    rows.append((no, "ok", reply, None, tries, False))
                except Exception as e:  # noqa: BLE001 - every failure is a row
                    error = f"{type(e).__name__}: {e}"[:500]
                    try:
                        if fallback is None or request is None:
                            raise e
                        reply, tries = ask(request, fallback)
                        rows.append((no, "ok", reply, error, tries, True))
                    except Exception:  # noqa: BLE001
                        rows.append((no, "failed", None, error, 0, False))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return requests.select(F.col("request_no").cast("bigint"), F.col("request").cast("string")).mapInArrow(batch, RESULT)


def staged(requests: DataFrame, stages: list[tuple[str, Responder]], check: Callable[[dict], str | None] | None = None, retry: Retry = Retry()) -> DataFrame:
    """``request_no, status, reply, error, stage``: stage after stage, each seeing the request and all before it.

    A row ends at the first stage that fails and names it; the reply of a whole row is the objects of all stages by name.
    """

    def whole(request: str) -> str:
        out: dict[str, dict] = {}
        for name, responder in stages:
            try:
                out[name] = repaired(retry.call(responder, json.dumps({"request": request, "stage": name, "before": out}, sort_keys=True))[0])
            except Exception as e:  # noqa: BLE001
                raise ValueError(f"[{name}] {type(e).__name__}: {e}") from e
            if check is not None and (said := check(out[name])) is not None:
                raise ValueError(f"[{name}] {said}")
        return json.dumps(out, sort_keys=True)

    done = run(requests, whole, retry=Retry(1))
    return done.select("request_no", "status", "reply", "error", F.regexp_extract("error", r"\[(\w+)\]", 1).alias("stage"))


def failure_metrics(names: list[str]) -> Column:
    """The metrics of a run that gave nothing: all zero."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.lit(0.0))])


def call_log(results: DataFrame) -> DataFrame:
    """``status, fallback, n, tries``: what a recorder of calls would have counted."""
    return results.groupBy("status", "fallback").agg(F.count("*").cast("bigint").alias("n"), F.sum("tries").cast("bigint").alias("tries"))


def student_answers(rows: DataFrame, target: str) -> DataFrame:
    """Adds ``answer`` (1..5) of the deterministic student to rows with its response style; a null target is the middle."""
    return rows.withColumn("answer", respond(rows, F.coalesce(F.col(target), F.lit(0.5))))


def _echo(**settings) -> Responder:
    return lambda request: json.dumps({"reply": request, **settings}, sort_keys=True)


def _neutral(items: int = 0) -> Responder:
    return lambda request: json.dumps({"answers": [3] * items})


register("echo", _echo)
register("neutral", _neutral)
