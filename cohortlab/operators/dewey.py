"""Nested JSON into flat tables by Dewey labels.

Every value of a document gets the label of its place (``1.4.2``: third child of the fifth child of the second child of
the root) and a schema path in which list places and declared map keys are replaced by ``[]`` and ``{}``. A parent's
label is the label cut by one step, and a table is the set of nodes of one schema path. Labels are given inside one
document, so a document is labelled in one pass and tables of any depth join by (document, label prefix).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "doc string, label string, parent string, depth int, path string, key string, kind string, value string"


def _constant(_: str):
    raise ValueError("not JSON")


def _load(text: str):
    """The parsed text; NaN and Infinity aren't JSON."""
    return json.loads(text, parse_constant=_constant)


def _nodes(text: str, maps: frozenset[str]) -> Iterator[tuple]:
    """Depth-first: label, parent, depth, path, key, kind, value. Text that itself is a JSON list or object is opened."""
    try:
        root = _load(text)
    except (ValueError, RecursionError):
        return
    todo = [("0", None, 0, "$", None, root)]
    while todo:
        label, parent, depth, path, key, x = todo.pop()
        if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
            try:
                inner = _load(x)
            except (ValueError, RecursionError):
                inner = None
            if isinstance(inner, list | dict):
                x = inner
        if isinstance(x, dict):
            yield label, parent, depth, path, key, "object", None
            keyed = path in maps
            todo += [(f"{label}.{i}", label, depth + 1, path + "{}" if keyed else f"{path}.{k}", k, v) for i, (k, v) in enumerate(x.items())][::-1]
        elif isinstance(x, list):
            yield label, parent, depth, path, key, "list", None
            todo += [(f"{label}.{i}", label, depth + 1, path + "[]", str(i), v) for i, v in enumerate(x)][::-1]
        elif x is None:
            yield label, parent, depth, path, key, "null", None
        elif isinstance(x, bool):
            yield label, parent, depth, path, key, "boolean", "true" if x else "false"
        elif isinstance(x, str):
            yield label, parent, depth, path, key, "string", x
        else:
            yield label, parent, depth, path, key, "number", repr(x)


def _labeller(maps: frozenset[str], wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]

        def flush():
            kinds = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 4
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [f.split()[0] for f in NODES.split(", ")])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                for node in _nodes(text, maps):
                    if not wanted or node[3].startswith(wanted):
                        for c, x in zip(out, (doc, *node), strict=True):
                            c.append(x)
                if len(out[0]) >= 20_000:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def label(df: DataFrame, doc: str, text: str, maps: tuple[str, ...] = (), wanted: tuple[str, ...] = ()) -> DataFrame:
    """One row per node of each document's JSON ``text``; see :data:`NODES`.

    ``maps`` are schema paths of objects whose keys are data. ``wanted`` keeps only paths that start so. Null, blank and
    broken texts give no rows; repeated documents repeat theirs; extra columns are ignored. Numbers keep their digits.
    """
    return df.select(F.col(doc).cast("string").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(_labeller(frozenset(maps), tuple(wanted)), NODES)


def ancestor(label: Column, steps: int) -> Column:
    """The label of the node so many steps above."""
    return F.array_join(F.slice(F.split(label, r"\."), 1, F.greatest(F.size(F.split(label, r"\.")) - steps, F.lit(0))), ".")


def at_depth(label: Column, depth: int) -> Column:
    """The label of the ancestor at a depth; the root has depth 0."""
    return F.substring_index(label, ".", depth + 1)


def place(label: Column) -> Column:
    """A node's place among its siblings."""
    return F.substring_index(label, ".", -1).cast("bigint")


#: Parts the steps of a field's name.
SEP = "\x1f"
FIELD = pa.struct([("at", pa.string()), ("key", pa.string()), ("value", pa.string())])
ROWS = "doc string, label string, path string, key string, fields array<struct<at string, key string, value string>>"


def _opened(x):
    """The value, or what a text holds that itself is a JSON list or object."""
    if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
        try:
            inner = _load(x)
        except (ValueError, RecursionError):
            return x
        return inner if isinstance(inner, list | dict) else x
    return x


def _coded(x) -> str:
    """A scalar with its kind in front: n number, s text, b boolean, z null; containers are o or l alone."""
    if x is None:
        return "z"
    if isinstance(x, str):
        return "s" + x
    if isinstance(x, bool):
        return "btrue" if x else "bfalse"
    return "l" if isinstance(x, list) else "o" if isinstance(x, dict) else "n" + repr(x)


def _rows(text: str, maps: frozenset[str], wrap: str | None, wanted: dict[str, bool]) -> Iterator[tuple]:
    """Label, path, key and fields (relative label, name, coded value) of each row of each flat table."""
    try:
        root = _load(text)
    except (ValueError, RecursionError):
        return
    todo = [("0", "$", None, root)]
    while todo:
        label, path, key, x = todo.pop()
        x = _opened(x)
        if isinstance(x, list):
            todo += [(f"{label}.{i}", path + "[]", str(i), v) for i, v in enumerate(x)][::-1] if _leads(path + "[]", wanted) else []
            continue
        out: list[tuple[str, str, str]] = []
        if isinstance(x, dict):
            open_: list[tuple[str, str, str, dict]] = [("", "", path, x)]
            while open_:
                at, name, where, d = open_.pop()
                keyed = where in maps
                for i, (k, v) in enumerate(d.items()):
                    v = _opened(v)
                    below, own = f"{at}{i}", where + "{}" if keyed else f"{where}.{k}"
                    if wrap is not None and isinstance(v, dict) and wrap in v and not isinstance(v[wrap], list | dict):
                        v = v[wrap]
                    if (own in maps or own in wanted) and isinstance(v, dict) or isinstance(v, list):
                        if _leads(own, wanted):
                            todo.append((f"{label}.{below}", own, k, v))
                    elif isinstance(v, dict):
                        open_.append((below + ".", name + k + SEP, own, v))
                    out.append((below, name + k, _coded(v)))
        else:
            out.append(("", "", _coded(x)))
        if wanted.get(path):
            yield label, path, key, out


def _leads(path: str, wanted: dict[str, bool]) -> bool:
    """Whether a wanted table lies at or below a path. (Schema paths are few, but for keys that aren't declared as maps.)"""
    return any(w.startswith(path) for w in wanted)


def _tabler(maps: frozenset[str], wrap: str | None, tables: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[list] = [[], [], [], []]
        fields: list[list] = [[], [], []]
        ends = [0]

        def flush() -> pa.RecordBatch:
            struct = pa.StructArray.from_arrays([pa.array(f, pa.string()) for f in fields], fields=list(FIELD))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            batch = pa.record_batch([*(pa.array(h, pa.string()) for h in heads), lists], ["doc", "label", "path", "key", "fields"])
            for x in (*heads, *fields):
                x.clear()
            ends[:] = [0]
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                for label, path, key, own in _rows(text, maps, wrap, dict.fromkeys(tables, True)):
                    for h, x in zip(heads, (doc, label, path, key), strict=True):
                        h.append(x)
                    for at, name, value in own:
                        fields[0].append(at), fields[1].append(name), fields[2].append(value)
                    ends.append(len(fields[0]))
                    if len(fields[0]) >= 50_000:
                        yield flush()
        if heads[0]:
            yield flush()

    return run


def tables(df: DataFrame, doc: str, text: str, paths: tuple[str, ...], maps: tuple[str, ...] = (), wrap: str | None = None) -> DataFrame:
    """Rows of the flat tables at some schema paths, from one pass over each document; see :data:`ROWS`.

    A table is the root, the elements of a list, a declared map (its entries are the fields) or an object at one of ``paths``. A row has the scalars of
    its object and of the plain objects nested in it, named by their steps joined by :data:`SEP`; nested lists and maps
    are tables of their own, whose rows' parent is their label without its last steps. ``at`` is a field's label relative
    to the row's. An object with a scalar at ``wrap`` stands for that scalar. Null, blank and broken texts give no rows.
    """
    return df.select(F.col(doc).cast("string").alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(_tabler(frozenset(maps), wrap, tuple(paths)), ROWS)


def field(*steps: str) -> Column:
    """The coded value of a field of a row, or null."""
    return F.get(F.filter("fields", lambda f: f["key"] == SEP.join(steps)), F.lit(0))["value"]


def plain(coded: Column) -> Column:
    """A coded scalar as text; null for null and for containers."""
    return F.when(F.substring(coded, 1, 1).isin("n", "s", "b"), F.substring(coded, 2, 1 << 30))


def number(coded: Column) -> Column:
    """The number that a coded scalar is, typed as number or text; null for all else, also for NaN and infinities."""
    text = F.trim(F.substring(coded, 2, 1 << 30))
    return F.when(F.substring(coded, 1, 1).isin("n", "s") & text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


# A run's simulations: a list holds several, an object stands for one.
SIMS = "$.shadow_simulations"
#: Names that writers give to the parts of an answer or a score; fixed values.
ITEM, ANSWER, AXIS, SCORE, WRAP, AXES = ("item", "item_id"), ("answer", "response"), ("axis",), ("score",), "value", ("axes", "scores")
PARTS = {"response": ("responses", ITEM, ANSWER), "axis": ("axis_scores", AXIS, SCORE)}
MAPS = tuple(f"{SIMS}{x}.{part}" for x in ("[]", "") for part, _, _ in PARTS.values())


def run_rows(runs: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Rows of the wanted tables of raw runs: :data:`ROWS` (``doc`` is one delivery of a run) and ``run_id``; ``sim``, the

    label of the row's simulation; ``sim_no``, its place in the list, else 0; ``tail``, the path inside the simulation.
    ``parts`` are tables inside a simulation, "" being the simulation itself.
    """
    key = F.concat(F.lpad(F.hex(F.xxhash64("payload")), 16, "0"), F.col("run_id").cast("string"))
    rows = tables(runs.select(key.alias("doc"), F.col("payload").alias("text")), "doc", "text", tuple(f"{SIMS}{x}{p}" for x in ("[]", "") for p in parts), MAPS, WRAP)
    listed = F.col("path").startswith(SIMS + "[]")
    return (
        rows.withColumn("run_id", F.expr("substring(doc, 17)"))
        .withColumn("sim", F.when(listed, at_depth(F.col("label"), 2)).otherwise(at_depth(F.col("label"), 1)))
        .withColumn("sim_no", F.when(listed, place(F.col("sim"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("tail", F.when(listed, F.expr(f"substring(path, {len(SIMS) + 3})")).otherwise(F.expr(f"substring(path, {len(SIMS) + 1})")))
    )


def entries(runs: DataFrame) -> DataFrame:
    """``run_id, sim_no, sim, entry, kind, name, number``: answers and axis scores of all runs, from one pass, unshuffled.

    Map keys and item fields give the name; ``number`` is null where none can be read. An object under ``axes`` holds the
    scores; its siblings are then no scores.
    """
    names = [p for part, _, _ in PARTS.values() for p in (f".{part}", f".{part}[]")]
    rows = run_rows(runs, tuple(names))
    top = F.filter("fields", lambda f: F.instr(f["key"], SEP) == 0)
    boxes = F.transform(F.filter("fields", lambda f: f["key"].isin(*AXES) & (f["value"] == "o")), lambda f: f["key"])
    inner = F.filter("fields", lambda f: F.array_contains(boxes, F.substring_index(f["key"], SEP, 1)) & (F.size(F.split(f["key"], SEP)) == 2))
    one = lambda f: F.struct(F.concat_ws(".", "label", f["at"]).alias("entry"), F.substring_index(f["key"], SEP, -1).alias("name"), number(f["value"]).alias("number"))

    def listed(names: tuple[str, ...], values: tuple[str, ...]) -> Column:
        return F.array(F.struct(F.col("label").alias("entry"), F.coalesce(*[plain(field(x)) for x in names]).alias("name"), number(F.coalesce(*[field(x) for x in values])).alias("number")))

    kind = F.when(F.col("tail").startswith(".responses"), "response").otherwise("axis")
    of = F.when(F.col("tail") == ".responses", F.transform(top, one)).when(F.col("tail") == ".axis_scores", F.transform(F.when(F.size(boxes) > 0, inner).otherwise(top), one))
    for _, (part, n, v) in PARTS.items():
        of = of.when(F.col("tail") == f".{part}[]", listed(n, v))
    return rows.select("run_id", "sim_no", "sim", kind.alias("kind"), F.explode(of).alias("e")).select("run_id", "sim_no", "sim", "e.entry", "kind", "e.name", "e.number").where("name is not null")


def simulations(runs: DataFrame) -> DataFrame:
    """One row per simulation: ``run_id, sim_no, sim, persona_id, survey_id, backend, fatigue``."""
    own = run_rows(runs, ("",)).where(F.exists("fields", lambda f: f["key"] != "") | (F.size("fields") == 0))
    return own.select("run_id", "sim_no", "sim", plain(field("persona_id")).alias("persona_id"), plain(field("survey_id")).alias("survey_id"), plain(field("metadata", "simulator_backend")).alias("backend"), number(field("metadata", "student_state", "fatigue")).alias("fatigue"))


def run_values(runs: DataFrame) -> DataFrame:
    """``run_id, sim_no, kind, name, value``: whole answers 1..5 and axis scores in thousandths, once each."""
    n = F.col("number")
    whole = (F.col("kind") == "axis") | n.between(1, 5) & (n == F.floor(n))
    return entries(runs).where(n.isNotNull() & whole).select("run_id", "sim_no", "kind", "name", F.when(F.col("kind") == "axis", F.round(n * 1000)).otherwise(n).cast("bigint").alias("value")).distinct()
