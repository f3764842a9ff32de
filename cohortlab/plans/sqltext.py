"""Building blocks of the SQL twins: common table expressions over the test tables."""

from __future__ import annotations

from cohortlab.operators.personas import AXES, NUMBERS, WORDS


def r6(x: str) -> str:
    return f"round({x}, 6)"


_fields = ", ".join(f"'{n}': {p}" for n, p in (NUMBERS | WORDS).items())
_filled = ", ".join(f"coalesce(case when isnan(r.{n}) then null else r.{n} end, 0.5) as {n}" for n in NUMBERS)
_raw = ", ".join(f"r.{n} as {n}" for n in (*NUMBERS, *WORDS))
_words = ", ".join(f"r.{n} as {n}" for n in WORDS)
_last = f"""pl as (select persona_id, arg_max({{{_fields}, 'age': demographics.age, 'protective': mental_health_context.protective_factors, 'risks': mental_health_context.risk_factors,
    'core_values': values_identity.core_values, 'run_id': run_id, 'source': source}}, ingested_at) as r from personas where persona_id is not null group by persona_id)"""
_rest = "r.age as age, r.protective as protective, r.risks as risks, r.core_values as core_values, r.run_id as run_id, r.source as source"
#: ``t``: one flat row per persona, missing numbers as null.
TRAITS = f"{_last}, t as (select persona_id, {_raw}, {_rest} from pl)"
#: ``f``: the same with 0.5 for missing numbers, and the three axes.
FILLED = f"""{_last}, f0 as (select persona_id, {_filled}, {_words}, {_rest} from pl),
    f as (select *, abstraction as cognitive_core, (intrinsic + (1.0 - external)) / 2.0 as motivation_core, (persistence + emotional + metacognition + habit + resilience) / 5.0 as regulation_core from f0)"""


def axis(map_: str, name: str) -> str:
    """Largest value in 0..1 of an axis map under any spelling of a name."""
    return f"list_max(list_transform(list_filter(map_entries({map_}), lambda e: lower(trim(e.key)) = '{name}' and e.value >= 0 and e.value <= 1), lambda e: e.value))"


#: ``s``: one row per slot with its three target axes.
SLOTS = "s as (select distinct slot_id, run_id, quota_label, constraints, adaptive_constraints, " + ", ".join(f"{axis('target_axes', a)} as target_{a}" for a in AXES) + " from slots)"
_gaps = ", ".join(f"abs(f.{a} - s.target_{a})" for a in AXES)
#: ``a``: filled personas with their alignment to their slot.
ALIGNED = f"""{FILLED}, {SLOTS}, a as (select f.*, coalesce(greatest(0.0, least(1.0, 1.0 - list_avg(list_filter([{_gaps}], lambda x: x is not null)))), 1.0) as axis_alignment from f left join s on s.slot_id = f.persona_id)"""
#: ``i``: one row per item. ``ans``: one row per (simulation, item).
ITEMS = "i0 as (select item_id, arg_max({'survey_id': survey_id, 'item_pos': item_pos, 'split': split, 'construct': construct, 'text': text, 'direction': direction, 'axis_weights': axis_weights, 'instrument': instrument}, added_at) as r from survey_items where item_id is not null group by item_id), i as (select item_id, r.survey_id as survey_id, r.item_pos as item_pos, r.split as split, r.construct as construct, r.text as text, r.direction as direction, r.axis_weights as axis_weights, r.instrument as instrument from i0)"
SIMS = "sim0 as (select sim_id, arg_max({'persona_id': persona_id, 'survey_id': survey_id, 'responses': responses, 'axis_scores': axis_scores, 'backend': backend, 'run_id': run_id}, ingested_at) as r from simulations group by sim_id), sim as (select sim_id, r.persona_id as persona_id, r.survey_id as survey_id, r.responses as responses, r.axis_scores as axis_scores, r.backend as backend, r.run_id as run_id from sim0)"
ANSWERS = f"{SIMS}, ans as (select sim_id, persona_id, survey_id, e.key as item_id, e.value as response from (select sim_id, persona_id, survey_id, unnest(map_entries(responses)) as e from sim))"
SCORED = f"{ITEMS}, {ANSWERS}, sc as (select ans.*, i.construct, i.axis_weights, case when i.direction = -1 then 1 - (response - 1) / 4.0 else (response - 1) / 4.0 end as score from ans join i using (item_id) where response between 1 and 5)"
#: ``c``: one row per candidate, its last record.
CANDIDATES = "c0 as (select candidate_id, arg_max({'parent_id': parent_id, 'island_id': island_id, 'generation': generation, 'fitness': fitness, 'evaluated': evaluated, 'metrics': metrics, 'genome': genome, 'seed_name': seed_name, 'recorded_at': recorded_at}, (recorded_at, ingested_at)) as r from candidates where candidate_id is not null group by candidate_id), c as (select candidate_id, r.parent_id as parent_id, r.island_id as island_id, cast(r.generation as bigint) as generation, case when isnan(r.fitness) then null else r.fitness end as fitness, r.evaluated as evaluated, r.metrics as metrics, r.genome as genome, r.seed_name as seed_name, r.recorded_at as recorded_at from c0)"


def contains(text: str, words: tuple[str, ...] | list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({text}, '')), '{w}')" for w in words) + ")" if words else "false"


def weighted(weights: dict[str, float], constant: float) -> str:
    parts = [repr(constant)] + [f"{w!r}::double * (1.0 - {n[1:]})" if n.startswith("~") else f"{w!r}::double * {n}" for n, w in weights.items()]
    return f"greatest(0.0, least(1.0, {' + '.join(parts)}))"


def stages(source: str, all_stages, prefix: str) -> tuple[str, str]:
    """CTEs that add the states stage by stage; returns them and the last one's name."""
    out, at = [], source
    for k, stage in enumerate(all_stages):
        name = f"{prefix}{k}"
        cols = ", ".join(f"{weighted(w, const)} as {n}" for n, (const, w) in stage.items())
        out.append(f"{name} as (select *, {cols} from {at})")
        at = name
    return ", ".join(out), at
