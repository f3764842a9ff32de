"""Expected constants for the SQL twins, typed here on their own, so that a wrong weight or word of an operator shows.

A line is a name, a constant and weights of earlier values; ``~x`` stands for 1 - x.
"""

from __future__ import annotations

# Fixed values.
CONTEXTS = """
threat .25 .60*cue_threat .20*cue_evaluation
opportunity .20 .70*cue_opportunity .15*cue_ambiguity
external_evaluation .20 .70*cue_evaluation
peer_pressure .15 .75*cue_peers
ambiguous .20 .70*cue_ambiguity
support .20 .70*cue_support
deadline_pressure .15 .80*cue_deadline
"""
STATES = """
stress 0 .38*stress_load .24*threat .18*failure .12*~emotional .08*deadline_pressure
fatigue 0 .40*stress_load .22*~habit .22*deadline_pressure .16*stress
perceived_autonomy 0 .42*intrinsic .28*~external .12*opportunity 1*drive_state -.15*external_evaluation -.08*peer_pressure
perceived_competence 0 .25*persistence .25*metacognition .18*resilience .18*abstraction .10*habit -.16*failure -.08*stress
social_safety 0 .30*~peer_influence .20*support .18*~stress_load .16*energy .16*resilience -.16*peer_pressure
task_interest 0 .34*intrinsic .22*abstraction .20*ambiguity .18*opportunity -.12*stress
avoidance 0 .30*failure .22*external .18*threat .16*~persistence .14*fatigue -.12*support
recovery_capacity 0 .35*resilience .25*emotional .20*metacognition .12*support .08*~stress
cognitive_flexibility 0 .36*abstraction .34*ambiguity .18*metacognition .12*intrinsic
autonomous_orientation 0 .48*intrinsic .24*~external .12*metacognition 1*drive_autonomous
defensive_orientation 0 .34*failure .30*external .16*stress_load 1*drive_defensive -.12*resilience
self_regulation_capacity 0 .26*persistence .24*emotional .24*metacognition .16*habit .10*resilience
social_confidence 0 .32*energy .24*~peer_influence .22*resilience .12*emotional .10*~stress_load
growth_readiness 0 .28*intrinsic .22*cognitive_flexibility .22*self_regulation_capacity .16*resilience 1*drive_growth
pressure_reactivity 0 .30*external .28*failure .22*stress_load .12*peer_influence .08*~emotional
reflective_accuracy 0 .34*metacognition .24*abstraction .18*emotional .14*resilience .10*~defensive_orientation
stress2 0 .58*stress .20*pressure_reactivity .16*threat -.10*support
fatigue2 0 .62*fatigue .16*stress2 .12*defensive_orientation -.08*self_regulation_capacity
perceived_autonomy2 0 .52*perceived_autonomy .30*autonomous_orientation .12*opportunity -.12*external_evaluation -.06*peer_pressure
perceived_competence2 0 .48*perceived_competence .28*self_regulation_capacity .12*cognitive_flexibility .08*support -.12*stress2
social_safety2 0 .48*social_safety .28*social_confidence .14*support -.14*peer_pressure
task_interest2 0 .46*task_interest .26*growth_readiness .14*opportunity .08*ambiguous -.12*stress2
avoidance2 0 .48*avoidance .26*defensive_orientation .16*stress2 .08*fatigue2 -.12*support
recovery_capacity2 0 .50*recovery_capacity .26*self_regulation_capacity .14*support -.10*fatigue2
honest_self_access 0 .40*reflective_accuracy .24*perceived_competence2 .16*social_safety2 .12*recovery_capacity2 -.12*stress2
state_variability 0 .30*pressure_reactivity .24*ambiguous .18*peer_pressure .16*fatigue2 .12*~recovery_capacity2
spread 0 1*growth_gap
acquiescence .30 .18*peer_influence .14*external .10*social_safety2 -.12*reflective_accuracy
social_desirability .24 .24*external .18*peer_influence .14*social_safety2 .10*defensive_orientation
uncertainty_preference .18 .24*state_variability .20*fatigue2 .16*~reflective_accuracy .10*stress_load
extremity_preference .16 .22*~uncertainty_preference .18*reflective_accuracy .14*perceived_competence2 .10*spread
fatigue_compression .12 .36*fatigue2 .20*stress2 .12*~recovery_capacity2
"""
DRIVES = """
drive_state autonomy .18 curiosity .15 mastery .12 achievement .04 recognition -.06 belonging -.05 security -.08 avoidance -.14
drive_autonomous autonomy .18 curiosity .15 mastery .12 achievement .04 recognition -.05 belonging -.04 security -.07 avoidance -.16
drive_defensive avoidance .18 security .12 recognition .08 belonging .06 achievement .04
drive_growth curiosity .16 mastery .14 autonomy .10 achievement .06
"""
#: Name, weight of the weaker terms, terms, weaker terms.
CUES = """
cue_threat | .6 | criticism, deadline, stress, pressure, failure, conflict | bullied, exclusion, outsider, unsafe, disrupt
cue_opportunity | .7 | opportunity, interesting, exploration, curious, creative | project, new, complex, challenge
cue_evaluation | .7 | criticism, approval, feedback, checking, rules | deadline, group, teacher, adult, peer
cue_peers | .6 | peer, group, approval, uncool, embarrassing | belong, outsider, social
cue_ambiguity | .7 | unclear, no single correct, complex, unfamiliar | new, exploration, method
cue_support | .6 | supportive, understands, help, feedback is firm but fair | adult, peer relationships, belonging
cue_deadline | 0 | deadline, competing demands, schedule, time |
"""
#: Label in short, and the words that call for it.
MECHANISMS = """
thinking: curious, understand, idea, complex, different way
own choice: choose, own, because i want, meaningful, interest
outer pressure: grade, approval, praise, others think, pressure
self-control: plan, keep going, finish, habit, setback, recover
threat: avoid, give up, failure, mistake, criticism
belonging: friend, peer, group, belong, share
"""


def lines(text: str) -> list[str]:
    return [x.strip() for x in text.strip().splitlines()]


def formula(line: str) -> tuple[str, str]:
    """Name and SQL of a line, clipped to 0..1."""
    name, constant, *parts = line.split()
    terms = [f"{float(constant)}::double"]
    for part in parts:
        w, x = part.split("*")
        terms.append(f"({float(w)}::double * {f'(1.0 - {x[1:]})' if x[0] == '~' else x})")
    return name, f"greatest(0.0, least(1.0, {' + '.join(terms)}))"


def steps(source: str, text: str, prefix: str) -> tuple[str, str]:
    """Common table expressions that add the values one after the other; returns them and the last one's name."""
    out, at = [], source
    for k, line in enumerate(lines(text)):
        name, sql = formula(line)
        out.append(f"{prefix}{k} as (select *, {sql} as {name} from {at})")
        at = f"{prefix}{k}"
    return ", ".join(out), at


def drive(line: str) -> str:
    name, *rest = line.split()
    return "case drive " + " ".join(f"when '{k}' then {float(v)}" for k, v in zip(rest[::2], rest[1::2], strict=True)) + f" else 0.0 end as {name}"


def has(text: str, words: str) -> str:
    own = [w.strip() for w in words.split(",") if w.strip()]
    return "(" + " or ".join(f"contains(lower(coalesce({text}, '')), '{w}')" for w in own) + ")" if own else "false"


def cues(text: str, combine: str = "{}") -> str:
    """Select list of the cues of a text; ``combine`` wraps each, ``max({})`` over the rows of a group for instance."""
    out = []
    for line in lines(CUES):
        name, w, strong, weak = (x.strip() for x in line.split("|"))
        one = f"greatest(case when {has(text, strong)} then 1.0 else 0.0 end, {float(w)} * case when {has(text, weak)} then 1.0 else 0.0 end)"
        out.append(f"{combine.format(one)} as {name}")
    return ", ".join(out)
