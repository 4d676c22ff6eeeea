"""Ordered folds: several actions on one record, against a loop over the same actions."""

from __future__ import annotations

import pytest

from tallywright.operators import folds
from tallywright.operators.ledger import CHAIN, DISMISSAL_REASONS, STATUSES, TERMINAL

LEDGER = "dedupe_key string, status string, lifecycle_version int, owner string"
ACTIONS = "dedupe_key string, ordinal long, kind string, to_status string, owner string, may_act boolean, expected_version int, reason_code string, note string, outcome_id string"
LOG = "m string, ordinal long, kind string, version int"


def move(to, version, ordinal, key="g", **more):
    return (key, ordinal, "transition", to, None, more.get("may", True), version, more.get("reason"), more.get("note"), more.get("outcome"))


def outcomes(spark, ledger, actions):
    rows = folds.gap_actions(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(actions, ACTIONS)).collect()
    return [(r.outcome, r.status_after, r.version_after, r.owner_after) for r in sorted(rows, key=lambda r: (r.dedupe_key or "", r.ordinal))]


def test_of_two_that_expect_one_version_the_first_wins(spark):
    got = outcomes(spark, [("g", "detected", 1, "me")], [move("triaged", 1, 1), move("dismissed", 1, 2, reason="duplicate", note="n"), move("investigating", 2, 3)])
    assert got == [("applied", "triaged", 2, "me"), ("version_conflict", "triaged", 2, "me"), ("applied", "investigating", 3, "me")]


def test_a_refused_action_leaves_the_version_to_the_next(spark):
    actions = [move("triaged", 1, 1), ("g", 2, "assign", None, "you", True, 1, None, None, None), move("triaged", 2, 3), ("g", 4, "action", None, None, True, None, None, None, None), ("g", 5, "dance", None, None, True, 3, None, None, None)]
    got = outcomes(spark, [("g", "detected", 1, None)], actions)
    assert [x[0] for x in got] == ["missing_requirement", "applied", "applied", "applied", "unknown_kind"]
    assert got[-1][1:] == ("triaged", 3, "you")


def test_refusals_come_in_order(spark):
    ledger = [("g", "validating", 4, "me"), ("d", "dismissed", 9, "me")]
    actions = [
        move("resolved", 9, 1, may=False),
        move("triaged", 9, 2),
        move("resolved", 9, 3),
        move("resolved", 4, 4),
        move("dismissed", 4, 5, reason="whim", note="n"),
        move("dismissed", 4, 6, reason="duplicate", note=" "),
        move("resolved", 4, 7, outcome="o"),
        move("dismissed", 5, 8, reason="duplicate", note="n"),
        move("triaged", 9, 1, key="d"),
        ("d", 2, "action", None, None, True, None, None, None, None),
        move("triaged", 1, 1, key="unknown"),
        (None, 1, "assign", None, "x", True, 1, None, None, None),
    ]
    got = [x[0] for x in outcomes(spark, ledger, actions)]
    assert got == ["no_such_gap", "illegal_transition", "terminal", "not_permitted", "illegal_transition", "version_conflict", "missing_requirement", "missing_requirement", "missing_requirement", "applied", "illegal_transition", "no_such_gap"]


def loop(ledger, actions):
    state = {k: [s, v, o] for k, s, v, o in ledger}
    out = []
    for key, ordinal, kind, to, owner, may, expected, reason, note, outcome_id in sorted(actions, key=lambda a: (a[0], a[1])):
        s = state.get(key)
        if s is None:
            out.append((key, ordinal, "no_such_gap"))
            continue
        along = s[0] in CHAIN and to in CHAIN and CHAIN.index(to) == CHAIN.index(s[0]) + 1
        if not may:
            result = "not_permitted"
        elif kind == "action":
            result = "terminal" if s[0] in TERMINAL else "applied"
        elif kind == "transition" and not (along or (to == "dismissed" and s[0] not in TERMINAL)):
            result = "illegal_transition"
        elif expected != s[1]:
            result = "version_conflict"
        elif kind == "transition" and ((to == "dismissed" and (reason not in DISMISSAL_REASONS or not (note or "").strip())) or (to == "resolved" and outcome_id is None) or (to == "triaged" and s[2] is None)):
            result = "missing_requirement"
        else:
            result = "applied"
            s[1] += kind != "action"
            s[0] = to if kind == "transition" else s[0]
            s[2] = owner if kind == "assign" else s[2]
        out.append((key, ordinal, result))
    return out, state


@pytest.mark.parametrize("seed", range(4))
def test_random_actions_against_a_loop(spark, seed):
    import random

    r = random.Random(seed)
    ledger = [(f"g{i}", r.choice(STATUSES), 1, r.choice([None, "a"])) for i in range(30)]
    actions = []
    for n in range(900):
        kind, legal = r.choice(["transition", "transition", "transition", "assign", "action"]), r.choice(STATUSES)
        actions.append((f"g{r.randrange(32)}", n, kind, legal, r.choice([None, "b", "c"]), r.random() < 0.95, r.randint(1, 5), r.choice([None, "duplicate", "x"]), r.choice([None, " ", "n"]), r.choice([None, "o"])))
    want, state = loop(ledger, actions)
    rows = folds.gap_actions(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(actions, ACTIONS).repartition(5)).collect()
    assert sorted((x.dedupe_key, x.ordinal, x.outcome) for x in rows) == sorted(want)
    after = folds.after_actions(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(actions, ACTIONS)).collect()
    assert {x.dedupe_key: [x.status, x.lifecycle_version, x.owner] for x in after} == state


def test_mapping_versions(spark):
    log = [("m", i, kind, v) for i, (kind, v) in enumerate([("apply", 1), ("create", None), ("create", None), ("edit", 2), ("apply", 2), ("apply", 2), ("rollback", 1), ("rollback", 2), ("edit", 2), ("create", None), ("edit", 3), ("rollback", 3), ("apply", 3), ("rollback", None), ("burn", 1)])]
    rows = sorted(folds.mapping_actions(spark.createDataFrame(log, LOG), "m").collect(), key=lambda r: r.ordinal)
    assert [(r.outcome, r.version, r.active_version) for r in rows] == [
        ("no_such_version", 1, None), ("created", 1, None), ("created", 2, None), ("edited", 2, None), ("applied", 2, 2), ("already_active", 2, 2), ("rolled_back", 1, 1), ("newer_than_active", 2, 1),
        ("frozen", 2, 1), ("created", 3, 1), ("edited", 3, 1), ("newer_than_active", 3, 1), ("applied", 3, 3), ("no_such_version", None, 3), ("unknown_kind", 1, 3),
    ]
    assert rows[-1].frozen_versions == 3


def test_no_actions(spark):
    ledger = spark.createDataFrame([("g", "detected", 1, None)], LEDGER)
    none = spark.createDataFrame([], ACTIONS)
    assert folds.gap_actions(ledger, none).count() == 0
    assert [tuple(r) for r in folds.after_actions(ledger, none).collect()] == [("g", "detected", 1, None)]
    assert folds.mapping_actions(spark.createDataFrame([], LOG), "m").count() == 0


def mapping_loop(log):
    out, state = [], {}
    for m, ordinal, kind, version in sorted(log, key=lambda a: (a[0], a[1])):
        s = state.setdefault(m, {"highest": 0, "active": None, "applied": set()})
        there = version is not None and 1 <= version <= s["highest"]
        if kind == "create":
            s["highest"] = version = s["highest"] + 1
            result = "created"
        elif not there:
            result = "no_such_version"
        elif kind == "edit":
            result = "frozen" if version in s["applied"] else "edited"
        elif kind not in ("apply", "rollback"):
            result = "unknown_kind"
        elif version == s["active"]:
            result = "already_active"
        elif kind == "rollback" and s["active"] is not None and version > s["active"]:
            result = "newer_than_active"
        else:
            result = "applied" if kind == "apply" else "rolled_back"
            s["active"] = version
            s["applied"].add(version)
        out.append((m, ordinal, kind, version, result, s["active"], len(s["applied"])))
    return out


@pytest.mark.parametrize("most", [3, 40])
def test_a_mapping_may_have_any_number_of_actions(spark, most):
    """Against a loop, one mapping with most of the actions; no row or value holds all actions of one."""
    import random

    r = random.Random(most)
    kinds = ["create"] * 1 + ["apply", "rollback", "rollback", "edit"] * 3 + ["burn"]
    log = [("hot" if r.random() < 0.8 else f"m{r.randrange(200)}", n, r.choice(kinds), r.choice([None, *range(-1, most)])) for n in range(15_000)]
    found = folds.mapping_actions(spark.createDataFrame(log, LOG).repartition(5), "m")
    assert sorted(map(tuple, found.collect()), key=lambda x: x[:2]) == mapping_loop(log)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
