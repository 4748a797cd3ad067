"""Audits of linked ledgers, routes and reports on made cases: one sound history, then one fault at a time."""

import datetime
import hashlib
import json

import pytest
from newsloom.operators import histories as H

AT = datetime.datetime(2026, 1, 5, 12)
LATER = lambda minutes: AT + datetime.timedelta(minutes=minutes)
sha = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
SESSION = "session_id long, sequence long, rounds int, retry_count int, state string, created_at timestamp, deadline_at timestamp, cooldown_until timestamp, input string, input_hash string"
ATTEMPT = "attempt_id long, session_id long, sequence long, number int, exposure string, exposure_hash string"
RETRY = "retry_id long, session_id long, number int, after_round int, requested_at timestamp, note string, document string, document_hash string"


def history():
    sessions = [[1, 1, 2, 1, "blocked", AT, LATER(3), LATER(60), "in1", sha("in1")], [2, 2, 0, 0, "running", AT, LATER(3), None, "in2", sha("in2")]]
    attempts = [[10, 1, 1, 1, "e1", sha("e1", sha("in1"))], [11, 1, 2, 2, "e2", sha("e2", sha("in1"))]]
    retries = [[20, 1, 1, 1, LATER(1), "again", "d", sha("d", sha("in1"))]]
    return {"sessions": sessions, "attempts": attempts, "retries": retries, "marker": [2, 2]}


FAULTS = [
    (lambda h: None, []),
    (lambda h: h["sessions"][0].__setitem__(1, 3), ["sequence history sessions"]),
    (lambda h: h["marker"].__setitem__(1, 3), ["sequence history attempts"]),
    (lambda h: h["attempts"][1].__setitem__(3, 3), ["rounds session 1"]),
    (lambda h: h["attempts"][1].__setitem__(1, 9), ["rounds session 1", "parent attempt 11"]),
    (lambda h: h["sessions"][0].__setitem__(2, 4), ["rounds session 1"]),
    (lambda h: h["sessions"][0].__setitem__(7, None), ["cooldown session 1"]),
    (lambda h: h["sessions"][1].__setitem__(8, "other"), ["input_hash session 2"]),
    (lambda h: h["sessions"][1].__setitem__(9, None), ["input_hash session 2"]),
    (lambda h: h["attempts"][0].__setitem__(4, "other"), ["exposure_hash attempt 10"]),
    (lambda h: h["retries"][0].__setitem__(3, 3), ["retry_rounds session 1", "after_round retry 20"]),
    (lambda h: h["retries"][0].__setitem__(4, LATER(3)), ["time retry 20"]),
    (lambda h: h["retries"][0].__setitem__(5, " "), ["note retry 20"]),
    (lambda h: h["retries"][0].__setitem__(7, "x"), ["document_hash retry 20"]),
    (lambda h: h["sessions"][0].__setitem__(3, 2), ["retries session 1"]),
    (lambda h: h["retries"].clear(), ["retries session 1"]),
]


def test_history_audit(spark):
    for fault, want in FAULTS:
        h = history()
        fault(h)
        frame = lambda name, schema: spark.createDataFrame([tuple(r) for r in h[name]], schema)  # noqa: E731, B023
        markers = spark.createDataFrame([tuple(h["marker"])], "sessions long, attempts long")
        got = H.history_audit(frame("sessions", SESSION), frame("attempts", ATTEMPT), frame("retries", RETRY), markers).collect()
        assert sorted(f"{r.rule} {r.kind} {r.record}" for r in got) == sorted(want)


REPORT = "report_id long, session_id long, candidate_id long, binding string, binding_hash string, state string, selection string, selection_hash string, sequence long, result string, result_hash string"


def report(report_id, session, candidate, state, sequence):
    binding = json.dumps({"format": "v2", "session_id": session, "candidate_id": candidate})
    selection = json.dumps({"sequence": sequence}) if sequence else None
    result = json.dumps({"status": state} | dict.fromkeys(H.RESULT_KEYS[1:], 1)) if state in H.TERMINAL else None
    marks = [sha(binding), sha(selection) if selection else None]
    return [report_id, session, candidate, binding, marks[0], state, selection, marks[1], sequence, result, sha(marks[0], marks[1] or "", result) if result else None]


@pytest.mark.parametrize(
    "place, value, want",
    [
        (None, None, []),
        ((0, 8), 3, ["sequence history selections"]),
        ((0, 3), '{"session_id": 1, "candidate_id": 9}', ["binding report 1", "binding_hash report 1"]),
        ((0, 5), "running", ["result report 1", "result_hash report 1"]),
        ((0, 9), '{"status": "passed"}', ["result report 1", "result_hash report 1"]),
        ((0, 6), "{}", ["selection_hash report 1"]),
        ((1, 5), "odd", ["state report 2"]),
        ((1, 2), 7, ["binding report 2", "enrolled candidate 1:7", "one_report candidate 1:6"]),
    ],
)
def test_validation_audit(spark, place, value, want):
    rows = [report(1, 1, 5, "passed", 1), report(2, 1, 6, "awaiting_evidence", None)]
    if place:
        rows[place[0]][place[1]] = value
    candidates = spark.createDataFrame([(1, 5), (1, 6), (1, 6)], "session_id long, candidate_id long")
    got = H.validation_audit(candidates, spark.createDataFrame([tuple(r) for r in rows], REPORT), 1).collect()
    assert sorted(f"{r.rule} {r.kind} {r.record}" for r in got) == sorted(want)


def test_retries_and_starts(spark):
    rows = [(1, "queued", AT, LATER(3), 0, 3), (2, "blocked", None, LATER(3), 0, 3), (3, "blocked", AT, AT, 0, 3), (4, "blocked", AT, LATER(3), 3, 3), (5, "blocked", AT, LATER(3), 1, 3), (6, "blocked", AT, LATER(3), 1, 3), (7, "blocked", AT, LATER(3), 1, 3), (8, None, AT, AT, 0, 3)]
    sessions = spark.createDataFrame(rows, "session_id long, state string, dispatch_due_at timestamp, deadline_at timestamp, rounds int, max_rounds int")
    attempts = spark.createDataFrame([(50, 5), (51, 5), (70, 7)], "attempt_id long, session_id long")
    reserved = spark.createDataFrame([(50,), (50,), (None,)], "attempt_id long")
    retries = spark.createDataFrame([(6, 1), (7, 0)], "session_id long, after_round int")
    got = {r.session_id: r.reason for r in H.retry_eligibility(sessions, attempts, reserved, retries, AT).collect()}
    assert got == {1: "state", 2: "delivery", 3: "deadline", 4: "rounds", 5: "admitted", 6: "asked", 7: None, 8: "state"}
    held = spark.createDataFrame([(1, "running", None), (2, "blocked", LATER(1)), (2, "passed", None), (3, "blocked", AT), (4, "exhausted", None), (5, "passed", None)], "source_id long, state string, cooldown_until timestamp")
    sources = spark.createDataFrame([(i,) for i in range(1, 7)], "source_id long")
    assert {r.source_id: r.reason for r in H.start_blocked(sources, held, AT).collect()} == {1: "active", 2: "cooldown", 3: None, 4: "cooldown", 5: None, 6: None}


def test_manifests(spark):
    page = {"requested_url_hash": sha("a"), "document_url_hash": sha("b"), "snapshot_id": "sha256:" + sha("c"), "response_bytes": 10, "fetched_at": "2026-01-05T12:00:00+00:00"}
    good = {"format": "crawl-capture.v1", "purpose": "preview", "source_id": 1, "version_id": 2, "preview_report_id": 3, "sequence": 4, "generation": 0, "source_generation": 0, "source_fingerprint": sha(), "recipe_hash": sha(), "fetch_policy_hash": sha(), "quality_profile_hash": sha(), "engine_version": "v.1", "source_policy": None, "capture_id": "0" * 32, "result_status": "ready", "completion_status": "stale", "documents": [page]}
    cases = [
        (good, []),
        (good | {"source_policy": {"id": 1, "hash": sha()}}, []),
        (good | {"source_policy": {"id": 0}}, ["keys $.source_policy", "integer $.source_policy.id"]),
        (good | {"sequence": 5}, ["binding $"]),
        (good | {"more": 1, "capture_id": "x"}, ["keys $", "shape $.capture_id"]),
        (good | {"documents": [page] * 7}, ["size $.documents"]),
        (good | {"documents": [page | {"response_bytes": 500_000}] * 5}, ["size $"]),
        (good | {"documents": [page | {"fetched_at": "2026-01-05T12:00:00", "snapshot_id": sha("c")}]}, ["shape $.documents[0].fetched_at", "shape $.documents[0].snapshot_id"]),
    ]
    rows = [(i, 1, 2, 3, 4, json.dumps(d), sha(json.dumps(d))) for i, (d, _) in enumerate(cases)] + [(90, 1, 2, 3, 4, "{", sha("{")), (91, 1, 2, 3, 4, json.dumps(good), sha("other")), (92, 1, 2, 3, 4, None, None)]
    got = {}
    for r in H.manifest_check(spark.createDataFrame(rows, "manifest_id long, source_id long, version_id long, preview_report_id long, sequence long, document string, document_hash string")).collect():
        got.setdefault(r.manifest_id, []).append(f"{r.code} {r.path}")
    for i, (_, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == sorted(want)
    assert (got[90], got[91], sorted(got[92])) == (["json $"], ["hash $"], ["hash $", "json $"])


def test_routes_and_reports(spark):
    profiles = spark.createDataFrame([(1, 2, None, 0, 0), (2, 2, 7, 1, 1), (3, 2, 7, 0, 1), (4, 2, 7, 1, 1), (5, 2, 8, 1, 1), (6, 2, 9, 1, 1)], "source_id long, activation_generation int, active_version_id long, active_source_generation int, source_generation int")
    claims = spark.createDataFrame([(s, s, 2) for s in range(1, 7)] + [(17, 2, 1), (18, 8, 0)], "claim_id long, source_id long, activation_generation int")
    policies = spark.createDataFrame([(s, "stale" if s == 4 else "effective") for s in range(1, 8)], "source_id long, state string")
    versions = spark.createDataFrame([(7, "r", sha("r"), True), (8, "r", sha("x"), True), (9, "r", sha("r"), False)], "version_id long, recipe string, recipe_hash string, valid boolean")
    got = {r.claim_id: (r.route, r.version_id, r.code) for r in H.current_route(claims, profiles, policies, versions).collect()}
    assert got == {1: ("legacy", None, None), 2: ("schema", 7, None), 3: ("blocked", None, "schema_stale"), 4: ("blocked", None, "policy_unavailable"), 5: ("blocked", None, "invalid_schema"), 6: ("blocked", None, "invalid_schema"), 17: ("lost", None, "lost"), 18: ("legacy", None, None)}

    row = lambda i, version=1, status="ready", policy=True, at=AT, generation=1, engine="e": (i, version, status, policy, at, generation, "f", "h", engine)
    rows = [row(1), row(2, status="failed"), row(3, policy=False), row(4, at=AT - datetime.timedelta(days=8)), row(5, generation=0), row(6, engine="old"), row(7), row(8, version=2), row(9, version=3)] + [row(i, version=4) for i in range(100, 125)]
    reports = spark.createDataFrame(rows, "report_id long, version_id long, status string, has_policy boolean, created_at timestamp, generation int, source_fingerprint string, recipe_hash string, engine_version string")
    current = spark.createDataFrame([(v, 1, "f", "h", "e", v != 2, v != 3) for v in range(1, 5)], "version_id long, generation int, source_fingerprint string, recipe_hash string, engine_version string, is_active boolean, policy_matches boolean")
    found = sorted((r.version_id, r.report_id) for r in H.usable_reports(reports, current, AT).collect())
    assert found == [(1, 1), (1, 7)] + [(4, i) for i in range(105, 125)]
