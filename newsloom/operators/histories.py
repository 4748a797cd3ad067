"""Audits of linked ledgers: every broken rule is a row, all rules in one pass over each ledger.

Numbers that should run from 1 without a gap are told by their count, distinct count, least and greatest, so that no
parent's children are gathered. Hashes are worked out anew: a child's covers its parent's.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.times import moment
from newsloom.sources.documents import Rule, broken_rules, duplicate_keys, json_nodes

#: Most rounds and retries of a session, states, and the keys of results by format.
MOST_ROUNDS, MOST_NOTE = 3, 300
STOPPED = ("blocked", "exhausted", "cancelled")
TERMINAL, WAITING = ("passed", "failed", "inconclusive"), ("awaiting_evidence", "running")
RESULT_KEYS = ("status", "reason", "details", "templates", "engine_status", "errors")
_HASH = r"\A[0-9a-f]{64}\z"


def chained_hash(document: str, parent: str) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(document, F.lit("")), F.coalesce(parent, F.lit(""))), 256)


def _gapless(n: str, distinct: str, low: str, high: str, want: Column) -> Column:
    """Whether numbers are 1 to ``want``, each once; none are wanted where it is 0."""
    return F.coalesce((F.col(n) == want) & ((want == 0) | ((F.col(distinct) == want) & (F.col(low) == 1) & (F.col(high) == want))), F.lit(False))


def _numbers(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(number).alias("d"), F.min(number).alias("low"), F.max(number).alias("high"))


def _told(rows: DataFrame, kind: str, record: str, rules: dict[str, Column]) -> DataFrame:
    """``rule, kind, record`` of each broken rule; a rule that cannot be told is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.lit(kind).alias("kind"), F.col(record).cast("string").alias("record"))


def history_audit(sessions: DataFrame, attempts: DataFrame, retries: DataFrame, markers: DataFrame) -> DataFrame:
    """``rule, kind, record`` of each broken rule of a history of sessions, their attempts and their retries.

    Sessions: ``session_id, sequence, rounds, retry_count, state, created_at, deadline_at, cooldown_until, input, input_hash``; attempts:
    ``attempt_id, session_id, sequence, number, exposure, exposure_hash``; retries: ``retry_id, session_id, number, after_round,
    requested_at, note, document, document_hash``; ``markers``: one row ``sessions, attempts``. Sequences of sessions and of
    attempts are 1 to the marker's; children have parents; the attempts of a session are numbered 1 to its rounds and its
    retries 1 to their count, each after another round; a stopped session has a cooldown.
    """
    whole = []
    for rows, name in ((sessions, "sessions"), (attempts, "attempts")):
        both = _numbers(rows, [], "sequence").crossJoin(F.broadcast(markers.agg(F.count("*").alias("rows"), F.max(name).alias("want"))))  # one row each
        whole.append(_told(both.withColumn("of", F.lit(name)), "history", "of", {"sequence": (F.col("rows") == 1) & _gapless("n", "d", "low", "high", F.col("want"))}))
    tried = _numbers(attempts, ["session_id"], "number").select("session_id", *[F.col(c).alias(f"a_{c}") for c in ("n", "d", "low", "high")])
    asked = retries.groupBy("session_id").agg(F.count("*").alias("r_n"), F.count_distinct("number").alias("r_d"), F.min("number").alias("r_low"), F.max("number").alias("r_high"), F.count_distinct("after_round").alias("r_rounds"), F.max("after_round").alias("r_after"))
    of = sessions.join(tried, "session_id", "left").join(asked, "session_id", "left").fillna(0, ["a_n", "r_n", "r_rounds"])
    told = _told(
        of,
        "session",
        "session_id",
        {
            "rounds": F.col("rounds").between(0, MOST_ROUNDS) & _gapless("a_n", "a_d", "a_low", "a_high", F.col("rounds")),
            "retries": F.col("retry_count").between(0, MOST_ROUNDS) & _gapless("r_n", "r_d", "r_low", "r_high", F.col("retry_count")),
            "retry_rounds": (F.col("r_rounds") == F.col("r_n")) & (F.coalesce("r_after", F.lit(0)) <= F.col("rounds")),
            "cooldown": ~F.col("state").isin(*STOPPED) | F.col("cooldown_until").isNotNull(),
            "input_hash": F.col("input_hash") == F.sha2("input", 256),
        },
    )
    parents = sessions.select("session_id", "input_hash", "created_at", "deadline_at", F.lit(True).alias("parent"))
    own = attempts.join(parents, "session_id", "left")
    told = told.unionByName(_told(own, "attempt", "attempt_id", {"parent": F.col("parent"), "exposure_hash": F.col("parent").isNull() | (F.col("exposure_hash") == chained_hash("exposure", "input_hash"))}))
    own = retries.join(parents, "session_id", "left")
    note = F.length(F.btrim("note"))
    told = told.unionByName(
        _told(
            own,
            "retry",
            "retry_id",
            {
                "parent": F.col("parent"),
                "after_round": F.col("after_round").between(0, MOST_ROUNDS - 1),
                "note": (note >= 1) & (note <= MOST_NOTE),
                "time": F.col("parent").isNull() | ((F.col("requested_at") >= F.col("created_at")) & (F.col("requested_at") < F.col("deadline_at"))),
                "document_hash": F.col("parent").isNull() | (F.col("document_hash") == chained_hash("document", "input_hash")),
            },
        )
    )
    return told.unionByName(whole[0]).unionByName(whole[1])


def validation_audit(candidates: DataFrame, reports: DataFrame, marker: int) -> DataFrame:
    """``rule, kind, record`` of each broken rule of validation reports against the enrolled candidates.

    ``candidates``: ``session_id, candidate_id``; each has one report and there is no other. Reports: ``report_id, session_id,
    candidate_id, binding, binding_hash, state, selection, selection_hash, sequence, result, result_hash`` with JSON texts. Selections are
    numbered 1 to ``marker``; a report in a last state has a result of that status with the known keys and a hash over
    binding, selection and result; any other has none.
    """
    key = ["session_id", "candidate_id"]
    held = reports.groupBy(*key).agg(F.count("*").alias("n"))
    both = candidates.select(*key).distinct().withColumn("enrolled", F.lit(True)).join(held, key, "full_outer")
    pairs = _told(both.withColumn("pair", F.concat_ws(":", *key)), "candidate", "pair", {"enrolled": F.col("enrolled"), "one_report": F.col("enrolled").isNull() | (F.col("n") == 1)})
    numbers = _numbers(reports.where("selection is not null"), [], "sequence").withColumn("of", F.lit("selections"))
    counted = _told(numbers, "history", "of", {"sequence": _gapless("n", "d", "low", "high", F.lit(marker))})
    bound = lambda c: F.get_json_object("binding", f"$.{c}")
    last = F.col("state").isin(*TERMINAL)
    keys = F.array_sort(F.json_object_keys("result"))
    whole = F.sha2(F.concat_ws("|", "binding_hash", F.coalesce("selection_hash", F.lit("")), "result"), 256)
    own = _told(
        reports,
        "report",
        "report_id",
        {
            "binding": (bound("session_id") == F.col("session_id").cast("string")) & (bound("candidate_id") == F.col("candidate_id").cast("string")),
            "binding_hash": F.col("binding_hash") == F.sha2("binding", 256),
            "selection_hash": F.col("selection").isNull() | (F.col("selection_hash") == F.sha2("selection", 256)),
            "state": F.col("state").isin(*TERMINAL, *WAITING),
            "result": F.when(last, (F.get_json_object("result", "$.status") == F.col("state")) & (keys == F.array_sort(F.array(*map(F.lit, RESULT_KEYS))))).otherwise(F.col("result").isNull()),
            "result_hash": F.when(last, F.col("result_hash") == whole).otherwise(F.col("result_hash").isNull()),
        },
    )
    return pairs.unionByName(counted).unionByName(own)


def retry_eligibility(sessions: DataFrame, attempts: DataFrame, reservations: DataFrame, retries: DataFrame, as_of: datetime) -> DataFrame:
    """``session_id, reason``: the first reason why a session may not be retried; null if it may.

    ``sessions``: ``session_id, state, dispatch_due_at, deadline_at, rounds, max_rounds``; ``reservations``: ``attempt_id``.
    """
    spent = attempts.join(reservations.select("attempt_id").distinct(), "attempt_id", "left_semi").select("session_id").distinct().withColumn("spent", F.lit(True))
    asked = retries.select("session_id", F.col("after_round").alias("rounds")).distinct().withColumn("asked", F.lit(True))
    both = sessions.join(spent, "session_id", "left").join(asked, ["session_id", "rounds"], "left")
    reason = (
        F.when(~F.col("state").eqNullSafe("blocked"), "state")
        .when(F.col("dispatch_due_at").isNull(), "delivery")
        .when(F.lit(moment(as_of)) >= F.col("deadline_at"), "deadline")
        .when(F.col("rounds") >= F.col("max_rounds"), "rounds")
        .when(F.col("spent"), "admitted")
        .when(F.col("asked"), "asked")
    )
    return both.select("session_id", reason.alias("reason"))


def start_blocked(sources: DataFrame, sessions: DataFrame, as_of: datetime) -> DataFrame:
    """``source_id, reason``: ``active`` where a session of the source is queued or running, ``cooldown`` where one has not cooled down or never will; null if a session may start."""
    active = F.col("state").isin("queued", "running")
    cooling = (F.col("cooldown_until") > moment(as_of)) | (F.col("state").isin(*STOPPED) & F.col("cooldown_until").isNull())
    told = sessions.groupBy("source_id").agg(F.bool_or(active).alias("active"), F.bool_or(F.coalesce(cooling, F.lit(False))).alias("cooling"))
    return sources.join(told, "source_id", "left").select("source_id", F.when(F.col("active"), "active").when(F.col("cooling"), "cooldown").alias("reason"))


_STATUSES = ("ready", "no_change", "partial", "degraded", "blocked", "failed", "inconclusive")
_PAGE = ("requested_url_hash", "document_url_hash", "snapshot_id", "response_bytes", "fetched_at")
_BOUND = ("source_id", "version_id", "preview_report_id", "sequence")
_HASHES = ("source_fingerprint", "recipe_hash", "fetch_policy_hash", "quality_profile_hash")
_FIELDS = ("format", "purpose", *_BOUND, "generation", "source_generation", *_HASHES, "engine_version", "source_policy", "capture_id", "result_status", "completion_status", "documents")


def _whole(pattern: str, least: int, most: int = 2**31 - 1) -> Rule:
    return Rule(pattern, "integer", "integer", least=least, most=most)


def _shape(pattern: str, regex: str) -> Rule:
    return Rule(pattern, "text", "text", regex=regex, regex_code="shape")


MANIFEST: tuple[Rule, ...] = (
    Rule("$", "object", "type", _FIELDS, key_code="keys"),
    Rule("$.format", "choice", "choice", choices=("crawl-capture.v1",)),
    Rule("$.purpose", "choice", "choice", choices=("preview",)),
    *[_whole(f"$.{c}", 1) for c in _BOUND],
    *[_whole(f"$.{c}", 0) for c in ("generation", "source_generation")],
    *[_shape(f"$.{c}", _HASH) for c in _HASHES],
    _shape("$.engine_version", r"\A[a-z0-9._-]{1,40}\z"),
    _shape("$.capture_id", r"\A[0-9a-f]{32}\z"),
    Rule("$.result_status", "choice", "choice", choices=_STATUSES),
    Rule("$.completion_status", "choice", "choice", choices=(*_STATUSES, "stale")),
    Rule("$.source_policy", "object", "type", ("id", "hash"), nullable=True, key_code="keys"),
    _whole("$.source_policy.id", 1),
    _shape("$.source_policy.hash", _HASH),
    Rule("$.documents", "array", "size", most=6),
    Rule("$.documents[*]", "object", "type", _PAGE, key_code="keys"),
    _shape("$.documents[*].requested_url_hash", _HASH),
    _shape("$.documents[*].document_url_hash", _HASH),
    _shape("$.documents[*].snapshot_id", r"\Asha256:[0-9a-f]{64}\z"),
    _whole("$.documents[*].response_bytes", 0, 512 * 1024),
    Rule("$.documents[*].fetched_at", "text", "text", most=40, regex=r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})\z", regex_code="shape"),
)


def manifest_check(manifests: DataFrame) -> DataFrame:
    """``manifest_id, code, path`` of each failure of ``manifest_id, source_id, version_id, preview_report_id, sequence, document, document_hash``.

    The document is closed JSON within bounds, its hash is the stored one, it names the row that holds it (``binding``), and its pages have at most 2 MiB.
    """
    read = manifests.withColumn("nodes", json_nodes("document"))
    nodes = F.col("nodes")
    value = lambda path: F.get(F.filter(nodes, lambda n: n.path == path), F.lit(0)).text
    size = F.aggregate(F.filter(nodes, lambda n: (n.pattern == "$.documents[*].response_bytes") & (n.kind == "integer")), F.lit(0).cast("double"), lambda a, n: a + n.text.cast("double"))
    bound = F.lit(True)
    for c in _BOUND:
        bound = bound & value(f"$.{c}").eqNullSafe(F.col(c).cast("string"))
    failure = lambda test, code: F.when(test, F.struct(F.lit(code).alias("code"), F.lit("$").alias("path")))
    known = nodes.isNotNull()
    own = F.array_compact(F.array(failure(~known, "json"), failure(~F.coalesce(F.sha2("document", 256) == F.col("document_hash"), F.lit(False)), "hash"), failure(known & ~bound, "binding"), failure(known & (size > 2 * 1024 * 1024), "size")))
    twice = F.transform(duplicate_keys(nodes), lambda p: F.struct(F.lit("duplicate_key").alias("code"), p.alias("path")))
    across = read.select(F.col("manifest_id").alias("id"), F.explode(F.concat(own, F.coalesce(twice, F.array().cast("array<struct<code:string,path:string>>")))).alias("f")).select("id", "f.code", "f.path")
    each = broken_rules(read.where(known).select(F.col("manifest_id").alias("id"), F.lit("manifest").alias("contract"), "nodes"), {"manifest": MANIFEST})
    return across.unionByName(each).withColumnRenamed("id", "manifest_id")


def current_route(claims: DataFrame, profiles: DataFrame, policies: DataFrame, versions: DataFrame) -> DataFrame:
    """``claim_id, route, version_id, code`` of ``claim_id, source_id, activation_generation``.

    ``lost`` where activation changed since the claim; ``legacy`` without an active version; ``blocked`` with ``schema_stale``,
    ``policy_unavailable`` or ``invalid_schema``; else ``schema``. ``profiles``: ``source_id, activation_generation, active_version_id,
    active_source_generation, source_generation``; ``policies``: ``source_id, state``; ``versions``: ``version_id, recipe, recipe_hash, valid``.
    """
    asked = claims.select("claim_id", "source_id", F.col("activation_generation").alias("claimed"))
    own = versions.select(F.col("version_id").alias("active_version_id"), (F.col("valid") & (F.sha2("recipe", 256) == F.col("recipe_hash"))).alias("sound"))
    both = asked.join(profiles, "source_id", "left").join(policies.select("source_id", F.col("state").alias("policy")), "source_id", "left").join(own, "active_version_id", "left")
    code = (
        F.when(F.coalesce("activation_generation", F.lit(0)) != F.col("claimed"), "lost")
        .when(F.col("active_version_id").isNull(), None)
        .when(~F.col("active_source_generation").eqNullSafe(F.col("source_generation")), "schema_stale")
        .when(~F.col("policy").eqNullSafe("effective"), "policy_unavailable")
        .when(~F.coalesce("sound", F.lit(False)), "invalid_schema")
    )
    route = F.when(code == "lost", "lost").when(code.isNotNull(), "blocked").when(F.col("active_version_id").isNull(), "legacy").otherwise("schema")
    return both.select("claim_id", route.alias("route"), F.when(route == "schema", F.col("active_version_id")).alias("version_id"), code.alias("code"))


def usable_reports(reports: DataFrame, current: DataFrame, as_of: datetime, days: int = 7, most: int = 20) -> DataFrame:
    """``version_id, report_id``: ready reports with a policy, not older than ``days``, made from what is current, of the ``most`` newest ready ones of a version.

    ``reports``: ``report_id, version_id, status, has_policy, created_at, generation, source_fingerprint, recipe_hash, engine_version``;
    ``current``: one row for each version with the last four as they are now and ``is_active, policy_matches``.
    """
    names = ("generation", "source_fingerprint", "recipe_hash", "engine_version")
    ready = reports.where("status = 'ready'").withColumn("n", F.row_number().over(Window.partitionBy("version_id").orderBy(F.desc("report_id")))).where(F.col("n") <= most)
    now = current.select("version_id", "is_active", "policy_matches", *[F.col(c).alias(f"now_{c}") for c in names])
    both = ready.join(now, "version_id").where("has_policy and is_active and policy_matches").where(F.col("created_at") >= moment(as_of) - F.make_dt_interval(F.lit(days)))
    for c in names:
        both = both.where(F.col(c).eqNullSafe(F.col(f"now_{c}")))
    return both.select("version_id", "report_id")
