"""Commands judged against the log and against what earlier commands of the same batch wrote: an ordered fold for each application.

Sessions are decided first, for all commands at once, since only their own opening creates them. An application's commands then pass
in order; the fold keeps the application's state, never its rows. A command moves once, to its application (twice, if it needs its
session): what the fold doesn't read goes along as one JSON text, so that verdicts need not be joined to their commands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructField, StructType

from ..functions.expressions import by_category, clean_app_id, typed
from ..schema import CONFIDENCE_FLOOR
from ..sources.stored import dealt, stored
from .aggregates import compliance_record, loan_state
from .outcomes import COMMANDS, RULES, command_events, command_rules
from .rules import ALLOWED_FROM, rule_errors

#: Columns of a command that are read; absent ones count as null.
COMMAND_DDL = (
    "ord long, command string, application_id string, applicant_id string, requested_amount_usd double, document_id string, file_path string, document_type string, "
    "agent_id string, session_id string, model_version string, context_source string, context_token_count int, risk_tier string, confidence_score double, "
    "recommended_limit_usd double, reasoning string, analysis_duration_ms double, fraud_score double, screening_result string, flags array<string>, "
    "rule_id string, status string, failure_reason string, regulation_set string, required_rules array<string>, recommendation string, "
    "contributing_agent_sessions array<string>, reviewer_id string, final_decision string, `override` boolean, override_reason string, approved_amount_usd double, reason string")
#: What names a command; its other columns are packed.
_PLAIN = ("ord", "command", "application_id", "agent_id", "session_id", "model_version")
_PASSED = "ord long, command string, application_id string, agent_id string, session_id string, model_version string, rest string"
_VERDICT = "accepted boolean, error_type string, message string, suggested_action string, effective string, models string, clears boolean"
#: The columns that the fold reads, and the commands for which it does.
_READ = {"confidence_score": "generate_decision", "recommendation": "generate_decision", "rule_id": "record_compliance", "status": "record_compliance", "final_decision": "record_review", "override": "record_review"}
_MUST_EXIST = ("upload_document", "request_credit", "record_fraud", "request_compliance", "record_compliance")
_IN_SESSION = ("record_credit", "record_fraud", "generate_decision")


def session_key() -> Column:
    return F.concat_ws("-", F.lit("agent"), "agent_id", "session_id")


def _command_types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.sparkSession.createDataFrame([], COMMAND_DDL).schema}


def with_defaults(commands: DataFrame) -> DataFrame:
    """All columns of COMMAND_DDL, defaults filled in (a compliance request asks for its whole set), and the bare application id."""
    names = _command_types(commands)
    have = set(commands.columns)
    out = commands.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in names.items()))
    defaults = {"screening_result": "PASS", "regulation_set": "EU-AI-ACT-2025", "context_source": "MLflow Registry", "context_token_count": 1024, "document_type": "LOAN_APPLICATION_PDF", "analysis_duration_ms": 0.0, "override": False}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}).withColumn("application_id", clean_app_id(F.col("application_id")))
    asked = F.col("required_rules")
    for name, rules in RULES.items():
        asked = F.when((F.coalesce(F.size("required_rules"), F.lit(0)) < 1) & (F.col("regulation_set") == name), F.array(*map(F.lit, rules))).otherwise(asked)
    return out.withColumn("required_rules", F.when(F.col("command") == "request_compliance", asked))


def validated(commands: DataFrame) -> DataFrame:
    """commands with error, the first of each command's rules that fails (null: none)."""
    first = F.lit(None)
    for name in COMMANDS:
        first = F.when(F.col("command") == name, F.get(rule_errors(command_rules(name)), F.lit(0))).otherwise(first)
    unknown = F.struct(F.lit("VALIDATION_ERROR").alias("error_type"), F.concat(F.lit("Unknown command '"), F.coalesce("command", F.lit("")), F.lit("'.")).alias("message"), F.lit("").alias("suggested_action"))
    return commands.withColumn("error", F.when(F.coalesce(F.col("command").isin(*COMMANDS), F.lit(False)), first).otherwise(unknown))


def sessions_of(commands: DataFrame, log: DataFrame) -> DataFrame:
    """session, opened (ord; -1: the log has it), begins (its first event loads a context), model: of every session of log and commands.

    Of several openings the first valid one counts.
    """
    e = typed(by_category(log, "agent-"))
    known = e.groupBy(F.col("stream_id").alias("session")).agg(
        F.lit(-1).cast("long").alias("opened"), (F.min_by("event_type", "stream_position") == "AgentContextLoaded").alias("begins"),
        F.max_by(F.when(F.col("event_type") == "AgentContextLoaded", F.col("p")["model_version"]), F.when(F.col("event_type") == "AgentContextLoaded", F.col("stream_position"))).alias("model"))
    opens = commands.where("command = 'start_session' and error is null").groupBy(session_key().alias("session")).agg(
        F.min("ord").alias("opened"), F.lit(True).alias("begins"), F.min_by("model_version", "ord").alias("model"))
    return known.unionByName(opens).groupBy("session").agg(
        F.min("opened").alias("opened"), F.min_by("begins", "opened").alias("begins"), F.min_by("model", "opened").alias("model"))


def applications_of(log: DataFrame) -> DataFrame:
    """application_id with its state, flags and rule results, and the sessions (agent, model) that worked on it, as log has them."""
    loans = loan_state(log).select(
        F.regexp_replace("stream_id", "^loan-", "").alias("application_id"), F.lit(True).alias("exists"), "state", "has_human_override", (F.size("model_versions") > 0).alias("analysed"))
    rules = compliance_record(log).select(F.regexp_replace("stream_id", "^compliance-", "").alias("application_id"), "passed", "failed", "required")
    e, p = typed(by_category(log, "agent-")), F.col("p")
    models = e.where("event_type = 'AgentContextLoaded'").groupBy("stream_id").agg(F.max_by(p["model_version"], "stream_position").alias("model"), F.max_by(p["agent_id"], "stream_position").alias("agent"))
    work = e.where(F.col("event_type").isin("CreditAnalysisCompleted", "FraudScreeningCompleted", "DecisionGenerated") & p["application_id"].isNotNull())
    done = work.select("stream_id", clean_app_id(p["application_id"]).alias("application_id")).distinct().join(models, "stream_id", "left").groupBy("application_id").agg(
        F.collect_list(F.struct(F.col("stream_id").alias("session"), "agent", "model")).alias("worked"))
    return loans.join(rules, "application_id", "full_outer").join(done, "application_id", "full_outer")


class _Application:
    """What the guards read of one application."""

    def __init__(self, known: str | None):
        row = json.loads(known) if known else {}
        self.exists, self.state = row.get("exists") is True, row.get("state") or "SUBMITTED"
        self.override, self.analysed = row.get("has_human_override") is True, row.get("analysed") is True
        self.results = {r: True for r in row.get("passed") or []} | {r: False for r in row.get("failed") or []}
        self.required = set(row.get("required") or [])
        self.passed = self._all_passed() if self.results else False
        self.worked = {w["session"]: (w.get("agent"), w.get("model")) for w in row.get("worked") or []}

    def _all_passed(self) -> bool:
        return all(self.results.get(r) for r in self.required) if self.required else bool(self.results) and all(self.results.values())

    def record(self, rule: str, ok: bool) -> bool:
        """Notes a result; whether all has passed just now."""
        before, self.results[rule] = self.passed, ok
        self.passed = self._all_passed()
        return self.passed and not before


def _judge(app: _Application, c) -> tuple[tuple[str, str, str] | None, str | None, dict | None, bool]:
    """Error or None, the recommendation that counts, models of a decision, whether compliance clears; moves app on if there is no error."""
    command, known, named = c.command, isinstance(c.model, str) or c.opened == c.opened, json.loads(c.named) if c.named else []
    in_time = known and c.opened < c.ord
    domain = lambda say, do="": (("DOMAIN_RULE_VIOLATION", say, do), None, None, False)
    if command in ("record_credit", "record_fraud"):
        if not in_time:
            return ("RESOURCE_NOT_FOUND", f"AgentSession {c.session} not found.", "Verify the ID and try again."), None, None, False
        if c.begins is not True:
            return ("VALIDATION_ERROR", "AgentSession has no AgentContextLoaded event.", "Call start_agent_session first."), None, None, False
    if command in _MUST_EXIST and not app.exists:
        return ("RESOURCE_NOT_FOUND", f"Loan application loan-{c.application_id} not found.", "Verify the ID and try again."), None, None, False
    if command == "submit_application":
        if app.exists:
            return ("VALIDATION_ERROR", f"Application {c.application_id} already exists.", "Use a unique application_id."), None, None, False
        app.exists = True
    kind = {"record_credit": "CreditAnalysisCompleted", "record_compliance": "ComplianceRulePassed", "generate_decision": "DecisionGenerated", "record_review": "HumanReviewCompleted"}.get(command)
    wrong = kind and app.state not in ALLOWED_FROM[kind]
    if command == "record_credit" and app.analysed and not app.override:
        return domain("A further analysis needs a human override.", "A HumanReviewCompleted with override=True is required.")
    if command == "generate_decision":
        if not in_time or c.begins is not True:
            return domain(f"Session {c.session} has no loaded context.", "Ensure AgentContextLoaded is the first event on this session.")
        strange = next((s for s in named if s not in app.worked), None)
        if strange is not None:
            return domain(f"Session {strange} did not process application loan-{c.application_id}.", "Only include sessions that recorded analysis for this loan.")
    if wrong:
        name = "Compliance event" if command == "record_compliance" else kind
        return domain(f"{name} invalid from state {app.state}")
    if command == "approve" and not app.passed:
        return domain(f"ApplicationApproved blocked for loan-{c.application_id}: compliance has not passed.", "Ensure all ComplianceRulePassed events are recorded first.")
    effective, models, clears = None, None, False
    if command == "request_credit":
        app.state = "AWAITING_ANALYSIS"
    elif command == "record_credit":
        app.state, app.analysed = "ANALYSIS_COMPLETE", app.analysed or bool(c.model)
    elif command == "request_compliance":
        app.state = "COMPLIANCE_REVIEW"
        app.required = set(named) or app.required
    elif command == "record_compliance":
        clears = app.record(c.rule_id, c.status == "PASSED")
        app.state = "PENDING_DECISION" if clears else app.state
    elif command == "generate_decision":
        effective = "REFER" if c.confidence_score < CONFIDENCE_FLOOR else c.recommendation
        models = {a: m for a, m in (app.worked[s] for s in named) if a and m} | {c.agent_id: c.model or "unknown"}
        app.state = {"APPROVE": "APPROVED_PENDING_HUMAN", "DECLINE": "DECLINED_PENDING_HUMAN"}.get(effective, "REFERRED")
    elif command == "record_review":
        app.override = c.override is True
        app.state = {"APPROVE": "FINAL_APPROVED", "DECLINE": "FINAL_DECLINED"}.get(c.final_decision, app.state)
    elif command in ("approve", "decline"):
        app.state, app.exists = "FINAL_APPROVED" if command == "approve" else "FINAL_DECLINED", True
    if command in _IN_SESSION:
        app.worked[c.session] = (c.agent_id, c.model)
    return None, effective, models, clears


def _packed(commands: DataFrame, events_only: bool) -> DataFrame:
    """Valid and invalid commands: what names them, what the fold reads, error, and in rest, as JSON, their other columns.

    events_only: in rest and model_version those alone that the command's event holds.
    """
    rows, command = validated(with_defaults(commands)), F.col("command")
    holders = {c: [n for n, (_, _, _, fields) in COMMANDS.items() if c in {f[1] if isinstance(f, tuple) else f for f in fields}] for c in rows.columns}
    for c in ("status", "failure_reason"):
        holders[c] = ["record_compliance"]
    held = lambda c: (F.when(command.isin(*holders[c]), F.col(c)) if events_only else F.col(c)).alias(c)
    rest = F.to_json(F.struct(*(held(c) for c in rows.columns if c not in _PLAIN and c != "error" and (holders[c] or not events_only))))
    # lists and states go to Python as JSON: Spark measures an Arrow batch anew with each row, which for a column of lists takes a pass over the batch
    listed = F.when(command == "generate_decision", F.to_json("contributing_agent_sessions")).when(command == "request_compliance", F.to_json("required_rules"))
    return rows.select(
        *(held(c) if c == "model_version" else F.col(c) for c in _PLAIN), *(F.when(command == n, F.col(c)).alias(c) for c, n in _READ.items()), listed.alias("named"), "error", rest.alias("rest"))


def _unpacked(judged: DataFrame) -> DataFrame:
    """judged with the columns of COMMAND_DDL in place of rest, and model_versions in place of models."""
    types = _command_types(judged)
    p = F.from_json("rest", StructType([StructField(c, t) for c, t in types.items() if c not in _PLAIN]))
    verdict = [c for c in judged.columns if c not in (*_PLAIN, "rest", "models")]
    return judged.withColumn("p", p).select(
        *(F.col(c) if c in _PLAIN else F.col("p")[c].alias(c) for c in types), *verdict, F.from_json("models", "map<string,string>").alias("model_versions"))


def _judged(own: DataFrame, log: DataFrame, events_only: bool) -> DataFrame:
    """_PLAIN and rest of each packed command, and its verdict; model_version is the session's where the command has none (events_only: for its event)."""
    sessions = stored(sessions_of(own, log))
    rows = own.withColumn("session", F.when(F.col("agent_id").isNotNull() & F.col("session_id").isNotNull(), session_key()))
    met = lambda df: df.join(sessions, "session", "left")
    unmet = lambda df: df.withColumns({"session": F.lit(None).cast("string"), "opened": F.lit(None).cast("long"), "begins": F.lit(None).cast("boolean"), "model": F.lit(None).cast("string")})
    version = F.coalesce("model_version", "model").alias("model_version")
    plain = [version if c == "model_version" else c for c in _PLAIN]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("effective", "models")] + [F.lit(None).cast("boolean").alias("clears")]

    error = lambda f: F.col(f"error.{f}").alias(f)
    bad = rows.where("error is not null")
    failed = (unmet(bad) if events_only else met(bad)).select(*plain, "rest", F.lit(False).alias("accepted"), error("error_type"), error("message"), error("suggested_action"), *nothing)
    twice = F.col("opened") != F.col("ord")
    opened = met(rows.where("error is null and command = 'start_session'")).select(*plain, "rest", (~twice).alias("accepted"), F.when(twice, "VALIDATION_ERROR").alias("error_type"), F.when(twice, F.concat(
        F.lit("Session "), "session_id", F.lit(" for agent "), "agent_id", F.lit(" already exists."))).alias("message"), F.when(twice, "Use a unique session_id.").alias("suggested_action"), *nothing)

    # the commands that need no session don't move to it
    good, asks = rows.where("error is null and command != 'start_session'"), F.col("command").isin(*_IN_SESSION)
    asks = asks if events_only else asks | F.col("model_version").isNull()
    work = met(good.where(asks)).unionByName(unmet(good.where(~asks))).select(
        *plain, "rest", "session", "opened", "begins", "model", *_READ, "named", F.lit(None).cast("string").alias("known"))
    # an application's state in the log is a row of its own before its commands, so hot applications move it once
    states = applications_of(log).where("application_id is not null")
    states = states.select(F.lit(0).cast("long").alias("ord"), "application_id", F.to_json(F.struct(*(c for c in states.columns if c != "application_id"))).alias("known"))
    passed, verdict = ([f.split()[0] for f in ddl.split(", ")] for ddl in (_PASSED, _VERDICT))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, app = None, None
        for pdf in batches:
            out = []
            for c in pdf.itertuples(index=False):
                if app is None or c.application_id != now:
                    now, app = c.application_id, _Application(c.known)
                if c.known:
                    continue
                wrong, effective, models, clears = _judge(app, c)
                out.append((wrong is None, *(wrong or (None,) * 3), effective, models and json.dumps(models), clears))
            mine = pdf.loc[pdf["known"].isna(), passed]
            said = pd.DataFrame(out, columns=verdict, index=mine.index).astype({c: bool if c in ("accepted", "clears") else object for c in verdict})
            yield pd.concat([mine, said], axis=1)

    moved = dealt(work.unionByName(states, allowMissingColumns=True), "application_id")
    folded = moved.sortWithinPartitions("application_id", F.col("known").isNull(), "ord").mapInPandas(fold, f"{_PASSED}, {_VERDICT}")
    return folded.unionByName(failed).unionByName(opened)


def judge_commands(commands: DataFrame, log: DataFrame) -> DataFrame:
    """commands (COMMAND_DDL; ord is unique) with accepted, error_type, message, suggested_action, and what acceptance settles.

    effective: a decision's recommendation after the confidence floor. model_versions: of a decision. clears: whether a rule's result
    makes compliance pass. model_version: the session's. Each command meets what those before it, by ord, have written.
    A first failing rule of the command's own fields is a VALIDATION_ERROR, what it names and isn't there RESOURCE_NOT_FOUND, a broken
    business rule DOMAIN_RULE_VIOLATION. Commands without application are decided by their sessions alone.
    """
    return _unpacked(_judged(stored(_packed(commands, False)), log, False))


def admit_commands(commands: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accepted events (ord, stream_id, stream_position, event_type, event_version, payload) and rejected commands (ord, command, error_type, message, suggested_action)."""
    judged = stored(_judged(stored(_packed(commands, True)), log, True))
    events = None
    for name in COMMANDS:
        ok = _unpacked(judged.where(F.col("accepted") & (F.col("command") == name)))
        own = command_events(ok.withColumn("recommendation", F.coalesce("effective", "recommendation")), name, "ord")
        events = own if events is None else events.unionByName(own)
    heads = log.groupBy("stream_id").agg(F.max("stream_position").alias("head"))
    return _positioned(events, heads), judged.where("not accepted").select("ord", "command", "error_type", "message", "suggested_action")


def _positioned(events: DataFrame, heads: DataFrame) -> DataFrame:
    at = F.row_number().over(W.partitionBy("stream_id").orderBy("ord", "k"))
    return events.withColumn("n", at).join(heads, "stream_id", "left").select(
        "ord", "stream_id", (F.coalesce("head", F.lit(0)) + F.col("n")).cast("long").alias("stream_position"), "event_type", "event_version", "payload")
