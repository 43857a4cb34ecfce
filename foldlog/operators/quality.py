"""Checks and counts over logs, and per-session telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import has_key
from ..sources.stored import stored

#: Rows of a key, times calls, that throttle folds as one array; keys of more are hot.
FOLD = 4096
#: Keys that a payload of each type must have, as stored logs do.
REQUIRED = {
    "ApplicationSubmitted": ("application_id", "applicant_id", "requested_amount_usd"), "CreditAnalysisCompleted": ("application_id", "risk_tier", "model_version"),
    "FraudScreeningCompleted": ("application_id", "fraud_score"), "ComplianceRulePassed": ("application_id", "rule_id"), "ComplianceRuleFailed": ("application_id", "rule_id"),
    "DecisionGenerated": ("application_id", "recommendation", "model_versions"), "HumanReviewCompleted": ("application_id", "reviewer_id", "final_decision"),
    "ApplicationApproved": ("application_id", "approved_amount_usd"), "ApplicationDeclined": ("application_id",), "AgentContextLoaded": ("agent_id", "session_id", "model_version"),
    "CreditAnalysisRequested": ("application_id",), "FraudScreeningRequested": ("application_id",), "ComplianceCheckRequested": ("application_id",)}


def validate_schema(log: DataFrame) -> DataFrame:
    """Events that don't hold: global_position, event_type and error (unknown_type, or missing and the first key that is)."""
    error = F.when(~F.col("event_type").isin(list(REQUIRED)), "unknown_type")
    for name, keys in REQUIRED.items():
        for k in keys:
            error = error.when((F.col("event_type") == name) & ~has_key(F.col("payload"), k), f"missing {k}")
    return log.withColumn("error", error).where("error is not null").select("global_position", "event_type", "error")


#: Kinds of values by key, wherever a payload has it; others may be anything.
KINDS = {
    **dict.fromkeys(("application_id", "applicant_id", "agent_id", "session_id", "rule_id", "risk_tier", "recommendation", "model_version", "reviewer_id", "final_decision", "orchestrator_agent_id"), "string"),
    **dict.fromkeys(("requested_amount_usd", "approved_amount_usd", "confidence_score", "fraud_score", "recommended_limit_usd", "analysis_duration_ms"), "number"),
    "override": "boolean", "contributing_agent_sessions": "array", "required_rules": "array", "model_versions": "object"}
#: What schema_of_variant calls each kind. A number may be written as a string that reads as one.
_NAMES = {"string": "STRING", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def typed_errors(log: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Each fault of each event: global_position, event_type, field and error (unknown_type, not_an_object, missing, or not_a_ and the kind).

    The payload is parsed once, to a variant; a JSON null counts as missing where the key is required, and as no value elsewhere.
    """
    e = log.select("global_position", "event_type", F.try_parse_json("payload").alias("v"))
    shape = F.schema_of_variant("v")
    t, value = F.col("event_type"), lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    fault = lambda field, error: F.struct(F.lit(field).alias("field"), F.lit(error).alias("error"))
    known, found = t.isin(list(required)), []
    for k in sorted({k for keys in required.values() for k in keys} | set(kinds)):
        needs = t.isin([name for name, keys in required.items() if k in keys])
        kind = F.schema_of_variant(value(k))
        absent = value(k).isNull() | (kind == "VOID")
        found.append(F.when(needs & absent, fault(k, "missing")))
        if k in kinds:
            fits = kind.rlike(f"^({_NAMES[kinds[k]]})$")
            if kinds[k] == "number":
                fits = fits | (kind.eqNullSafe("STRING") & F.try_variant_get("v", f"$.{k}", "string").try_cast("double").isNotNull())
            found.append(F.when(~absent & ~fits, fault(k, f"not_a_{kinds[k]}")))
    faults = F.when(~known, F.array(fault(None, "unknown_type"))).when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), F.array(fault(None, "not_an_object"))).otherwise(F.array_compact(F.array(*found)))
    return e.select("global_position", "event_type", F.explode(faults).alias("f")).select("global_position", "event_type", F.col("f.field").cast("string").alias("field"), "f.error")


def schema_report(log: DataFrame, first: int = 10) -> DataFrame:
    """One row: valid and faulty events, counts by event type and by stream prefix (maps), and the first faults by position."""
    errors = typed_errors(log).checkpoint()
    bad = errors.agg(F.count_distinct("global_position").alias("faulty"))
    head = errors.orderBy("global_position", "field", "error").limit(first).agg(F.array_sort(F.collect_list(F.struct("global_position", "event_type", "field", "error"))).alias("first_errors"))
    counts = log.groupBy("event_type", F.split("stream_id", "-")[0].alias("prefix")).agg(F.count("*").alias("n"))
    by = lambda c: counts.groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"), F.sum("n").alias("events"))
    # single rows
    out = bad.crossJoin(head).crossJoin(by("event_type")).crossJoin(by("prefix").drop("events"))
    return out.select((F.coalesce("events", F.lit(0)) - F.col("faulty")).alias("valid"), "faulty", "by_event_type", "by_prefix", "first_errors")


def event_type_counts(log: DataFrame, top: int = 8) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(top)


def version_distribution(log: DataFrame) -> DataFrame:
    """Per type and version: count, oldest, newest and percent of the type."""
    per = log.groupBy("event_type", "event_version").agg(F.count("*").alias("n"), F.min("recorded_at").alias("oldest"), F.max("recorded_at").alias("newest"))
    return per.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("event_type")), 1))


def dwell_times(log: DataFrame) -> DataFrame:
    """Seconds from each event of a stream to the next, summed and counted per type."""
    gap = F.lead("recorded_at").over(W.partitionBy("stream_id").orderBy("stream_position"))
    e = log.withColumn("s", F.timestamp_diff("SECOND", F.col("recorded_at"), gap))
    return e.where("s is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("s").alias("total_s"), F.max("s").alias("longest_s"))


def session_sequence_check(log: DataFrame, first: str, last: str, needed: list[str]) -> DataFrame:
    """Per stream: whether it begins and ends with the given types and holds the needed ones."""
    t = F.col("event_type")
    return log.groupBy("stream_id").agg(
        (F.min_by("event_type", "stream_position") == first).alias("begins"), (F.max_by("event_type", "stream_position") == last).alias("ends"),
        *(F.bool_or(t == n).alias(f"has_{n}") for n in needed))


def session_totals(nodes: DataFrame) -> DataFrame:
    """Per session: nodes, model calls, tokens, cost (6 decimals) and duration. nodes: session_id, llm_called, tokens_in, tokens_out, duration_ms."""
    cost = F.col("tokens_in") / 1e6 * 3 + F.col("tokens_out") / 1e6 * 15
    return nodes.groupBy("session_id").agg(
        F.count("*").alias("nodes"), F.count_if("llm_called").alias("llm_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum(cost), 6).alias("cost"), F.sum("duration_ms").alias("duration_ms"))


def throttle(df: DataFrame, key: str, ts: str, calls: int = 1, period_s: float = 60.0) -> DataFrame:
    """df (with ord, which tells a key's rows apart) with allowed: fewer than calls allowed rows of the key in the trailing period.

    Rows of a key are judged in order of time and ord; ts is a timestamp or seconds. A key of few rows is folded as an array. In a hot
    key a limit of n calls is n servers of one call, of which each row takes the first that is free: a server's calls are those that a limit
    of one allows of the rows left by the servers before it. A server's call points to the first moment a period later, found within the
    moments of one period, and pointers double, so a chain takes the logarithm of its length in rounds. A null key is a key of its own; a
    null time isn't allowed.
    """
    if calls < 1 or period_s <= 0:
        raise ValueError("throttle takes one call at least and a period above 0")
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 if df.schema[ts].dataType.typeName().startswith("timestamp") else F.col(ts).cast("double")
    rows = df.select(F.struct(F.col(key).alias("key")).alias("k"), seconds.alias("t"), "ord").where("t is not null")
    # of a moment's rows only so many can be allowed: the rank is limited before the shuffle
    first = stored(rows.withColumn("rank", F.row_number().over(W.partitionBy("k", "t").orderBy("ord"))).where(F.col("rank") <= calls))
    hot = stored(first.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") * calls > FOLD).select("k"))
    allowed = _in_turn(first.join(hot, "k", "left_anti"), calls, period_s)
    if not hot.isEmpty():
        allowed = allowed.unionByName(_by_servers(first.join(hot, "k", "left_semi"), calls, period_s))
    allowed = allowed.withColumn("yes", F.lit(True)).alias("a")
    out = df.alias("d").join(allowed, (F.struct(F.col(f"d.`{key}`").alias("key")) == F.col("a.k")) & (F.col("d.ord") == F.col("a.ord")), "left")
    return out.select("d.*", F.coalesce("a.yes", F.lit(False)).alias("allowed"))


def _in_turn(rows: DataFrame, calls: int, period: float) -> DataFrame:
    """k and ord of the rows that are allowed, each key's one after the other: an array of a key's rows, of which the last calls are kept."""
    state = lambda recent, yes: F.struct(recent.alias("recent"), yes.alias("yes"))

    def step(m, x):
        busy = F.filter(m["recent"], lambda at: at + period > x["t"])
        return F.when(F.size(busy) < calls, state(F.concat(busy, F.array(x["t"])), F.concat(m["yes"], F.array(x["ord"])))).otherwise(m)

    none = state(F.array().cast("array<double>"), F.array().cast(f"array<{rows.schema['ord'].dataType.simpleString()}>"))
    own = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "ord"))).alias("own"))
    return own.select("k", F.explode(F.aggregate("own", none, step)["yes"]).alias("ord"))


def _by_servers(rows: DataFrame, calls: int, period: float) -> DataFrame:
    """The same for keys of any size: rows with their rank among those of a moment, one server after the other."""
    moments = rows.groupBy("k", "t").agg(F.count("*").alias("n")).withColumn("taken", F.lit(0)).checkpoint()
    for _ in range(calls):
        called = _one_call(moments.where("taken < n").select("k", "t"), period).withColumn("more", F.lit(1))
        moments = moments.join(called, ["k", "t"], "left").select("k", "t", "n", (F.col("taken") + F.coalesce("more", F.lit(0))).alias("taken")).checkpoint()
    return rows.join(moments.where("taken > 0"), ["k", "t"]).where("rank <= taken").select("k", "ord")


def _one_call(moments: DataFrame, period: float) -> DataFrame:
    """Of each k's moments t (distinct) those that a limit of one call a period allows."""
    bucket = lambda at: F.floor(at / period)
    free = moments.select("k", bucket(F.col("t")).alias("b"), F.col("t").alias("at"), F.col("t").alias("own"), F.lit(None).cast("double").alias("of"))
    ends = moments.select("k", bucket(F.col("t") + period).alias("b"), (F.col("t") + period).alias("at"), F.lit(None).cast("double").alias("own"), F.col("t").alias("of"))
    both = free.unionByName(ends)
    here = both.withColumn("to", F.min("own").over(W.partitionBy("k", "b").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, W.currentRow)))
    # one row a period: the first moment after it
    later = both.groupBy("k", "b").agg(F.min("own").alias("own")).select("k", "b", F.min("own").over(W.partitionBy("k").orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)).alias("later"))
    jumps = here.where("of is not null").join(later, ["k", "b"]).select("k", "of", F.coalesce("to", "later").alias("to")).where("to is not null").checkpoint()
    allowed = moments.groupBy("k").agg(F.min("t").alias("t"))
    while not jumps.isEmpty():
        reached = allowed.join(jumps.withColumnRenamed("of", "t"), ["k", "t"]).select("k", F.col("to").alias("t"))
        allowed = allowed.unionByName(reached).checkpoint()
        next_ = jumps.select("k", F.col("of").alias("to"), F.col("to").alias("_to"))
        jumps = jumps.join(next_, ["k", "to"]).select("k", "of", F.col("_to").alias("to")).checkpoint()
    return allowed
