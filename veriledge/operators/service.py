"""Service logs: latency histograms, circuit breakers, rate limits, SLO alerts."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, with_violations
from veriledge.operators.ordered import Machine, ordered_fold


def bucket_label(edge: float) -> str:
    return repr(edge)


def latency_histogram(requests: DataFrame, duration: str = "duration_seconds",
                      keys: tuple[str, ...] = ("method", "route")) -> DataFrame:
    """Cumulative buckets, count and sum in one pass, long form (keys, le, value)."""
    wide = requests.groupBy(*keys).agg(
        *[F.count_if(F.col(duration) <= edge).alias(f"le_{i}")
          for i, edge in enumerate(S.LATENCY_BUCKETS)],
        F.count(F.lit(1)).alias("n"), F.sum(duration).alias("total"))
    return histogram_rows(wide, keys)


def histogram_rows(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    cells = [F.struct(F.lit("bucket").alias("series"), F.lit(bucket_label(edge)).alias("le"),
                      F.col(f"le_{i}").cast("double").alias("value"))
             for i, edge in enumerate(S.LATENCY_BUCKETS)]
    cells += [F.struct(F.lit(series).alias("series"), F.lit(le).alias("le"),
                       F.col(source).cast("double").alias("value"))
              for series, le, source in (("bucket", "+Inf", "n"), ("count", "", "n"),
                                         ("sum", "", "total"))]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by method, route and status."""
    return requests.groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("requests"))


CIRCUIT_OUTPUT = S.flat(
    "verdict string, prior_state string, next_state string, event_type string, "
    "reason string, failures bigint, opened_at double, probe_operation_id string, "
    "probe_started_at double")


def circuit_machine(threshold: int = 3, cooldown: float = 60.0, probe_timeout: float = 900.0
                    ) -> Machine:
    """Closed, open, half open. State: name, failures, opened at, probe id, probe start."""
    if threshold < 1 or cooldown <= 0 or probe_timeout <= 0:
        raise ValueError("circuit threshold and timeouts must be positive")

    def start(_row):
        return ["CLOSED", 0, None, None, None]

    def admit(state, operation, now):
        name, failures, opened, _, began = state
        if name == "CLOSED":
            return state, "admitted", None, None
        if name == "HALF_OPEN":
            if now - (began or 0) >= probe_timeout:
                return (["OPEN", failures, now, None, None], "rejected", "probe_expired",
                        "probe_lease_expired")
            return state, "rejected", None, None
        if now - (opened or 0) < cooldown:
            return state, "rejected", None, None
        return (["HALF_OPEN", failures, opened, operation, now], "admitted", "probe_admitted",
                "recovery_timeout_elapsed")

    def settle(state, operation, now, ok, reason):
        name, failures, _, probe, _ = state
        if name == "HALF_OPEN" and probe != operation:
            return state, "foreign_probe", None, None
        if name == "OPEN":
            return state, ("success_while_open" if ok else "ignored"), None, None
        if ok:
            changed = name != "CLOSED" or failures != 0
            return (["CLOSED", 0, None, None, None], "recorded",
                    "call_succeeded" if changed else None,
                    "provider_success" if changed else None)
        failures += 1
        opens = name == "HALF_OPEN" or failures >= threshold
        return (["OPEN" if opens else "CLOSED", failures, now if opens else None, None, None],
                "recorded", "call_failed", reason)

    def step(state, row):
        kind, operation, now = row["kind"], row["operation_id"], row["at"]
        prior = state[0]
        if kind == "before":
            state, verdict, event, reason = admit(state, operation, now)
        else:
            state, verdict, event, reason = settle(state, operation, now, kind == "success",
                                                   row["reason_code"])
        return state, (verdict, prior, state[0], event, reason, *state[1:])

    return Machine(start, step, ("kind", "operation_id", "at", "reason_code"), CIRCUIT_OUTPUT)


def circuit_states(log: DataFrame, order: list[str], threshold: int = 3, cooldown: float = 60.0,
                   probe_timeout: float = 900.0, partitions: int | None = None) -> DataFrame:
    """Replay of a call-outcome log: circuit_id, operation_id, kind (before, success,
    failure), reason_code, at."""
    return ordered_fold(log, ["circuit_id"], order,
                        circuit_machine(threshold, cooldown, probe_timeout), partitions)


def circuit_snapshot(replayed: DataFrame, order: list[str]) -> DataFrame:
    """Latest state and number of events per circuit."""
    state = F.struct("next_state", "failures", "opened_at", "probe_operation_id",
                     "probe_started_at")
    return replayed.groupBy("circuit_id").agg(
        F.max_by(state, F.struct(*order)).alias("s"),
        F.count("event_type").alias("events")).select(
        "circuit_id", F.col("s.next_state").alias("state"),
        F.col("s.failures").alias("consecutive_failures"),
        F.col("s.opened_at").alias("opened_at"),
        F.col("s.probe_operation_id").alias("probe_operation_id"),
        F.col("s.probe_started_at").alias("probe_started_at"), "events")


def circuit_events(replayed: DataFrame) -> DataFrame:
    """The state changes of each circuit."""
    return replayed.where(F.col("event_type").isNotNull()).select(
        "circuit_id", "operation_id", "event_type", "prior_state", "next_state",
        F.col("reason").alias("reason_code"), F.col("at").alias("occurred_at"))


TOKEN_OUTPUT = S.flat("allowed boolean, retry_after bigint, tokens_left double")


def token_bucket_machine(per_minute: int = 600, burst: int = 100) -> Machine:
    """State: tokens left, time of the last request."""
    if per_minute < 1 or burst < 1:
        raise ValueError("rate and burst must be positive")
    rate = per_minute / 60.0

    def start(row):
        return [float(burst), row["at"]]

    def step(state, row):
        tokens = min(float(burst), state[0] + max(0.0, row["at"] - state[1]) * rate)
        if tokens >= 1.0:
            return [tokens - 1.0, row["at"]], (True, 0, tokens - 1.0)
        wait = max(1, math.ceil((1.0 - tokens) / rate))
        return [tokens, row["at"]], (False, wait, tokens)

    return Machine(start, step, ("at",), TOKEN_OUTPUT)


def token_bucket(requests: DataFrame, order: list[str], per_minute: int = 600, burst: int = 100,
                 partitions: int | None = None) -> DataFrame:
    """Admission replay per (tenant, principal)."""
    return ordered_fold(requests, ["tenant_id", "principal_id"], order,
                        token_bucket_machine(per_minute, burst), partitions)


def slo_alerts(observations: DataFrame, max_backup_age: float = 86_400.0,
               max_runnable_age: float = 300.0) -> DataFrame:
    """One row per observation set and raised alert, plus input violations.

    ``observations`` columns: scope, requests, successes, success_rate, p95, p99, scenarios,
    passed, failed, backup_created_at (text), backup_verified, restore_verified,
    source_restore_snapshot_equal, now_epoch, expired_leases, oldest_runnable_age_seconds,
    circuits_open, circuits_half_open.
    """
    if max_backup_age <= 0 or max_runnable_age <= 0:
        raise ValueError("SLO age thresholds must be positive")
    return _alert_rows(slo_checked(observations), max_backup_age, max_runnable_age)


def _backup_age():
    made = F.unix_micros(fn.zoned_timestamp("backup_created_at")) / F.lit(1e6)
    return F.col("now_epoch") - made


def slo_checked(observations: DataFrame) -> DataFrame:
    """Consistency checks of the inputs; an inconsistent set supports no alert decision."""
    def number(name):
        return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))

    rate_gap = F.abs(F.col("success_rate") - F.col("successes")
                     / F.greatest(F.col("requests"), F.lit(1)))
    rules = [
        Rule("not_finite", F.array_contains(F.array(*[number(n) for n in (
            "requests", "successes", "success_rate", "p95", "p99", "scenarios", "passed",
            "failed")]), True)),
        Rule("load_counts", (F.col("requests") < 1) | (F.col("successes") < 0)
             | (F.col("successes") > F.col("requests")) | (F.col("success_rate") < 0)
             | (F.col("success_rate") > 1)),
        Rule("success_rate_disagrees", rate_gap > 1e-12),
        Rule("fault_counts", (F.col("scenarios") < 1) | (F.least("passed", "failed") < 0)
             | (F.col("passed") + F.col("failed") != F.col("scenarios"))),
        Rule("backup_time", fn.zoned_timestamp("backup_created_at").isNull()),
        Rule("backup_in_future", _backup_age() < -60),
    ]
    return with_violations(observations, rules)


def _alert_rows(checked: DataFrame, max_backup_age: float, max_runnable_age: float) -> DataFrame:
    age = F.greatest(F.lit(0.0), _backup_age())
    verified = F.coalesce(F.col("backup_verified") & F.col("restore_verified")
                          & F.col("source_restore_snapshot_equal"), F.lit(False))
    table = [
        ("CONTROL_SUCCESS_RATE", "critical", F.col("success_rate") < 0.999, "success_rate"),
        ("CONTROL_P95_LATENCY", "critical", F.col("p95") >= 300, "p95"),
        ("CONTROL_P99_LATENCY", "warning", F.col("p99") >= 1000, "p99"),
        ("FAULT_INJECTION_FAILURE", "critical", F.col("failed") > 0, "failed"),
        ("BACKUP_RESTORE_VERIFICATION", "critical", ~verified, F.lit(0.0)),
        ("BACKUP_EVIDENCE_STALE", "warning", age > max_backup_age, F.round(age, 3)),
        ("EXPIRED_WORKER_LEASES", "warning", F.col("expired_leases") > 0, "expired_leases"),
        ("RUNNABLE_BACKLOG_AGE", "critical",
         F.col("oldest_runnable_age_seconds") > max_runnable_age,
         "oldest_runnable_age_seconds"),
        ("PROVIDER_CIRCUIT_OPEN", "critical", F.col("circuits_open") > 0, "circuits_open"),
        ("PROVIDER_CIRCUIT_HALF_OPEN", "warning", F.col("circuits_half_open") > 0,
         "circuits_half_open"),
    ]
    alerts = F.filter(F.array(*[
        F.when(F.coalesce(raised, F.lit(False)), F.struct(
            F.lit(name).alias("alert_id"), F.lit(severity).alias("severity"),
            (F.col(seen) if isinstance(seen, str) else seen).cast("double").alias("observed")))
        for name, severity, raised, seen in table]), lambda a: a.isNotNull())
    clean = F.size("violations") == 0
    return checked.withColumn("alerts", F.when(clean, alerts).otherwise(
        F.array().cast("array<struct<alert_id:string,severity:string,observed:double>>")))


def slo_status(alerted: DataFrame) -> DataFrame:
    """A12 status per observation set: FAIL, WARN or PASS; INVALID for inconsistent inputs."""
    def count(severity):
        return F.size(F.filter("alerts", lambda a: a["severity"] == severity))

    critical, warning = count("critical"), count("warning")
    return alerted.select(
        "scope", critical.alias("critical"), warning.alias("warning"),
        F.when(F.size("violations") > 0, "INVALID").when(critical > 0, "FAIL")
        .when(warning > 0, "WARN").otherwise("PASS").alias("status"))
