"""Job control logs: status, stages, budgets, leases, telemetry, retention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, any_of, violation_codes, with_violations
from veriledge.operators.ordered import Machine, ordered_fold, prefix_scan
from veriledge.session import broadcast_if_bounded, materialise


def stage_index(column: str | Column) -> Column:
    """Position of a stage in the fixed order; null for an unknown stage."""
    value = F.col(column) if isinstance(column, str) else column
    position = F.array_position(F.array(*[F.lit(s) for s in S.STAGES]), value)
    return F.when(position > 0, position - 1)


def is_runnable(now: Column | float) -> Column:
    at = now if isinstance(now, Column) else F.lit(float(now))
    expired = (F.col("status") == "RUNNING") & F.col("lease_expires_at").isNotNull() & (
        F.col("lease_expires_at") <= at)
    return F.col("status").isin("QUEUED", "RETRY_WAIT") | expired


# --- telemetry -------------------------------------------------------------------------------

def operational_snapshot(jobs: DataFrame, checkpoints: DataFrame, usage: DataFrame, now: float
                         ) -> DataFrame:
    """A05 as (field, key, value) rows; statuses and stages are zero filled, an unknown one is
    reported as a violation row."""
    at = F.lit(float(now))
    expires = F.col("lease_expires_at")
    running = F.col("status") == "RUNNING"
    one_pass = jobs.agg(
        *[F.count_if(F.col("status") == s).alias(f"jobs_by_status|{s}") for s in S.JOB_STATUSES],
        *[F.count_if(F.col("stage") == s).alias(f"jobs_by_stage|{s}") for s in S.STAGES],
        F.count_if(~F.col("status").isin(*S.JOB_STATUSES)).alias("violation|unknown_status"),
        F.count_if(~F.col("stage").isin(*S.STAGES)).alias("violation|unknown_stage"),
        F.count(F.lit(1)).alias("jobs_total|"),
        F.count_if(running & (expires > at)).alias("active_leases|"),
        F.count_if(running & (expires <= at)).alias("expired_leases|"),
        F.coalesce(F.greatest(F.lit(0.0), at - F.min(F.when(is_runnable(now),
                                                            F.col("created_at")))), F.lit(0.0))
        .alias("oldest_runnable_age_seconds|"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}|")
          for c in ("used_calls", "used_tokens", "used_cost_microunits")])
    counts = (checkpoints.agg(F.count(F.lit(1)).alias("checkpoint_records|"))
              .crossJoin(usage.agg(F.count(F.lit(1)).alias("usage_records|"))))  # one row each
    wide = one_pass.crossJoin(counts)
    names = wide.columns
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(n.split("|")[0]).alias("field"), F.lit(n.split("|")[1]).alias("key"),
                 F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("r"))
    return long.select("r.*").where((F.col("field") != "violation") | (F.col("value") > 0))


def usage_totals(charges: DataFrame) -> DataFrame:
    """A24."""
    return charges.groupBy("job_id", "provider").agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"),
        F.sum("cost_microunits").alias("cost_microunits"))


def usage_reconciliation(reservations: DataFrame, reported: DataFrame) -> DataFrame:
    """Reserved calls against reported usage per operation.

    The reservation was charged first; the charge after the call is the remainder plus tokens.
    """
    held = reservations.groupBy("operation_id").agg(F.sum("calls").alias("reserved_calls"))
    told = reported.groupBy("operation_id").agg(
        F.sum("calls").alias("reported_calls"), F.sum("tokens").alias("reported_tokens"))
    joined = held.join(told, "operation_id", "full_outer")
    reserved = F.coalesce("reserved_calls", F.lit(0))
    rules = [
        Rule("unreported_reservation", F.col("reported_calls").isNull() & (reserved > 0)),
        Rule("fewer_calls_than_reserved", F.col("reported_calls") < reserved),
    ]
    checked = with_violations(joined, rules)
    good = (F.size("violations") == 0) & F.col("reported_calls").isNotNull()
    return checked.select(
        "operation_id", reserved.alias("reserved_calls"), "reported_calls",
        F.when(good, F.col("reported_calls") - reserved).alias("charge_calls"),
        F.when(good, F.col("reported_tokens")).alias("charge_tokens"), "violations")


def runnable_jobs(jobs: DataFrame, now: float, limit: int = 100) -> DataFrame:
    """An ordered, limited report of jobs a worker may claim."""
    return (jobs.where(is_runnable(now)).select("job_id", "created_at")
            .orderBy("created_at", "job_id").limit(limit))


def checkpoint_progress(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The stages a job has not committed yet, with their stable operation ids."""
    stages = F.explode(F.array(*[F.struct(F.lit(i).alias("stage_index"), F.lit(s).alias("stage"))
                                 for i, s in enumerate(S.EXECUTION_STAGES)]))
    wanted = jobs.select("job_id", stages.alias("s")).select(
        "job_id", "s.stage_index", "s.stage",
        F.concat(F.lit("stage:"), F.col("s.stage"), F.lit(":v1")).alias("checkpoint_key"))
    left = wanted.join(checkpoints.select("job_id", "checkpoint_key"),
                       ["job_id", "checkpoint_key"], "left_anti")
    return left.select("job_id", "stage_index", "stage", F.concat_ws(
        ":", "job_id", "stage", F.lit("v1")).alias("operation_id"))


# --- legality of logs ------------------------------------------------------------------------

def job_status_legality(log: DataFrame) -> DataFrame:
    """Transitions against the allowed map.

    ``log``: job_id, version (1 is the QUEUED row), status, stage, expected_version. A row's
    predecessor is found by an equi-join on (job, version - 1): versions count up by one, so a
    missing predecessor is itself a violation and no window over a job's log is needed.
    """
    before = log.groupBy("job_id", (F.col("version") + 1).alias("version")).agg(
        F.min("status").alias("from_status"))
    first = F.col("version") == 1
    allowed = any_of([(F.col("from_status") == source) & F.col("status").isin(*targets)
                      for source, targets in S.JOB_TRANSITIONS.items()])
    moved = ~first & F.col("from_status").isNotNull()
    rules = [
        Rule("unknown_status", ~F.col("status").isin(*S.JOB_STATUSES)),
        Rule("initial_status", first & (F.col("status") != "QUEUED")),
        Rule("version_gap", ~first & F.col("from_status").isNull()),
        Rule("version_mismatch", F.col("expected_version").isNotNull()
             & (F.col("expected_version") != F.col("version") - 1)),
        Rule("illegal_transition", moved & ~allowed),
        Rule("succeeded_before_validate", (F.col("status") == "SUCCEEDED")
             & (F.col("stage") != "VALIDATE")),
    ]
    return with_violations(log.join(before, ["job_id", "version"], "left"), rules)


def stage_monotonic(log: DataFrame, seq: str = "version") -> DataFrame:
    """Stages never go back. Running maximum in fixed-width blocks of the log sequence."""
    indexed = log.withColumn("__stage", stage_index("stage"))
    scanned = prefix_scan(indexed, ["job_id"], seq, {"__before": ("max", F.col("__stage"))})
    rules = [
        Rule("unknown_stage", F.col("__stage").isNull()),
        Rule("stage_backwards", F.col("__stage") < F.col("__before")),
    ]
    return with_violations(scanned, rules).drop("__stage", "__before")


def _budget_machine() -> Machine:
    """Admit a charge only if its usage is valid and none of the three budgets is exceeded."""
    amounts = ("calls", "tokens", "cost_microunits")

    def start(_row):
        return [0, 0, 0]

    def step(used, row):
        invalid = [f"invalid_{a}" for a in amounts if row[a] is None or row[a] < 0]
        if invalid:
            return used, (False, ",".join(invalid), *used)
        after = [u + row[a] for u, a in zip(used, amounts)]
        broken = [a for a, total in zip(amounts, after) if total > row[f"max_{a}"]]
        if broken:
            return used, (False, ",".join(broken), *used)
        return after, (True, "", *after)

    output = S.flat("admitted boolean, exceeded string, used_calls bigint, "
                                "used_tokens bigint, used_cost_microunits bigint")
    return Machine(start, step, (*amounts, *[f"max_{a}" for a in amounts]), output)


def deduplicated_charges(charges: DataFrame, order: list[str]) -> DataFrame:
    """First charge per (job, key); ``conflict`` marks a key reused with other usage."""
    from veriledge.operators.ledger import idempotent_dedup

    same = F.concat_ws("|", "provider", F.col("calls").cast("string"),
                       F.col("tokens").cast("string"), F.col("cost_microunits").cast("string"))
    return idempotent_dedup(charges, ["job_id", "charge_key"], order, same)


def budget_admission(charges: DataFrame, jobs: DataFrame, order: list[str],
                     partitions: int | None = None) -> DataFrame:
    """Admit or reject each charge of a job in order; usage must not be null or negative.

    A job whose charges are all valid and fit its budgets altogether never rejects one: those
    jobs are settled by a map-side combined sum and a running total is not needed to decide.
    Only jobs that overrun go through the ordered fold, where a rejected charge does not count
    and a later, smaller one may pass.
    """
    first = deduplicated_charges(charges, order)
    budgets = jobs.select("job_id", "max_calls", "max_tokens", "max_cost_microunits")
    joined = materialise(first.join(budgets, "job_id"))  # read three times below
    totals = joined.groupBy("job_id").agg(
        *[(F.coalesce(F.min(a) < 0, F.lit(True)) | (F.count(a) < F.count(F.lit(1)))
           | (F.sum(a) > F.max(f"max_{a}"))).alias(f"__o_{a}")
          for a in ("calls", "tokens", "cost_microunits")])
    over = totals.where("__o_calls OR __o_tokens OR __o_cost_microunits").select("job_id")
    contested = joined.join(over, "job_id", "left_semi")
    settled = joined.join(over, "job_id", "left_anti")
    folded = ordered_fold(contested, ["job_id"], order, _budget_machine(), partitions)
    names = [*charges.columns, "occurrences", "conflict", "admitted", "exceeded"]
    easy = settled.withColumn("admitted", F.lit(True)).withColumn("exceeded", F.lit(""))
    return folded.select(*names).unionByName(easy.select(*names))


def _lease_machine() -> Machine:
    """Replay acquire, heartbeat and status rows of one job."""
    def start(_row):
        return ["QUEUED", None, None, 0]  # status, owner, expiry, attempts

    def step(state, row):
        status, owner, expiry, attempts = state
        kind, worker, now = row["kind"], row["worker_id"], row["at"]
        problem = ""
        if kind == "status":
            status, owner, expiry = row["status"], None, None
        elif kind == "acquire":
            held = owner is not None and owner != worker and expiry is not None and expiry > now
            if status in S.TERMINAL_JOB_STATUSES or status == "VALIDATING":
                problem = "not_runnable"
            elif held:
                problem = "leased_elsewhere"
            else:
                status = "RUNNING" if status in ("QUEUED", "RETRY_WAIT") else status
                owner, expiry, attempts = worker, now + row["lease_seconds"], attempts + 1
        elif owner != worker or status != "RUNNING" or expiry is None or expiry < now:
            problem = "heartbeat_rejected"
        else:
            expiry = now + row["lease_seconds"]
        return ([status, owner, expiry, attempts],
                (problem == "", problem, status, owner, expiry, attempts))

    output = S.flat("granted boolean, problem string, job_status string, "
                                "lease_owner string, lease_expires_at double, attempts bigint")
    return Machine(start, step, ("kind", "worker_id", "at", "status", "lease_seconds"), output)


def lease_audit(log: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """W07. ``log``: job_id, kind (acquire/heartbeat/status), worker_id, at, lease_seconds,
    status."""
    return ordered_fold(log, ["job_id"], order, _lease_machine(), partitions)


# --- reconciliation --------------------------------------------------------------------------

def operation_reconciliation(requests: DataFrame, operations: DataFrame) -> DataFrame:
    """Resolve pending operations by recorded operator requests.

    ``requests``: reconciliation_id, operation_id, request_sha256, action, actor, reason,
    evidence_receipt_sha256, has_response. A malformed request changes nothing, so per operation
    the first request that is well formed and matches its digest wins; later ones come too late.
    """
    known = operations.select("operation_id", F.col("request_sha256").alias("__sha"),
                              F.col("status").alias("__status"))
    joined = requests.join(known, "operation_id", "left")
    own = [
        Rule("operation_id", F.coalesce((F.trim("operation_id") == "")
                                        | (F.length("operation_id") > 500), F.lit(True))),
        Rule("action", ~F.col("action").isin("complete", "authorize_retry", "abandon")),
        Rule("request_digest", ~fn.is_sha256("request_sha256")),
        Rule("actor", F.coalesce((F.trim("actor") == "") | (F.length("actor") > 200),
                                 F.lit(True))),
        Rule("reason", F.coalesce((F.trim("reason") == "") | (F.length("reason") > 2000),
                                  F.lit(True))),
        Rule("receipt", ~fn.is_sha256("evidence_receipt_sha256")),
        Rule("response_missing", (F.col("action") == "complete") & ~F.col("has_response")),
        Rule("response_unexpected", (F.col("action") != "complete") & F.col("has_response")),
        Rule("unknown_operation", F.col("__status").isNull()),
        Rule("digest_mismatch", F.col("__sha") != F.col("request_sha256")),
        Rule("not_pending", F.col("__status") != "PENDING"),
    ]
    checked = with_violations(joined, own)
    winner = (checked.where(F.size("violations") == 0).groupBy("operation_id")
              .agg(F.min("reconciliation_id").alias("__winner")))
    late = with_violations(checked.join(winner, "operation_id", "left"), [
        Rule("already_resolved", (F.size("violations") == 0)
             & (F.col("reconciliation_id") > F.col("__winner")))])
    status = (F.when(F.size("violations") > 0, F.lit(None))
              .when(F.col("action") == "complete", "COMPLETED")
              .when(F.col("action") == "authorize_retry", "RETRY_AUTHORIZED")
              .otherwise("ABANDONED"))
    return late.select(*requests.columns, F.col("__status").alias("prior_status"),
                       status.alias("next_status"), "violations")


def open_operations(operations: DataFrame, include_completed: bool = False) -> DataFrame:
    """Operation metadata without prompts or responses, for an operator's list."""
    rows = operations if include_completed else operations.where(F.col("status") != "COMPLETED")
    return rows.select("operation_id", "request_sha256", "status", "created_at", "completed_at")


# --- retention -------------------------------------------------------------------------------

def retention_targets(jobs: DataFrame, tenant_id: str, cutoff: float) -> DataFrame:
    """Terminal jobs of the tenant that were last updated at or before the cutoff."""
    return (jobs.where((F.col("tenant_id") == tenant_id) & (F.col("updated_at") <= cutoff)
                       & F.col("status").isin(*S.TERMINAL_JOB_STATUSES))
            .select("tenant_id", "job_id", "status", "updated_at"))


def exclusive_blobs(targets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Digests that only jobs to be deleted refer to."""
    wanted = targets.select("tenant_id", "job_id", F.lit(True).alias("__gone"))
    per_digest = (artifacts.join(wanted, ["tenant_id", "job_id"], "left")
                  .groupBy("tenant_id", "content_sha256").agg(
                      F.max("size_bytes").alias("size_bytes"),
                      F.min("size_bytes").alias("__lo"),
                      F.count_if(F.col("__gone").isNull()).alias("__kept"),
                      F.count_if(F.col("__gone").isNotNull()).alias("__gone")))
    return per_digest.where("__kept = 0 AND __gone > 0").select(
        "tenant_id", "content_sha256", "size_bytes")


def retention_plan(jobs: DataFrame, artifacts: DataFrame, receipts: DataFrame, tenant_id: str,
                   cutoff: float) -> DataFrame:
    """One row per target job with the preconditions of its deletion.

    A job's bindings are folded to a count and a digest over their sorted lines; a job has one
    binding per stage output, a short list.
    """
    if not cutoff >= 0:
        raise ValueError("cutoff must be a finite past epoch")
    targets = retention_targets(jobs, tenant_id, cutoff)
    line = F.concat_ws("|", "logical_key", "content_sha256",
                       F.col("size_bytes").cast("string"), "media_type")
    bindings = (artifacts.where(F.col("tenant_id") == tenant_id)
                .groupBy("tenant_id", "job_id").agg(
                    F.count(F.lit(1)).alias("bindings"),
                    bindings_digest(line).alias("bindings_sha256")))
    ledger = receipts.select("tenant_id", "job_id", "ok", "event_count", "head_hash")
    joined = (targets.join(bindings, ["tenant_id", "job_id"], "left")
              .join(ledger, ["tenant_id", "job_id"], "left"))
    rules = [
        Rule("unsafe_tenant_id", ~fn.safe_id("tenant_id")),
        Rule("unsafe_job_id", ~fn.safe_id("job_id")),
        Rule("ledger_missing", F.col("ok").isNull()),
        Rule("ledger_invalid", ~F.col("ok")),
    ]
    return with_violations(joined, rules).select(
        "tenant_id", "job_id", "status", "updated_at",
        F.coalesce("bindings", F.lit(0)).alias("bindings"),
        F.coalesce("bindings_sha256", F.lit("")).alias("bindings_sha256"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("head_hash", F.lit("")).alias("head_hash"), "violations")


def bindings_digest(line: Column) -> Column:
    """Order-free, map-side combinable digest of a set of lines: sums of digest words.

    Four 60-bit words per line are added modulo 2^60-sized integers, so no list is gathered even
    for a job with very many bindings; equal sets of lines have equal sums.
    """
    digest = fn.sha256(line)
    words = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
             for i in range(4)]
    return fn.sha256(F.concat_ws("|", *[w.cast("string") for w in words]))


def plan_digest(plan: DataFrame, blobs: DataFrame) -> DataFrame:
    """Digest an operator has to acknowledge, over targets and deletable blobs."""
    from veriledge.operators.score import dataset_digest

    target = plan.select(F.concat_ws(
        "|", F.lit("job"), "tenant_id", "job_id", "status", F.col("updated_at").cast("string"),
        F.col("bindings").cast("string"), "bindings_sha256",
        F.col("event_count").cast("string"), "head_hash").alias("line"))
    blob = blobs.select(F.concat_ws("|", F.lit("blob"), "tenant_id", "content_sha256",
                                    F.col("size_bytes").cast("string")).alias("line"))
    return dataset_digest(target.unionByName(blob), F.col("line")).withColumnRenamed(
        "digest", "plan_sha256")


def stale_plan(plan: DataFrame, blobs: DataFrame, jobs: DataFrame, artifacts: DataFrame,
               receipts: DataFrame, tenant_id: str, cutoff: float) -> DataFrame:
    """Planned targets and blobs that no longer match the current state."""
    now = retention_plan(jobs, artifacts, receipts, tenant_id, cutoff).drop("violations")
    fields = ("status", "updated_at", "bindings", "bindings_sha256", "event_count", "head_hash")
    current = now.select("tenant_id", "job_id", F.struct(*fields).alias("now"))
    joined = plan.drop("violations").join(current, ["tenant_id", "job_id"], "left")
    found = F.col("now").isNotNull()
    rules = [Rule("job_changed", ~found)] + [
        Rule(f"changed_{f}", found & ~F.col(f).eqNullSafe(F.col("now")[f])) for f in fields]
    jobs_bad = with_violations(joined, rules).where(F.size("violations") > 0).select(
        F.lit("job").alias("kind"), F.col("job_id").alias("id"),
        violation_codes().alias("codes"))
    still = exclusive_blobs(plan.select("tenant_id", "job_id"), artifacts).select(
        "tenant_id", "content_sha256")
    blobs_bad = blobs.join(still, ["tenant_id", "content_sha256"], "left_anti").select(
        F.lit("blob").alias("kind"), F.col("content_sha256").alias("id"),
        F.lit("blob_referenced").alias("codes"))
    return jobs_bad.unionByName(blobs_bad)


def apply_retention(plan: DataFrame, blobs: DataFrame, jobs: DataFrame, artifacts: DataFrame,
                    receipts: DataFrame, tenant_id: str, cutoff: float, acknowledged_sha256: str
                    ) -> dict[str, DataFrame]:
    """The next version of the job and artifact tables and a content-free receipt.

    Nothing is deleted in place. A wrong acknowledgement or a stale plan raises.
    """
    from veriledge.functions.contracts import ContractError

    digest = plan_digest(plan, blobs).first()["plan_sha256"]
    if digest != acknowledged_sha256:
        raise ContractError("plan digest or explicit acknowledgement does not match")
    stale = stale_plan(plan, blobs, jobs, artifacts, receipts, tenant_id, cutoff).limit(1)
    found = stale.collect()
    if found:
        raise ContractError(f"stale plan: {found[0]['kind']} {found[0]['id']}: "
                            f"{found[0]['codes']}")
    gone = broadcast_if_bounded(plan.select("tenant_id", "job_id"))
    return {
        "jobs": jobs.join(gone, ["tenant_id", "job_id"], "left_anti"),
        "artifacts": artifacts.join(gone, ["tenant_id", "job_id"], "left_anti"),
        "receipt": retention_receipt(plan, blobs, tenant_id, digest),
    }


def retention_receipt(plan: DataFrame, blobs: DataFrame, tenant_id: str, digest: str | None = None
                      ) -> DataFrame:
    """One row that names counts and digests only."""
    jobs = plan.agg(F.count(F.lit(1)).alias("deleted_jobs"),
                    F.coalesce(F.sum("bindings"), F.lit(0)).alias("deleted_artifact_bindings"))
    count = blobs.agg(F.count(F.lit(1)).alias("deleted_exclusive_blobs"))
    out = jobs.crossJoin(count)  # one row each
    return out.select(
        fn.sha256(F.lit(tenant_id)).alias("tenant_sha256"), F.lit(digest).alias("plan_sha256"),
        F.lit("RETENTION_COMPLETED").alias("event_type"), "deleted_jobs",
        "deleted_artifact_bindings", "deleted_exclusive_blobs",
        F.col("deleted_jobs").alias("deleted_ledgers"))


def manifest_verify(manifest: DataFrame, files: DataFrame, receipts: DataFrame | None = None
                    ) -> DataFrame:
    """Manifest entries against files found.

    ``manifest``: path, kind, size_bytes, sha256 and for ledgers events, head_sha256.
    ``files``: path, size_bytes, sha256. ``receipts``: path, ok, event_count, head_hash.
    """
    entries = manifest.groupBy("path").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(*manifest.columns), "sha256")
        .alias("m"))
    actual = files.select("path", F.struct("size_bytes", "sha256").alias("f"))
    joined = entries.join(actual, "path", "full_outer")
    m, f = F.col("m"), F.col("f")
    both = m.isNotNull() & f.isNotNull()
    parts = F.split("path", "/")
    rules = [
        Rule("unsafe_path", m.isNotNull() & (F.col("path").startswith("/")
                                             | F.array_contains(parts, ".."))),
        Rule("duplicate_entry", F.col("__n") > 1),
        Rule("missing_file", f.isNull()),
        Rule("unmanifested_file", m.isNull()),
        Rule("size", both & (m["size_bytes"] != f["size_bytes"])),
        Rule("sha256", both & (m["sha256"] != f["sha256"])),
    ]
    if receipts is not None:
        joined = joined.join(receipts.select(
            "path", F.struct("ok", "event_count", "head_hash").alias("r")), "path", "left")
        r = F.col("r")
        rules.append(Rule("ledger_receipt", (m["kind"] == "event_ledger") & ~F.coalesce(
            r["ok"] & (r["event_count"] == m["events"])
            & (r["head_hash"] == m["head_sha256"]), F.lit(False))))
    return with_violations(joined, rules).select("path", "violations")
