"""Hash-chained ledgers: verification, building, idempotent appends, bindings."""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, violation_codes, with_violations
from veriledge.operators.ordered import Machine, ordered_fold
from veriledge.operators.rows import validate_events
from veriledge.session import broadcast_if_bounded, cols, materialise

LEDGER = ["tenant_id", "job_id"]
KEY, ID = [*LEDGER, "idempotency_key"], [*LEDGER, "event_id"]


def _digest(keys: list[str]) -> Column:
    return F.xxhash64(F.lit(keys[-1]), *cols(keys))


def _repeated_digests(df: DataFrame, *key_lists: list[str]) -> DataFrame:
    """64-bit digests of keys that more than one row has, stored.

    Numbers are counted instead of the keys. A key without its digest here is single; rows with
    one are suspects only, whose keys have to be compared.
    """
    digests = F.explode(F.array(*[_digest(keys) for keys in key_lists]))
    return materialise(df.select(digests.alias("__digest")).groupBy("__digest")
                       .agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__digest"))


def _suspects(df: DataFrame, keys: list[str], repeated: DataFrame, kind: str = "left_semi"
              ) -> DataFrame:
    """Rows whose key has (``left_anti``: has not) one of the digests."""
    return (df.withColumn("__digest", _digest(keys)).join(repeated, "__digest", kind)
            .drop("__digest"))


def _mark_repeated(df: DataFrame, keys: list[str], flag: str, repeated: DataFrame) -> DataFrame:
    """``duplicated`` for rows whose repeated digests are known: without suspects nothing moves."""
    if repeated.isEmpty():
        return df.withColumn(flag, F.lit(False))
    twice = materialise(
        _suspects(df.select(*keys), keys, broadcast_if_bounded(repeated)).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys, F.lit(True).alias(flag)))
    return df.join(broadcast_if_bounded(twice), keys, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False)))


def _with_neighbours(narrow: DataFrame) -> DataFrame:
    """Add ``__prior``, the least hash of the events one number before, and ``__same``, the events
    of the same number.

    Numbers lie in blocks of 65,536, so a giant ledger is many groups; the last number of a block is
    copied to the next one, which needs it. Rows without ledger or number have no neighbours.
    """
    block, low = F.shiftright("sequence", 16), F.col("sequence").bitwiseAND(65_535).cast("int")
    own = F.struct(block.alias("block"), low.alias("low"))
    follows = F.struct((block + 1).alias("block"), F.lit(-1).alias("low"))
    placed = narrow.withColumn("__at", F.explode(
        F.when(low == 65_535, F.array(own, follows)).otherwise(F.array(own))))
    near = Window.partitionBy(*LEDGER, "__at.block").orderBy("__at.low")
    known = F.col("tenant_id").isNotNull() & F.col("job_id").isNotNull() \
        & F.col("sequence").isNotNull()
    return placed.select(
        "*", F.min("event_hash").over(near.rangeBetween(-1, -1)).alias("__before"),
        F.count(F.lit(1)).over(near.rangeBetween(0, 0)).alias("__peers")).where(
        F.coalesce("__at.low", F.lit(0)) >= 0).select(
        *narrow.columns, F.when(known, F.col("__before")).alias("__prior"),
        F.when(known, F.col("__peers")).otherwise(1).alias("__same"))


def chain_violations(events: DataFrame, mode: str = "exact") -> DataFrame:
    """Row level part of W01: ledger, sequence, ids, hashes and ``violations`` of every event.

    Rows are hashed where they are read and lose their payload there. The narrow rows move once, to
    their neighbours in the ledger, and are stored with what the sequence rules found; ids and keys
    are compared only where 64-bit digests of them repeat. A giant ledger is checked by all tasks.
    An event whose line was not exactly one envelope (``line_problem`` of ``read_ledgers``) breaks
    its ledger.
    """
    checked = validate_events(events, mode)
    if "line_problem" in events.columns:
        problem = F.col("line_problem")
        checked = with_violations(checked, [Rule("line_invalid", problem.isNotNull(), problem)])
    narrow = checked.select(
        *LEDGER, "sequence", "event_id", "idempotency_key", "previous_hash", "event_hash",
        "violations")
    chained = materialise(with_violations(_with_neighbours(narrow), [
        Rule("sequence_gap", (F.col("sequence") > 1) & F.col("__prior").isNull()),
        Rule("sequence_repeated", F.col("__same") > 1),
        Rule("previous_hash", ~F.coalesce("previous_hash", F.lit("")).eqNullSafe(
            F.coalesce("__prior", F.lit("")))),
    ]).drop("__prior", "__same"))
    repeated = _repeated_digests(chained, ID, KEY)
    marked = _mark_repeated(chained, ID, "__dup_id", repeated)
    marked = _mark_repeated(marked, KEY, "__dup_key", repeated)
    rules = [
        Rule("duplicate_event_id", F.col("__dup_id")),
        Rule("duplicate_idempotency_key", F.col("__dup_key")),
    ]
    return with_violations(marked, rules).drop("__dup_id", "__dup_key")


def verify_chain(events: DataFrame, mode: str = "exact") -> DataFrame:
    """One receipt per ledger. A broken ledger reports no count and no head."""
    return receipts_of(chain_violations(events, mode))


def receipts_of(checked: DataFrame) -> DataFrame:
    """The receipts of events that ``chain_violations`` has checked."""
    bad = F.size("violations") > 0
    first = F.struct("sequence", violation_codes().alias("codes"))
    folded = checked.groupBy(*LEDGER).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("broken"),
        F.max_by("event_hash", "sequence").alias("head"),
        F.min(F.when(bad, first)).alias("first"))
    return folded.select(
        *LEDGER, (~F.col("broken")).alias("ok"),
        F.when(F.col("broken"), 0).otherwise(F.col("n")).cast("bigint").alias("event_count"),
        F.when(F.col("broken"), "").otherwise(F.col("head")).alias("head_hash"),
        F.when(F.col("broken"), F.concat(
            F.lit("sequence "), F.coalesce(F.col("first.sequence").cast("string"), F.lit("?")),
            F.lit(": "), F.col("first.codes"))).otherwise("").alias("error"))


def idempotent_dedup(df: DataFrame, keys: list[str], order: list[str], fingerprint: Column
                     ) -> DataFrame:
    """The first row per key, with ``conflict`` when a later row means something else.

    Both the first row and the spread of fingerprints are map-side combined aggregates.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    grouped = df.withColumn("__fp", fingerprint).groupBy(
        *[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.min_by(row, rank).alias("__row"), F.count(F.lit(1)).alias("occurrences"),
        (F.min("__fp") != F.max("__fp")).alias("conflict"))
    return grouped.select("__row.*", "occurrences", F.coalesce("conflict", F.lit(False))
                          .alias("conflict"))


def _chain_machine() -> Machine:
    """Sequence, previous hash and hash for one event after another.

    The state is (number of events, head hash). The canonical text around the chain's own
    values is prepared by Spark, so a step is one string join and one digest; odd number spellings
    are left to the step. A refused event passes without a place in the chain.
    """
    spelt = fn.exact_json  # travels by value, unlike its module

    def start(row):
        return [row["__base_count"] or 0, row["__base_head"] or ""]

    def step(state, row):
        if row["__refused"]:
            return state, (None, None, None)
        sequence, previous, head = state[0] + 1, state[1], row["__head"]
        if row["__left"] is not None:
            body = spelt(row["__left"])
            head = None if body is None else f'{row["__start"]}{body},"previous_hash":'
        text = f'{head}"{previous}","schema_version":1,"sequence":{sequence}{row["__tail"]}'
        digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
        return [sequence, digest], (sequence, previous, digest)

    return Machine(start, step,
                   ("__base_count", "__base_head", "__head", "__start", "__left", "__tail",
                    "__refused"),
                   S.flat("sequence bigint, previous_hash string, event_hash string"),
                   guesses=False)


def _first_of_keys(events: DataFrame, order: list[str], mode: str, repeated: DataFrame
                   ) -> DataFrame:
    """``idempotent_dedup`` by idempotency key: single keys are neither moved nor compared."""
    if repeated.isEmpty():
        return events.withColumn("conflict", F.lit(False))
    sent = broadcast_if_bounded(repeated)
    several = idempotent_dedup(_suspects(events, KEY, sent), KEY, order,
                               fn.semantic_fingerprint(mode)).drop("occurrences")
    single = _suspects(events, KEY, sent, "left_anti").withColumn("conflict", F.lit(False))
    return single.unionByName(several)


def _without_replays(first: DataFrame, held: DataFrame, mode: str) -> DataFrame:
    """Rows that are no replay of a held event, with ``__held``: the key is held."""
    keys = held.select(*KEY, F.unhex(fn.semantic_fingerprint(mode)).alias("__meaning"))
    joined = first.join(keys, KEY, "left")
    replay = F.col("__meaning") == F.unhex(fn.semantic_fingerprint(mode))
    return joined.where(F.col("conflict") | ~F.coalesce(replay, F.lit(False))).withColumn(
        "__held", F.col("__meaning").isNotNull()).drop("__meaning")


def _mark_held_ids(first: DataFrame, held: DataFrame) -> DataFrame:
    """``__held_id`` of stored rows with a new key: digests meet first, then the ids they leave."""
    fresh = first.where(~F.col("__held"))
    shared = materialise(fresh.select(_digest(ID).alias("__digest")).join(
        held.select(_digest(ID).alias("__digest")), "__digest", "left_semi").distinct())
    if shared.isEmpty():
        return first.withColumn("__held_id", F.lit(False))
    ids = materialise(_suspects(held.select(*ID), ID, broadcast_if_bounded(shared)).distinct()
                      .withColumn("__held_id", F.lit(True)))
    return first.join(broadcast_if_bounded(ids), ID, "left").withColumn(
        "__held_id", F.coalesce("__held_id", F.lit(False)))


def build_ledger(events: DataFrame, order: list[str], receipts: DataFrame | None = None,
                 expected: DataFrame | None = None, mode: str = "exact",
                 partitions: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """Append a batch of events to their ledgers.

    ``events`` has the envelope columns without sequence and hashes. Replays of an idempotency key
    collapse to the first event; a key with two meanings is reported in ``violations`` and not
    appended. ``receipts`` (from ``verify_chain``) gives the ledgers the batch continues: one that
    is not ok takes no event, and only a ledger without receipt begins anew. ``held`` has the
    events those ledgers hold: a key that is held with the same meaning is a replay and adds
    nothing, one with another meaning is a conflict, a held event id is refused. ``expected``
    (tenant_id, job_id, expected_head) asks for an optimistic check.
    """
    repeated = _repeated_digests(events, KEY, ID)
    first = _first_of_keys(events, order, mode, repeated)
    rules = [Rule("idempotency_conflict", F.col("conflict"), F.col("idempotency_key"))]
    if held is not None:
        first = materialise(_without_replays(first, held, mode))
        rules.append(Rule("idempotency_conflict", F.col("__held") & ~F.col("conflict"),
                          F.col("idempotency_key")))
        first = _mark_held_ids(first, held)
        rules.append(Rule("duplicate_event_id", F.col("__held_id") & ~F.col("__held"),
                          F.col("event_id")))
        repeated = _repeated_digests(first, ID)
    first = _mark_repeated(first, ID, "__same_id", repeated)
    rules.append(Rule("duplicate_event_id", F.col("__same_id"), F.col("event_id")))
    if receipts is not None:
        base = receipts.select(*LEDGER, F.col("ok").alias("__ok"),
                               F.col("event_count").alias("__base_count"),
                               F.col("head_hash").alias("__base_head"))
        first = first.join(base, LEDGER, "left")
        rules.append(Rule("ledger_invalid", ~F.col("__ok")))
    else:
        first = (first.withColumn("__base_count", F.lit(0).cast("bigint"))
                 .withColumn("__base_head", F.lit("")))
    if expected is not None:
        first = first.join(expected, LEDGER, "left")
        rules.append(Rule("head_mismatch", F.col("expected_head").isNotNull() & (
            F.col("expected_head") != F.coalesce("__base_head", F.lit("")))))
    checked = with_violations(first, rules)
    head, tail = fn.envelope_parts(mode="native")
    start, left = fn.envelope_start(), fn.payload_left(mode=mode)
    columns = dict.fromkeys([*S.EVENT.fieldNames(), *order, "violations"])
    chained = ordered_fold(
        checked.select(*[c for c in columns if c in checked.columns], "__base_count", "__base_head"),
        LEDGER, order, _chain_machine(), partitions,
        {"__head": F.when(left.isNull(), head), "__start": F.when(left.isNotNull(), start),
         "__left": left, "__tail": tail, "__refused": F.size("violations") > 0})
    version = F.when(F.col("sequence").isNotNull(), F.lit(1))
    return chained.withColumn("schema_version", version).select(
        *S.EVENT.fieldNames(), "violations")


def prediction_ledger_binding(predictions: DataFrame, receipts: DataFrame, events: DataFrame
                              ) -> DataFrame:
    """Prediction -> verified ledger -> exactly one matching commitment event.

    ``predictions`` carries tenant_id and job_id taken from its ledger path.
    """
    keyed = predictions.withColumn("__commitment", fn.prediction_commitment())
    payload = F.try_parse_json(F.col("payload"))
    names = ("challenge_id", "run_id", "method_id", "prediction_commitment_sha256")
    commits = (events.where(F.col("event_type") == "benchmark.prediction_committed")
               .select(*LEDGER, *[F.try_variant_get(payload, f"$.{n}", "string").alias(n)
                                  for n in names])
               .groupBy(*LEDGER, *names).agg(F.count(F.lit(1)).alias("__commits"))
               .withColumnRenamed("prediction_commitment_sha256", "__commitment"))
    receipt = receipts.select(*LEDGER, F.col("ok").alias("__ok"),
                              F.col("event_count").alias("__count"),
                              F.col("head_hash").alias("__head"))
    joined = (keyed.join(receipt, LEDGER, "left")
              .join(commits, [*LEDGER, "challenge_id", "run_id", "method_id", "__commitment"],
                    "left"))
    rules = [
        Rule("commitment_mismatch",
             F.col("__commitment") != F.col("prediction_commitment_sha256")),
        Rule("ledger_missing", F.col("__ok").isNull()),
        Rule("ledger_invalid", ~F.col("__ok")),
        Rule("receipt_mismatch", F.col("__ok") & (
            (F.col("__head") != F.col("ledger_head"))
            | (F.col("__count") != F.col("ledger_event_count")))),
        Rule("commitment_event", F.coalesce("__commits", F.lit(0)) != 1),
    ]
    return with_violations(joined, rules).select(*predictions.columns, "violations")


def policy_audit_links(events: DataFrame, receipts: DataFrame, policy_receipts: DataFrame
                       ) -> DataFrame:
    """Link events of task ledgers against the policy ledger they name."""
    payload = F.try_parse_json(F.col("payload"))
    links = events.where(F.col("event_type") == "policy.audit_linked").select(
        *LEDGER,
        F.try_variant_get(payload, "$.policy_ledger_head", "string").alias("head"),
        F.try_variant_get(payload, "$.policy_ledger_events", "bigint").alias("events"),
        F.try_variant_get(payload, "$.newly_dispatched", "bigint").alias("newly_dispatched"))
    per_task = links.groupBy(*LEDGER).agg(
        F.count(F.lit(1)).alias("links"), F.min("head").alias("head"),
        F.min("events").alias("events"), F.min("newly_dispatched").alias("newly_dispatched"))
    policy = policy_receipts.select(
        "tenant_id", F.col("head_hash").alias("head"), F.col("ok").alias("__policy_ok"),
        F.col("event_count").alias("__policy_count"))
    joined = (receipts.select(*LEDGER, F.col("ok").alias("__ok"))
              .join(per_task, LEDGER, "left").join(policy, ["tenant_id", "head"], "left"))
    linked = F.coalesce("links", F.lit(0)) > 0
    rules = [
        Rule("multiple_links", F.col("links") > 1),
        Rule("unknown_policy_head", linked & F.col("__policy_ok").isNull()),
        Rule("policy_ledger_invalid", linked & ~F.col("__policy_ok")),
        Rule("policy_count", linked & (F.col("events") != F.col("__policy_count"))),
        Rule("task_ledger_invalid", ~F.col("__ok")),
    ]
    return with_violations(joined, rules).select(
        *LEDGER, F.coalesce("links", F.lit(0)).alias("links"), "head", "events",
        "newly_dispatched", "violations")


def pending_outbox(outbox: DataFrame, ledger_events: DataFrame) -> DataFrame:
    """Outbox rows not yet dispatched whose key the destination does not hold, in order."""
    pending = outbox.where(F.col("dispatched_at").isNull())
    return (pending.join(ledger_events.select("tenant_id", "idempotency_key").distinct(),
                         ["tenant_id", "idempotency_key"], "left_anti"))


def flush_outbox(outbox: DataFrame, ledger_events: DataFrame, audit_job_id: str,
                 receipts: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Events to append to the policy ledger, chained after what it already holds."""
    shaped = shaped_outbox(pending_outbox(outbox, ledger_events), audit_job_id)
    # Pending rows have no key that the ledger holds; ids are compared all the same.
    ids = ledger_events if set(S.EVENT.fieldNames()) <= set(ledger_events.columns) else None
    return build_ledger(shaped, ["created_at", "event_id"], receipts, partitions=partitions,
                        held=ids)


def shaped_outbox(outbox: DataFrame, audit_job_id: str) -> DataFrame:
    """Outbox rows as events of the policy ledger, with their ``created_at``."""
    return outbox.select(
        "event_id", F.concat(F.date_format(F.timestamp_seconds("created_at"),
                                           "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
        .alias("occurred_at"),
        "tenant_id", F.lit(audit_job_id).alias("job_id"), "aggregate_type", "aggregate_id",
        "event_type", "payload", "idempotency_key", "created_at")


def mark_dispatched(outbox: DataFrame, ledger_events: DataFrame, at: float) -> DataFrame:
    """The next version of the outbox table, acknowledging what the ledger holds."""
    held = ledger_events.select("tenant_id", "idempotency_key",
                                F.lit(at).alias("__at")).dropDuplicates(
        ["tenant_id", "idempotency_key"])
    return (outbox.join(held, ["tenant_id", "idempotency_key"], "left")
            .withColumn("dispatched_at", F.coalesce("dispatched_at", "__at"))
            .select(*outbox.columns))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, combined map-side."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys])
            .agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*"))
