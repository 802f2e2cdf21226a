"""Claim-evidence graphs folded out of event logs, as tables.

The rules of the graph look at earlier events only through existence ("was this query executed
before?"), so each is an equi-join against the first sequence number of the thing it needs. A
claim can legally change state at most three times, so the state before a transition needs only
the first four transitions of a claim. Nothing gathers a claim's or a ledger's whole log.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import (
    Rule, any_of, is_missing, violation_codes, with_violations,
)
from veriledge.operators.ledger import LEDGER, verify_chain
from veriledge.session import materialise



def _longest(state: str) -> int:
    """Most transitions that can follow a state; the states form no cycle."""
    return max((1 + _longest(to) for to in S.CLAIM_TRANSITIONS.get(state, ())), default=0)


# One more than a claim can legally make: the first one too many is still seen.
_MAX_TRANSITIONS = 1 + _longest("PROPOSED")
REQUIRED = {
    "claim.proposed": ("claim_id", "text", "scope"),
    "query.executed": ("query_id", "claim_id", "text", "intent"),
    "passage.observed": ("passage_id", "doc_id", "query_id", "content_sha256"),
    "evidence.linked": ("claim_id", "passage_id", "relation"),
    "claim.transitioned": ("claim_id", "to_state", "reason"),
}
_TEXT = ("claim_id", "text", "scope", "query_id", "intent", "passage_id", "doc_id",
         "content_sha256", "relation", "to_state", "reason", "boundary")
_COUNTS = ("n_hits", "offset", "page_no")


def flatten_claim_events(events: DataFrame) -> DataFrame:
    """Event payloads as columns, row by row."""
    value = F.try_parse_json(F.col("payload"))

    def bad_count(name):
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        number = F.try_variant_get(value, f"$.{name}", "bigint")
        return F.coalesce(kind != "VOID", F.lit(False)) & (
            ~kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | (number < 0))

    return events.select(
        *LEDGER, "sequence", "event_id", "event_type",
        *[F.try_variant_get(value, f"$.{n}", "string").alias(n) for n in _TEXT],
        *[F.try_variant_get(value, f"$.{n}", "bigint").alias(n) for n in _COUNTS],
        *[bad_count(n).alias(f"bad_{n}") for n in _COUNTS])


def parse_claim_log(events: DataFrame) -> DataFrame:
    """Flattened events; a replayed event id keeps its first occurrence."""
    flat = flatten_claim_events(events)
    first = flat.groupBy(*LEDGER, "event_id").agg(F.min("sequence").alias("sequence"))
    return flat.join(first, [*LEDGER, "event_id", "sequence"], "left_semi")


def _first_seen(log: DataFrame, event_type: str, key: str, extra: tuple[str, ...] = ()
                ) -> DataFrame:
    """First sequence per key, with columns of that first event."""
    return (log.where((F.col("event_type") == event_type) & F.col(key).isNotNull())
            .groupBy(*LEDGER, key).agg(
                F.min("sequence").alias(f"first_{key}"),
                *[F.min_by(c, "sequence").alias(f"{key}_{c}") for c in extra]))


def graph_references(log: DataFrame) -> DataFrame:
    """Attach to each event the first appearance of what it refers to."""
    claims = _first_seen(log, "claim.proposed", "claim_id")
    queries = _first_seen(log, "query.executed", "query_id", ("claim_id", "intent"))
    passages = _first_seen(log, "passage.observed", "passage_id", ("query_id",))
    owners = (passages.withColumnRenamed("passage_id_query_id", "query_id")
              .join(queries.select(*LEDGER, "query_id", "query_id_claim_id", "query_id_intent"),
                    [*LEDGER, "query_id"], "left")
              .select(*LEDGER, "passage_id", "first_passage_id",
                      F.col("query_id_claim_id").alias("passage_claim"),
                      F.col("query_id_intent").alias("passage_intent")))
    return (log.join(claims, [*LEDGER, "claim_id"], "left")
            .join(queries.select(*LEDGER, "query_id", "first_query_id"),
                  [*LEDGER, "query_id"], "left")
            .join(owners, [*LEDGER, "passage_id"], "left"))


def reference_rules() -> list[Rule]:
    """Rules of J13 over the output of ``graph_references``."""
    kind, seq = F.col("event_type"), F.col("sequence")

    def unknown(first):
        return F.col(first).isNull() | (F.col(first) >= seq)

    return [
        Rule("claim_exists", (kind == "claim.proposed") & (F.col("first_claim_id") < seq)),
        Rule("unknown_claim", kind.isin("query.executed", "evidence.linked",
                                        "claim.transitioned")
             & F.col("claim_id").isNotNull() & unknown("first_claim_id")),
        Rule("query_exists", (kind == "query.executed") & (F.col("first_query_id") < seq)),
        Rule("unknown_query", (kind == "passage.observed") & F.col("query_id").isNotNull()
             & unknown("first_query_id")),
        Rule("passage_exists", (kind == "passage.observed") & (F.col("first_passage_id") < seq)),
        Rule("unknown_passage", (kind == "evidence.linked") & F.col("passage_id").isNotNull()
             & unknown("first_passage_id")),
        Rule("foreign_passage", (kind == "evidence.linked")
             & ~unknown("first_passage_id")
             & ~F.col("passage_claim").eqNullSafe(F.col("claim_id"))),
    ]


def row_rules() -> list[Rule]:
    """Rules of W02 that an event breaks by itself."""
    kind, target = F.col("event_type"), F.col("to_state")
    moving, watching = kind == "claim.transitioned", kind == "passage.observed"
    no_boundary = F.trim(F.coalesce("boundary", F.lit(""))) == ""
    return [
        *[Rule(f"missing_{kind_name}", (kind == kind_name) & any_of(
            [is_missing(n) for n in names])) for kind_name, names in REQUIRED.items()],
        Rule("intent", (kind == "query.executed")
             & ~F.col("intent").isin("support", "counterevidence")),
        Rule("n_hits", (kind == "query.executed") & F.col("bad_n_hits")),
        Rule("locator_missing", watching & F.col("offset").isNull() & F.col("page_no").isNull()
             & ~F.col("bad_offset") & ~F.col("bad_page_no")),
        Rule("locator_value", watching & (F.col("bad_offset") | F.col("bad_page_no"))),
        Rule("content_sha256", watching & ~is_missing("content_sha256")
             & ~fn.is_sha256("content_sha256")),
        Rule("relation", (kind == "evidence.linked") & ~F.col("relation").isin(*S.RELATIONS)),
        Rule("unknown_state", moving & ~target.isin(*S.CLAIM_STATES)),
        Rule("boundary", moving & target.isin("SURVIVED", "NARROWED") & no_boundary),
    ]


def _transition_states(log: DataFrame) -> DataFrame:
    """State before each of a claim's first transitions, and its rank."""
    order = Window.partitionBy(*LEDGER, "claim_id").orderBy("sequence")
    ranked = (log.where((F.col("event_type") == "claim.transitioned")
                        & F.col("claim_id").isNotNull())
              .select(*LEDGER, "claim_id", "sequence", "to_state",
                      F.row_number().over(order).alias("turn"))
              .where(F.col("turn") <= _MAX_TRANSITIONS))
    return ranked.select(
        *LEDGER, "sequence", "turn",
        F.coalesce(F.lag("to_state").over(order), F.lit("PROPOSED")).alias("from_state"))


def claim_projection(events: DataFrame) -> DataFrame:
    """Every event of a claim log with its violations and whether it was applied.

    The first illegal event of a ledger stops it: later events are not applied.
    """
    log = parse_claim_log(events)
    linked = log.where(F.col("event_type") == "evidence.linked")
    support = linked.groupBy(*LEDGER, "claim_id").agg(*[
        F.min(F.when(F.col("relation") == r, F.col("sequence"))).alias(f"first_{r}")
        for r in S.RELATIONS])
    counter = (log.where((F.col("event_type") == "query.executed")
                         & (F.col("intent") == "counterevidence"))
               .groupBy(*LEDGER, "claim_id").agg(F.min("sequence").alias("first_counter")))
    edges = (linked.groupBy(*LEDGER, "claim_id", "passage_id", "relation")
             .agg(F.min("sequence").alias("first_edge")))
    joined = (graph_references(log)
              .join(support, [*LEDGER, "claim_id"], "left")
              .join(counter, [*LEDGER, "claim_id"], "left")
              .join(edges, [*LEDGER, "claim_id", "passage_id", "relation"], "left")
              .join(_transition_states(log), [*LEDGER, "sequence"], "left"))
    kind, seq, target = F.col("event_type"), F.col("sequence"), F.col("to_state")

    def seen(name):
        return F.coalesce(F.col(name) < seq, F.lit(False))

    moving, linking = kind == "claim.transitioned", kind == "evidence.linked"
    allowed = any_of([(F.col("from_state") == source) & target.isin(*targets)
                      for source, targets in S.CLAIM_TRANSITIONS.items()])
    rules = [
        *row_rules(),
        *reference_rules(),
        Rule("support_intent", linking & (F.col("relation") == "SUPPORTS")
             & (F.col("passage_intent") != "support")),
        Rule("counter_intent", linking & F.col("relation").isin(*S.COUNTER_RELATIONS)
             & (F.col("passage_intent") != "counterevidence")),
        Rule("duplicate_edge", linking & (F.col("first_edge") < seq)),
        Rule("illegal_transition", moving & target.isin(*S.CLAIM_STATES)
             & (F.col("turn").isNull() | ~allowed)),
        Rule("supported_without_edge", moving & (target == "SUPPORTED")
             & ~seen("first_SUPPORTS")),
        Rule("challenged_without_query", moving & (target == "CHALLENGED")
             & ~seen("first_counter")),
        Rule("survived_without_evidence", moving & (target == "SURVIVED")
             & ~(seen("first_SUPPORTS") & seen("first_counter"))),
        Rule("narrowed_without_edge", moving & (target == "NARROWED") & ~seen("first_BOUNDS")),
        Rule("refuted_without_edge", moving & (target == "REFUTED")
             & ~(seen("first_CONTRADICTS") | seen("first_PRECEDENT_FOR"))),
    ]
    # Read twice: to find where each ledger stops, and to mark what came before.
    checked = materialise(with_violations(joined, rules).select(
        *LEDGER, "sequence", "event_id", "event_type", *_TEXT, *_COUNTS, "violations"))
    stop = (checked.where(F.size("violations") > 0).groupBy(*LEDGER)
            .agg(F.min("sequence").alias("stopped_at")))
    return (checked.join(stop, LEDGER, "left")
            .withColumn("applied", F.col("stopped_at").isNull() | (seq < F.col("stopped_at")))
            .select(*LEDGER, "sequence", "event_id", "event_type", *_TEXT, *_COUNTS,
                    "violations", "applied"))


def claim_states(projected: DataFrame) -> DataFrame:
    """Final claims of a projection: state, boundary, reason and version."""
    proposed = F.col("event_type") == "claim.proposed"
    moved = F.col("event_type") == "claim.transitioned"
    per_claim = projected.where(F.col("applied") & (proposed | moved)).groupBy(
        *LEDGER, "claim_id").agg(
        F.max(F.when(proposed, F.col("text"))).alias("text"),
        F.max(F.when(proposed, F.col("scope"))).alias("scope"),
        F.max_by("to_state", F.when(moved, F.col("sequence"))).alias("state"),
        F.max_by("boundary", F.when(moved & F.col("boundary").isNotNull(), F.col("sequence")))
        .alias("boundary"),
        F.max_by("reason", F.when(moved, F.col("sequence"))).alias("reason"),
        F.count_if(moved).alias("moves"), F.bool_or(proposed).alias("known"))
    return per_claim.where("known").select(
        *LEDGER, "claim_id", "text", "scope",
        F.coalesce("state", F.lit("PROPOSED")).alias("state"),
        F.coalesce("boundary", F.lit("")).alias("boundary"),
        F.coalesce("reason", F.lit("")).alias("reason"), (F.col("moves") + 1).alias("version"))


def publication_issues(events: DataFrame, states: DataFrame) -> DataFrame:
    """Ledgers without claims, claims left open, surviving claims without a boundary."""
    ledgers = events.select(*LEDGER).distinct()
    counted = states.groupBy(*LEDGER).agg(F.count(F.lit(1)).alias("n"))
    none = ledgers.join(counted, LEDGER, "left_anti").select(
        *LEDGER, F.lit("graph contains no claims").alias("issue"))
    found = F.array(
        F.when(~F.col("state").isin(*S.TERMINAL_CLAIM_STATES), F.concat(
            "claim_id", F.lit(": non-terminal state "), "state")),
        F.when(F.col("state").isin("SURVIVED", "NARROWED") & (F.col("boundary") == ""), F.concat(
            "claim_id", F.lit(": surviving decision has no boundary"))))
    per_claim = states.select(*LEDGER, F.explode(F.filter(
        found, lambda issue: issue.isNotNull())).alias("issue"))
    return none.unionByName(per_claim)


def graph_metrics(projected: DataFrame) -> DataFrame:
    """Counts per ledger; claims per state are zero filled."""
    applied = F.col("applied")

    def hits(event_type):
        return F.count_if(applied & (F.col("event_type") == event_type))

    counted = projected.groupBy(*LEDGER).agg(
        hits("claim.proposed").alias("claims"), hits("query.executed").alias("queries"),
        hits("passage.observed").alias("passages"),
        hits("evidence.linked").alias("evidence_edges"))
    per_state = claim_states(projected).groupBy(*LEDGER).agg(*[
        F.count_if(F.col("state") == state).alias(f"claims_{state.lower()}")
        for state in S.CLAIM_STATES])
    names = [f"claims_{state.lower()}" for state in S.CLAIM_STATES]
    return counted.join(per_state, LEDGER, "left").fillna(0, names)


def first_violation(projected: DataFrame) -> DataFrame:
    """The event that stopped a ledger."""
    broken = projected.where(F.size("violations") > 0)
    return broken.groupBy(*LEDGER).agg(
        F.min(F.struct("sequence", violation_codes().alias("codes"))).alias("f")).select(
        *LEDGER, F.col("f.sequence").alias("sequence"), F.col("f.codes").alias("codes"))


def claim_graph_validator(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E03 for claim graphs: metrics and issues per ledger."""
    projected = materialise(claim_projection(events))
    stopped = first_violation(projected).select(
        *LEDGER, F.concat(F.lit("validator: "), "codes").alias("issue"))
    issues = publication_issues(events, claim_states(projected)).join(
        stopped.select(*LEDGER), LEDGER, "left_anti")
    return graph_metrics(projected), stopped.unionByName(issues)


def control_validator(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E03 for runs without a claim graph."""
    from veriledge.operators.rows import control_finalizer

    counted = control_finalizer(events)
    issues = counted.select(*LEDGER, F.explode("violations").alias("v")).select(
        *LEDGER, F.concat(F.col("v.code"), F.lit(": "), F.col("v.detail")).alias("issue"))
    return counted.drop("violations"), issues


def finalize_jobs(events: DataFrame, validator=claim_graph_validator, receipts=None,
                  mode: str = "exact") -> DataFrame:
    """C14: SUCCEEDED when the ledger verifies and the validator has no issue, else FAILED."""
    receipts = receipts if receipts is not None else verify_chain(events, mode)
    sound = events.join(receipts.where("ok").select(*LEDGER), LEDGER, "left_semi")
    _, issues = validator(sound)
    # An issue list is a report for people: its size is the number of open claims of one job.
    grouped = issues.groupBy(*LEDGER).agg(F.count(F.lit(1)).alias("n"),
                                          F.min("issue").alias("first_issue"))
    joined = receipts.join(grouped, LEDGER, "left")
    n = F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(1)
    return joined.select(
        *LEDGER, F.when(n == 0, "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.when(n > 0, "EVIDENCE_INVARIANT_FAILED").alias("error_code"),
        n.cast("bigint").alias("issue_count"),
        F.when(~F.col("ok"), F.concat(F.lit("ledger: "), "error"))
        .otherwise(F.col("first_issue")).alias("first_issue"),
        F.col("event_count").alias("ledger_events"), F.col("head_hash").alias("ledger_head"))


