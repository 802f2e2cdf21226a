"""Benchmark scoring: coverage, evidence matching, item scores, summaries, calibration, drift."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, violation_codes, with_violations
from veriledge.operators.rows import validate_observations
from veriledge.session import broadcast_if_bounded

RUN = ["run_id", "method_id"]


def coverage_join(predictions: DataFrame, challenges: DataFrame) -> DataFrame:
    """Full coverage report per (run, method, challenge).

    A run with no row for a challenge shows up as missing; a prediction for an unknown challenge
    as unknown; more than one prediction as duplicate.
    """
    counted = (predictions.groupBy(*RUN, "challenge_id").agg(F.count(F.lit(1)).alias("n")))
    runs = counted.select(*RUN).distinct()
    wanted = challenges.select("challenge_id").distinct().crossJoin(broadcast_if_bounded(runs))
    joined = (wanted.withColumn("__known", F.lit(True))
              .join(counted, [*RUN, "challenge_id"], "full_outer"))
    return joined.select(
        *RUN, "challenge_id",
        F.when(F.col("__known").isNull(), "unknown").when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "duplicate").otherwise("covered").alias("coverage"))


# Challenges that are counted together when gaps are looked for; only a block that is short is read.
_BLOCK = 1_024


def coverage_gaps(predictions: DataFrame, challenges: DataFrame) -> DataFrame:
    """J01 without its covered pairs: (run, method, challenge_id, coverage), where coverage is
    missing, unknown or duplicate.

    Challenges lie in hashed blocks. A run is first held against the number of all challenges,
    then against the number of every block; only the challenges of blocks that are short are
    listed, so a complete run costs one count and the result grows with the gaps. Null run or
    method ids are a run of their own; a null challenge id is never covered.
    """
    ids = challenges.select("challenge_id").distinct()
    total = ids.count()
    blocks = max(1, -(-total // _BLOCK))
    ids = ids.withColumn("__b", F.pmod(F.xxhash64("challenge_id"), F.lit(blocks)))
    run = F.struct(*RUN).alias("__run")  # a struct equals another also where fields are null
    counted = predictions.groupBy(*RUN, "challenge_id").agg(F.count(F.lit(1)).alias("n"))
    found = counted.select(run, "challenge_id", "n").join(ids, "challenge_id", "left")
    known = F.col("__b").isNotNull()
    kind = F.when(~known, "unknown").when(F.col("n") > 1, "duplicate")
    wrong = found.select("__run", "challenge_id", kind.alias("coverage")).where(
        F.col("coverage").isNotNull())
    have = found.groupBy("__run", "__b").agg(F.count(F.lit(1)).alias("__have"))
    short_runs = have.groupBy("__run").agg(F.coalesce(F.sum(F.when(known, F.col("__have"))),
                                                      F.lit(0)).alias("__all")).where(
        F.col("__all") < total)
    sizes = ids.groupBy("__b").agg(F.count(F.lit(1)).alias("__size"))
    short = (short_runs.select("__run", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("__b"))
        .join(sizes, "__b").join(have, ["__run", "__b"], "left")
        .where(F.coalesce("__have", F.lit(0)) < F.col("__size")))
    missing = (short.select("__run", "__b").join(ids, "__b").select("__run", "challenge_id")
               .join(found.select("__run", "challenge_id"), ["__run", "challenge_id"],
                     "left_anti").withColumn("coverage", F.lit("missing")))
    return wrong.unionByName(missing).select("__run.*", "challenge_id", "coverage")


def single_run(predictions: DataFrame) -> DataFrame:
    """Methods and runs in one prediction set; a scored file must have one of each."""
    return predictions.agg(F.countDistinct("method_id").alias("methods"),
                           F.countDistinct("run_id").alias("runs"))


def evidence_rows(df: DataFrame, keys: list[str], column: str, trim: bool = True) -> DataFrame:
    """Distinct evidence keys per row of ``df``."""
    return (df.select(*keys, F.explode(column).alias("e"))
            .select(*keys, fn.evidence_key(F.col("e"), trim).alias("k"))
            .select(*keys, "k.*").distinct())


def gold_evidence(challenges: DataFrame, trim: bool = True) -> DataFrame:
    available = challenges.withColumn("__a", F.filter(
        "accepted_evidence", lambda e: e["oracle_scope"] == "available_by_cutoff"))
    return evidence_rows(available, ["challenge_id"], "__a", trim)


def evidence_match(predictions: DataFrame, challenges: DataFrame, trim: bool = True
                   ) -> DataFrame:
    """Predicted, matched and counter-evidence counts per prediction.

    The arrays of one row are intersected in place: evidence lists are bounded by their contract,
    and the one join is on the challenge id.
    """
    def keys(column):
        return F.array_distinct(F.transform(F.coalesce(column, F.array()),
                                            lambda e: fn.evidence_key(e, trim)))

    gold = challenges.select("challenge_id", keys(F.filter(
        F.col("accepted_evidence"), lambda e: e["oracle_scope"] == "available_by_cutoff"))
        .alias("gold"))
    mine = predictions.select(*RUN, "challenge_id", keys(F.col("evidence")).alias("mine"))
    both = mine.join(gold, "challenge_id").withColumn(
        "matched", F.array_intersect("mine", "gold"))

    def counter(name):
        return F.size(F.filter(name, lambda k: k["relation"].isin(*S.COUNTER_RELATIONS)))

    return both.select(
        *RUN, "challenge_id", F.size("mine").alias("predicted_evidence"),
        F.size("matched").alias("matched_evidence"),
        counter("mine").alias("predicted_counter"), counter("matched").alias("matched_counter"))


def score_items(predictions: DataFrame, challenges: DataFrame, max_calls: int, max_tokens: int
                ) -> DataFrame:
    """A01."""
    gold = challenges.select("challenge_id", "benchmark_track", "split", "task_family",
                             "leakage_group", "counterevidence_exists", "expected_decision")
    joined = (predictions.join(gold, "challenge_id")
              .join(evidence_match(predictions, challenges), [*RUN, "challenge_id"]))
    label = F.col("counterevidence_exists")
    completed = F.col("status") == "completed"
    over = (F.col("calls") > max_calls) | (F.col("tokens") > max_tokens)
    counter_hit, counter_any = F.col("matched_counter") > 0, F.col("predicted_counter") > 0
    probability = F.col("counterevidence_probability")
    return joined.select(
        *RUN, "challenge_id", "benchmark_track", "split", "task_family", "leakage_group",
        completed.alias("completed"), over.alias("over_budget"),
        label.cast("int").alias("counterevidence_label"),
        F.when(label, counter_hit).otherwise(counter_any).alias("counterevidence_detected"),
        (label & counter_hit & completed & ~over).alias("true_positive"),
        (~label & counter_any).alias("false_positive"),
        ((F.col("predicted_decision") == F.col("expected_decision")) & completed & ~over)
        .alias("decision_correct"),
        "predicted_evidence", "matched_evidence",
        F.when(F.col("predicted_evidence") > 0,
               F.col("matched_evidence") / F.col("predicted_evidence")).otherwise(1.0)
        .alias("replay_precision"),
        probability.alias("probability"),
        F.pow(probability - label.cast("double"), F.lit(2.0)).alias("brier"),
        "calls", "tokens")


def probability_bin(probability: str | Column, bins: int = 10) -> Column:
    """Index of the half-open bin a probability lies in; 1.0 belongs to the last one. Edges are
    compared as literals, as flooring a product can land on the wrong side of an edge."""
    p = F.col(probability) if isinstance(probability, str) else probability
    out = F.lit(bins - 1)
    for index in reversed(range(bins - 1)):
        out = F.when(p < (index + 1) / bins, index).otherwise(out)
    return out


def ece(items: DataFrame, keys: list[str], label: str = "counterevidence_label",
        probability: str = "probability", bins: int = 10) -> DataFrame:
    """Expected calibration error per group."""
    inside = items.where((F.col(probability) >= 0) & (F.col(probability) <= 1))
    per_bin = inside.groupBy(*keys, probability_bin(probability, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(probability).alias("p"),
        F.sum(F.col(label).cast("double")).alias("y"))
    return per_bin.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece_10"))


def score_summary(items: DataFrame) -> DataFrame:
    """A02 with A03: one row per run and method."""
    label = F.col("counterevidence_label") == 1

    def rate(name, condition=None):
        value = F.col(name).cast("double")
        return F.avg(value if condition is None else F.when(condition, value))

    predicted = F.sum("predicted_evidence")
    # Calibration in the same pass: label and probability sums of each bin.
    place = probability_bin("probability")
    gap = F.col("counterevidence_label") - F.col("probability")
    error = sum((F.abs(F.coalesce(F.sum(F.when(place == i, gap)), F.lit(0.0)))
                 for i in range(10)), F.lit(0.0))
    return items.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"), rate("completed").alias("completed_rate"),
        (F.lit(1.0) - rate("over_budget")).alias("budget_compliance_rate"),
        rate("true_positive", label).alias("counterevidence_recall"),
        rate("false_positive", ~label).alias("counterevidence_false_positive_rate"),
        rate("decision_correct").alias("decision_accuracy"),
        F.when(predicted > 0, F.sum("matched_evidence") / predicted)
        .alias("evidence_replay_precision"),
        F.avg("brier").alias("brier_score"),
        F.sum("calls").alias("total_calls"), F.sum("tokens").alias("total_tokens"),
        (error / F.count(F.lit(1))).alias("ece_10"))


def known_answer_credit(predictions: DataFrame, challenges: DataFrame, max_calls: int,
                        max_tokens: int, challenge_sha256: str) -> DataFrame:
    """Delayed credit per prediction. Document ids are lower-cased but not trimmed here."""
    matched = evidence_match(predictions, challenges, trim=False)
    joined = predictions.join(
        challenges.select("challenge_id", "expected_decision", "counterevidence_exists"),
        "challenge_id").join(matched, [*RUN, "challenge_id"])
    earned = ((F.col("status") == "completed") & (F.col("calls") <= max_calls)
              & (F.col("tokens") <= max_tokens))
    return joined.select(
        *RUN, "challenge_id", F.lit("known_answer").alias("evaluator_kind"),
        (earned & (F.col("matched_evidence") > 0)
         & (F.col("predicted_decision") == F.col("expected_decision"))).alias("success"),
        (earned & F.col("counterevidence_exists") & (F.col("matched_counter") > 0))
        .alias("false_gap_avoided"),
        F.lit(0.0).alias("valid_finding_delta"),
        fn.evidence_ref(challenge_sha256, "challenge_id").alias("evidence_ref"))


def snapshot_reference_check(challenges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Findings on evidence -> snapshot references, in both directions."""
    refs = (challenges.select("challenge_id", F.explode("accepted_evidence").alias("e"))
            .select("challenge_id", "e.*"))
    fields = ("content_sha256", "source_url", "doi", "source_locator", "license_spdx",
              "publication_date")
    known = snapshots.select("snapshot_id", F.struct(*fields).alias("s"))
    joined = refs.join(known, "snapshot_id", "left")
    has = F.col("s").isNotNull()
    locator = F.col("locator")
    at_zero = (fn.locator_kind(locator) == "offset") & (locator["offset"] == 0)
    rules = [
        Rule("missing_snapshot", ~has),
        *[Rule(f"disagrees_{f}", has & ~F.col(f).eqNullSafe(F.col("s")[f])) for f in fields],
        Rule("locator_not_zero", has & ~F.coalesce(at_zero, F.lit(False))),
    ]
    bad = (with_violations(joined, rules).where(F.size("violations") > 0)
           .select("challenge_id", "snapshot_id", violation_codes().alias("codes")))
    orphans = (snapshots.select("snapshot_id")
               .join(refs.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
               .select(F.lit(None).cast("string").alias("challenge_id"), "snapshot_id",
                       F.lit("unreferenced").alias("codes")))
    return bad.unionByName(orphans)


def dataset_digest(df: DataFrame, row_text: Column) -> DataFrame:
    """Order-free digest of a table in place of a file digest, one row.

    Rows are hashed where they are and equal rows are counted. Digests are then folded by prefix
    in three levels. Digests are uniform, so a prefix group stays small: about n / 16^6 lines on
    the first level, at most 4096 on the others.
    """
    def fold(level, size, item):
        return (level.groupBy(F.substring("g", 1, size).alias("g"))
                .agg(fn.sha256(F.array_join(F.array_sort(F.collect_list(item)), "\n"))
                     .alias("d")))

    lines = (df.select(fn.sha256(row_text).alias("g")).groupBy("g")
             .agg(F.count(F.lit(1)).alias("n")))
    first = fold(lines, 6, F.concat_ws(":", "g", F.col("n").cast("string")))
    second = fold(first, 3, F.concat_ws(":", "g", "d"))
    return second.agg(fn.sha256(F.array_join(
        F.array_sort(F.collect_list(F.concat_ws(":", "g", "d"))), "\n")).alias("digest"))


def seal_benchmark(challenges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The counts of a seal manifest as (field, key, value) rows."""
    def rows(df, field, key, value):
        return df.select(F.lit(field).alias("field"), key.cast("string").alias("key"),
                         value.cast("string").alias("value"))

    status = F.col("construction_provenance.status")
    by_split = challenges.groupBy(
        F.concat_ws(":", "benchmark_track", "split").alias("k")).count()
    by_status = challenges.groupBy(status.alias("k")).count()
    totals = challenges.agg(
        F.count(F.lit(1)).alias("challenges"),
        F.countDistinct("leakage_group").alias("leakage_groups"),
        F.bool_and(status == "frozen").alias("publication_ready"))
    used = (challenges.select(F.explode("accepted_evidence.snapshot_id").alias("snapshot_id"))
            .distinct())
    n_snapshots = snapshots.agg(F.countDistinct("snapshot_id").alias("n"))
    n_used = used.join(snapshots.select("snapshot_id").distinct(), "snapshot_id").agg(
        F.count(F.lit(1)).alias("n"))
    blank = F.lit("")
    out = rows(by_split, "counts", F.col("k"), F.col("count"))
    out = out.unionByName(rows(by_status, "curation_statuses", F.col("k"), F.col("count")))
    for name in ("challenges", "leakage_groups", "publication_ready"):
        out = out.unionByName(rows(totals, name, blank, F.col(name)))
    out = out.unionByName(rows(n_snapshots, "snapshots", blank, F.col("n")))
    return out.unionByName(rows(n_used, "referenced_snapshots", blank, F.col("n")))


# --- drift -----------------------------------------------------------------------------------

def observation_pairing(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """Structs ``s`` and ``o`` side by side; a null side is a coverage finding. Repeated
    observations of one snapshot are reported by ``n_observations``."""
    left = snapshots.select("snapshot_id", F.struct(*snapshots.columns).alias("s"))
    # The earliest instant, whatever zone its text is written in; unreadable texts come last.
    stamp = F.try_to_timestamp("observed_at")
    instant = F.struct(stamp.isNull(), stamp, "observed_at")
    right = (observations.groupBy("snapshot_id").agg(
        F.min_by(F.struct(*observations.columns), instant).alias("o"),
        F.count(F.lit(1)).alias("n_observations")))
    return left.join(right, "snapshot_id", "full_outer")


def drift_records(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """J04 + P11 + F09: one record per snapshot id seen on either side."""
    pairs = validate_observations(observation_pairing(snapshots, observations))
    pairs = with_violations(pairs, [Rule("duplicate_observation", F.col("n_observations") > 1)])
    clean = F.size("violations") == 0
    return pairs.withColumn("__class", fn.drift_class()).select(
        "snapshot_id", F.when(clean, F.col("__class")).alias("classification"),
        F.col("s.content_sha256").alias("expected_sha256"),
        F.when(F.col("o.status") == "available", F.col("o.content_sha256"))
        .alias("observed_sha256"),
        (~F.col("o.source_locator").eqNullSafe(F.col("s.source_locator")))
        .alias("source_locator_changed"),
        F.col("o.retrieval.independently_verified").alias("independently_verified"),
        F.col("o.retrieval.receipt_sha256").alias("receipt_sha256"), "violations")


def drift_report(records: DataFrame) -> DataFrame:
    """One summary row; the gate needs every capsule exact and independently checked."""
    def hits(name):
        return F.count_if(F.col("classification") == name).alias(name.lower())

    exact = F.coalesce(F.col("classification") == "EXACT", F.lit(False))
    independent = F.coalesce(F.col("independently_verified"), F.lit(False))
    kinds = ("EXACT", "LOCATOR_DRIFT", "NORMALIZATION_DRIFT", "CONTENT_DRIFT", "UNAVAILABLE")
    return records.agg(
        F.count(F.lit(1)).alias("snapshots"), *[hits(kind) for kind in kinds],
        F.count_if(F.size("violations") > 0).alias("invalid"),
        F.bool_and(exact).alias("all_exact"),
        F.bool_and(independent).alias("all_independently_verified"),
        F.bool_and(exact & independent).alias("publication_gate_passed"))
