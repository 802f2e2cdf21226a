"""Personal data: proposed spans, scored by boosted trees, beside the spans of fixed rules.

Everything runs as DataFrame expressions. Generators propose overlapping spans with high recall;
their format and context become a few discrete features. Candidates are counted per feature cell
and label over the whole corpus, where the label says whether a fixed rule confirms the span. The
trees are boosted on those counts, which are as many as there are cells whatever the corpus size,
and are written back as an expression. The sign that decides in a rule (@, plus, plain separators) is
no feature: a confirmed span stands for the same span in a looser spelling. Digit sums, lengths and
number ranges hold in any spelling and stay. A quarter of the documents is held back from the fit;
their counts say which cells are precise enough to be selected.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge.llm.common import stored

# Fixed values of the contract, in its order. Repeats are possessive where nothing after them could
# take less, and runs are entered at their beginning or where the last match ended, so the time is
# linear in the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Our own generators: looser forms of the kinds. "number" becomes card or phone by its digits.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\(@\)|\[@\]) ?"
             r"[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]|\[\.\]|\(\.\)) ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])",
    "number": r"(?<![0-9])[+(]?[0-9](?:[ ()./-]{0,3}+[0-9]){7,18}(?![0-9])",
}
# Signs without which a kind cannot occur, so most texts skip its pattern.
SIGNS = {"email": ("@", "(at)", "[at]"), "phone": ("+",)}
CUES = r"(?i)(?:tel|phone|fon|call|fax|mobil|mail|contact|card|visa|iban|account|ip|host|addr)"
FEATURES = ("generator", "digits", "groups", "brackets", "luhn", "octets", "cue", "joined")
CONTEXT = 24
TREES, RATE, PRECISION = 20, 0.5, 0.95
# Matches of one text that are placed together; documents of one in so many are held back.
RUN, FOLDS = 256, 4


def _parts(text: Column, pattern: str, signs: tuple) -> tuple[Column, Column]:
    """Matches and the gaps around them, one gap more than matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if not signs:
        return found, gaps
    may = F.lit(False)
    for sign in signs:
        may = may | text.contains(sign)
    none = F.array().cast("array<string>")
    return F.when(may, found).otherwise(none), F.when(may, gaps).otherwise(none)


def _spans(found: Column, gaps: Column) -> Column:
    """Structs of start, end, text, before and after of every match, in code points."""
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"),
                         F.slice(gaps, F.lit(2), F.size(found)).alias("h"))
    kind = "struct<at:bigint,out:array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def add(state, x):
        start = state["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["m"].alias("text"),
            F.right(x["g"], F.lit(CONTEXT)).alias("before"),
            F.left(x["h"], F.lit(1)).alias("after")))).alias("out"))

    def add_run(state, run):
        """A run of matches on its own, then its spans: arrays grow by runs, not by matches."""
        start = F.struct(state["at"].alias("at"), F.array().alias("out")).cast(kind)
        done = F.aggregate(run, start, lambda s, x: add(s, x).cast(kind))
        return F.struct(done["at"].alias("at"), F.concat(state["out"], done["out"]).alias("out"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")),
                       lambda b: F.slice(pairs, b * RUN + 1, F.lit(RUN)))
    runs = F.when(F.size(pairs) > 0, runs).otherwise(F.slice(runs, 1, 0))
    return F.aggregate(runs, empty, lambda s, run: add_run(s, run).cast(kind), lambda s: s["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether all numbers of a text are at most 255."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))

    def small(p):
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) < 3) | (F.length(p) == 3) & (p <= F.lit("255"))

    return F.forall(parts, small)


def _valid(kind: str, text: Column) -> Column:
    count = F.length(_digits(text))
    if kind == "ip":
        return _octets(text)
    if kind == "card":
        # The sum is only formed for strings of a card's length.
        return F.when(count.between(12, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _features(name: str, x: Column) -> Column:
    """Small integers that describe a candidate's format and context."""
    digits = _digits(x["text"])
    count = F.length(digits)
    size = (F.when(count < 9, 0).when(count < 10, 1).when(count < 12, 2).when(count < 16, 3)
            .when(count < 17, 4).otherwise(5))
    groups = F.least(F.size(F.split(x["text"], "[^0-9]+")), F.lit(5))
    number = F.lit(name == "number")
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"),
        F.when(number, F.when(count >= 12, "card").otherwise("phone")).otherwise(name).alias("kind"),
        F.lit(list(GENERATORS).index(name)).alias("generator"),
        F.when(number, size).otherwise(0).alias("digits"),
        F.when(number, groups).otherwise(0).alias("groups"),
        F.when(number, x["text"].contains("(").cast("int")).otherwise(0).alias("brackets"),
        F.when(number & count.between(12, 19), luhn(digits).cast("int")).otherwise(0).alias("luhn"),
        F.when(F.lit(name == "ip"), _octets(x["text"]).cast("int")).otherwise(1).alias("octets"),
        x["before"].rlike(CUES).cast("int").alias("cue"),
        (F.right(x["before"], F.lit(1)).rlike(r"[\p{L}\p{N}_]")
         | x["after"].rlike(r"[\p{L}\p{N}_]")).cast("int").alias("joined"))


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id with ``base`` (start, no, end of confirmed spans) and ``candidates`` with features."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    columns = {}
    for kind in KINDS:
        columns[f"m_{kind}"], columns[f"g_{kind}"] = _parts(
            F.col("text"), PATTERNS[kind], SIGNS.get(kind, ()))
    for name in GENERATORS:
        columns[f"cm_{name}"], columns[f"cg_{name}"] = _parts(
            F.col("text"), GENERATORS[name], SIGNS.get(name, ()))
    split = rows.withColumns(columns).drop("text")

    def confirmed_of(kind):
        spans = F.filter(_spans(F.col(f"m_{kind}"), F.col(f"g_{kind}")),
                         lambda x: _valid(kind, x["text"]))
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"), x["end"].alias("end")))

    def proposed_by(name):
        return F.transform(_spans(F.col(f"cm_{name}"), F.col(f"cg_{name}")),
                           lambda x: _features(name, x))

    base = F.concat(*map(confirmed_of, KINDS))
    candidates = F.concat(*map(proposed_by, GENERATORS))
    found = split.select("doc_id", F.array_sort(base).alias("base"), candidates.alias("c"))
    confirmed = F.transform("c", lambda c: F.struct(
        *[c[f].alias(f) for f in ("start", "end", "kind", *FEATURES)],
        F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).alias("label")))
    return found.select("doc_id", "base", confirmed.alias("candidates"))


def _split_gain(cells, rows, feature, cut):
    sums = [[0.0, 0.0], [0.0, 0.0]]
    for r in rows:
        side = sums[cells[r][0][feature] > cut]
        side[0] += cells[r][3]
        side[1] += cells[r][4]
    return sum(g * g / (h + 1.0) for g, h in sums if h > 0), sums


def _grow(cells, rows, depth):
    """A regression tree on gradients: a leaf value, or (feature, cut, low, high)."""
    g, h = sum(cells[r][3] for r in rows), sum(cells[r][4] for r in rows)
    best = (g * g / (h + 1.0) + 1e-6, None)
    if depth:
        for f in range(len(FEATURES)):
            for cut in sorted({cells[r][0][f] for r in rows})[:-1]:
                gain, _ = _split_gain(cells, rows, f, cut)
                if gain > best[0]:
                    best = (gain, (f, cut))
    if best[1] is None:
        return RATE * g / (h + 1.0)
    f, cut = best[1]
    return (f, cut, _grow(cells, [r for r in rows if cells[r][0][f] <= cut], depth - 1),
            _grow(cells, [r for r in rows if cells[r][0][f] > cut], depth - 1))


def _value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass
class Selection:
    """Boosted trees, the least score that is selected per generator, and cells that never are."""

    bias: float
    trees: list
    limits: dict
    refused: list


def boost(counts, held=None, depth: int = 3) -> Selection:
    """Logistic boosting on (features, n, positives), calibrated on the held-back counts ``held``.

    A confirmed span is one whose decisive sign (@, +, plain separators) is no feature: it stands
    for the same span without that sign. A cell is therefore judged by itself, by the share of
    confirmed ones among all its held-back candidates: only cells that reach the wanted precision
    are selected, and a generator's limit is the least score of such a cell.
    """
    total, good = sum(n for _, n, _ in counts), sum(p for _, _, p in counts)
    share = (good + 1) / (total + 2)
    bias, trees = math.log(share / (1 - share)), []
    score = [bias] * len(counts)
    for _ in range(TREES):
        cells = []
        for (x, n, p), z in zip(counts, score):
            q = 1 / (1 + math.exp(-z))
            cells.append((x, n, p, p - n * q, n * q * (1 - q)))
        tree = _grow(cells, range(len(cells)), depth)
        trees.append(tree)
        score = [max(-30.0, min(30.0, z + _value(tree, c[0]))) for z, c in zip(score, counts)]
    score = dict(zip((x for x, _, _ in counts), score))
    shown = {x: (n, p) for x, n, p in (counts if held is None else held) if n}
    good = {x for x, (n, p) in shown.items() if x in score and p > 0 and p >= PRECISION * n}
    limits = {g: min((score[x] for x in good if x[0] == g), default=math.inf) - 1e-6
              for g in range(len(GENERATORS))}
    refused = sorted(x for x, z in score.items() if z >= limits[x[0]] and x not in good)
    # Cells that only the held-back fold has are judged there, too.
    refused += sorted(x for x in shown if x not in score)
    return Selection(bias, trees, limits, refused)


def _expression(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(c[FEATURES[tree[0]]] <= tree[1], _expression(tree[2], c)).otherwise(
        _expression(tree[3], c))


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts and digest of the confirmed spans of every document, and all its spans.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. Offsets are code points,
    ends exclusive. Confirmed spans are those of the fixed rules; a candidate above its threshold
    is added where it overlaps none of them and its cell is precise by itself. Null and empty texts have no span. Repeated rows get
    the same result each; an empty table gives no rows; further columns are ignored.
    """
    found = stored(proposals(docs), "pii-spans")
    back = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(FOLDS)) == 0
    cells = (found.select(back.alias("back"), F.explode("candidates").alias("c"))
             .groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES])
             .agg(F.count_if(~F.col("back")).alias("n"), F.count_if("back").alias("held_n"),
                  F.count_if(~F.col("back") & F.col("c.label")).alias("p"),
                  F.count_if(F.col("back") & F.col("c.label")).alias("held_p")))
    # As many rows as feature cells: a fixed number, at most a few thousand.
    counts = sorted((tuple(r[f] for f in FEATURES), r["n"], r["p"], r["held_n"], r["held_p"])
                    for r in cells.collect())
    extra = F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")
    if counts:
        chosen_by = boost([(x, n, p) for x, n, p, _, _ in counts if n],
                          [(x, n, p) for x, _, _, n, p in counts])

        def cell(c):
            return F.concat_ws(",", *[c[f].cast("string") for f in FEATURES])

        refused = F.array(*[F.lit(",".join(map(str, x))) for x in chosen_by.refused]).cast("array<string>")

        def chosen(c):
            score = F.lit(chosen_by.bias)
            for tree in chosen_by.trees:
                score = score + _expression(tree, c)
            limit = F.element_at(F.array(*[F.lit(float(chosen_by.limits[g]))
                                           for g in range(len(GENERATORS))]), c["generator"] + 1)
            return ~c["label"] & (score >= limit) & ~F.array_contains(refused, cell(c))

        number = F.array(*[F.lit(k) for k in KINDS])
        extra = F.transform(F.filter("candidates", chosen), lambda c: F.struct(
            c["start"].alias("start"), (F.array_position(number, c["kind"]) - 1).cast("int").alias("no"),
            c["end"].alias("end")))
    named = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.element_at(named, x["no"] + 1), x["start"].cast("string"),
            x["end"].cast("string"))), ",")

    def count(kind):
        own = F.filter("base", lambda x: x["no"] == KINDS.index(kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.array_distinct(F.concat("base", extra)))).alias("spans"))
