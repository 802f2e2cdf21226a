"""Scalar functions as Columns. Python runs only where Spark has no built-in, on Arrow batches."""
from __future__ import annotations

import json
import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veriledge import schemas as S
from veriledge.functions.contracts import is_missing

# Unicode white space as split on by the data's producers, including U+001C-U+001F.
_FAR_SPACE = (r"[\x{1680}-\x{3000}&&"
              r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]")
_ANY_SPACE = rf"[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}{_FAR_SPACE}]"
_ODD_SPACE = rf"[\x09-\x0D\x1C-\x1F\x{{85}}\x{{A0}}{_FAR_SPACE}]"
# Runs of it that are not one plain space already; the others need no replacement.
_SPACE = rf"{_ODD_SPACE}{_ANY_SPACE}*+| {_ANY_SPACE}++"
# JSON texts whose canonical spelling the built-in printer may change: fractions, exponents,
# negative zero, escapes, very long integers and characters outside the basic plane.
_RISKY_JSON = r"[0-9][.eE]|-0|\\|[0-9]{19}|[\x{10000}-\x{10FFFF}]"


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- JSON and digests ------------------------------------------------------------------------

# Texts of a batch whose results are Python strings at the same time.
_TOGETHER = 64


def exact_json(text: str | None) -> str | None:
    """Canonical spelling of one JSON text in Python; null for a text that is not finite JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True,
                          separators=(",", ":"), allow_nan=False)
    except ValueError:
        return None


@F.arrow_udf(StringType())
def _exact_json(texts: pa.Array) -> pa.Array:
    """Texts leave Arrow one by one and go back a few at a time: a batch may hold long documents."""
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    return pa.concat_arrays([
        pa.array([exact_json(text.as_py()) for text in texts.slice(at, _TOGETHER)], pa.string())
        for at in range(0, max(len(texts), 1), _TOGETHER)])


def parse_json_strict(text: str | Column) -> Column:
    """The value of a JSON text, null when anything but white space follows it.

    The built-in parser stops after the first value. Here the text becomes a member of an object
    whose last key is the text's own digest: only a text that is exactly one value leaves that
    key where the parser finds it.
    """
    value = _c(text)
    mark = F.sha2(value, 256)
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit(',"'), mark, F.lit('":1}')))
    members = F.try_variant_get(wrapped, "$", "map<string,variant>")
    # Bound to a variable, the members are made once for both uses.
    return F.get(F.transform(F.array(members), lambda found: F.when(
        F.array_contains(F.map_keys(found), mark), F.try_element_at(found, F.lit("v")))), F.lit(0))


def canonical_json(text: str | Column, mode: str = "native") -> Column:
    """sorted keys, no spaces, non-ASCII kept; null for text that is not finite JSON.

    ``native`` stays in the JVM. ``exact`` sends only the texts to Python whose numbers or
    escapes the JVM printer spells differently; all others are null for the Python side.
    """
    value = _c(text)
    native = F.to_json(F.try_parse_json(value))
    if mode == "native":
        return native
    risky = value.rlike(_RISKY_JSON)
    return F.when(risky, _exact_json(F.when(risky, value))).otherwise(native)


def canonical_object(**fields: Column) -> Column:
    """Canonical JSON of named Columns; nested structs and arrays are allowed."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.to_variant_object(F.struct(*ordered)))


def sha256(value: str | Column) -> Column:
    return F.sha2(_c(value).cast("binary"), 256)


def json_text(value: str | Column) -> Column:
    """A string as a JSON string literal; null becomes null. Only control characters need the
    printer."""
    text = _c(value).cast("string")
    body = F.to_json(F.to_variant_object(F.struct(text.alias("v"))))
    printed = F.substring(body, F.lit(6), F.length(body) - 6)  # {"v":"..."} -> "..."
    plain = ~text.rlike(_CONTROL)
    return F.when(plain, F.concat(F.lit('"'), _escaped(text), F.lit('"'))).otherwise(printed)


_CONTROL = r"[\x00-\x1f]"


def _escaped(text: Column) -> Column:
    """Backslashes and quotes of a text without control characters."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def envelope_start() -> Column:
    """Canonical event text before the payload."""
    return F.concat(_members(("aggregate_id", "aggregate_type", "event_id", "event_type",
                              "idempotency_key", "job_id", "occurred_at")), F.lit(',"payload":'))


def envelope_parts(payload: str | Column = "payload", mode: str = "exact"
                   ) -> tuple[Column, Column]:
    """Canonical event text before the previous hash and after the sequence number."""
    return (F.concat(envelope_start(), canonical_json(payload, mode), F.lit(',"previous_hash":')),
            F.concat(F.lit(',"tenant_id":'), json_text("tenant_id"), F.lit("}")))


def payload_left(payload: str | Column = "payload", mode: str = "exact") -> Column:
    """The payload where ``canonical_json`` would send it to Python, else null: a task that runs
    Python anyway spells it there by ``exact_json``."""
    value = _c(payload)
    return F.when(value.rlike(_RISKY_JSON), value) if mode == "exact" else F.lit(None).cast("string")


def _members(names: tuple[str, ...]) -> Column:
    """The start of an object with these string members. One look at all of them says whether any
    needs the printer, which is then bound to variables and kept out of the compiled path."""
    plain = ~F.concat_ws("", *names).rlike(_CONTROL)
    quick = []
    for name in names:
        quick += [F.lit(('{"' if not quick else '","') + f'{name}":"'),
                  _escaped(F.col(name).cast("string"))]
    texts = F.array(F.struct(*[F.col(name).cast("string").alias(name) for name in names]))
    careful = F.transform(texts, lambda row: F.concat(*[
        part for i, name in enumerate(names)
        for part in (F.lit(("," if i else "{") + f'"{name}":'), json_text(row[name]))]))
    return F.coalesce(F.when(plain, F.concat(*quick, F.lit('"'))), F.get(careful, F.lit(0)))


def envelope_json(payload: str | Column = "payload", mode: str = "exact") -> Column:
    """Canonical text of an event without its own hash."""
    head, tail = envelope_parts(payload, mode)
    return F.concat(
        head, json_text("previous_hash"),
        F.lit(',"schema_version":'), F.col("schema_version").cast("string"),
        F.lit(',"sequence":'), F.col("sequence").cast("string"), tail)


def event_hash(payload: str | Column = "payload", mode: str = "exact") -> Column:
    """F02."""
    return sha256(envelope_json(payload, mode))


def semantic_fingerprint_json(mode: str = "exact") -> Column:
    """F05 as the canonical JSON text of the six fields that decide what an event means."""
    def field(name: str) -> Column:
        return F.coalesce(json_text(name), F.lit("null"))

    return F.concat(
        F.lit('{"aggregate_id":'), field("aggregate_id"),
        F.lit(',"aggregate_type":'), field("aggregate_type"),
        F.lit(',"event_type":'), field("event_type"), F.lit(',"job_id":'), field("job_id"),
        F.lit(',"payload":'), F.coalesce(canonical_json("payload", mode), F.lit("null")),
        F.lit(',"tenant_id":'), field("tenant_id"), F.lit("}"))


def semantic_fingerprint(mode: str = "exact") -> Column:
    """digest of that text."""
    return sha256(semantic_fingerprint_json(mode))


def hypothesis_digest(metadata: Column | None = None) -> Column:
    """F03."""
    names = ("hypothesis_id", "claim", "boundary", "support_evidence", "counter_queries",
             "physical_checks")
    extra = metadata if metadata is not None else F.parse_json(F.lit("{}"))
    return sha256(canonical_object(metadata=extra, **{name: F.col(name) for name in names}))


def locator_variant(locator: str | Column) -> Column:
    """A locator struct as an object that carries only its non-null member."""
    value = _c(locator)
    offset, page = value["offset"], value["page_no"]
    return F.try_parse_json(F.concat(
        F.lit("{"), F.concat_ws(
            ",", F.concat(F.lit('"offset":'), offset.cast("string")),
            F.concat(F.lit('"page_no":'), page.cast("string"))),
        F.lit("}"),
    ))


def json_number(value: str | Column) -> Column:
    """A double spelled as JSON: 0.0 stays 0.0, small exponents are kept short."""
    number = _c(value).cast("double")
    return number.cast("string")


def prediction_commitment_json() -> Column:
    """Canonical text of the ten semantic prediction fields."""
    evidence = F.to_json(F.transform(F.col("evidence"), lambda item: F.to_variant_object(
        F.struct(item["content_sha256"].alias("content_sha256"),
                 item["doc_id"].alias("doc_id"),
                 locator_variant(item["locator"]).alias("locator"),
                 item["relation"].alias("relation")))))
    return F.concat(
        F.lit('{"calls":'), F.col("calls").cast("string"),
        F.lit(',"challenge_id":'), json_text("challenge_id"),
        F.lit(',"counterevidence_probability":'), json_number("counterevidence_probability"),
        F.lit(',"evidence":'), evidence,
        F.lit(',"method_id":'), json_text("method_id"),
        F.lit(',"predicted_decision":'), json_text("predicted_decision"),
        F.lit(',"run_id":'), json_text("run_id"),
        F.lit(',"schema_version":'), F.col("schema_version").cast("string"),
        F.lit(',"status":'), json_text("status"),
        F.lit(',"tokens":'), F.col("tokens").cast("string"), F.lit("}"),
    )


def prediction_commitment() -> Column:
    """F04."""
    return sha256(prediction_commitment_json())


def request_digest(kind: str | Column, request_json: str | Column) -> Column:
    """digest of a cached request together with its kind."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return sha256(canonical_object(kind=kind, request=F.try_parse_json(_c(request_json))))


# --- text ------------------------------------------------------------------------------------

def collapse_spaces(value: str | Column) -> Column:
    return F.trim(F.regexp_replace(_c(value), _SPACE, " "))


def normalize_query(value: str | Column) -> Column:
    """F07."""
    return collapse_spaces(F.lower(F.coalesce(_c(value), F.lit(""))))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


@cache
def nfkc_risky() -> str:
    """A pattern for texts that NFKC may change: any code point that it replaces, that combines
    with the one before it, or that has an order among marks."""
    second = {chr(int(unicodedata.decomposition(chr(i)).split()[1], 16)) for i in range(0x110000)
              if len(unicodedata.decomposition(chr(i)).split()) == 2
              and unicodedata.decomposition(chr(i))[0] != "<"}
    # Vowels and final consonants of Hangul compose by rule.
    second |= {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    risky = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (
        chr(i) in second or unicodedata.combining(chr(i))
        or unicodedata.normalize("NFKC", chr(i)) != chr(i))]
    runs, start = [], None
    for i, point in enumerate(risky):
        start = point if start is None else start
        if i + 1 == len(risky) or risky[i + 1] != point + 1:
            runs.append((start, point))
            start = None
    return _class(runs)


def _class(runs: list[tuple[int, int]]) -> str:
    """A character class of sorted ranges that compares a character with a few bounds only: an
    engine tries the members of one flat class one after another."""
    if len(runs) <= 4:
        return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"
    half = len(runs) // 2
    return "[" + "".join(rf"[\x{{{part[0][0]:X}}}-\x{{{part[-1][1]:X}}}&&{_class(part)}]"
                         for part in (runs[:half], runs[half:])) + "]"


def normalize_passage(value: str | Column) -> Column:
    """NFKC, then collapsed spaces. Only texts that NFKC may change leave the JVM."""
    text = _c(value)
    risky = text.rlike(nfkc_risky())
    return collapse_spaces(F.when(risky, _nfkc(F.when(risky, text))).otherwise(text))


def strategy_key(kind: str | Column = "kind", pattern: str | Column = "pattern") -> Column:
    """F06."""
    return sha256(F.concat(_c(kind), F.lit("|"), normalize_query(pattern)))


def terms(text: str | Column) -> Column:
    """lower-case alphanumeric tokens of two or more characters that are not stop words."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda token: (F.length(token) > 1) & ~token.isin(*S.STOPWORDS))


def label_escape(value: str | Column) -> Column:
    """F23."""
    text = F.replace(_c(value), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def rendered_query(query: str | Column, strategies: str | Column, intent: str | Column) -> Column:
    """append the recalled strategies to counter queries; other queries stay as they are."""
    lines = F.transform(_c(strategies), lambda item: F.concat(
        F.lit("- "), item["kind"], F.lit(": "), item["pattern"]))
    memory = F.concat(F.lit("\n" + S.MEMORY_MARKER + "\n"), F.array_join(lines, "\n"))
    applies = (_c(intent) == "counterevidence") & (F.size(_c(strategies)) > 0)
    return F.when(applies, F.concat(_c(query), memory)).otherwise(_c(query))


# --- dates and identity ----------------------------------------------------------------------

def iso_date(value: str | Column) -> Column:
    """``YYYY-MM-DD`` only; anything else is null."""
    text = _c(value).cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def zoned_timestamp(value: str | Column) -> Column:
    """ISO-8601 with an explicit zone, in UTC; null when the zone is absent."""
    text = _c(value).cast("string")
    has_zone = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)" + S.ZONE_SUFFIX)
    return F.when(has_zone, F.try_to_timestamp(text))


def publication_date(dates: list[str | Column], years: list[str | Column]) -> Column:
    """first present date key decides; only without any does the year count, as 31 December."""
    present = F.coalesce(*[F.when(~is_missing(_c(d)), _c(d).cast("string")) for d in dates])
    year = F.coalesce(*[
        F.when(~is_missing(_c(y)) & (_c(y).cast("string") != "0"), _c(y).cast("string"))
        for y in years])
    year_int = F.when(year.rlike("^[0-9]{4}$"), year.cast("int"))
    from_year = F.when(year_int >= 1000, F.make_date(year_int, F.lit(12), F.lit(31)))
    return F.when(present.isNotNull(), iso_date(F.substring(present, 1, 10))).otherwise(from_year)


def is_sha256(value: str | Column) -> Column:
    """F18."""
    return F.coalesce(_c(value).rlike(S.HEX64), F.lit(False))


def safe_id(value: str | Column) -> Column:
    """F18."""
    return F.coalesce(_c(value).rlike(S.SAFE_ID), F.lit(False))


def safe_relpath(value: str | Column, suffix: str = ".jsonl") -> Column:
    """relative, without a parent step, with the wanted extension."""
    path = _c(value)
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return F.coalesce(
        ~path.startswith("/") & ~F.array_contains(parts, "..") & name.endswith(suffix)
        & (F.length(name) > len(suffix)), F.lit(False))


def locator_kind(locator: str | Column) -> Column:
    value = _c(locator)
    return (F.when(value["offset"].isNotNull() & value["page_no"].isNull(), F.lit("offset"))
            .when(value["page_no"].isNotNull() & value["offset"].isNull(), F.lit("page_no")))


def locator_position(locator: str | Column) -> Column:
    return F.coalesce(_c(locator)["offset"], _c(locator)["page_no"])


def evidence_key(item: Column, trim: bool = True) -> Column:
    """the five parts that identify a cited passage."""
    doc = F.lower(F.coalesce(item["doc_id"], F.lit("")))
    return F.struct(
        (F.trim(doc) if trim else doc).alias("doc_id"),
        item["relation"].alias("relation"),
        locator_kind(item["locator"]).alias("locator_kind"),
        locator_position(item["locator"]).alias("position"),
        item["content_sha256"].alias("content_sha256"),
    )


def passage_id(query_id, doc_id, offset, digest) -> Column:
    """F16: identity of one re-read passage."""
    seed = F.concat_ws("|", _c(query_id), _c(doc_id), _c(offset).cast("string"), _c(digest))
    return F.concat(F.lit("obs-"), F.substring(sha256(seed), 1, 32))


def capsule_passage_id(snapshot_id, query_id) -> Column:
    """F16 for sealed capsules."""
    return F.concat(_c(snapshot_id), F.lit("@"), _c(query_id))


def evidence_ref(file_sha256: str | Column, challenge_id: str | Column) -> Column:
    """F22."""
    digest = F.lit(file_sha256) if isinstance(file_sha256, str) else file_sha256
    return F.concat(F.lit("sha256:"), digest, F.lit("#challenge:"), _c(challenge_id))


def idempotency_key(*parts: str | Column) -> Column:
    """colon separated key; strings are literals, pass Columns for values."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string")
                              for p in parts])


def transition_hash(strategy_id, from_status, to_status, evaluations, successes,
                    wilson) -> Column:
    """digest of a status change."""
    return sha256(F.concat(
        F.lit('{"evaluations":'), _c(evaluations).cast("string"),
        F.lit(',"from_status":"'), _c(from_status),
        F.lit('","strategy_id":"'), _c(strategy_id),
        F.lit('","successes":'), _c(successes).cast("string"),
        F.lit(',"to_status":"'), _c(to_status),
        F.lit('","wilson_lower":'), json_number(wilson), F.lit("}"),
    ))


def order_digest(ids: str | Column) -> Column:
    """digest of an ordered id list."""
    return sha256(F.to_json(_c(ids)))


def parse_traceparent(header: str | Column, salt: str | Column) -> Column:
    """W3C trace context. New ids come from a hash of ``salt``, so a rerun agrees."""
    text = F.lower(F.trim(F.coalesce(_c(header), F.lit(""))))
    trace, parent, flags = [F.regexp_extract(text, S.TRACEPARENT, i) for i in (1, 2, 3)]
    usable = text.rlike(S.TRACEPARENT) & (trace != "0" * 32) & (parent != "0" * 16)
    fresh = sha256(_c(salt))
    return F.struct(
        F.when(usable, trace).otherwise(F.substring(fresh, 1, 32)).alias("trace_id"),
        F.substring(fresh, 33, 16).alias("span_id"),
        F.when(usable, parent).otherwise(F.lit("")).alias("parent_span_id"),
        F.when(usable, flags).otherwise(F.lit("01")).alias("flags"),
    )


# --- numbers ---------------------------------------------------------------------------------

def wilson_lower(successes: str | Column, trials: str | Column, z: float = S.WILSON_Z) -> Column:
    """F13."""
    n = _c(trials).cast("double")
    p = _c(successes).cast("double") / F.when(n > 0, n)
    centre = p + F.lit(z * z) / (n * 2)
    margin = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (n * n * 4))
    bound = (centre - margin) / (F.lit(1.0) + F.lit(z * z) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), bound)).otherwise(F.lit(0.0))


def drift_class(snapshot: str = "s", observation: str = "o") -> Column:
    """F09 over two struct columns."""
    s, o = F.col(snapshot), F.col(observation)
    observed = sha256(o["content"])
    return (
        F.when(o["status"] == "unavailable", F.lit("UNAVAILABLE"))
        .when(observed == s["content_sha256"],
              F.when(o["source_locator"].eqNullSafe(s["source_locator"]), F.lit("EXACT"))
              .otherwise(F.lit("LOCATOR_DRIFT")))
        .when(normalize_passage(o["content"]) == normalize_passage(s["content"]),
              F.lit("NORMALIZATION_DRIFT"))
        .otherwise(F.lit("CONTENT_DRIFT"))
    )
