"""Merkle manifest of a dataset: a SHA midstate tree per source, and one tree over the sources.

Every parent row keeps its children's digests and the copied hash state before each child slot.
A changed child is folded from the state of its slot, its replacement and its right siblings; what
lies to the left is never read again. Nodes are rows: levels are built and proofs handed down by
joins on (source, node number), so no source, however large, meets in one task.
"""
from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge.llm.common import placed, slices, stored
from veriledge.llm.sha_states import absorb, from_bytes, resume

# Fixed value of the contract: children of a parent.
FAN = 16
# Fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A source as a key without nulls; null comes first.
SOURCE = ["has_source", "source_key"]
STEP = "array<struct<state: binary, left: binary, right: binary, n: int>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(columns[f]) for f in FIELDS]).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _digests(values, size: int = 32) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, size)


def _padded(values: list, width: int) -> np.ndarray:
    """(rows, width, 32) of byte strings that hold up to ``width`` digests each."""
    whole = b"".join(v.ljust(32 * width, b"\0") for v in values)
    return np.frombuffer(whole, np.uint8).reshape(len(values), width, 32)


def parents(level: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Parent rows of one level: keys, run, n, children, states, digest, members.

    ``level`` has keys, place, n and digest; ``extra`` columns of the children are kept in
    ``members``. A run has at most 16 rows. A lone node of its keys (n = 1) is passed on as it is.
    """
    member = F.struct("place", "digest", *(extra or []))
    runs = (level.withColumn("run", F.floor(F.col("place") / FAN))
            .groupBy(*keys, "run").agg(F.first("n").alias("n"),
                                       F.sort_array(F.collect_list(member)).alias("members"))
            .withColumn("digests", F.col("members.digest")))

    def build(batches):
        for batch in slices(batches, 2048):
            kids = batch.column("digests").to_pylist()
            counts = np.array([len(k) for k in kids], np.int64)
            children = [b"".join(k) for k in kids]
            made, states = absorb(_padded(children, FAN), counts)
            lone = np.array(batch.column("n").to_pylist(), np.int64) == 1
            own = [children[i] if lone[i] else made[i].tobytes() for i in range(len(kids))]
            kept = [states[i, :c].tobytes() for i, c in enumerate(counts)]
            names = [n for n in batch.schema.names if n != "digests"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(children, pa.binary()),
                 pa.array(kept, pa.binary()), pa.array(own, pa.binary())],
                names=[*names, "children", "states", "digest"])

    schema = ", ".join([f"{n} {t}" for n, t in runs.dtypes if n != "digests"]
                       + ["children binary", "states binary", "digest binary"])
    return runs.mapInArrow(build, schema)


@dataclass
class Tree:
    """``levels``: stored parent rows, leaves' parents first; ``tops``: keys and top digest."""

    keys: list[str]
    levels: list[DataFrame]
    tops: DataFrame


def build_tree(leaves: DataFrame, keys: list[str], label: str, extra: list[str] | None = None
               ) -> Tree:
    """All levels above ``leaves`` (keys, place, n, digest, extra columns), each stored."""
    levels = [stored(parents(leaves, keys, extra), label)]
    tops = []
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while True:
        nodes = levels[-1].select(*keys, F.col("run").alias("place"),
                                  F.ceil(F.col("n") / FAN).alias("n"), "digest")
        tops.append(nodes.where("n = 1").select(*keys, "digest"))
        most = -(-most // FAN)
        if most <= 1:
            break
        levels.append(stored(parents(nodes.where("n > 1"), keys), label))
    out = tops[0]
    for part in tops[1:]:
        out = out.unionByName(part)
    return Tree(keys, levels, out)


def with_step(slot: Column, count: Column) -> Column:
    """``path`` with one more step before it: from child number ``slot`` to this parent."""
    step = F.struct(
        F.substring("states", slot * 32 + 1, F.lit(32)).alias("state"),
        F.substring("children", F.lit(1), slot * 32).alias("left"),
        F.substring("children", slot * 32 + 33, F.octet_length("children")).alias("right"),
        count.alias("n"))
    return F.concat(F.array(step), "path").cast(STEP)


def handed_down(tree: Tree, above: DataFrame) -> list[DataFrame]:
    """Each level's parent rows with ``path``, the steps from there to the root, and ``subroot``.

    ``above`` has one row per keys: path and subroot of the top. A step is a slot's kept state,
    the siblings to its left and right, and the number of children.
    """
    out, paths = [], None
    for level in reversed(tree.levels):
        here = level.where(f"n <= {FAN}").join(above, tree.keys)
        if paths is not None:
            here = here.unionByName(level.where(f"n > {FAN}").join(paths, [*tree.keys, "run"]))
        out.append(here)
        if level is tree.levels[0]:
            break
        count = (F.octet_length("children") / 32).cast("int")
        slot = F.col("slot")
        paths = stored(
            here.withColumn("slot", F.explode(F.sequence(F.lit(0), count - 1)))
            .select(*tree.keys, (F.col("run") * FAN + slot).alias("run"), "subroot",
                    with_step(slot, count).alias("path")), "merkle-paths")
    return out[::-1]


@dataclass
class Manifest:
    """Trees of the sources and over the sources; ``root`` is hex, None for an empty table."""

    sources: Tree
    top: Tree
    root: str | None


def build_manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Leaves of ``docs`` per source in ascending doc_id, their trees, and the tree of subroots.

    ``changed`` is the text that a leaf is checked against later; by default the text itself.
    Equal doc_ids of a source are ordered by leaf digest, null ones come first; null is a value of
    every field and a source of its own. Other columns are ignored.
    """
    fields = {f: F.col(f).cast("string") for f in FIELDS}
    fields["doc_id"] = F.col("doc_id").cast("long")
    text = fields["text"]
    leaves = stored(docs.select(
        fields["doc_id"].alias("doc_id"),
        fields["source"].isNotNull().alias("has_source"),
        F.coalesce(fields["source"], F.lit("")).alias("source_key"),
        leaf_digest(fields).alias("digest"),
        leaf_digest({**fields, "text": text if changed is None else changed}).alias("changed")),
        "merkle-leaves")
    # Repeated rows are alike in all columns; a running number lets a range split them.
    level = placed(leaves.withColumn("copy", F.monotonically_increasing_id()), SOURCE,
                   ["doc_id", "digest", "copy"], "merkle-placed")
    sources = build_tree(level, SOURCE, "merkle-level", ["doc_id", "changed"])
    subroots = stored(sources.tops.withColumn("tree", F.lit(0)), "merkle-subroots")
    top = build_tree(placed(subroots, ["tree"], SOURCE, "merkle-sources"), ["tree"],
                     "merkle-top", SOURCE)
    # One row, unless the table is empty.
    last = top.tops.first()
    return Manifest(sources, top, bytes(last["digest"]).hex() if last else None)


def _above(manifest: Manifest) -> DataFrame:
    """Per source: its subroot and the steps from it to the root."""
    start = manifest.top.tops.select(
        "tree", F.lit(None).cast("binary").alias("subroot"), F.array().cast(STEP).alias("path"))
    runs = handed_down(manifest.top, start)[0]
    longer = with_step(F.col("slot"), F.size("members"))
    return stored(
        runs.select("*", F.posexplode("members").alias("slot", "member"))
        .select(*[F.col(f"member.{k}").alias(k) for k in SOURCE],
                F.col("member.digest").alias("subroot"),
                F.when(F.col("n") > 1, longer).otherwise(F.col("path")).alias("path")),
        "merkle-above")


def _check_runs(batches, root: str):
    """Fold every leaf of runs that carry their path; one row per leaf."""
    for batch in slices(batches, 512):
        members, paths = batch.column("members").to_pylist(), batch.column("path").to_pylist()
        n, subroots = batch.column("n").to_pylist(), batch.column("subroot").to_pylist()
        states = batch.column("states").to_pylist()
        counts = np.array([len(m) for m in members], np.int64)
        run = np.repeat(np.arange(len(members)), counts)
        slot = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        children = _padded([b"".join(x["digest"] for x in m) for m in members], FAN)
        folded = _digests([x["changed"] for m in members for x in m]).copy()
        live = np.flatnonzero(np.array(n, np.int64)[run] > 1)
        if len(live):
            kept = _padded(states, FAN)
            shifted = np.minimum(slot[live, None] + np.arange(1, FAN)[None, :], FAN - 1)
            folded[live] = resume(
                from_bytes(kept[run[live], slot[live]]), folded[live],
                children[run[live][:, None], shifted], counts[run[live]] - 1 - slot[live],
                counts[run[live]])
        depths = np.array([len(p) for p in paths], np.int64)
        for level in range(int(depths.max(initial=0))):
            has = depths > level
            steps = [p[level] if ok else None for p, ok in zip(paths, has)]
            state = _digests([s["state"] if s else bytes(32) for s in steps])
            rights = [s["right"] if s else b"" for s in steps]
            right = _padded(rights, FAN - 1)
            n_right = np.array([len(r) // 32 for r in rights], np.int64)
            width = np.array([s["n"] if s else 0 for s in steps], np.int64)
            live = np.flatnonzero(has[run])
            at = run[live]
            folded[live] = resume(from_bytes(state[at]), folded[live], right[at], n_right[at],
                                  width[at])
        out = [[], [], [], [], []]
        texts = [row.tobytes().hex() for row in folded]
        i = 0
        for m, path, top in zip(members, paths, subroots):
            hexes = [x["digest"].hex().encode() for x in m]
            upper = b"".join((s["left"] + s["right"]).hex().encode() for s in path)
            for k, x in enumerate(m):
                proof = hashlib.sha256(b"".join(hexes[:k] + hexes[k + 1:]))
                proof.update(upper)
                for column, value in zip(out, (x["doc_id"], hexes[k].decode(), top.hex(),
                                               proof.hexdigest(), texts[i])):
                    column.append(value)
                i += 1
        rows = len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()),
             pa.array(out[2], pa.string()), pa.array([root] * rows, pa.string()),
             pa.array(out[3], pa.string()), pa.array(out[4], pa.string()),
             pa.array([t == root for t in texts], pa.bool_())],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def check_leaves(manifest: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is recomputed from the leaf's ``changed`` text and the kept states and right
    siblings of its path; ``verified`` says whether it is the root.
    """
    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean")
    runs = handed_down(manifest.sources, _above(manifest))[0]
    root = manifest.root or ""
    return runs.select("members", "states", "n", "path", "subroot").mapInArrow(
        lambda batches: _check_runs(batches, root), schema)


def tamper_check(docs: DataFrame, divisor: int = 5) -> DataFrame:
    """Manifest of ``docs``, then every leaf folded again, some from a tampered text.

    Where the unsigned CRC-32 of the decimal doc_id is divisible by ``divisor``, A-Z of the text is
    lower-cased before folding. A null doc_id is not tampered with, null texts stay. An empty
    table gives no rows; repeated rows are leaves of their own.
    """
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    text = F.col("text").cast("string")
    changed = F.when(F.coalesce(crc % divisor == 0, F.lit(False)), lower_ascii(text)).otherwise(text)
    return check_leaves(build_manifest(docs, changed))
