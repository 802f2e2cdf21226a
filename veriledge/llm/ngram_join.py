"""N-gram Jaccard join: bucketed by rare shared n-grams, verified in prefix trees.

1. Every text becomes a set of 64-bit word n-gram hashes. Equal sets form one class, and only
   classes are joined.
2. Two classes at the threshold share an n-gram among the first few of either, in any global
   order. The order used is: a fixed sixth of all hash values first, those by document frequency
   and then hash; then the rest by hash. Frequencies are needed for that share only. An n-gram of
   one class takes a place in the order but makes no bucket.
3. A bucket whose members all meet in one other bucket, or that has the members of another, is
   left out. Members of the others are first compared by sketches (how many n-grams fall in each
   of some hash ranges), whose cell-wise minimum is an upper bound of the overlap: a member stays
   where some other one of fitting size may reach the threshold. Only then texts are brought
   together, in blocks where a bucket is large: every member in its largest bucket first, and then
   in those buckets that the links found so far leave in parts.
4. In a bucket the sets are ordered by local frequency and stored in a compressed trie. Each set
   traverses it once: the overlap with a path is shared by all sets below it, and a subtree is
   left where sizes, or the overlap so far plus what remains, cannot reach the threshold, or
   where all sets are in the component already.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge.llm.common import components, giving_back, sent_if_small, slices, stored

# Blocks of a bucket hold about this many n-grams, or this many sketches.
BLOCK, SKETCH_BLOCK = 4_000_000, 4_000
# A sketch has at most 2 ** this many hash ranges.
MOST_BITS = 12
PIECE = 1 << 18


class Shingler:
    """Sets of word n-gram hashes, for many texts at once.

    A word's hash is a polynomial in an odd base over random byte values, modulo 2**64, taken from
    one running sum over all bytes.
    """

    def __init__(self, n: int, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.n = n
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62)) * 4 + 1
        self.salts = rng.integers(1 << 62, dtype=np.uint64, size=n + 1) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(0, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers = np.full(size, self.base, np.uint64)
            self.inverse = np.full(size, pow(self.base, -1, 1 << 64), np.uint64)
            self.powers[0] = self.inverse[0] = 1
            self.powers, self.inverse = np.cumprod(self.powers), np.cumprod(self.inverse)

    def sets(self, texts):
        """The sorted distinct hashes of every text, as unsigned 64-bit arrays."""
        held, size = [], 0
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass").lower()
            held.append(raw)
            size += len(raw) + 1
            if size >= PIECE:
                yield from self._many(held)
                held, size = [], 0
        yield from self._many(held)

    def _many(self, raws):
        if not raws:
            return
        data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
        self._grow(len(data) + 1)
        gap = self.space[data]
        edge = np.flatnonzero(gap[:-1] != gap[1:]) + 1
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=total[1:])
        words = self._mix((total[ends] - total[starts]) * self.inverse[starts]
                          + (ends - starts).astype(np.uint64) * self.salts[0])
        borders = np.cumsum([0, *(len(r) + 1 for r in raws)])
        cuts = np.searchsorted(starts, borders)
        m = len(words) - self.n + 1
        grams = np.zeros(max(0, m), np.uint64)
        for k in range(self.n):
            grams = self._mix(grams + words[k:k + max(0, m)] * self.salts[k + 1])
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high - low >= self.n:
                yield np.unique(grams[low:high - self.n + 1])
            elif high > low:
                whole = np.uint64(high - low)
                for k in range(low, high):
                    whole = self._mix(whole + words[k:k + 1] * self.salts[k - low + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)

    @staticmethod
    def _mix(x):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def class_key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little",
                          signed=True)


def counted_below(num: int, den: int) -> int:
    """The hash value under which n-grams are counted: five thirds of the share of first places.

    First places then hold the rarest three fifths of a set's counted n-grams, so passages that
    many documents share stay behind them.
    """
    return (1 << 64) * min(3 * den, 5 * (den - num)) // (3 * den)


def first_places(n: int, num: int, den: int) -> int:
    """How many first n-grams of a set of size n meet every set at a Jaccard of num / den."""
    return n - -(-n * num // den) + 1


class PrefixTree:
    """A compressed trie of ordered sets, with union-find over its members.

    ``sets`` are ascending arrays of ranks; ``sizes`` are the sizes of the whole sets, of which
    ranks that no other member has may have been left out.
    """

    def __init__(self, sets, sizes, num: int, den: int):
        self.sets, self.sizes = sets, sizes
        self.num, self.den = num, den
        self.parent = list(range(len(sets)))
        self._build(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()))

    def _build(self, order) -> None:
        """Nodes from the common beginnings of neighbours; children come after their parent."""
        self.node_set, self.node_from, self.node_to = [order[0]], [0], [0]
        self.children, self.members = [[]], [[]]
        stack = [0]
        before = None
        for i in order:
            row = self.sets[i]
            common = 0
            if before is not None:
                k = min(len(row), len(before))
                differ = np.flatnonzero(row[:k] != before[:k])
                common = int(differ[0]) if len(differ) else k
            while self.node_to[stack[-1]] > common:
                last = stack.pop()
                if self.node_from[last] < common:
                    # Split: the upper part becomes a node of its own.
                    upper = self._node(self.node_set[last], self.node_from[last], common)
                    self.children[stack[-1]][-1] = upper
                    self.node_from[last] = common
                    self.children[upper].append(last)
                    stack.append(upper)
            if common < len(row):
                leaf = self._node(i, common, len(row))
                self.children[stack[-1]].append(leaf)
                stack.append(leaf)
            self.members[stack[-1]].append(i)
            before = row
        self._summarise()

    def _node(self, owner, start, stop):
        self.node_set.append(owner)
        self.node_from.append(start)
        self.node_to.append(stop)
        self.children.append([])
        self.members.append([])
        return len(self.node_set) - 1

    def _summarise(self) -> None:
        """Least and largest size, and the most ranks still to come, below every node."""
        count = len(self.node_set)
        self.least, self.most = [1 << 60] * count, [0] * count
        self.tail, self.label = [0] * count, [-1] * count
        todo, self.post = [0], []
        while todo:
            node = todo.pop()
            self.post.append(node)
            todo.extend(self.children[node])
        self.post.reverse()
        for node in self.post:
            for i in self.members[node]:
                self.least[node] = min(self.least[node], self.sizes[i])
                self.most[node] = max(self.most[node], self.sizes[i])
            for c in self.children[node]:
                self.least[node] = min(self.least[node], self.least[c])
                self.most[node] = max(self.most[node], self.most[c])
                self.tail[node] = max(self.tail[node],
                                      self.tail[c] + self.node_to[c] - self.node_from[c])
        # Wide nodes compare sizes with all children at once.
        self.wide = {node: tuple(map(np.array, (
            c, [self.least[i] for i in c], [self.most[i] for i in c])))
            for node, c in enumerate(self.children) if len(c) > 16}
        self.relabel()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def relabel(self) -> None:
        """Name the component of every subtree that has only one; -1 elsewhere."""
        for node in self.post:
            seen = {self.find(i) for i in self.members[node]}
            for c in self.children[node]:
                seen.add(self.find(self.label[c]) if self.label[c] >= 0 else -1)
            self.label[node] = seen.pop() if len(seen) == 1 else -1

    def links(self):
        """Pairs of members at the threshold that join two components, until none is left."""
        joined, since = [], 0
        for i in range(len(self.sets)):
            found = self._probe(i)
            joined += found
            since += len(found)
            if since * 16 >= len(self.sets) or found and since > 64:
                self.relabel()
                since = 0
        return joined

    def _probe(self, i: int):
        mine, size, num, den = self.sets[i], self.sizes[i], self.num, self.den
        held = np.zeros(int(mine[-1]) + 1 if len(mine) else 1, bool)
        held[mine] = True
        top = len(held)
        out = []
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            # Sizes alone: the smaller set must have num / den of the larger.
            if self.most[node] * den < size * num or size * den < self.least[node] * num:
                continue
            label = self.label[node]
            if label >= 0 and self.find(label) == self.find(i):
                continue
            start, stop = self.node_from[node], self.node_to[node]
            if stop > start:
                part = self.sets[self.node_set[node]][start:stop]
                if part[-1] >= top:
                    part = part[:int(part.searchsorted(top))]
                overlap += int(np.count_nonzero(held[part]))
            # Overlap that the smallest set below needs, against what can still be shared.
            reach = overlap + min(self.tail[node], len(mine) - overlap)
            if reach * (num + den) < num * (size + self.least[node]):
                continue
            for j in self.members[node]:
                if self.find(j) != self.find(i) and \
                        overlap * (num + den) >= num * (size + self.sizes[j]):
                    self.parent[self.find(j)] = self.find(i)
                    out.append((i, j))
            below = self.children[node]
            if node in self.wide:
                below, least, most = self.wide[node]
                below = below[(most * den >= size * num) & (size * den >= least * num)].tolist()
            todo.extend((c, overlap) for c in below)
        return out


def bucket_links(sets, num: int, den: int):
    """Links that join the components of a bucket's sets, by positions."""
    alive = list(range(len(sets)))
    while len(alive) > 1:
        values, inverse, count = np.unique(np.concatenate([sets[i] for i in alive]),
                                           return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *(len(sets[i]) for i in alive)])
        common = np.add.reduceat(count[inverse] > 1, cuts[:-1], dtype=np.int64)
        # A set shares at most the n-grams that another one here has as well.
        stay = [i for i, c in zip(alive, common.tolist()) if c * den >= len(sets[i]) * num]
        if len(stay) == len(alive):
            break
        alive = stay
    if len(alive) < 2:
        return []
    # Frequent n-grams first: similar sets then share long beginnings of the trie.
    rank = np.empty(len(values), np.uint32)
    rank[np.lexsort((values, -count))] = np.arange(len(values), dtype=np.uint32)
    shared = int(np.count_nonzero(count > 1))
    ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    ranked = [r[:int(r.searchsorted(shared))] for r in ranked]
    found = PrefixTree(ranked, [len(sets[i]) for i in alive], num, den).links()
    return [(alive[a], alive[b]) for a, b in found]


def sketch(grams: np.ndarray) -> bytes:
    """Counts of n-grams per hash range, rounded up to a unit that fits bytes; the unit is first.

    There are about half as many ranges as n-grams, a power of two, so few n-grams that two sets
    do not share fall in the same range.
    """
    bits = min(max(len(grams).bit_length() - 1, 6), MOST_BITS)
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    unit = max(1, -(-int(counts.max()) // 255))
    return unit.to_bytes(4, "little") + (-(-counts // unit)).astype(np.uint8).tobytes()


def plausible(sizes: np.ndarray, sketches, num: int, den: int) -> np.ndarray:
    """Which members may reach the threshold with another one; ``sizes`` ascend.

    The minimum of two counts per range, summed up, is at least the overlap. Finer sketches are
    added up to the ranges of a coarser one.
    """
    cells = np.array([len(s) - 4 for s in sketches])
    # By number of ranges: the members' places and their counts.
    classes = {}
    for c in np.unique(cells).tolist():
        own = np.flatnonzero(cells == c)
        counts = np.stack([np.frombuffer(sketches[i], np.uint8, c, 4) for i in own]).astype(np.int32)
        counts *= np.array([int.from_bytes(sketches[i][:4], "little") for i in own])[:, None]
        classes[c] = {c: (own, counts)}
    for c, held in classes.items():
        for coarse in classes:
            if coarse < c:
                own, counts = held[c]
                held[coarse] = own, counts.reshape(len(own), coarse, -1).sum(axis=2)
    alive = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes):
        stop = int(np.searchsorted(sizes, size * den // num, side="right"))
        if stop <= i + 1:
            continue
        for c, held in classes.items():
            shared = int(min(c, cells[i]))
            mine, all_mine = classes[int(cells[i])][shared]
            own, counts = held[shared]
            low, high = np.searchsorted(own, (i + 1, stop))
            if low == high:
                continue
            row = all_mine[int(np.searchsorted(mine, i))]
            most = np.minimum(row, counts[low:high]).sum(axis=1)
            others = own[low:high]
            fits = most * (num + den) >= num * (size + sizes[others])
            if fits.any():
                alive[i] = True
                alive[others[fits]] = True
    return alive


def shingle_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, class key, set size, counted n-grams, those that fill up places, and the sketch."""
    limit = min(counted_below(num, den), (1 << 64) - 1)

    def shingle(batches):
        maker = Shingler(n)
        for batch in slices(batches):
            keys, sizes, heads, fills, outlines = [], [], [], [], []
            for found in maker.sets(batch.column(1).to_pylist()):
                size = len(found)
                keys.append(class_key(found) if size else None)
                sizes.append(size)
                cut = int(np.searchsorted(found, np.uint64(limit)))
                places = first_places(size, num, den) if size else 0
                heads.append(found[:cut].view(np.int64))
                fills.append(found[cut:max(cut, places)].view(np.int64))
                outlines.append(sketch(found) if size else None)
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (heads, fills)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists,
                 pa.array(outlines, pa.binary())], names=names)

    schema = ("doc_id long, k long, n long, head array<long>, fill array<long>, outline binary")
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: giving_back(shingle(batches)), schema)


def _classes(table: DataFrame) -> DataFrame:
    """One row per class with its counted n-grams and fill, for its smallest doc_id."""
    known = table.where("k is not null and doc_id is not null")
    first = known.groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    others = stored(known.select("k", "doc_id").join(first, ["k", "doc_id"], "left_anti").distinct(),
                    "join-others")
    rows = known.groupBy("k", "doc_id").agg(F.count("*").alias("m")).where("m > 1")
    if rows.isEmpty():
        return known.join(sent_if_small(others, 32), ["k", "doc_id"], "left_anti")
    # Fully repeated rows: nothing but a shuffle tells them apart.
    return known.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                  F.first("head").alias("head"), F.first("fill").alias("fill"),
                                  F.first("outline").alias("outline"))


def _needed(member: DataFrame) -> DataFrame:
    """(g, k) of the buckets to look at, from (g, k, n) rows.

    Of buckets with the same members one is enough. Every class leads with its largest bucket; a
    bucket whose members all lead with the same other one is contained in that.
    """
    sizes = (member.groupBy("g").agg(
        F.count("*").alias("m"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("k")).alias("who"),
        F.bit_xor(F.xxhash64(F.lit(1), "k")).alias("who2")).where("m > 1")
        .groupBy("m", "weight", "who", "who2").agg(F.min("g").alias("g")))
    held = stored(member.join(sizes.select("g", "m"), "g"), "join-members")
    lead = held.groupBy("k").agg(F.max(F.struct("m", "g"))["g"].alias("lead"))
    ends = held.join(lead, "k").groupBy("g").agg(
        F.min("lead").alias("low"), F.max("lead").alias("high")).where("low <> high or low = g")
    return held.join(ends.select("g"), "g").select("g", "k")


def _cells(rows: DataFrame) -> DataFrame:
    """Members of a bucket of several blocks meet in pairs of blocks: any two meet in some cell."""
    mine = F.pmod(F.xxhash64(F.lit(3), "k"), F.col("blocks")).cast("int")
    return (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least(mine, F.col("other"))).withColumn("j", F.greatest(mine, "other"))
            .select("g", "i", "j", *[c for c in rows.columns if c not in ("g", "blocks")]))


def _plausible_members(needed: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(g, k, n) of the members that a sketch of another member of the bucket fits."""
    members = needed.join(placed.select("k", "n", "outline"), "k")
    sizes = needed.groupBy("g").agg(F.ceil(F.count("*") / SKETCH_BLOCK).cast("int").alias("blocks"))
    cells = _cells(members.join(sizes, "g").select("g", "blocks", "k", "n", "outline"))

    def compare(batches):
        cell, keys, sizes, outlines = None, [], [], []
        out = []

        def flush():
            if len(keys) > 1:
                alive = plausible(np.array(sizes), outlines, num, den)
                out.extend((cell[0], k, n) for k, n, a in zip(keys, sizes, alive) if a)

        for batch in batches:
            for g, i, j, k, n, outline in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if (g, i, j) != cell:
                    flush()
                    cell, keys, sizes, outlines = (g, i, j), [], [], []
                keys.append(k)
                sizes.append(n)
                outlines.append(outline)
            if len(out) > 10_000:
                yield packed(out)
                out.clear()
        flush()
        yield packed(out)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64())
                                           for c in range(3)], names=["g", "k", "n"])

    kept = (cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "n", "k")
            .mapInArrow(lambda batches: giving_back(compare(batches)),
                        "g long, k long, n long").distinct())
    return stored(kept, "join-plausible")


def class_links(table: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b) links between class keys that connect all classes at the threshold."""
    classes = _classes(table)
    grams = classes.select("k", F.explode("head").alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    shared = (grams.join(counts, "g").groupBy("k")
              .agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("shared")))
    light = classes.select("k", "doc_id", "n", F.size("head").cast("long").alias("counted"), "fill",
                           "outline")
    places = F.expr(f"n - cast(ceil(n * {num}L / {den}) as long) + 1")
    # N-grams of one class come first in the order, then shared ones by frequency, then the fill.
    seen = F.coalesce(F.size("shared"), F.lit(0))
    take = F.greatest(F.lit(0), F.least(seen, places - (F.col("counted") - seen))).cast("int")
    chosen = F.concat(
        F.coalesce(F.slice(F.transform("shared", lambda x: x["g"]), F.lit(1), take), F.array()),
        F.coalesce("fill", F.array().cast("array<long>")))
    placed = stored(light.join(shared, "k", "left").select("k", "doc_id", "n", "outline", chosen.alias("gs"))
                    .where("size(gs) > 0"), "join-places")
    needed = _needed(placed.select(F.explode("gs").alias("g"), "k", "n"))
    members = _plausible_members(needed, placed, num, den)
    ids = placed.select("k", "doc_id")
    # Each member first goes to its largest bucket alone. A second round looks at the buckets whose
    # members these links have not joined already.
    lead = (members.join(members.groupBy("g").agg(F.count("*").alias("m")), "g").groupBy("k")
            .agg(F.max_by(F.struct("g", "n"), F.struct("m", "g")).alias("b")).select("b.g", "k", "b.n"))
    first = stored(_bucket_links(lead, ids, docs, n, num, den), "join-links")
    stars = components(first, "a", "b")
    named = (members.join(stars.withColumnRenamed("node", "k"), "k", "left")
             .withColumn("component", F.coalesce("component", "k"))
             .join(lead.select("k", F.col("g").alias("lead")), "k"))
    # Members with the same lead have been compared: with two leads and two components there is a
    # pair that differs in both, and only then.
    split = named.groupBy("g").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("lead").alias("first"), F.max("lead").alias("last"))
    rest = members.join(split.where("low <> high and first <> last").select("g"), "g")
    second = _bucket_links(rest, ids, docs, n, num, den)
    return stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)


def _bucket_links(members: DataFrame, ids: DataFrame, docs: DataFrame, n: int, num: int, den: int
                  ) -> DataFrame:
    """(a, b) links inside the buckets of (g, k, n) rows, by tries over the members' whole sets."""
    weights = members.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"),
                                       F.count("*").alias("m")).where("m > 1")
    wanted = stored(members.join(weights, "g").groupBy("k")
                    .agg(F.collect_list(F.struct("g", "blocks")).alias("buckets"))
                    .join(ids, "k"), "join-wanted")
    # The mean number of buckets of a member sets its width.
    width = wanted.agg(F.avg(F.size("buckets"))).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    full = texts.join(sent_if_small(wanted, 48 + int(32 * width)), "doc_id")
    cells = _cells(full.select("k", "text", F.explode("buckets").alias("b"))
                   .select("b.g", "b.blocks", "k", "text"))

    def join(batches):
        maker = Shingler(n)
        cell, keys, texts, found = None, [], [], []

        def flush():
            """Links of the cell; a text that is not of the wanted class is passed over."""
            sets = list(maker.sets(texts)) if len(keys) > 1 else []
            own = [i for i, s in enumerate(sets) if len(s) and class_key(s) == keys[i]]
            found.extend((keys[own[a]], keys[own[b]])
                         for a, b in bucket_links([sets[i] for i in own], num, den))

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for g, i, j, k, text in zip(*columns):
                if (g, i, j) != cell:
                    flush()
                    cell, keys, texts = (g, i, j), [], []
                keys.append(k)
                texts.append(text)
            if len(found) > 10_000:
                yield packed(found)
                found.clear()
        flush()
        yield packed(found)

    def packed(pairs):
        return pa.RecordBatch.from_arrays(
            [pa.array([p[s] for p in pairs], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return (cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "k")
            .mapInArrow(lambda batches: giving_back(join(batches)), "a long, b long"))


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when the Jaccard similarity of their sets of word n-grams is num / den or
    more; a component's id is the smallest doc_id in it. Words are split at ASCII white space
    after A-Z are lower-cased; a text shorter than n words is one n-gram. Null and empty texts
    have an empty set and stand alone. Repeated rows and equal texts share a component. Rows
    without doc_id are returned with the component of their equal texts, and null where there is
    none; they link nothing. Other columns are ignored; an empty table gives no rows. N-grams are
    compared by 64-bit hashes.
    """
    table = stored(shingle_table(docs, n, num, den), "join-sets")
    links = class_links(table, docs, n, num, den)
    groups = components(links, "a", "b")
    least = table.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"))
    named = least.join(groups.withColumnRenamed("node", "k"), "k", "left")
    root = F.coalesce("component", "k")
    roots = named.groupBy(root.alias("root")).agg(F.min("least").alias("component_id"))
    final = named.select("k", root.alias("root")).join(roots, "root").select("k", "component_id")
    return (table.select("doc_id", "n", "k").join(final, "k", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with its smallest doc_id.

    Of rows that repeat this doc_id one stays. Rows without doc_id stay unless an equal text has
    one, as nothing tells them apart.
    """
    joined = stored(ngram_join(docs, n, num, den), "join-components")
    stays = joined.where("doc_id = component_id").select("doc_id").distinct()
    key = F.col("doc_id").cast("long")
    named = docs.select(key.alias("k"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    kept = (named.where("k is not null").withColumn("place", place).where("place = 1")
            .join(stays.withColumnRenamed("doc_id", "k"), "k").select("row.*"))
    if joined.where("doc_id is null").isEmpty():
        return kept
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    held = named.where("k is not null").select(sha.alias("sha")).distinct()
    alone = named.where("k is null").withColumn("sha", sha).join(held, "sha", "left_anti")
    return kept.unionByName(alone.select("row.*"))
