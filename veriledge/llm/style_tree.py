"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by path: a node of the merged tree stands for all elements
with the same tags, classes and ids down from the root. Its presentation importance is the entropy
of the child sequences that pages show there, its content importance the entropy of the texts;
both are 0 where all pages agree and 1 where all differ. Branches of low composite importance are
removed from every page, and so are presentation nodes whose tag or role says that they are no
article (menus, forms and the like). Names only vote: a class or id counts where all its words
speak of noise or of boxes, as ``comment-list`` and unlike ``related-work``, and never against a
branch that holds the marked article or most of the page's text. Inside a marked article whole
boxes go where nothing in them differs between pages; beside it, texts stay that differ.
"""
from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledge.llm.common import slices, stored

# Fixed values of HTML: elements without content, raw text, and the elements that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main "
    "menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title "
    "tr ul").split())
ENDS_P = BLOCK - frozenset("br body caption head html optgroup option tbody td tfoot th thead tr".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Where an implied end tag stops looking for the element it closes.
SCOPE = frozenset("table ul ol dl select body html article section div nav aside".split())
# Presentation that is never the article.
NOISE_TAGS = frozenset((
    "head nav footer aside form script style noscript template svg iframe button select input "
    "textarea dialog menu object canvas audio video map title xmp").split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
NOISE_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal "
    "overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "disqus reply replies share sharing social related recommended widget toolbar pagination pager "
    "login signup signin search masthead skip").split())
# Words that say how noise is boxed, where it stands or to what it belongs, but not that it is noise.
BOX_WORDS = frozenset((
    "area article bar block body bottom box button buttons card cards col column container content "
    "desktop entry fixed float form global group header heading icon icons inner inline item items "
    "label left line link links list main mobile module news outer page pane panel placeholder post "
    "posts primary right row secondary section site slot stack sticky story strip tab tabs thread "
    "title top unit user users view wrap wrapper").split())
# Tags that may hold text of the article inside it.
INNER_TAGS = frozenset("dialog map".split())
# Words whose ids are noise inside the article too; other ids there are anchors to its sections.
INNER_IDS = frozenset("ad ads comment comments disqus replies".split())
# Names that are noise only outside the article, where they hold a site's head.
OUTER_NAMES = frozenset("header topbar".split())
WHOLE = frozenset("html body article main".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z|</[^a-zA-Z][^>]*+>""",
    re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAMES = re.compile(r"[a-z]+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
# Weight of a node's children against its own presentation, and the least importance that stays.
DECAY, LEAST = 0.9, 0.2
# Content importance from which a text beside a marked article is taken.
HIGH = 0.5
# Elements that can be a box of the site inside an article; headings, rows and inline text are not.
BOXES = frozenset("address blockquote center details dialog div dl fieldset figure form hgroup menu "
                  "ol p pre section table ul".split())
# Pages that have to show a node before its entropy says anything.
PAGES = 3
# Template nodes that are sent to every executor (24 bytes each); more travel with the pages.
SENT_NODES = 200_000


_KEYS: dict = {}


def _key(parent: int, tag: str, names: str) -> int:
    """The number of a path, by its parent's; known ones are looked up."""
    found = _KEYS.get((parent, tag, names))
    if found is None:
        if len(_KEYS) > 1 << 16:
            _KEYS.clear()
        raw = hashlib.blake2b(f"{parent}/{tag}.{names}".encode("utf-8", "replace"), digest_size=8)
        found = _KEYS[parent, tag, names] = int.from_bytes(raw.digest(), "little", signed=True)
    return found


@lru_cache(1 << 14)
def votes(value: str, noise: frozenset) -> bool:
    """Whether some token of a class or id has a word of ``noise`` and else only words of boxes."""
    for token in value.split():
        words = {w.lower() for w in PARTS.findall(token)}
        if not words.isdisjoint(noise) and words <= noise | BOX_WORDS:
            return True
    return False


class Page:
    """The DOM of a page in page order, tolerant of missing and crossed end tags."""

    def __init__(self, html: str):
        self.tags, self.names, self.parent, self.keys = ["#"], [()], [-1], [0]
        self.roles = [""]
        # Whether names speak of noise, inside and outside a marked article.
        self.marked, self.named = [False], [False]
        # How many elements of a tag are open, so an end tag without one is passed over at once.
        self.open: Counter = Counter()
        # (node, text) in page order; text None is a block border.
        self.items: list = []
        self.stack = [0]
        position, end = 0, len(html)
        while position < end:
            found = TAG.search(html, position)
            if not found:
                self._text(html[position:])
                break
            self._text(html[position:found.start()])
            position = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag = tag.lower()
            if found[1] or found[4]:
                self._close(tag)
                continue
            self._open(tag, found[3] or found[6] or "")
            if tag in RAW:
                stop = re.compile(f"</{tag}", re.I).search(html, position)
                position = stop.start() if stop else end

    def _text(self, raw: str) -> None:
        if raw:
            self.items.append((self.stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def _border(self, tag: str) -> None:
        if tag in BLOCK:
            self.items.append((self.stack[-1], None))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self._imply(("p",))
        if tag in ENDS_SAME:
            self._imply(ENDS_SAME[tag])
        self._border(tag)
        if tag in VOID:
            return
        names, role, marked, named = (), "", False, False
        if attributes:
            marks = {}
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                marks.setdefault(name.lower(), a or b or c)
            kind, own = marks.get("class", ""), marks.get("id", "")
            names = tuple(sorted(set(NAMES.findall(f"{kind} {own}".lower()))))
            role = marks.get("role", "").lower()
            marked = votes(kind, NOISE_NAMES) or votes(own, INNER_IDS)
            named = marked or votes(own, NOISE_NAMES) or votes(f"{kind} {own}", OUTER_NAMES)
        parent = self.stack[-1]
        self.tags.append(tag)
        self.names.append(names)
        self.roles.append(role)
        self.marked.append(marked)
        self.named.append(named)
        self.open[tag] += 1
        self.parent.append(parent)
        self.keys.append(_key(self.keys[parent], tag, " ".join(names)))
        self.stack.append(len(self.tags) - 1)

    def _cut(self, depth: int) -> None:
        """Close the elements of the stack from ``depth`` on."""
        for node in self.stack[depth:]:
            self.open[self.tags[node]] -= 1
        del self.stack[depth:]

    def _imply(self, closed: tuple) -> None:
        if not any(self.open[tag] for tag in closed):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in closed:
                self._cut(depth)
                return
            if tag in SCOPE:
                return

    def _close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1) if self.open[tag] else ():
            if self.tags[self.stack[depth]] == tag:
                self._cut(depth)
                break
        self._border(tag)

    def _summed(self, keep) -> list:
        """Characters of kept text in each branch."""
        size = [0] * len(self.tags)
        for n, t in self.items:
            if t and keep[n]:
                size[n] += len("".join(t.split()))
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size

    def _is_main(self, i: int) -> bool:
        return self.tags[i] in ("article", "main") or self.roles[i] == "main"

    def _protected(self) -> set:
        """Branches that no name removes: around a marked article or a headline with most of the
        text; where nothing is marked, also those with nearly all of it."""
        named = [i for i, n in enumerate(self.named) if n]
        if not named:
            return set()
        mains = [i for i in range(len(self.tags)) if self._is_main(i)]
        held, headed = set(), set()
        for found, nodes in ((held, mains), (headed, [i for i, t in enumerate(self.tags) if t == "h1"])):
            for i in nodes:
                up = self.parent[i]
                while up > 0 and up not in found:
                    found.add(up)
                    up = self.parent[up]
        safe = held.intersection(named)
        open_to = [i for i in named if i not in safe and (i in headed or not mains)]
        if not open_to:
            return safe
        alive = [True]
        for i in range(1, len(self.tags)):
            alive.append(alive[self.parent[i]] and self.roles[i] not in NOISE_ROLES
                         and (self.tags[i] not in NOISE_TAGS or self.tags[i] == "form"))
        size = self._summed(alive)
        return safe.union(i for i in open_to if i in headed and 2 * size[i] > size[0]
                          or not mains and 5 * size[i] > 4 * size[0])

    def kept(self, noise=frozenset(), same=frozenset(), rich=frozenset()) -> list:
        """Whether the text of each node stays; a removed branch takes everything below it along.

        ``noise`` are keys of low importance, ``same`` those below which also nothing differs
        between pages, ``rich`` those of high content importance.

        A form with more than half of the text that would stay is a container like any other.
        """
        safe = frozenset(self._protected())
        forms = [i for i, tag in enumerate(self.tags) if tag == "form"]
        if not forms:
            return self._kept(noise, same, rich, safe)
        size = self._summed(self._kept(noise, same, rich, safe.union(forms)))
        return self._kept(noise, same, rich, safe.difference(forms).union(
            i for i in forms if 2 * size[i] > size[0]))

    def _kept(self, noise, same, rich, plain=frozenset()) -> list:
        """What ``kept`` returns, with the nodes of ``plain`` as containers like any other."""
        keep, main, beside = [True], [False], [False]
        # Nodes around a marked article: what is low there on average may hold the article.
        around = {i for i in range(len(self.tags)) if self._is_main(i)}
        marks = bool(around)
        around |= plain
        for i in range(len(self.tags) - 1, 0, -1):
            if i in around:
                around.add(self.parent[i])
        for i in range(1, len(self.tags)):
            up, tag = self.parent[i], self.tags[i]
            inside = main[up] or self._is_main(i)
            bad = tag in NOISE_TAGS and i not in plain or self.roles[i] in NOISE_ROLES
            if inside:
                bad = bad and not (tag in INNER_TAGS and self.roles[i] not in NOISE_ROLES)
                bad = bad or tag != "main" and self.marked[i] and i not in plain
                bad = bad or tag in BOXES and self.keys[i] in same
            elif tag not in WHOLE:
                bad = bad or tag == "header" or self.named[i] and i not in plain
            part = marks and beside[up] and tag not in WHOLE and up not in around
            if not inside and tag not in WHOLE and (tag in BOXES or not part) and \
                    self.keys[i] in (same if i in around or part else noise):
                bad = True
            keep.append(keep[up] and not bad)
            main.append(inside and keep[-1])
            beside.append(part or self.keys[i] in rich)
        # Where a page marks its article, text beside it is taken only by its importance.
        if any(main):
            keep = [k and (m or b) for k, m, b in zip(keep, main, beside)]
        return keep

    def text(self, noise=frozenset(), same=frozenset(), rich=frozenset()) -> str:
        """Texts of the kept nodes; white space, block borders included, is one space."""
        keep = self.kept(noise, same, rich)
        return " ".join("".join("\n" if t is None else t for n, t in self.items
                                if t is None or keep[n]).split())

    def nodes(self):
        """(key, parent key, child sequence, text) of every path, over its elements in page order."""
        style: dict[int, list] = {}
        text: dict[int, list] = {}
        for i in range(1, len(self.tags)):
            style.setdefault(self.keys[i], [])
            style.setdefault(self.keys[self.parent[i]], []).append(self.keys[i])
        for n, t in self.items:
            if t and not t.isspace():
                text.setdefault(self.keys[n], []).append(t)
        up = {self.keys[i]: self.keys[self.parent[i]] for i in range(1, len(self.tags))}
        for key, parent in up.items():
            yield key, parent, _digest(dict.fromkeys(style[key])), _digest(text.get(key, ()))


def _digest(parts) -> int | None:
    if not parts:
        return None
    raw = hashlib.blake2b("\n".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8)
    return int.from_bytes(raw.digest(), "little", signed=True)


def host_of(url):
    """The host of a URL column, lower-cased, without port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _importance(nodes: pd.DataFrame) -> pd.DataFrame:
    """Composite importance of a host's nodes, from the leaves up.

    ``peak`` is the largest importance of presentation or content in a branch, ``content`` that of
    a node's own texts.
    """
    rows = {r.key: r for r in nodes.itertuples()}
    below: dict[int, list] = {}
    for r in rows.values():
        below.setdefault(r.parent, []).append(r.key)
    order, todo = [], [k for k, r in rows.items() if r.parent not in rows]
    while todo:
        key = todo.pop()
        order.append(key)
        todo.extend(below.get(key, ()))
    value: dict[int, float] = {}
    peak: dict[int, float] = {}
    for key in reversed(order):
        r = rows[key]
        parts = [value[c] for c in below.get(key, ())]
        peak[key] = max([r.style, r.content if r.texts else 0.0, *(peak[c] for c in below.get(key, ()))])
        if r.texts:
            parts.append(r.content)
        if not below.get(key):
            value[key] = r.content if r.texts else 0.0
            continue
        weight = DECAY ** len(parts)
        value[key] = (1 - weight) * r.style + weight * sum(parts) / len(parts)
    return pd.DataFrame({"host": nodes["host"].iloc[0], "key": list(value),
                         "importance": list(value.values()), "peak": [peak[k] for k in value],
                         "content": [rows[k].content if rows[k].texts else 0.0 for k in value]})


def site_importance(pages: DataFrame) -> DataFrame:
    """(host, key, importance, peak, content) of the nodes that at least ``PAGES`` different pages of a host show.

    Pages with the same html count once, so copies do not look like a template.
    """
    def nodes(batches):
        for batch in slices(batches):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = _digest([html])
                rows += [(host, page, *node) for node in Page(html).nodes()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["host", "page", "key", "parent", "style", "content"])

    seen = pages.mapInArrow(
        nodes, "host string, page long, key long, parent long, style long, content long").distinct()
    counts = stored(seen.groupBy("host", "key", "parent", "style", "content")
                    .agg(F.count("*").alias("n")), "style-counts")

    def entropy(column):
        """Shares of the values of a node, as entropy to the base of its pages; 1 for one page."""
        each = counts.groupBy("host", "key", column).agg(F.sum("n").alias("n"))
        return each.groupBy("host", "key").agg(
            F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"),
            F.max(F.col(column).isNotNull()).alias("any")).select(
            "host", "key", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m")))
            .otherwise(1.0).alias(column), F.col("any").alias(f"any_{column}"))

    total = counts.groupBy("host", "key").agg(F.sum("n").alias("m"), F.first("parent").alias("parent"))
    measured = (total.where(F.col("m") >= PAGES).join(entropy("style"), ["host", "key"])
                .join(entropy("content"), ["host", "key"])
                .select("host", "key", "parent", "style", "content", F.col("any_content").alias("texts")))
    # One row per node of a host's template: pages are no longer in these groups.
    return measured.groupBy("host").applyInPandas(
        _importance, "host string, key long, importance double, peak double, content double")


def main_text(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html counts as empty and gives empty text; a null or odd url belongs to the host with the
    empty name. Hosts with fewer than three different pages are cleaned by presentation alone.
    Where a page marks its article (article, main), text beside it is taken only where its content
    importance over the host is high. Repeated rows give the same
    text each; an empty table gives no rows; further columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        host_of(F.col("url").cast("string")).alias("host"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    low = stored(site_importance(rows.select("host", "html")).select(
        "host", "key", (F.col("importance") < least).alias("low"),
        (F.col("peak") < least).alias("same"), (F.col("content") >= HIGH).alias("rich"))
        .where("low or same or rich"), "style-noise")
    names = ("low", "same", "rich")
    noise = low.groupBy("host").agg(*[
        F.sort_array(F.collect_set(F.when(F.col(c), F.col("key")))).alias(c) for c in names])
    schema = "page_id long, url string, text string, n_chars long"

    def cleaned(batch, sets_of):
        texts = [Page(html).text(*sets_of(i)) for i, html in enumerate(batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    if low.limit(SENT_NODES + 1).count() <= SENT_NODES:
        sent = pages.sparkSession.sparkContext.broadcast(
            {r["host"]: [np.array(r[c], np.int64) for c in names] for r in noise.collect()})

        def extract(batches):
            known: dict = {}
            for batch in slices(batches):
                hosts = batch.column(2).to_pylist()
                for host in set(hosts) - known.keys():
                    known[host] = [frozenset(a.tolist()) for a in sent.value.get(host, ())]
                yield cleaned(batch, lambda i: known[hosts[i]])

        return rows.mapInArrow(extract, schema)

    # A host's nodes come before its pages; pages of one host are spread over salts.
    salts = 32
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
              .select("page_id", "url", "host", "html", "salt",
                      *[F.lit(None).cast("array<long>").alias(c) for c in names]))
    before = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host",
        F.lit(None).cast("string").alias("html"), "salt", *names)
    together = (salted.unionByName(before).withColumn("page", F.col("html").isNotNull())
                .repartition("host", "salt").sortWithinPartitions("host", "salt", "page"))

    def follow(batches):
        host, sets = None, ()
        for batch in slices(batches):
            hosts, pages_at = batch.column("host").to_pylist(), batch.column("page").to_pylist()
            of = []
            for i, name in enumerate(hosts):
                if not pages_at[i]:
                    host, sets = name, [frozenset(batch.column(c)[i].as_py()) for c in names]
                of.append(sets if name == host else ())
            at = [i for i, is_page in enumerate(pages_at) if is_page]
            yield cleaned(batch.take(pa.array(at, pa.int64())), lambda i: of[at[i]])

    return together.mapInArrow(follow, schema)
