"""Cutoff-safe lexical retrieval, passage re-reading and replay of cached responses."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.functions.contracts import is_blank
from veriledge.session import (
    BROADCAST_ROW_LIMIT, broadcast_if_bounded, is_bounded, materialise,
)

_SALTS = 32
# Documents that a block has on average, and blocks of a query that set its threshold.
BLOCK_DOCUMENTS, SEED_BLOCKS = 32, 4
# Documents whose postings one task has on average.
TASK_DOCUMENTS = 2_048


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, cutoff_date, term, qtf) from (query_id, query, cutoff_date)."""
    return (queries.select("query_id", "cutoff_date", F.explode(fn.terms("query")).alias("term"))
            .groupBy("query_id", "cutoff_date", "term")
            .agg(F.count(F.lit(1)).alias("qtf")))


def document_frequency(corpus: DataFrame, text: str = "content",
                       vocabulary: DataFrame | None = None) -> DataFrame:
    """Number of documents each term occurs in, for all terms or a given vocabulary."""
    words = corpus.select(F.explode(F.array_distinct(fn.terms(text))).alias("term"))
    if vocabulary is not None:
        words = words.join(vocabulary, "term", "left_semi")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weighted_query_terms(queries: DataFrame, corpus: DataFrame,
                         postings: DataFrame | None = None, total: int | None = None
                         ) -> DataFrame:
    """Query terms with the inverse frequency of the *whole* corpus, before any cutoff."""
    terms = query_terms(queries)
    if postings is None:
        vocabulary = broadcast_if_bounded(terms.select("term").distinct())
        frequency = document_frequency(corpus, vocabulary=vocabulary)
    else:
        frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if total is None:
        total = corpus.count()  # a scalar of the whole corpus
    return (
        terms.join(frequency, "term")
        .withColumn("weight", F.log(F.lit(float(total + 1)) / (F.col("df") + 1)) + 1)
        .drop("df")
    )


def posting_tasks(documents: int) -> int:
    """Tasks that postings are dealt over, so that a task's memory does not grow with the corpus."""
    return -(-documents // TASK_DOCUMENTS) or 1


def _term_counts(corpus: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, term, tf), from (keep, words): words are counted inside their row.

    Equal words of a sorted list are neighbours, so a task counts without a table of all words of
    its documents. An inner explode would split the texts once more for the filter Spark infers.
    """
    ended = corpus.withColumn("words", F.sort_array("words")).withColumn("ends", F.filter(
        F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"))),
        lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i - 1))))
    counts = F.transform("ends", lambda i, place: F.struct(
        F.get("words", i - 1).alias("term"),
        (i - F.coalesce(F.get("ends", place - 1), F.lit(0))).cast("bigint").alias("tf")))
    return ended.select(*keep, F.explode_outer(counts).alias("c")).select(*keep, "c.term", "c.tf")


def term_postings(corpus: DataFrame, vocabulary: DataFrame, documents: int | None = None
                  ) -> DataFrame:
    """How often each document uses each term of the vocabulary.

    Texts are split where they are read and never move: only counts of the vocabulary's words do.
    """
    keep = ["snapshot_id", "publication_date"]
    counts = _term_counts(corpus.select(*keep, fn.terms("content").alias("words")), keep)
    known = counts.join(broadcast_if_bounded(vocabulary), "term", "left_semi")
    if documents is not None:
        known = known.repartition(posting_tasks(documents), "snapshot_id")
    return known.groupBy(*keep, "term").agg(F.sum("tf").alias("tf"))


def lexical_term_join(weighted: DataFrame, corpus: DataFrame,
                      postings: DataFrame | None = None, documents: int | None = None
                      ) -> DataFrame:
    """Scores of every (query, document) that share a term, one row each.

    Term counts are dealt by document and meet the weights there, so no pair is shuffled and a task
    has the pairs of some documents only. A query set too large to broadcast is joined on a salted
    term instead.
    """
    if documents is None:
        documents = corpus.count()  # a scalar of the whole corpus
    if postings is None:
        postings = term_postings(corpus, weighted.select("term").distinct(), documents)
    else:
        postings = postings.repartition(posting_tasks(documents), "snapshot_id")
    return (
        _on_term(postings, weighted, "snapshot_id").where(F.col("publication_date") <= F.col("cutoff_date"))
        .groupBy("query_id", "snapshot_id")
        .agg(F.sum(F.least("qtf", "tf") * F.col("weight")).alias("score"))
    )


def lexical_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """J18 from queries: the corpus is split once, frequencies and scores come from the postings."""
    total = corpus.count()  # a scalar of the whole corpus
    postings = materialise(term_postings(
        corpus, query_terms(queries).select("term").distinct(), total))
    weighted = materialise(weighted_query_terms(queries, corpus, postings, total))
    return lexical_term_join(weighted, corpus, postings, total)


def block_postings(corpus: DataFrame, vocabulary: DataFrame, documents: int) -> DataFrame:
    """Postings with the block of their document: some 32 documents of similar length.

    Long documents can score more than short ones, so blocks of one length class bound them well.
    """
    keep = ["snapshot_id", "publication_date", "block"]
    kind = F.floor(F.log2(F.size("words") + 1) / 2)
    place = F.pmod(F.xxhash64("snapshot_id"), F.lit(-(-documents // BLOCK_DOCUMENTS) or 1))
    rows = (corpus.select("snapshot_id", "publication_date", fn.terms("content").alias("words"))
            .withColumn("block", place * 64 + kind))
    known = _term_counts(rows, keep).join(broadcast_if_bounded(vocabulary), "term", "left_semi")
    return (known.repartition(posting_tasks(documents), "block")
            .groupBy(*keep, "term").agg(F.sum("tf").alias("tf")))


def block_bounds(weighted: DataFrame, postings: DataFrame, documents: int) -> DataFrame:
    """(query_id, block, bound): no document of the block scores more for the query.

    The impact of a term in a block is that of its largest count; blocks whose use of a term is
    all after the query's cutoff leave the term out. Postings are dealt by block, which serves both
    aggregates.
    """
    dealt = postings.repartition(posting_tasks(documents), "block")
    impact = dealt.groupBy("block", "term").agg(
        F.max("tf").alias("most"), F.min("publication_date").alias("earliest"))
    return (_on_term(impact, weighted, "block").where(F.col("earliest") <= F.col("cutoff_date"))
            .groupBy("query_id", "block")
            .agg(F.sum(F.least("qtf", "most") * F.col("weight")).alias("bound")))


def _on_term(rows: DataFrame, weighted: DataFrame, spread: str) -> DataFrame:
    """Join by term; a query set too large to broadcast is salted, as terms are skewed."""
    if is_bounded(weighted, BROADCAST_ROW_LIMIT):
        return rows.join(F.broadcast(weighted), "term")
    salted = weighted.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {_SALTS - 1}L)")))
    salt = F.pmod(F.xxhash64(spread), F.lit(_SALTS).cast("bigint"))
    return rows.withColumn("__salt", salt).join(salted, ["term", "__salt"]).drop("__salt")


def score_blocks(blocks: DataFrame, weighted: DataFrame, postings: DataFrame, digits: int
                 ) -> DataFrame:
    """(query_id, snapshot_id, score) of the documents of some (query_id, block) pairs."""
    needed = blocks.select("query_id", "block").join(weighted, "query_id")
    joined = postings.join(broadcast_if_bounded(needed), ["block", "term"])
    return (joined.where(F.col("publication_date") <= F.col("cutoff_date"))
            .groupBy("query_id", "snapshot_id")
            .agg(F.round(F.sum(F.least("qtf", "tf") * F.col("weight")), digits).alias("score")))


def lexical_candidates(queries: DataFrame, corpus: DataFrame, k: int = 3, digits: int = 6
                       ) -> DataFrame:
    """Scores of all documents that can be among a query's best ``k``: query_id, snapshot_id, score.

    A threshold algorithm over blocks: the blocks of a query with the highest bounds are scored
    first, their k-th best score is the query's threshold, and of all others only blocks whose
    bound reaches it are scored. Pairs below are never formed.
    """
    total = corpus.count()  # a scalar of the whole corpus
    # The corpus is split once; frequencies, bounds and scores all come from the postings.
    postings = materialise(block_postings(
        corpus, query_terms(queries).select("term").distinct(), total))
    weighted = materialise(weighted_query_terms(queries, corpus, postings, total))
    bounds = materialise(block_bounds(weighted, postings, total))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEED_BLOCKS)
    seeds = materialise(score_blocks(first, weighted, postings, digits).where("score <> 0"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reached = (seeds.withColumn("place", F.row_number().over(best)).where(F.col("place") == k)
               .select("query_id", F.col("score").alias("least")))
    # A rounded score may lie half a unit above the sum it stands for.
    open_blocks = (bounds.join(broadcast_if_bounded(reached), "query_id", "left")
                   .where(F.col("least").isNull()
                          | (F.col("bound") >= F.col("least") - 10.0 ** -digits))
                   .join(broadcast_if_bounded(first.select("query_id", "block")),
                         ["query_id", "block"], "left_anti"))
    return seeds.unionByName(
        score_blocks(open_blocks, weighted, postings, digits).where("score <> 0"))


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int = 3,
                 digits: int = 6) -> DataFrame:
    """The best ``k`` documents per query, ties by id. Columns query_id, rank, snapshot_id,
    score. Scores are rounded before ranking, so that sums taken in another order tie alike.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "snapshot_id")
    return (lexical_candidates(queries, corpus, k, digits)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "snapshot_id", "score"))


def retrieve_capsules(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """K01 with the passage columns of the sealed corpus joined back."""
    hits = materialise(lexical_topk(queries, corpus, k))  # k rows per query
    return corpus.join(broadcast_if_bounded(hits), "snapshot_id").select(
        "query_id", "rank", fn.capsule_passage_id("snapshot_id", "query_id").alias("passage_id"),
        F.concat(F.lit("doi:"), "doi").alias("doc_id"), F.col("content").alias("text"),
        F.struct(F.lit(0).cast("bigint").alias("offset"),
                 F.lit(None).cast("bigint").alias("page_no")).alias("locator"),
        "content_sha256", "publication_date", "score")


def cutoff_filter(rows: DataFrame, published: str = "published", cutoff: str = "cutoff_date"
                  ) -> DataFrame:
    """Rows known to be published on or before their cutoff."""
    return rows.where(F.col(published).isNotNull() & (F.col(published) <= F.col(cutoff)))


def metadata_filter(df: DataFrame, *, lang=None, year_from=None, year_to=None, domain=None,
                    venue=None, lang_col="lang", year_col="year", domain_col="domain",
                    venue_col="venue") -> DataFrame:
    """P20: conjunction of the given terms; unset terms are left out."""
    wanted = [(lang_col, lang), (domain_col, domain), (venue_col, venue)]
    terms = [F.col(name) == value for name, value in wanted if value]
    terms += [F.col(year_col) >= year_from] if year_from else []
    terms += [F.col(year_col) <= year_to] if year_to else []
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def content_slice(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Text slices for (doc_id, offset, limit) requests, in characters."""
    wanted = broadcast_if_bounded(requests)
    return documents.join(wanted, "doc_id").select(
        *requests.columns,
        F.substring(F.col("text"), F.col("offset").cast("int") + 1, F.col("limit").cast("int"))
        .alias("slice"))


def reread_passages(searches: DataFrame, documents: DataFrame, k: int = 3,
                    content_limit: int = 4000) -> DataFrame:
    """From ranked hits to re-read passages.

    ``searches``: query_id, cutoff_date, hits array<struct<doc_id, offset, publication_date,
    publication_published_date, published_at, publication_published_year, year>>.
    Hits without an id or a valid offset, after the cutoff or seen before in the same query are
    dropped; the first position of a (document, offset) wins.
    """
    hit = F.col("hit")
    hits = (
        searches.select("query_id", "cutoff_date",
                        F.posexplode(F.slice("hits", 1, k)).alias("position", "hit"))
        .select(
            "query_id", "cutoff_date", "position",
            F.trim(F.coalesce(hit["doc_id"], F.lit(""))).alias("doc_id"),
            hit["offset"].alias("offset"),
            fn.publication_date(
                [hit["publication_date"], hit["publication_published_date"],
                 hit["published_at"]],
                [hit["publication_published_year"], hit["year"]]).alias("published"))
        .where(~is_blank("doc_id") & F.col("offset").isNotNull() & (F.col("offset") >= 0))
    )
    kept = (cutoff_filter(hits).groupBy("query_id", "doc_id", "offset")
            .agg(F.min_by(F.struct("position", "published"), "position").alias("h")))
    content = documents.select("doc_id", "text")
    text = F.trim(F.substring(F.col("text"), F.col("offset").cast("int") + 1,
                              F.lit(content_limit)))
    return (
        content.join(broadcast_if_bounded(kept), "doc_id")
        .withColumn("text", text).where(F.col("text") != "")
        .withColumn("content_sha256", fn.sha256("text"))
        .select("query_id", F.col("h.position").alias("position"),
                fn.passage_id("query_id", "doc_id", "offset", "content_sha256")
                .alias("passage_id"),
                "doc_id", "offset", "text", "content_sha256",
                F.col("h.published").alias("publication_date"))
    )


def response_replay(requests: DataFrame, operations: DataFrame,
                    response: str = "response_json") -> DataFrame:
    """What a cached response log allows for each request."""
    cached = operations.select("operation_id", F.col("request_sha256").alias("__cached"),
                               F.col("status").alias("__status"),
                               F.col(response).alias("__response"))
    joined = requests.join(cached, "operation_id", "left")
    return joined.select(
        *requests.columns,
        F.when(F.col("__cached").isNull(), "miss")
        .when(F.col("__cached") != F.col("request_sha256"), "digest_conflict")
        .when(F.col("__status").isin("PENDING", "ABANDONED"), "indeterminate")
        .when(F.col("__status") == "RETRY_AUTHORIZED", "retry_authorized")
        .when(F.col("__status") == "COMPLETED", "hit")
        .otherwise("invalid_status").alias("outcome"),
        F.when((F.col("__cached") == F.col("request_sha256"))
               & (F.col("__status") == "COMPLETED"), F.col("__response")).alias("response"))


def resolve_citations(decisions: DataFrame, passages: DataFrame) -> DataFrame:
    """The evidence array of each decision with its passages' identity columns.

    ``decisions``: keys challenge_id, method_id and evidence array<struct<passage_id, relation>>.
    """
    keys = ["challenge_id", "method_id"]
    cited = decisions.select(*keys, F.posexplode("evidence").alias("pos", "e")).select(
        *keys, "pos", F.col("e.passage_id").alias("passage_id"),
        F.col("e.relation").alias("relation"))
    known = passages.select(
        "challenge_id", "passage_id", "doc_id", "locator", "content_sha256").dropDuplicates(
        ["challenge_id", "passage_id"])
    found = cited.join(known, ["challenge_id", "passage_id"])
    packed = found.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(
            "pos", "doc_id", "relation", "locator", "content_sha256"))),
        lambda x: F.struct(x["doc_id"].alias("doc_id"), x["relation"].alias("relation"),
                           x["locator"].alias("locator"),
                           x["content_sha256"].alias("content_sha256"))).alias("citations"))
    return decisions.join(packed, keys, "left").withColumn(
        "citations", F.coalesce("citations", F.array().cast(packed.schema["citations"].dataType)))
