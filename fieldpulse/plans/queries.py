"""The registered queries: every operator over the driver tables.

Each takes ``(spark, folder)``.  Doubles are rounded to six digits, because sums
of doubles depend on their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import TITLE_STOP_WORDS, reconstruct_abstract
from ..functions.stats import ratio
from ..operators import (
    author_state, cluster, communities, emerging, evaluate, evolution, graph, ingest, latent, layout, neighbours, search, text, topics, transitions, views,
)
from ..schemas import empty
from ..session import materialise, shared_folder
from ..sources import bindings, sinks
from ..sources.bindings import commerce, raw_works, texts
from ..sources.works import limit_works, load_table, project_fields, read_works, select_works
from ..streaming.ingest import ingest_incremental, read_ingested
from ..streaming.live import live_topic_counts, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
BRAND_PATTERNS = ("%brand#1%", "%brand#2%")
BRAND_PIVOT = 1998
EVIDENCE_TOPICS = ["Brand#1", "Brand#13"]
EVIDENCE_YEARS = (1996, 1999)
EVIDENCE_TITLE = "urgent"
STOP_WORDS = list(TITLE_STOP_WORDS)
STORED_YEARS = (1995, 1997)
REFRESHED_YEAR = 1996
RECORD_LIMIT = 700
HELD_OUT_EVERY = 5
SELECTION = {"subfield": "1", "years": (1996, 1999), "work_type": "article", "min_citations": 50}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and negative zero turned into zero."""
    return df.select(*[
        (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes])


# -- shared inputs ---------------------------------------------------------------------------------

def _tagged(spark, folder) -> DataFrame:
    c = commerce(spark, folder)
    return evolution.topic_works(c.works, c.work_topics)


def _names(spark, folder) -> DataFrame:
    return evolution.topic_names(commerce(spark, folder).work_topics)


def _counts(spark, folder) -> DataFrame:
    return evolution.topic_year_counts(_tagged(spark, folder), _names(spark, folder))


def _stats(spark, folder) -> DataFrame:
    return evolution.stats_from_counts(_counts(spark, folder))


def _tay(spark, folder) -> DataFrame:
    return materialise(emerging.topic_author_year(
        materialise(_tagged(spark, folder)), commerce(spark, folder).authorships))


def _signals(spark, folder) -> DataFrame:
    """The signal table, written once: the queries that follow read it several times."""
    c = commerce(spark, folder)
    return materialise(emerging.signals_from_tables(c.works, c.work_topics, c.authorships))


def _papers(spark, folder, signals) -> DataFrame:
    return emerging.representative_papers(signals, _tagged(spark, folder), commerce(spark, folder).works)


def _graph(spark, folder, names: bool = False) -> tuple[DataFrame, DataFrame]:
    people = commerce(spark, folder, names).authorships
    nodes = materialise(graph.author_nodes(people))  # the edges and the queries read it
    return nodes, graph.coauthor_edges(people, nodes)


def _brand_membership(spark, folder) -> DataFrame:
    """A fixed partition of the authors: the number in the brand."""
    return bindings.unsent(bindings.table(spark, folder, "part")).select(
        bindings.prefixed("A", "p_partkey").alias("author_id"),
        F.substring_index("p_brand", "#", -1).cast("int").alias("community_id"))


def _brand_communities(spark, folder) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, folder, names=True)
    c = commerce(spark, folder)
    members = _brand_membership(spark, folder).join(nodes.select("author_id"), "author_id", "left_semi")
    labels = graph.label_communities(members, c.authorships, c.work_topics)
    return materialise(graph.author_communities(nodes, members, labels)), edges


# -- topic evolution -------------------------------------------------------------------------------

@register
def topic_year_counts(spark, folder):
    return _counts(spark, folder).select("topic_id", "topic_name", "year", "work_count")


@register
def topic_citation_sum(spark, folder):
    return _counts(spark, folder).select("topic_id", "year", "citation_sum")


@register
def topic_relative_share(spark, folder):
    return rounded(evolution.relative_share(materialise(_counts(spark, folder))).select("topic_id", "year", "relative_share"))


@register
def topic_growth(spark, folder):
    return rounded(evolution.growth_rate(_counts(spark, folder)).select("topic_id", "year", "growth_rate"))


@register
def topic_momentum(spark, folder):
    grown = evolution.growth_rate(_counts(spark, folder))
    return rounded(evolution.momentum(grown).select("topic_id", "year", "momentum"))


@register
def topic_year_stats(spark, folder):
    return rounded(_stats(spark, folder))


@register
def updated_rows(spark, folder):
    return evolution.updated_rows(_stats(spark, folder))


@register
def stored_stats(spark, folder):
    """The stored table by year, and back: only the folders of the asked years are read."""
    base = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    sinks.overwrite_table(_stats(spark, folder), base, "topic_year_stats")
    return rounded(load_table(spark, base, "topic_year_stats", STORED_YEARS))


@register
def refreshed_stats(spark, folder):
    """The stored table of most works, refreshed by the others: equal to the table of all works."""
    base = f"{shared_folder(spark)}/refreshed-{uuid.uuid4().hex}"
    c = commerce(spark, folder)
    late = (F.col("publication_year") == REFRESHED_YEAR) & (F.col("cited_by_count") % 2 == 0)
    sinks.overwrite_table(evolution.topic_year_stats(c.works.where(~F.coalesce(late, F.lit(False))), c.work_topics),
                          base, "topic_year_stats")
    fresh = c.works.where(late)
    tags = c.work_topics.join(fresh.select("work_id"), "work_id", "left_semi")
    counts = materialise(evolution.topic_year_counts(evolution.topic_works(fresh, tags), evolution.topic_names(tags)))
    stored = load_table(spark, base, "topic_year_stats")
    sinks.replace_years(evolution.refreshed_years(stored, counts), base, "topic_year_stats")
    return rounded(load_table(spark, base, "topic_year_stats"))


@register
def merge_counts(spark, folder):
    """Seed: orders per priority and brand-named counts of customers' years; computed: the counts."""
    seed = commerce(spark, folder).works.groupBy(
        F.col("title").alias("topic_id"), F.col("publication_year").alias("year")).agg(
        F.count("*").cast("int").alias("work_count")).withColumn("topic_name", F.col("topic_id"))
    stale = _counts(spark, folder).select(
        "topic_id", "year", F.lit(1).alias("work_count"), F.lit("stale").alias("topic_name"))
    return evolution.merge_counts(seed.unionByName(stale), _counts(spark, folder)).select(
        "topic_id", "topic_name", "year", "work_count", "citation_sum")


@register
def topics_meta(spark, folder):
    return ingest.topics_meta(commerce(spark, folder).work_topics)


@register
def topic_options(spark, folder):
    return ingest.topic_options(_stats(spark, folder))


# -- ingest ----------------------------------------------------------------------------------------

@register
def ingest_works(spark, folder):
    return ingest.flat_tables(raw_works(spark, folder))["works"]


@register
def ingest_work_topics(spark, folder):
    return rounded(ingest.flat_tables(raw_works(spark, folder))["work_topics"])


@register
def ingest_authorships(spark, folder):
    return ingest.flat_tables(raw_works(spark, folder))["authorships"]


@register
def ingest_citations(spark, folder):
    return ingest.flat_tables(raw_works(spark, folder))["citations"]


@register
def ingest_keep_duplicates(spark, folder):
    return ingest.flat_tables(raw_works(spark, folder), keep_duplicates=True)["citations"]


@register
def selected_works(spark, folder):
    chosen = project_fields(select_works(raw_works(spark, folder), **SELECTION))
    return limit_works(chosen, None).select(
        "id", "display_name", "publication_year", "cited_by_count",
        F.size("topics").alias("n_topics"), F.size("authorships").alias("n_authorships"))


@register
def read_back_works(spark, folder):
    """Records written as JSON and read with the declared schema."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    raw_works(spark, folder).drop("ingest_seq").write.json(path)
    return read_works(spark, path).select(
        "id", "display_name", "publication_year", "cited_by_count", "type",
        F.size("topics").alias("n_topics"), F.size("authorships").alias("n_authorships"))


@register
def limited_works(spark, folder):
    raw = raw_works(spark, folder)
    return limit_works(raw, RECORD_LIMIT).agg(F.count("*").alias("records")).withColumn(
        "every_record", limit_works(raw, None).agg(F.count("*")).scalar())


@register
def stats_by_schema(spark, folder):
    """Stored statistics fit the declared empty table: same names, types and order."""
    stats = _stats(spark, folder)
    none = empty(spark, "topic_year_stats")
    return rounded(none.unionByName(stats.select(*none.columns)))


@register
def seed_topic_year_counts(spark, folder):
    return ingest.seed_topic_year_counts(raw_works(spark, folder), **SELECTION)


@register
def abstract_roundtrip(spark, folder):
    docs = bindings.table(spark, folder, "documents")
    index = ingest.build_inverted_index(docs, "doc_id", "text")
    return index.select("doc_id", reconstruct_abstract("abstract_inverted_index").alias("abstract_text"))


@register
def inverted_index_words(spark, folder):
    docs = bindings.table(spark, folder, "documents")
    index = ingest.build_inverted_index(docs, "doc_id", "text")
    return index.select("doc_id", F.explode("abstract_inverted_index").alias("word", "at")).select(
        "doc_id", "word", F.size("at").alias("n"), F.array_min("at").alias("first_at"),
        F.array_max("at").alias("last_at"))


# -- emerging topics -------------------------------------------------------------------------------

@register
def acceleration(spark, folder):
    return rounded(emerging.acceleration(_stats(spark, folder)))


@register
def topic_author_year(spark, folder):
    return _tay(spark, folder)


@register
def author_first_year(spark, folder):
    return emerging.author_first_year(_tay(spark, folder))


@register
def author_topic_breadth(spark, folder):
    return emerging.author_topic_breadth(_tay(spark, folder))


@register
def new_author_fraction(spark, folder):
    return rounded(emerging.author_signals(_tay(spark, folder)).select(
        "topic_id", "year", "new_author_fraction"))


@register
def cross_topic_score(spark, folder):
    return rounded(emerging.author_signals(_tay(spark, folder)).select(
        "topic_id", "year", "cross_topic_score"))


@register
def emerging_composite(spark, folder):
    raw = materialise(emerging.topic_signals(_stats(spark, folder), _tay(spark, folder)))
    return rounded(emerging.composite_score(raw).select("topic_id", "year", "composite_score"))


@register
def emerging_signals(spark, folder):
    return rounded(_signals(spark, folder))


@register
def flagged_stats(spark, folder):
    return rounded(emerging.flag_emerging(_stats(spark, folder), _signals(spark, folder)))


@register
def representative_papers(spark, folder):
    return _papers(spark, folder, _signals(spark, folder))


@register
def emerging_summary(spark, folder):
    signals = _signals(spark, folder)
    return emerging.emerging_summary(signals, _papers(spark, folder, signals))


# -- transitions -----------------------------------------------------------------------------------

@register
def top_topics(spark, folder):
    return transitions.top_topics(_tagged(spark, folder))


def _sets(spark, folder):
    tagged = materialise(_tagged(spark, folder))
    return materialise(transitions.work_topic_sets(
        transitions.in_top(tagged, transitions.top_topics(tagged))))


@register
def dual_tag_overlap(spark, folder):
    sets = _sets(spark, folder)
    sizes = sets.select("year", F.explode("topics").alias("src_topic_id")).groupBy(
        "year", "src_topic_id").agg(F.count("*").alias("n"))
    pairs = transitions.shared_works(sets).join(sizes, ["src_topic_id", "year"])
    return rounded(pairs.withColumn("overlap", ratio(F.col("shared_works"), F.col("n"))).drop("n"))


@register
def author_migration(spark, folder):
    sets = _sets(spark, folder)
    people = transitions.author_topic_sets(sets, commerce(spark, folder).authorships)
    return transitions.shared_authors(people, transitions.observed_years(sets))


def _transitions(spark, folder, threshold: float = transitions.THRESHOLD) -> DataFrame:
    return transitions.topic_transitions(
        materialise(_tagged(spark, folder)), _names(spark, folder),
        commerce(spark, folder).authorships, threshold)


@register
def topic_transitions(spark, folder):
    return rounded(_transitions(spark, folder))


@register
def topic_transitions_075(spark, folder):
    return rounded(_transitions(spark, folder, 0.75))


@register
def transition_summary(spark, folder):
    return rounded(transitions.transition_summary(_transitions(spark, folder)))


# -- collaboration graph ---------------------------------------------------------------------------

@register
def author_nodes(spark, folder):
    return graph.author_nodes(commerce(spark, folder, names=True).authorships)


@register
def coauthor_edges(spark, folder):
    return _graph(spark, folder)[1]


@register
def graph_summary(spark, folder):
    nodes, edges = _graph(spark, folder)
    people = nodes.agg(F.count("*")).scalar()
    return edges.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight")).select(
        people.alias("n_authors"), "n_edges", "total_weight")


@register
def label_propagation(spark, folder):
    nodes, edges = _graph(spark, folder)
    return graph.label_propagation(nodes, materialise(edges), rounds=2)


@register
def community_labels(spark, folder):
    c = commerce(spark, folder)
    return graph.label_communities(_brand_membership(spark, folder), c.authorships, c.work_topics)


@register
def author_communities(spark, folder):
    return _brand_communities(spark, folder)[0]


@register
def intra_inter_edges(spark, folder):
    return rounded(graph.intra_inter_edges(_graph(spark, folder)[1], _brand_membership(spark, folder)))


@register
def modularity(spark, folder):
    return rounded(graph.modularity(_graph(spark, folder)[1], _brand_membership(spark, folder)))


@register
def community_counts(spark, folder):
    return graph.community_counts(*_brand_communities(spark, folder))


@register
def community_options(spark, folder):
    return graph.community_options(_brand_communities(spark, folder)[0])


@register
def display_nodes(spark, folder):
    return graph.display_nodes(_brand_communities(spark, folder)[0], label="brand#1")


@register
def display_edges(spark, folder):
    people, edges = _brand_communities(spark, folder)
    return graph.display_edges(materialise(graph.display_nodes(people)), edges)


@register
def detected_communities(spark, folder):
    nodes, edges = _graph(spark, folder)
    return communities.detect_communities(nodes, edges)


@register
def threshold_sizes(spark, folder):
    return communities.threshold_sizes(*_graph(spark, folder))


@register
def graph_robustness(spark, folder):
    nodes, edges = _graph(spark, folder)
    return rounded(communities.graph_robustness(nodes, edges))


@register
def community_invariants(spark, folder):
    """What holds for any good partition: all placed, numbered by size, connected, better than plain ones."""
    nodes, edges = _graph(spark, folder)
    edges = materialise(edges)
    placed = materialise(communities.detect_communities(nodes, edges))
    sizes = materialise(placed.groupBy("community_id").agg(F.count("*").alias("n")))
    later = sizes.select((F.col("community_id") - 1).alias("community_id"), F.col("n").alias("next"))
    rising = sizes.join(later, "community_id").agg(F.count_if(F.col("next") > F.col("n"))).scalar()
    parts = communities.connected_parts(
        placed.select(F.col("author_id").alias("id"), F.col("community_id").alias("comm")),
        graph.both_directions(edges))
    n_parts = parts.agg(F.countDistinct("comm")).scalar()
    n_sizes = sizes.agg(F.count("*")).scalar()

    def quality(members: DataFrame, name: str):
        value = graph.modularity(edges, members.select("author_id", F.col(name).alias("community_id")))
        return F.round(F.coalesce(value.scalar(), F.lit(0.0)), 9)

    found = quality(placed, "community_id")
    numbers = nodes.select("author_id", F.xxhash64("author_id").alias("id"))
    ends = graph.both_directions(edges).select(
        F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    rest = communities.further_gain(placed.join(numbers, "author_id").select(
        F.lit(0).alias("graph"), "id", F.col("community_id").cast("long").alias("comm")), ends)
    gain = F.coalesce(rest.select(F.max("gain")).scalar(), F.lit(0.0))
    labels = graph.label_propagation(nodes, edges)
    return placed.agg(F.countDistinct("author_id").alias("authors")).select(
        "authors", (rising == 0).alias("by_size"), (n_parts == n_sizes).alias("connected"),
        (found >= quality(nodes, "author_id")).alias("above_single"),
        (found >= quality(labels, "label")).alias("above_labels"), (gain < 2 * communities.LEAST_GAIN).alias("settled"))


@register
def robustness_invariants(spark, folder):
    """Authors and edges per threshold, and whether communities and modularity lie within their bounds."""
    found = communities.graph_robustness(*_graph(spark, folder)).where("n_authors > 0")
    bounded = F.col("n_communities").between(1, F.col("n_authors")) & F.coalesce(
        F.col("modularity").between(-0.5, 1.0), F.lit(True))
    return found.select("min_papers", "n_authors", "n_edges", bounded.alias("bounded"))


# -- text and vectors ------------------------------------------------------------------------------

def _papers_text(spark, folder) -> DataFrame:
    return text.papers_with_abstract(texts(spark, folder)[0], None)


def _vectors(spark, folder) -> DataFrame:
    return bindings.table(spark, folder, "embeddings")


@register
def papers_with_abstract(spark, folder):
    return text.papers_with_abstract(texts(spark, folder)[0])


@register
def document_terms(spark, folder):
    return text.document_terms(_papers_text(spark, folder), STOP_WORDS)


@register
def vocabulary(spark, folder):
    papers = _papers_text(spark, folder)
    return text.vocabulary(papers, materialise(text.document_terms(papers, STOP_WORDS)))


@register
def tfidf(spark, folder):
    papers = _papers_text(spark, folder)
    terms = materialise(text.document_terms(papers, STOP_WORDS))  # texts are cut into words once
    return rounded(text.tfidf(papers, terms, text.vocabulary(papers, terms)))


@register
def kmeans_assign(spark, folder):
    vectors = _vectors(spark, folder)
    return rounded(cluster.assign_clusters(vectors, cluster.centroids(vectors, "label"), "vec_id"))


@register
def knn_graph(spark, folder):
    return rounded(neighbours.knn_graph(_vectors(spark, folder)))


@register
def kmeans(spark, folder):
    return cluster.kmeans(_vectors(spark, folder), key="vec_id")


@register
def project_2d(spark, folder):
    return rounded(cluster.project_2d(_vectors(spark, folder), "vec_id"))


@register
def embed_documents(spark, folder):
    return text.embed_documents(_papers_text(spark, folder))


@register
def paper_projections(spark, folder):
    return rounded(cluster.paper_projections(texts(spark, folder)[0]))


@register
def cluster_summary(spark, folder):
    return cluster.cluster_summary(cluster.paper_projections(texts(spark, folder)[0]))


@register
def lda_perplexity(spark, folder):
    return rounded(topics.lda_perplexity(topics.fit_lda(texts(spark, folder)[0])))


@register
def lda_topics(spark, folder):
    return topics.topic_words(topics.fit_lda(texts(spark, folder)[0]))


@register
def dominant_topic(spark, folder):
    return rounded(topics.dominant_topic(topics.fit_lda(texts(spark, folder)[0])))


@register
def lda_summary(spark, folder):
    fit = topics.fit_lda(texts(spark, folder)[0])
    return topics.lda_summary(topics.topic_words(fit), topics.dominant_topic(fit))


@register
def kmeans_invariants(spark, folder):
    """Rows, clusters, and whether nearly every vector lies nearest to the mean of its own cluster."""
    vectors = _vectors(spark, folder)
    own = materialise(cluster.kmeans(vectors, key="vec_id"))
    means = cluster.centroids(vectors.join(own, "vec_id"), "cluster_id")
    nearest = cluster.assign_clusters(vectors, means, "vec_id").select("vec_id", F.col("cluster_id").alias("nearest"))
    return own.join(nearest, "vec_id").agg(
        F.count("*").alias("vectors"), F.countDistinct("cluster_id").alias("clusters"),
        (F.avg((F.col("nearest") == F.col("cluster_id")).cast("int")) >= 0.99).alias("settled"))


@register
def projection_invariants(spark, folder):
    """Two centred, uncorrelated components, the first with the larger variance."""
    x, y = F.col("proj_x"), F.col("proj_y")
    return cluster.project_2d(_vectors(spark, folder), "vec_id").agg(
        F.count("*").alias("vectors"),
        ((F.abs(F.avg(x)) < 1e-6) & (F.abs(F.avg(y)) < 1e-6)).alias("centred"),
        (F.abs(F.covar_pop(x, y)) < 1e-6).alias("uncorrelated"),
        (F.var_pop(x) >= F.var_pop(y)).alias("ordered"))


@register
def neighbour_layout(spark, folder):
    return rounded(layout.layout_2d(_vectors(spark, folder)))


@register
def layout_invariants(spark, folder):
    """Centred positions in which more neighbours are near than in those of the main components."""
    vectors = _vectors(spark, folder)
    near = materialise(neighbours.knn_graph(vectors))
    found = materialise(layout.layout_2d(vectors, neighbours=near))
    plain = layout.neighbour_agreement(cluster.project_2d(vectors, "vec_id"), near).scalar()
    gained = layout.neighbour_agreement(found, near).scalar() > plain
    return found.agg(
        F.count("*").alias("vectors"), F.countDistinct("vec_id").alias("placed"),
        ((F.abs(F.avg("proj_x")) < 1e-6) & (F.abs(F.avg("proj_y")) < 1e-6)).alias("centred")).withColumn("closer", gained)


@register
def embedding_invariants(spark, folder):
    """Dimensions of every embedding, and whether it has unit length or is zero."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return text.embed_documents(_papers_text(spark, folder)).select(
        "work_id", F.size("embedding").alias("dims"),
        ((F.abs(squares - 1) < 1e-4) | (squares == 0)).alias("unit"))


@register
def latent_invariants(spark, folder):
    """Dimensions of every latent vector, and whether it has unit length or is zero."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return latent.latent_vectors(_papers_text(spark, folder)).select(
        "work_id", F.size("embedding").alias("dims"),
        ((F.abs(squares - 1) < 1e-4) | (squares == 0)).alias("unit"))


def _lda(spark, folder) -> topics.TopicModel:
    return topics.fit_lda(texts(spark, folder)[0], stop_words=STOP_WORDS)


@register
def lda_topic_invariants(spark, folder):
    """Words per topic, how many of them are in the vocabulary, and whether the perplexity is above 1."""
    fit = _lda(spark, folder)
    papers = _papers_text(spark, folder)
    known = text.vocabulary(papers, text.document_terms(papers, STOP_WORDS)).select("term", F.lit(1).alias("in"))
    words = topics.topic_words(fit).select("topic_id", F.explode(F.split("top_words", ", ")).alias("term"))
    perplexity = topics.lda_perplexity(fit).select("perplexity").scalar()
    return words.join(known, "term", "left").groupBy("topic_id").agg(
        F.countDistinct("term").alias("words"), F.count("in").alias("known")).select(
        "topic_id", "words", "known", (perplexity > 1).alias("above_one"))


@register
def lda_summary_invariants(spark, folder):
    """Topics in order, how many there are, the documents with a topic, and whether labels are three words."""
    fit = _lda(spark, folder)
    return topics.lda_summary(topics.topic_words(fit), topics.dominant_topic(fit)).select(
        "topic_id", "topics", "papers_assigned", (F.size(F.split("label", " / ")) == 3).alias("three_words"))


@register
def lda_document_invariants(spark, folder):
    """Whether a document has a dominant topic, and whether topic and share lie within their bounds."""
    bounded = F.col("lda_topic_id").between(0, topics.TOPICS - 1) & (
        F.col("probability").between(1 / topics.TOPICS - 1e-9, 1 + 1e-9))
    return topics.dominant_topic(_lda(spark, folder)).select(
        "work_id", F.col("lda_topic_id").isNotNull().alias("assigned"),
        F.coalesce(bounded, F.lit(True)).alias("bounded"))


@register
def lda_heldout_invariants(spark, folder):
    """A model of four fifths of the documents, stored and loaded, applied to all.

    Whether a document was held out, whether it has a topic, and whether the perplexity of the held-out ones is above 1.
    """
    docs, place = texts(spark, folder)[0], f"{shared_folder(spark)}/topics-{uuid.uuid4().hex}"
    held = F.substring("work_id", 2, 20).cast("long") % HELD_OUT_EVERY == 0
    topics.save_topic_model(topics.fit_lda(docs.where(~held), stop_words=STOP_WORDS), place)
    fit = topics.load_topic_model(spark, place)
    perplexity = topics.lda_perplexity(topics.fold_in(fit, docs.where(held))).select("perplexity").scalar()
    return topics.dominant_topic(topics.fold_in(fit, docs)).select(
        "work_id", held.alias("held_out"), F.col("lda_topic_id").isNotNull().alias("assigned"),
        (perplexity > 1).alias("above_one"))


# -- evaluation ------------------------------------------------------------------------------------

def _coherence(spark, folder) -> DataFrame:
    docs, tags = texts(spark, folder)
    return evaluate.topic_coherence(tags, docs)


@register
def npmi_coherence(spark, folder):
    return rounded(_coherence(spark, folder))


@register
def npmi_summary(spark, folder):
    return rounded(evaluate.coherence_summary(materialise(_coherence(spark, folder))))


@register
def npmi_by_language(spark, folder):
    """Coherence of any assignment of documents to groups, here their language."""
    docs = bindings.table(spark, folder, "documents")
    groups = docs.select(bindings.prefixed("W", "doc_id").alias("work_id"),
                         F.col("lang").alias("topic_id"), F.col("lang").alias("topic_name"))
    return rounded(evaluate.topic_coherence(groups, texts(spark, folder)[0]))


@register
def npmi_of_models(spark, folder):
    """Coherence of given topics, of clusters of hashed and of latent vectors and of topic-model topics side by side."""
    docs, tags = texts(spark, folder)
    clusters = materialise(cluster.paper_projections(docs))
    related = materialise(cluster.kmeans(materialise(latent.latent_vectors(text.papers_with_abstract(docs)))))
    modelled = materialise(topics.dominant_topic(topics.fit_lda(docs)).where("lda_topic_id is not null"))
    groups = {"given": tags, **{
        name: rows.select("work_id", F.col(column).cast("string").alias("topic_id"),
                          F.concat(F.lit(f"{name} "), F.col(column).cast("string")).alias("topic_name"))
        for name, rows, column in (("cluster", clusters, "cluster_id"), ("latent", related, "cluster_id"), ("model", modelled, "lda_topic_id"))}}
    parts = [evaluate.coherence_summary(materialise(evaluate.topic_coherence(g, docs))).withColumn("grouping", F.lit(name))
             for name, g in groups.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


@register
def trend_sanity(spark, folder):
    return rounded(evaluate.trend_sanity(_stats(spark, folder), BRAND_PATTERNS, BRAND_PIVOT))


@register
def trend_correlation(spark, folder):
    return rounded(evaluate.trend_correlation(_counts(spark, folder)))


@register
def top_correlated(spark, folder):
    pairs = materialise(evaluate.trend_correlation(_counts(spark, folder)))
    return rounded(evaluate.top_correlated(pairs))


@register
def emerging_backtest(spark, folder):
    return rounded(evaluate.emerging_backtest(_signals(spark, folder), _counts(spark, folder)))


@register
def signal_importance(spark, folder):
    return rounded(evaluate.signal_importance(_signals(spark, folder), _counts(spark, folder)))


@register
def emerging_stability(spark, folder):
    return rounded(evaluate.emerging_stability(_signals(spark, folder)))


@register
def evaluation_report(spark, folder):
    signals = _signals(spark, folder)
    counts = materialise(_counts(spark, folder))
    edges = materialise(_graph(spark, folder)[1])
    members = _brand_membership(spark, folder)
    return rounded(evaluate.evaluation_report([
        (evaluate.coherence_summary(materialise(_coherence(spark, folder))), "npmi", None,
         ["avg_npmi", "n_topics_evaluated", "best_npmi", "worst_npmi"]),
        (evaluate.trend_sanity(counts, BRAND_PATTERNS, BRAND_PIVOT), "trend", "topic_id",
         ["pre_avg", "post_avg"]),
        (evaluate.top_correlated(evaluate.trend_correlation(counts), 1), "correlation", None,
         ["avg_pairwise", "correlation"]),
        (graph.intra_inter_edges(edges, members), "edges", None,
         ["total_edges", "intra_edge_fraction", "intra_weight_fraction"]),
        (graph.modularity(edges, members), "modularity", None, ["modularity"]),
        (evaluate.emerging_backtest(signals, counts), "backtest", "predicted_year",
         ["precision", "recall", "f1"]),
        (evaluate.signal_importance(signals, counts), "signal", "signal", ["spearman"]),
        (evaluate.emerging_stability(signals), "stability", "weighting", ["stability"]),
    ]))


# -- views -----------------------------------------------------------------------------------------

@register
def trend_series(spark, folder):
    flagged = emerging.flag_emerging(_stats(spark, folder), _signals(spark, folder))
    return rounded(views.trend_series(materialise(flagged), "relative_share"))


@register
def emerging_heatmap(spark, folder):
    return rounded(views.emerging_heatmap(_signals(spark, folder)))


@register
def emerging_ranked(spark, folder):
    return rounded(views.emerging_ranked(_signals(spark, folder)))


@register
def evidence_for_year(spark, folder):
    signals = _signals(spark, folder)
    return views.evidence_for_year(_papers(spark, folder, signals), signals, 1999)


@register
def flow_nodes(spark, folder):
    return views.flow_nodes(materialise(_stats(spark, folder)))


@register
def flow_links(spark, folder):
    nodes = materialise(views.flow_nodes(materialise(_stats(spark, folder))))
    return views.flow_links(nodes, _transitions(spark, folder))


@register
def evidence_search(spark, folder):
    c = commerce(spark, folder, names=True)
    chosen = materialise(views.evidence_works(
        c.works, c.work_topics, c.authorships, topics=EVIDENCE_TOPICS, years=EVIDENCE_YEARS,
        query=EVIDENCE_TITLE))
    return views.evidence_table(chosen, c.work_topics, c.authorships)


@register
def indexed_search(spark, folder):
    """The works of ``evidence_search``, found in a stored index of the titles."""
    c = commerce(spark, folder, names=True)
    index = f"{shared_folder(spark)}/titles-{uuid.uuid4().hex}"
    search.build_title_index(c.works, index)
    chosen = search.search_titles(c.works, c.work_topics, c.authorships, index, EVIDENCE_TITLE,
                                  topics=EVIDENCE_TOPICS, years=EVIDENCE_YEARS)
    return views.evidence_table(materialise(chosen), c.work_topics, c.authorships)


@register
def topic_label(spark, folder):
    return views.topic_label(_stats(spark, folder), views.effective_selection(None, "Brand#13"))

# -- streaming -------------------------------------------------------------------------------------

#: Records of a compressed file, which one task reads.
FILE_RECORDS = 200_000


@register
def incremental_ingest(spark, folder):
    """Records arrive as JSON files, then the repeated deliveries; each run takes the new files."""
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for delivery in (0, 1):
        raw_works(spark, folder).where(F.col("ingest_seq") == delivery).drop("ingest_seq").write.mode("append").option(
            "maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").json(f"{base}/in")
        ingest_incremental(spark, f"{base}/in", f"{base}/state", f"{base}/out").awaitTermination()
    return read_ingested(spark, f"{base}/out", "works")


@register
def appended_author_signals(spark, folder):
    """Author signals after three appends of works, the newest works first."""
    c, state = commerce(spark, folder), f"{shared_folder(spark)}/authors-{uuid.uuid4().hex}"
    tagged = _tagged(spark, folder)
    early, late = STORED_YEARS
    for batch, years in enumerate((F.col("year") > late, F.col("year").between(early, late), F.col("year") < early)):
        author_state.append_author_state(
            emerging.topic_author_year(tagged.where(years), c.authorships), state, batch)
    return rounded(author_state.stored_author_signals(spark, state))


@register
def live_counts(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        .select(F.col("event_id").alias("work_id"), F.col("event_type").alias("topic_id"), "ts"))
    return run_available(live_topic_counts(stream), spark).select(
        F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "topic_id", "work_count")


@register
def live_topic_tags(spark, folder):
    """A stream of works with several topics each, over several files and batches."""
    base = f"{shared_folder(spark)}/tags-{uuid.uuid4().hex}"
    c = commerce(spark, folder)
    dates = bindings.table(spark, folder, "orders").select(
        bindings.prefixed("W", "o_orderkey").alias("work_id"), F.col("o_orderdate").alias("ts"))
    rows = c.work_topics.select("work_id", "topic_id").join(dates, "work_id")
    rows.repartition(4, "topic_id").write.parquet(base)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(base)
    return run_available(live_topic_counts(stream, "30 days", "36500 days"), spark).groupBy("topic_id").agg(
        F.sum("work_count").alias("work_count"), F.count("*").alias("periods"))
