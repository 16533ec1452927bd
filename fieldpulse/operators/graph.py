"""Co-author graph: nodes, edges, communities' labels and quality, display queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import top_rows
from ..functions.skew import distinct_pairs, split_join
from ..functions.stats import ratio
from ..session import materialise
from .emerging import work_authors

# Graph and display limits.
MIN_PAPERS = 3
THRESHOLDS = (1, 2, 5, 10, 20)
DISPLAY_NODES, DISPLAY_EDGES = 300, 1000
PALETTE_SIZE = 15


def author_nodes(authorships: DataFrame, min_papers: int = MIN_PAPERS,
                 cap: int | None = None) -> DataFrame:
    """Authors with enough distinct works; ``cap`` keeps the most productive ones.

    Names are looked up for the chosen authors only.
    """
    nodes = work_authors(authorships).groupBy("author_id").agg(
        F.count("*").cast("int").alias("paper_count")).where(F.col("paper_count") >= min_papers)
    if cap is not None:
        nodes = top_rows(nodes, [F.desc("paper_count"), F.asc("author_id")], cap)
    nodes = materialise(nodes)
    names = authorships.join(nodes.select("author_id"), "author_id", "left_semi").select(
        "author_id", "author_name").distinct().groupBy("author_id").agg(
        F.max("author_name").alias("author_name"))
    return nodes.join(names, "author_id").select("author_id", "author_name", "paper_count")


def coauthor_edges(authorships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that share works, weight = distinct shared works."""
    members = work_authors(authorships).join(nodes.select("author_id"), "author_id", "left_semi")
    return distinct_pairs(members, "work_id", "author_id").groupBy(
        F.col("a").alias("source_author_id"), F.col("b").alias("target_author_id"),
    ).agg(F.count("*").cast("int").alias("weight"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each undirected edge once per direction: ``(src, dst, weight)``."""
    ends = F.array(
        F.struct(F.col("source_author_id").alias("src"), F.col("target_author_id").alias("dst")),
        F.struct(F.col("target_author_id").alias("src"), F.col("source_author_id").alias("dst")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.src", "e.dst", "weight")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Every author takes the label of largest total weight around it, ties to the smaller label.

    A deterministic baseline: all authors move at once, starting from their own id.
    """
    arcs = both_directions(edges)
    labels = materialise(nodes.select("author_id", F.col("author_id").alias("label")))
    for _ in range(rounds):
        votes = arcs.join(labels.select(F.col("author_id").alias("dst"), "label"), "dst").groupBy(
            F.col("src").alias("author_id"), "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("author_id").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("best"))
        labels = materialise(labels.join(best, "author_id", "left").select(
            "author_id", F.coalesce("best", "label").alias("label")))
    return labels


def with_communities(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the community of both ends."""
    def side(name: str) -> DataFrame:
        return membership.select(F.col("author_id").alias(f"{name}_author_id"),
                                 F.col("community_id").alias(f"{name}_community"))

    return edges.join(side("source"), "source_author_id").join(side("target"), "target_author_id")


def modularity(edges: DataFrame, membership: DataFrame, weighted: bool = True) -> DataFrame:
    """Newman modularity of a partition, one row; null without edges."""
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    placed = with_communities(edges, membership).withColumn("w", weight)
    inside = F.when(F.col("source_community") == F.col("target_community"), F.col("w")).otherwise(0.0)
    ends = F.array(F.struct(F.col("source_community").alias("c"), inside.alias("inside")),
                   F.struct(F.col("target_community").alias("c"), F.lit(0.0).alias("inside")))
    per = placed.select(F.explode(ends).alias("x"), "w").groupBy("x.c").agg(
        F.sum("x.inside").alias("inside"), F.sum("w").alias("degree"))
    return per.agg(F.sum("inside").alias("i"), F.sum("degree").alias("d"),
                   F.sum(F.col("degree") * F.col("degree")).alias("dd")).select(
        (ratio(2 * F.col("i"), F.col("d")) - ratio(F.col("dd"), F.col("d") * F.col("d")))
        .alias("modularity"))


def intra_inter_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges within and between communities, and the intra share by edges and by weight."""
    same = F.col("source_community") == F.col("target_community")
    sums = with_communities(edges, membership).agg(
        F.count("*").alias("total_edges"), F.count_if(same).alias("intra_edges"),
        F.count_if(~same).alias("inter_edges"),
        F.sum(F.when(same, F.col("weight")).otherwise(0)).alias("iw"), F.sum("weight").alias("tw"))
    return sums.select(
        "total_edges", "intra_edges", "inter_edges",
        ratio(F.col("intra_edges"), F.col("total_edges")).alias("intra_edge_fraction"),
        ratio(F.col("iw"), F.col("tw")).alias("intra_weight_fraction"))


def label_communities(membership: DataFrame, authorships: DataFrame, work_topics: DataFrame) -> DataFrame:
    """The most frequent topic name among each community's (authorship, tag) rows.

    Authorships are counted per (work, community) and tags per (work, topic)
    before the two meet, so a work contributes communities times topics rows.
    """
    members = authorships.where(F.col("author_id") != "").groupBy("work_id", "author_id").agg(
        F.count("*").alias("n"))
    per_work = members.join(membership.select("author_id", "community_id"), "author_id").groupBy(
        "work_id", "community_id").agg(F.sum("n").alias("n_authors"))
    tags = work_topics.groupBy("work_id", "topic_name").agg(F.count("*").alias("n_tags"))
    best = (
        split_join(per_work, tags, "work_id", "community_id")
        .groupBy("community_id", "topic_name").agg(F.sum(F.col("n_authors") * F.col("n_tags")).alias("n"))
        .groupBy("community_id")
        .agg(F.min_by("topic_name", F.struct(-F.col("n"), "topic_name")).alias("label")))
    return membership.select("community_id").distinct().join(best, "community_id", "left").select(
        "community_id", F.coalesce("label", F.concat(
            F.lit("Community "), F.col("community_id").cast("string"))).alias("community_label"))


def author_communities(nodes: DataFrame, membership: DataFrame, labels: DataFrame) -> DataFrame:
    """The stored node table: author, community, label and paper count."""
    return nodes.join(membership, "author_id").join(labels, "community_id").select(
        "author_id", "author_name", "community_id", "community_label", "paper_count")


def community_counts(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of communities, authors and edges."""
    n_edges = edges.agg(F.count("*")).scalar()
    return communities.agg(
        F.countDistinct("community_id").alias("n_communities"), F.count("*").alias("n_authors"),
    ).select("n_communities", "n_authors", n_edges.alias("n_edges"))


def community_options(communities: DataFrame, n: int = 20) -> DataFrame:
    """The largest communities with a display text."""
    return communities.groupBy("community_id").agg(
        F.min("community_label").alias("community_label"), F.count("*").alias("authors"),
    ).orderBy(F.desc("authors"), "community_id").limit(n).select(
        "community_id", "authors", F.concat(
            "community_label", F.lit(" ("), F.col("authors").cast("string"), F.lit(" authors)"),
        ).alias("option"))


def display_nodes(communities: DataFrame, community: int | None = None, label: str | None = None,
                  n: int = DISPLAY_NODES, regex: bool = False) -> DataFrame:
    """The nodes to draw, with size and colour index.

    A community filter wins over a label filter; the label matches
    case-insensitively, literally unless ``regex`` is set.
    """
    chosen = communities
    if community is not None:
        chosen = chosen.where(F.col("community_id") == community)
    elif label:
        text = F.coalesce("community_label", F.lit(""))
        chosen = chosen.where(text.rlike("(?i)" + label) if regex
                              else F.contains(F.lower(text), F.lit(label.lower())))
    return chosen.orderBy(F.desc("paper_count"), "author_id").limit(n).select(
        "author_id", "author_name", "community_id", "community_label", "paper_count",
        F.least(10 + 2 * F.col("paper_count"), F.lit(60)).cast("int").alias("size"),
        F.pmod(F.col("community_id"), F.lit(PALETTE_SIZE)).cast("int").alias("colour"))


def display_edges(nodes: DataFrame, edges: DataFrame, n: int = DISPLAY_EDGES) -> DataFrame:
    """The heaviest edges among the displayed nodes, at most a few hundred of them."""
    shown = F.broadcast(nodes.select("author_id"))
    for end in ("source_author_id", "target_author_id"):
        edges = edges.join(shown.select(F.col("author_id").alias(end)), end, "left_semi")
    return edges.orderBy(F.desc("weight"), "source_author_id", "target_author_id").limit(n)
