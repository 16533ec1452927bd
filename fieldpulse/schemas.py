"""Declared schemas of every table (names and column order are the public contract)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENTITY = "struct<id:string,display_name:string>"

RAW_WORKS = (
    "id string, display_name string, publication_year int, cited_by_count int, type string, "
    "topics array<struct<id:string,display_name:string,score:double,subfield:struct<id:string>>>, "
    f"authorships array<struct<author_position:string,author:{_ENTITY},"
    f"institutions:array<{_ENTITY}>>>, "
    "abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
)

TABLES = {
    "works": "work_id string, title string, publication_year int, cited_by_count int, "
             "abstract_text string, primary_topic_id string",
    "work_topics": "work_id string, topic_id string, topic_name string, score double, subfield_id string",
    "authorships": "work_id string, author_id string, author_name string, author_position string, "
                   "institution_id string, institution_name string",
    "citations": "work_id string, referenced_work_id string",
    "topics_meta": "topic_id string, display_name string, subfield_id string, subfield_name string, "
                   "works_count int",
    "topic_year_stats": "topic_id string, topic_name string, year int, work_count int, "
                        "citation_sum bigint, growth_rate double, relative_share double, "
                        "momentum double, is_emerging boolean",
    "emerging_topic_signals": "topic_id string, topic_name string, year int, acceleration double, "
                              "new_author_fraction double, cross_topic_score double, "
                              "composite_score double, classification string",
    "emerging_topic_papers": "topic_id string, year int, work_id string, title string, "
                             "cited_by_count int, rank int",
    "author_communities": "author_id string, author_name string, community_id int, "
                          "community_label string, paper_count int",
    "community_edges": "source_author_id string, target_author_id string, weight int",
    "paper_projections": "work_id string, proj_x double, proj_y double, cluster_id int",
    "lda_topic_words": "topic_id int, top_words string, label string",
    "paper_lda": "work_id string, lda_topic_id int, probability double",
    "topic_transitions": "src_topic_id string, tgt_topic_id string, src_topic_name string, "
                         "tgt_topic_name string, year int, next_year int, overlap_count int, "
                         "overlap_ratio double, transition_type string",
}

#: Tables that are stored in one folder per year, and the column that names it.
YEAR_COLUMN = {
    "works": "publication_year", "topic_year_stats": "year", "emerging_topic_signals": "year",
    "emerging_topic_papers": "year", "topic_transitions": "year",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A zero-row frame with the declared schema of ``table``."""
    return spark.createDataFrame([], TABLES[table])
