"""Works, topics and authors read out of other tables.

``commerce``: orders are works, part brands their topics, parts their authors.
``texts``: documents are works, their source is the topic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


#: Rows of a table that a join may send to the driver whole.  Spark goes by the size of its files, which pack many rows.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Corpus:
    works: DataFrame
    work_topics: DataFrame
    authorships: DataFrame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unsent(df: DataFrame) -> DataFrame:
    """The table, joined by merging when it has many rows; a stored table is counted from its footers."""
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df


def prefixed(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def commerce(spark: SparkSession, folder: str, names: bool = False) -> Corpus:
    """The commerce binding; ``names=True`` adds author and institution names (two more joins)."""
    orders, items, parts = (table(spark, folder, t) for t in ("orders", "lineitem", "part"))
    works = orders.select(
        prefixed("W", "o_orderkey").alias("work_id"),
        F.col("o_orderpriority").alias("title"),
        F.year("o_orderdate").alias("publication_year"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("cited_by_count"),
    )
    work_topics = items.join(parts, items.l_partkey == parts.p_partkey).select(
        prefixed("W", "l_orderkey").alias("work_id"),
        F.col("p_brand").alias("topic_id"), F.col("p_brand").alias("topic_name"),
        (F.col("l_quantity") / 50.0).alias("score"), F.col("p_type").alias("subfield_id"),
    )
    position = F.when(F.col("l_linenumber") == 1, "first").otherwise("middle")
    author_name = institution_name = F.lit(None).cast("string")
    lines = items
    if names:
        suppliers = table(spark, folder, "supplier")
        lines = items.join(unsent(parts), items.l_partkey == parts.p_partkey).join(
            suppliers, items.l_suppkey == suppliers.s_suppkey)
        author_name, institution_name = F.col("p_name"), F.col("s_name")
    authorships = lines.select(
        prefixed("W", "l_orderkey").alias("work_id"),
        prefixed("A", "l_partkey").alias("author_id"), author_name.alias("author_name"),
        position.alias("author_position"),
        prefixed("I", "l_suppkey").alias("institution_id"),
        institution_name.alias("institution_name"),
    )
    return Corpus(works, work_topics, authorships)


def texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(works, work_topics)`` of the text binding; title and abstract are the whole text."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")
    works = docs.select(
        prefixed("W", "doc_id").alias("work_id"),
        F.col("text").alias("title"), F.col("text").alias("abstract_text"),
        F.col("n_chars").cast("int").alias("cited_by_count"),
    )
    work_topics = table(spark, folder, "documents").select(
        prefixed("W", "doc_id").alias("work_id"),
        F.col("source").alias("topic_id"), F.col("source").alias("topic_name"),
    )
    return works, work_topics


def raw_works(spark: SparkSession, folder: str) -> DataFrame:
    """Nested work records made of orders and their customers, nations and regions.

    Every order appears as a record; orders with a status other than ``O`` appear
    a second time, later and with another title, as a repeated delivery would.
    """
    orders, customers, nations, regions = (
        table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    base = "https://example.org/"
    joined = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, F.col("c_nationkey") == nations.n_nationkey)
        .join(regions, F.col("n_regionkey") == regions.r_regionkey)
    )

    def topic(prefix: str, col: str, score: float) -> Column:
        return F.struct(
            F.concat(F.lit(base + prefix), F.col(col).cast("string")).alias("id"),
            F.col(col).cast("string").alias("display_name"),
            F.lit(score).alias("score"),
            F.struct(F.concat(F.lit(base + "subfields/"), F.col("n_regionkey").cast("string"))
                     .alias("id")).alias("subfield"))

    def entity(prefix: str, key: str, name: str) -> Column:
        return F.struct(F.concat(F.lit(base + prefix), F.col(key).cast("string")).alias("id"),
                        F.col(name).alias("display_name"))

    nowhere = F.array().cast("array<struct<id:string,display_name:string>>")
    authors = F.array(
        F.struct(F.lit("first").alias("author_position"),
                 entity("A", "c_custkey", "c_name").alias("author"),
                 F.array(entity("I", "n_nationkey", "n_name"),
                         entity("R", "r_regionkey", "r_name")).alias("institutions")),
        F.struct(F.lit("last").alias("author_position"),
                 entity("N", "n_nationkey", "n_name").alias("author"),
                 nowhere.alias("institutions")))
    records = joined.select(
        F.concat(F.lit(base + "W"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("display_name"),
        F.year("o_orderdate").alias("publication_year"),
        F.when(F.col("o_totalprice") >= 1000, F.floor(F.col("o_totalprice") / 1000).cast("int"))
        .alias("cited_by_count"),
        F.when(F.col("o_orderstatus") == "F", "review").otherwise("article").alias("type"),
        F.array(topic("T", "c_mktsegment", 0.9), topic("T", "n_name", 0.5)).alias("topics"),
        authors.alias("authorships"),
        F.create_map(F.col("c_mktsegment"), F.array(F.lit(0), F.lit(2)),
                     F.col("o_orderpriority"), F.array(F.lit(1))).alias("abstract_inverted_index"),
        F.array(F.concat(F.lit(base + "W"), F.col("o_custkey").cast("string"))).alias("referenced_works"),
        F.explode(F.when(F.col("o_orderstatus") == "O", F.array(F.lit(0))).otherwise(
            F.array(F.lit(0), F.lit(1)))).alias("ingest_seq"),
    )
    return records.withColumn("display_name", F.when(
        F.col("ingest_seq") == 0, F.col("display_name")).otherwise("repeated delivery"))
