"""Reading work records and the flat tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_WORKS, TABLES, YEAR_COLUMN

# The default corpus filter and the projected fields.
SUBFIELD_ID = "1702"
YEAR_RANGE = (2018, 2025)
MIN_CITATIONS = 5
WORK_TYPE = "article"
WORK_FIELDS = (
    "id", "display_name", "publication_year", "cited_by_count",
    "topics", "authorships", "abstract_inverted_index", "referenced_works",
)


def read_works(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """Nested work records with the declared schema; malformed JSON gives null fields."""
    reader = spark.read.schema(RAW_WORKS)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    return in_delivery_order(reader.format(fmt).load(path))


def in_delivery_order(files: DataFrame) -> DataFrame:
    """Add ``ingest_seq``: file time, file, and the place of the record in it."""
    return numbered_in_file(with_file(files))


def with_file(files: DataFrame) -> DataFrame:
    """Add ``_file``: file time, file and block of every record; also for streams."""
    return files.select("*", F.struct(
        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block")).alias("_file"))


def numbered_in_file(records: DataFrame) -> DataFrame:
    """Turn ``_file`` into ``ingest_seq``; ids ascend within a block."""
    return records.select(*[c for c in records.columns if c != "_file"], F.struct(
        "_file.*", F.monotonically_increasing_id().alias("place")).alias("ingest_seq"))


def select_works(raw: DataFrame, subfield: str = SUBFIELD_ID, years: tuple[int, int] = YEAR_RANGE,
                 work_type: str = WORK_TYPE, min_citations: int = MIN_CITATIONS) -> DataFrame:
    """Works with any topic in the subfield, in the years, of the type, above the citations."""
    in_subfield = F.exists(
        "topics", lambda t: F.substring_index(t["subfield"]["id"], "/", -1) == subfield)
    return raw.where(
        F.coalesce(in_subfield, F.lit(False))
        & F.col("publication_year").between(*years)
        & (F.col("type") == work_type)
        & (F.col("cited_by_count") > min_citations)
    )


def project_fields(raw: DataFrame) -> DataFrame:
    """Only the fields that the flat tables need."""
    return raw.select(*WORK_FIELDS, *[c for c in raw.columns if c == "ingest_seq"])


def limit_works(raw: DataFrame, n: int | None) -> DataFrame:
    """A development cap; ``None`` keeps every record."""
    return raw if n is None else raw.limit(n)


def load_table(spark: SparkSession, folder: str, table: str,
               years: tuple[int, int] | None = None) -> DataFrame:
    """A stored table; only the folders of the years in the range are read."""
    stored = spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")
    df = stored.select(*[field.split(" ")[0] for field in TABLES[table].split(", ")])
    return df if years is None else df.where(F.col(YEAR_COLUMN[table]).between(*years))
