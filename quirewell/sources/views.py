"""The reading library as views over the driver's tables.

Each function reads what it needs from ``sf_dir``; columns are selected first, so
scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders

BASE_TIME = 1700000000
_indexes: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 10).cast("bigint")
    d = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", n)
    return d.select(
        F.col("source").alias("book_id"),
        F.concat(F.lit("Book "), "source").alias("title"),
        F.concat(F.lit("author"), (F.col("n") % 7).cast("string")).alias("author"),
        F.when(F.col("n") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("cat"), (F.col("n") % 4).cast("string"))).alias("category"),
        (F.col("n") % 3 == 0).alias("finish_reading"),
        F.when(F.col("n") % 5 != 0, BASE_TIME + F.col("n") * 86400).alias("read_update_time"),
        (F.col("n") == 10).alias("is_deleted"),
    )


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return d.select(
        F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("bookmark_id"), F.col("source").alias("book_id"), F.col("lang").alias("chapter_title"),
        F.col("text").alias("mark_text"), (BASE_TIME + F.col("doc_id") * 60).alias("create_time"), (F.col("doc_id") % 17 == 0).alias("is_deleted"),
    )


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    return d.select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("review_id"), F.col("source").alias("book_id"), F.col("lang").alias("chapter_name"),
        F.col("text").alias("content"), (BASE_TIME + F.col("doc_id") * 60).alias("create_time"), (F.col("doc_id") % 19 == 0).alias("is_deleted"),
    )


def all_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights and thoughts in one shape, deleted ones too."""
    h = highlights(spark, sf_dir).select(F.col("bookmark_id").alias("note_id"), F.lit("highlight").alias("note_type"), "book_id", F.col("chapter_title").alias("chapter"), F.col("mark_text").alias("content"), F.col("create_time").alias("created"), "is_deleted")
    t = thoughts(spark, sf_dir).select(F.col("review_id").alias("note_id"), F.lit("thought").alias("note_type"), "book_id", F.col("chapter_name").alias("chapter"), "content", F.col("create_time").alias("created"), "is_deleted")
    return h.unionByName(t)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live notes of live books with the book's title."""
    live = books(spark, sf_dir).where(~F.col("is_deleted")).select("book_id", "title")
    return all_notes(spark, sf_dir).where(~F.col("is_deleted")).drop("is_deleted").join(live, "book_id")


def note_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("note_id"), F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("book_id"), F.when(F.col("vec_id") % 4 == 0, "thought").otherwise("highlight").alias("note_type"), F.col("embedding").alias("vector"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("book_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array("p_type", F.element_at(F.split("p_name", " "), -1)).alias("subjects"))


def intros(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("length(text) >= 40")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("book_id"), F.col("text").alias("description"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = p.count()
    key = F.col("p_partkey")
    return p.select(
        key.alias("page_id"), F.concat("p_name", F.lit("_"), key.cast("string")).alias("raw_title"), F.when(key % 13 == 0, 10).otherwise(0).alias("ns"),
        F.when(key % 4 != 0, (key * 3 + 1) % n).alias("target"), (key + 1000).alias("revision_id"), F.col("p_type").alias("summary"),
    )


def search_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live books as the search index has them."""
    b = books(spark, sf_dir).where(~F.col("is_deleted"))
    n = F.substring("book_id", 4, 10).cast("bigint")
    return b.select("book_id", "title", "author", "category", F.when(n % 3 == 0, F.concat(F.lit("978"), F.lpad(n.cast("string"), 10, "0"))).otherwise("").alias("isbn"), F.coalesce("read_update_time", F.lit(0)).alias("updated"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live imported passages: one of each page, tags blanked."""
    p = table(spark, sf_dir, "pages").where("page_id % 23 <> 0")
    key = F.col("page_id")
    return p.select(
        F.concat(F.lit("w"), key.cast("string")).alias("id"), F.col("url").alias("title"), F.when(key % 3 == 0, F.concat(F.lit("Section "), (key % 7).cast("string"))).otherwise("").alias("heading"),
        F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ").alias("content"), (BASE_TIME + key * 30).alias("updated"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of the benchmark's first words."""
    b, key = table(spark, sf_dir, "benchmark"), F.col("item_id")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    return b.select(
        key.alias("id"), word(1).alias("term"), F.when(key % 3 == 0, "").otherwise(word(2)).alias("canonical_name"), F.array(word(3), F.concat(F.lit("alias"), key.cast("string"))).alias("aliases"), F.col("text").alias("definition"),
        F.when(key % 4 == 0, "encyclopedia").otherwise("manual").alias("source"), F.when(key % 5 == 0, "ignored").when(key % 5 == 1, "pending").otherwise("confirmed").alias("status"),
        (key % 7 == 0).alias("manually_edited"), (BASE_TIME + (key * 37) % 1000).alias("updated_at"),
    )


def index(spark: SparkSession, sf_dir: str, kind: str):
    """The search index of ``notes``, ``books`` or ``sources``, made when it is first asked for and read from then on."""
    from ..operators.search_index import SearchIndex

    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _indexes:
        rows, id_col, fields = {
            "notes": (notes, "note_id", ("title", "chapter", "content")),
            "books": (search_books, "book_id", ("title", "author", "category", "isbn")),
            "sources": (sources, "id", ("title", "heading", "content")),
        }[kind]
        _indexes[key] = SearchIndex.build(rows(spark, sf_dir), folders.work_folder(spark), id_col, fields)
    return _indexes[key]


def indexes(spark: SparkSession, sf_dir: str) -> dict:
    return {k: index(spark, sf_dir, k) for k in ("notes", "books", "sources")}
