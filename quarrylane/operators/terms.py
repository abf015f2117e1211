"""An inverted index: which pages hold a term, and how often. Written once, read by term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index, and pages in a part of a term's list, on average.
FOLDERS, CHUNK_PAGES = 64, 4096
TERM = r"[a-z0-9_]+"


def postings(pages: DataFrame, key: str, text: str, chunks: int | None = None) -> DataFrame:
    """term, folder, chunk, pages (array of key and count, by key), n_pages, n_hits.

    Terms are runs of ASCII letters, digits and underscores, in lower case. A list is cut by a hash of the page into
    ``chunks`` parts (none: one for each CHUNK_PAGES pages), so that no row grows with the number of
    pages. Null texts and keys hold nothing.
    """
    chunks = chunks or -(-pages.count() // CHUNK_PAGES) or 1
    words = F.regexp_extract_all(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({TERM})"), F.lit(1))
    rows = pages.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(words).alias("term"))
    counts = rows.groupBy("term", "key").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")
    lists = counts.groupBy("term", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("pages"), F.count("*").alias("n_pages"), F.sum("n").alias("n_hits"))
    return lists.withColumn("folder", _folder())


def _folder():
    return F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")


def write_index(pages: DataFrame, key: str, text: str, path: str, chunks: int | None = None) -> None:
    """Folders by a hash of the term; within files terms are in order, so that row groups are skipped."""
    lists = postings(pages, key, text, chunks)
    lists.repartition("folder", "chunk").sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(path)


def look_up(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """term, key, n for some terms: only their folders are read, and of these only row groups that may hold them."""
    wanted = spark.createDataFrame([(t.lower(),) for t in terms], "term string").withColumn("folder", _folder())
    folders = sorted({r.folder for r in wanted.collect()})
    index = spark.read.parquet(path)
    found = index.filter(F.col("folder").isin(folders) & F.col("term").isin([t.lower() for t in terms]))
    return found.select("term", F.explode("pages").alias("p")).select("term", "p.*")
