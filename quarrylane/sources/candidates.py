"""Candidate tables: CSV files with drifting headers, and Markdown pipe tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The unified columns, and the names that files use for them: fixed values.
UNIFIED = {
    "id": ("string", ("id",)),
    "p": ("double", ("p", "p_first_usd_30d", "p_first_usd_30d_estimate")),
    "ceiling_usd": ("decimal(18,4)", ("ceiling", "month6_ceiling_usd", "ceiling_m6_usd", "ceiling_m6_usd_estimate")),
    "hours_week": ("double", ("hours", "owner_hours_week", "owner_h_week", "owner_h_week_estimate")),
    "days_to_first": ("int", ("days", "days_to_first_usd")),
    "time_to_first": ("string", ("time_to_first_usd",)),
    "crypto_payout": ("string", ("crypto_payout",)),
    "it_park": ("string", ("it_park",)),
    "score_stored": ("double", ("score",)),
}


#: Columns without which a file is of no layout known here.
REQUIRED = ("id", "p", "ceiling_usd", "hours_week")


def read_candidates(spark: SparkSession, *paths: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """All files under one schema, by column name; source_note is the file's name.

    A file that has none of the known names of a required column is refused. Other columns that it
    lacks are null, and so is a cell that isn't of the column's type.
    """
    frames = []
    for path in paths:
        raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
        have = {c.lower(): c for c in raw.columns}
        columns = []
        if missing := [r for r in required if not any(k in have for k in UNIFIED[r][1])]:
            raise ValueError(f"{path}: no column for {', '.join(missing)} in {raw.columns}")
        for name, (kind, known) in UNIFIED.items():
            own = next((have[k] for k in known if k in have), None)
            columns.append((F.col(f"`{own}`").try_cast(kind) if own else F.lit(None).cast(kind)).alias(name))
        frames.append(raw.select(F.lit(path.rsplit("/", 1)[-1]).alias("source_note"), *columns))
    return reduce(DataFrame.unionByName, frames)


def write_candidates(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_pipe_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Markdown pipe tables, also of indented ones: file, line text and cells.

    Separator lines are dropped; header lines stay, as only the reader knows which table it wants.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line"))
    rows = lines.filter(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.withColumn("cells", cells)


def table_with(rows: DataFrame, id_pattern: str, *names: str) -> DataFrame:
    """Rows whose first cell is an id of that pattern, with as many cells as there are names."""
    fits = (F.size("cells") == len(names)) & F.element_at("cells", 1).rlike(id_pattern)
    return rows.filter(fits).select(*[F.element_at("cells", i + 1).alias(n) for i, n in enumerate(names)])


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Verification records of Markdown files: id, lens, verdict, p, ceiling_usd, evidence, sources.

    A record starts with a third-level heading "id · lens — verdict" and ends at the next heading. Its first block of
    bullets has the figures: the label (what stands before the colon) that names P( has the probability,
    the one for month 6 ("6-") the ceiling; what isn't a number there, as None, is null. Numbered
    lines are its evidence, in order. Bullets after the first block are its sources: their bracketed
    labels, first address and text.
    """
    text = spark.read.text(path, wholetext=True)
    records = text.select(F.explode(F.slice(F.split("value", r"(?m)^(?=#{2,3} )"), 1, 1 << 30)).alias("r")).filter(F.col("r").rlike(r"\A### [A-Z]+-?\d+ · "))
    head = lambda i: F.regexp_extract("r", r"\A### ([A-Z]+-?\d+) · (.*?) — ([a-z_]+)\s", i)
    figures = F.regexp_extract("r", r"\A[^\n]*\n\s*((?:- [^\n]*(?:\n|\z))+)", 1)
    bullet = lambda mark: F.regexp_extract(figures, rf"(?m)^- [^:\n]*{mark}[^:\n]*:[  ]*([0-9][0-9  ]*(?:\.[0-9]+)?)\s*$", 1)
    number = lambda c: F.regexp_replace(c, "[  ]", "").try_cast("double")
    evidence = F.regexp_extract_all("r", F.lit(r"(?m)^\d+\. (.+)$"), F.lit(1))
    rest = F.substring(F.col("r"), F.position(figures, "r") + F.length(figures), F.length("r"))
    source = lambda x: F.struct(F.transform(F.regexp_extract_all(F.regexp_extract(x, r"^((?:\[[^\]]*\]\s*)*)", 1), F.lit(r"\[([^\]]*)\]"), F.lit(1)), F.lower).alias("labels"), F.nullif(F.regexp_extract(x, r"(https?://[^\s)>]+)", 1), F.lit("")).alias("url"), x.alias("text"))
    sources = F.transform(F.regexp_extract_all(rest, F.lit(r"(?m)^- (.+)$"), F.lit(1)), source)
    return records.select(head(1).alias("id"), head(2).alias("lens"), head(3).alias("verdict"), number(bullet(r"P\(")).alias("p"), number(bullet(r"6-")).alias("ceiling_usd"), evidence.alias("evidence"), sources.alias("sources")).filter("id <> ''")
