r"""Secret scans with an incremental blob ledger, in SQL functions only.

Every version of a text is addressed by its content. The ledger says which pairs of blob and rule
version have been scanned; a scan takes the others only, each blob once, and its findings are
joined back to all paths that hold the blob.

A rule's matches are leftmost and don't overlap. Their places come from the text's parts between
matches: a match starts after all parts and matches before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylane.llm import bloom
from quarrylane.llm.common import attach, scratch, stash, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. With ``least``, matches whose last group is shorter are dropped."""

    kind: str
    pattern: str
    least: int = 0
    #: A text without this string has no match.
    hint: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(f'{self.pattern} {self.least}'.encode()).hexdigest()[:12]}"


#: Kinds in the order in which spans of one start are listed. Runs of a class that are too short
#: can't hold a longer one, so the lengths of access and hex are part of the pattern.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE = ("assign", "access", "hex")

FOUND = T.StructType([T.StructField("blob", T.StringType()), T.StructField("version", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SCANNED = T.StructType([T.StructField("blob", T.StringType()), T.StructField("versions", T.ArrayType(T.StringType()))])


class Ledger:
    """Two Parquet tables in a shared folder: what was scanned, and what was found.

    Findings are written first; a run that dies between the two is repeated, and reading drops what
    was then found twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing was scanned yet

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        return only(self._read("findings", FOUND)).distinct()

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, version, start, end of each match in (blob, text, todo): todo lists rule versions.

    Places count code points from 0; ends are exclusive.
    """

    def matches(rule: Rule) -> Column:
        due = F.array_contains("todo", rule.version)
        if rule.hint:
            due = due & F.contains(F.col("text"), F.lit(rule.hint))
        found = F.regexp_extract_all(F.col("text"), F.lit(rule.pattern), F.lit(0))
        return F.struct(F.lit(rule.version).alias("version"), F.when(due, found).alias("found"))

    # the generator keeps the extraction from being done again below a filter
    each = blobs.select("blob", "text", F.explode(F.array(*[matches(r) for r in rules])).alias("r"))
    each = each.select("blob", "text", "r.version", "r.found").filter(F.size("found") > 0)
    gaps = F.coalesce(*[F.when(F.col("version") == r.version, F.split("text", r.pattern, -1)) for r in rules])

    def passes(match: Column) -> Column:
        out = F.lit(True)
        for r in rules:
            if r.least:
                value = F.regexp_extract(match, r.pattern, 2)
                out = F.when(F.col("version") == r.version, F.length(value) >= r.least).otherwise(out)
        return out

    shape = F.transform("found", lambda m: F.struct(F.length(m).alias("n"), passes(m).alias("ok")))
    parts = each.select("blob", "version", F.arrays_zip(F.transform(gaps, F.length).alias("gap"), shape.alias("match")).alias("parts"))
    rows = parts.select("blob", "version", F.posexplode("parts").alias("at", "p")).select("blob", "version", "at", F.col("p.gap").alias("gap"), F.col("p.match.n").alias("n"), F.col("p.match.ok").alias("ok"))
    upto = Window.partitionBy("blob", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(upto)
    return rows.withColumn("end", end).filter("n is not null and ok").select("blob", "version", (F.col("end") - F.col("n")).alias("start"), "end")


def scan(versions: DataFrame, ledger: Ledger, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks and add it; return path and blob of every version (null: empty).

    Rows whose blob can neither be repeated nor be in the ledger are scanned where they are; a
    Bloom filter finds them. Only the others shuffle, to be compared with the ledger and scanned
    once for each blob.
    """
    return _scan(versions, ledger, path_col, text_col, rules)[0]


def _filter(paths: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Keeps rows of the ledger whose blob may be one of these; the rest of its history never shuffles."""
    log2 = bloom.log_bits(paths.count())
    bitmaps = bloom.build(paths.select(F.xxhash64("blob").alias("key")), "key", log2)
    return lambda rows: bloom.flag(rows, F.xxhash64("blob"), bitmaps, log2, "maybe").filter("maybe").drop("maybe")


def _scan(versions: DataFrame, ledger: Ledger, path_col: str, text_col: str, rules: tuple[Rule, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """What scan gives, and the filter of ledger rows."""
    all_rules = F.array(*[F.lit(r.version) for r in rules])
    texts = versions.select(F.col(path_col).alias("path"), text_of(text_col).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = stash(texts.select("path", "blob"), "paths")
    only = _filter(paths)
    seen = only(ledger.scanned()).select("blob", F.explode("versions").alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
    seen = stash(seen, "seen")
    known = paths.select("blob").unionAll(seen.select("blob"))
    log2 = bloom.log_bits(known.count())
    bitmaps = bloom.build(known.select(F.xxhash64("blob").alias("key")), "key", log2, at_least=2)
    flagged = bloom.flag(texts, F.xxhash64("blob"), bitmaps, log2, "maybe")

    alone = flagged.filter(~F.col("maybe")).select("blob", "text", all_rules.alias("todo"))
    shared = flagged.filter("maybe").groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left")
    shared = shared.select("blob", "text", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
    done = paths.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>"))).alias("versions")).filter(F.size("versions") > 0)
    done = stash(done, "scanned")
    ledger.add(spans(alone.unionByName(shared), rules), done)
    return paths, only


def report(versions: DataFrame, folder: str | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob.

    ``folder`` holds the ledger (none: a new one). A null text is empty and has no spans; versions
    that repeat a blob share its findings; an empty table gives no rows and leaves the ledger as it
    was. ``spans`` has kind:start:end by start, then kind as listed in ``rules``, comma-joined;
    ``base_sha256`` is the digest of those of the base kinds alone.
    """
    spark = versions.sparkSession
    ledger = Ledger(spark, folder or scratch(spark, "ledger"))
    paths, only = _scan(versions, ledger, path_col, text_col, rules)
    place = F.coalesce(*[F.when(F.col("version") == r.version, F.lit(i)) for i, r in enumerate(rules)])
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("place") + 1)
    found = ledger.findings(only).withColumn("place", place).filter("place is not null").withColumn("kind", kind)
    each = F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("each")
    blobs = found.groupBy("blob").agg(each, *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform(F.filter("each", lambda s: s["kind"].isin(*BASE)), name), ",")
    blobs = blobs.select("blob", *[f"n_{k}" for k in BASE], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("each", name), ",").alias("spans"))
    # a blob may have very many paths
    counts = paths.groupBy("blob").agg(F.count("*").alias("n_paths"))
    blobs = stash(counts.join(blobs, "blob", "left"), "findings")
    out = attach(paths, blobs, "blob", "n_paths", max(1, paths.count()))
    return out.select(
        F.col("path").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
