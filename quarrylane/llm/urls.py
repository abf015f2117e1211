"""URL filters: host rules, and logistic regression on hashed character n-grams.

The model learns from the small table of labelled URLs below and judges what no rule fits. All of
it runs in Spark's JVM: SQL functions make the n-grams, Spark ML hashes and scores them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = 1 << 14
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))

#: The labelled table: each host with each path, blocked or not.
BLOCKED_HOSTS = ("casino-win.example.com", "free-bets.example.net", "cheap-pills.example.org", "www.online-casino.test", "poker-bonus.test", "m.adult-cams.test", "buy-viagra-now.test", "lottery-winner.test", "payday-loans.test", "slots-jackpot.test", "hot-singles.test", "replica-watches.test")
ALLOWED_HOSTS = ("www.library.test", "news.city-herald.test", "blog.gardening.example.com", "university.example.org", "docs.software.test", "m.weather.example.net", "museum.test", "www.cooking-recipes.test", "open-data.example.org", "history.test", "therhe.example.com", "ouvi.example.net")
PATHS = ("/", "/en/4033.html", "/de/12", "/fr/7424/", "/es/99.html", "/articles/2021/index.html")
BLOCKED_PATHS = ("/casino/bonus", "/pills/cheap", "/bets/free", "/win/jackpot")
ALLOWED_PATHS = ("/wiki/history", "/news/today", "/about", "/help/contact")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(h: Column, p: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits (equal lengths: the longer host, then code points), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fits = [((h == r.host) | F.endswith(h, F.lit(f".{r.host}"))) & F.startswith(p, F.lit(r.path)) for r in ordered]
    return F.coalesce(*[F.when(f, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for f, r in zip(fits, ordered, strict=True)], F.lit(None).cast("struct<rule:string,verdict:string>"))


def grams(text: Column) -> Column:
    """All character n-grams of SIZES, with marks for the ends."""
    t = F.concat(F.lit("^"), text, F.lit("$"))
    n = F.length(t)

    def of(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(t, i, F.lit(k)))
        return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(k) for k in SIZES])


def featured(urls: DataFrame) -> DataFrame:
    """Adds ``grams``: n-grams of the host and, marked as such, of the path, from host and path."""
    return urls.withColumn("grams", F.concat(grams(F.col("host")), F.transform(grams(F.col("path")), lambda g: F.concat(F.lit("/"), g))))


def labelled(spark: SparkSession) -> DataFrame:
    rows = [(h, p, 1.0) for h, p in product(BLOCKED_HOSTS, PATHS + BLOCKED_PATHS)] + [(h, p, 0.0) for h, p in product(ALLOWED_HOSTS, PATHS + ALLOWED_PATHS)]
    return spark.createDataFrame(rows, "host string, path string, label double")


def train(table: DataFrame, features: int = FEATURES) -> PipelineModel:
    """Logistic regression from (host, path, label 1: block)."""
    counts = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    model = LogisticRegression(regParam=0.01, maxIter=30)
    return Pipeline(stages=[counts, model]).fit(featured(table).coalesce(1))


def judge(pages: DataFrame, model: PipelineModel, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (of the model).

    A null URL, or one without ``://``, has an empty host and path and is judged by the model from
    those. Repeated rows give repeated rows; an empty table gives none.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    scored = model.transform(featured(urls)).withColumn("score", vector_to_array("probability")[1])
    best = best_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(best["verdict"], F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", best["rule"].alias("rule"), verdict.alias("verdict"), "score")
