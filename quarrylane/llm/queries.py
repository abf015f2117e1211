"""The driver's queries for these operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import audit, bpe, dedup, mixing, neardup, packing, quality, secrets, tokens, toxicity, trie, urls, warc
from quarrylane.llm.common import table
from quarrylane.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_documents(table(spark, sf_dir, "documents"), width=4, threshold=(80, 100))


ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
links AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT n.doc_id, n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = n.doc_id
"""


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_copies(table(spark, sf_dir, "documents")).drop("n_chars")


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source").withColumn("expected", F.round("expected", 6)).withColumn("target", F.round("target", 6))


def _mix_sql() -> str:
    most, passes = mixing.MOST_COPIES, []
    for k in range(1, mixing.PASSES + 1):
        before = f"p{k - 1}"
        passes.append(f"""
c{k} AS (SELECT *, CASE WHEN fit THEN sum(CASE WHEN fit THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE UNBOUNDED PRECEDING) END AS upto
  FROM (SELECT *, rank IS NOT NULL AND NOT taken_more AND size <= room AS fit FROM {before})),
p{k} AS (SELECT * EXCLUDE (fit, upto, taken_more, room, wanted), taken_more OR coalesce(upto <= wanted, false) AS taken_more,
  wanted - coalesce(max(upto) FILTER (upto <= wanted) OVER s, 0) AS room, wanted - coalesce(max(upto) FILTER (upto <= wanted) OVER s, 0) AS wanted FROM c{k} WINDOW s AS (PARTITION BY source))""")
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('10:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) * pow(2.0::DOUBLE, -52) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, {most}.0::DOUBLE * source_size AS cap, (sum(source_size) OVER () - coalesce(sum({most}.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS unit
  FROM s WINDOW b AS (ORDER BY {most}.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(unit, cap / w) FROM r WHERE cap >= unit * w) * w, cap)) AS target FROM r),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
y AS (SELECT z.source, size, (target - {most} * (source_size - sum(n * size) OVER o)) / sum(n * size * sqrt(sqrt(size))) OVER o AS try
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY z.source ORDER BY size)),
price AS (SELECT source, arg_max(try, size) FILTER (try * sqrt(sqrt(size)) <= {most}) AS price FROM y GROUP BY source),
e AS (SELECT d.*, source_size, target, CASE WHEN size > 0 THEN least({most}.0::DOUBLE, coalesce(price * sqrt(sqrt(size)), {most}.0::DOUBLE)) ELSE 0.0::DOUBLE END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN price ON d.source IS NOT DISTINCT FROM price.source),
f AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
g AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS ratio FROM f),
p0 AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN ratio / (1 + ratio) END AS rank, false AS taken_more, 'inf'::DOUBLE AS room, target - sum(whole * size) OVER (PARTITION BY source) AS wanted FROM g),{",".join(passes)}
SELECT doc_id, size, source_size, round(target, 6) AS target, round(expected, 6) AS expected, whole + taken_more::BIGINT AS copies, (whole + taken_more::BIGINT) * size AS taken FROM p{mixing.PASSES}
"""


ORACLES["op10_mix_sources"] = _mix_sql()


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    kinds = []
    for place, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        ok = f"length(regexp_extract(found[i], '{pattern}', 2)) >= {r.least}" if r.least else "true"
        kinds.append(f"""
  SELECT doc_id, {place} AS place, '{r.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(found) + 1), lambda i: struct_pack(
    s := list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0), n := length(found[i]), ok := {ok})), lambda m: m.ok)) AS m
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM t) WHERE len(found) > 0""")
    name = "kind || ':' || s || ':' || e"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, place, kind, m.s::BIGINT AS s, (m.s + m.n)::BIGINT AS e FROM ({" UNION ALL ".join(kinds)})),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({name}, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg({name}, ',' ORDER BY s, place) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


ORACLES["op1_secret_scan"] = _secrets_sql()


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled(spark))
    return urls.judge(table(spark, sf_dir, "pages"), model).drop("score")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op6_legacy_archives"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT page_id, n, d, first_value(page_id) OVER w AS lead, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY d ORDER BY page_id NULLS LAST))
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN lead END AS refers_to
FROM f
"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_trie"] = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: list_transform(range(8), lambda b: (ascii(s) >> b::INT) & 1)))),
  lambda a, x: xor(a >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT) % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, turn, 0 AS own, pos FROM c JOIN t ON t.conv_id = c.conv_id - (c.conv_id % 5 + 5) % 5 AND pos <= h UNION ALL SELECT c.conv_id, turn, 1, pos FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS (SELECT conv_id, coalesce(list(turn ORDER BY own, pos) FILTER (turn IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
q AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM l),
p AS (SELECT conv_id, n, depth, CASE WHEN depth = 0 THEN '' ELSE sha256(turns[1:depth]::VARCHAR) END AS here, CASE WHEN depth = 1 THEN '' WHEN depth > 1 THEN sha256(turns[1:depth - 1]::VARCHAR) END AS above,
  coalesce(strlen(turns[depth].text), 0) AS bytes FROM q),
nodes AS (SELECT here, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY here),
kids AS (SELECT above, count(*) AS n_children FROM nodes GROUP BY above),
inside AS (SELECT DISTINCT a.here AS top, b.here FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM inside JOIN nodes USING (here) LEFT JOIN kids ON kids.above = nodes.here GROUP BY top)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.here = x.above LEFT JOIN kids ON kids.above = x.here JOIN sums ON sums.top = x.here
"""


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
v AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM v LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT list_aggregate(list_transform(o, lambda i: chr((65 + i)::INT)), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step, o FROM o),
y AS (SELECT part, filter_order, step, o[step] AS f, (mask >> o[step]::INT) & 1 = 1 AS fails, mask = 1 << o[step]::INT AS alone, n, g, x, list_min(list_transform(range(1, 6), lambda i: CASE WHEN (mask >> o[i]::INT) & 1 = 1 THEN i ELSE 6 END)) AS gone FROM m, s),
z AS (SELECT part, filter_order, step, f, sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN gone = step THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM z
"""
