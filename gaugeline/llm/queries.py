"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe, centroids, decontaminate, html_text, importance, lm_score, media, mixing, near_dup, quality, token_files, url_filter, warc

#: The rules of the contract, and the patterns of this operator's own for hosts that advertise.
HOST_RULES = [url_filter.HostRule(*x) for x in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]
PATTERN_RULES = [url_filter.PatternRule(x, "block") for x in ("*casino-win.*", "*cheap-pills.*")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), HOST_RULES, PATTERN_RULES)


OP1_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE WHEN host LIKE '%casino-win.%' THEN '*casino-win.*' WHEN host LIKE '%cheap-pills.%' THEN '*cheap-pills.*' END AS pat FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pat IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN pat END AS pattern FROM r
"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3))::INT AS d1, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 4, 3))::INT AS d2 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
l AS (SELECT *, 3.0::DOUBLE * source_size AS stop, 3.0::DOUBLE * source_size / weight AS level FROM k),
o AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS if_open
    FROM l WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(stop, coalesce((SELECT arg_min(if_open, level) FROM o WHERE if_open <= level), level) * weight) AS target FROM o),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
h AS (SELECT source, d1, sum(size) AS size FROM d GROUP BY source, d1),
hb AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY d1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h),
e AS (SELECT w.source, max(hb.d1) AS d1, arg_max(hb.below, hb.d1) AS below FROM w JOIN hb ON w.source IS NOT DISTINCT FROM hb.source AND hb.below <= w.target - w.whole * w.source_size GROUP BY w.source),
g AS (SELECT w.*, e.d1, w.target - w.whole * w.source_size - e.below AS rest FROM w JOIN e ON w.source IS NOT DISTINCT FROM e.source),
h2 AS (SELECT d.source, d.d2, sum(d.size) AS size FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.d1 = g.d1 GROUP BY d.source, d.d2),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY d2 ROWS UNBOUNDED PRECEDING) AS upto FROM h2),
c AS (SELECT g.source, g.source_size, g.target, g.whole, g.d1, coalesce(max(CASE WHEN upto - rest <= rest - (upto - size) THEN d2 + 1 END), 0) AS d2
    FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source GROUP BY ALL)
SELECT d.doc_id, d.size, c.source_size, c.target,
  (d.size * least(c.whole + CASE WHEN d.d1 < c.d1 OR (d.d1 = c.d1 AND d.d2 < c.d2) THEN 1 ELSE 0 END, 3))::BIGINT AS taken, d.source
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.class_ids(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str = token_files.TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_rows(spark, table(spark, sf_dir, "documents"), tokenizer_file()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), lm_score.training(F.col("doc_id")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels"), learn_from=~quality.held_out(F.col("doc_id"))))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents"))).drop("reason")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM head THEN head END AS refers_to FROM g
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP11_SQL = r"""
WITH steps AS (SELECT i AS byte, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS code FROM range(256) t(i)),
codes AS (SELECT list(code ORDER BY byte) AS code FROM steps),
said AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 'corpus' AS side, row_number() OVER () AS r FROM documents
  UNION ALL SELECT NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 'target', -row_number() OVER () FROM benchmark),
grams AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM said),
kinds AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
crcs AS (SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(code[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM kinds, codes),
hits AS (SELECT side, r, bucket FROM grams JOIN crcs USING (gram)),
counts AS (SELECT bucket, count(*) FILTER (side = 'corpus') AS s, count(*) FILTER (side = 'target') AS t FROM hits GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM hits JOIN gain USING (bucket) WHERE side = 'corpus' GROUP BY r),
scored AS (SELECT doc_id, r, coalesce(len(w), 0) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM said LEFT JOIN weights USING (r) WHERE side = 'corpus'),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("centroid_sha256", centroids.digest(F.col("centroid"))).drop("centroid")


def _op12_sql(rounds: int = centroids.ROUNDS) -> str:
    """A CTE for each step of each round."""
    at = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = lambda centroids: f"SELECT r, arg_min(n, d * 64 + n) AS n, min(d)::BIGINT AS d FROM (SELECT r, n, {at}::BIGINT AS d FROM v, {centroids}) GROUP BY r"
    steps = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS n, v AS c FROM v QUALIFY n < 16)",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS ({near(f'c{k}')})",
            f"s{k} AS (SELECT n, i, sum(v[i])::HUGEINT AS s, count(*) AS m FROM a{k} JOIN v USING (r), range(1, 65) t(i) GROUP BY n, i)",
            f"u{k} AS (SELECT n, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS c FROM s{k} GROUP BY n)",
            f"c{k + 1} AS (SELECT n, coalesce(u{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN u{k} USING (n))",
        ]
    steps.append(f"last AS ({near(f'c{rounds}')})")
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps) + f"""
SELECT vec_id, n::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY n)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256 FROM last JOIN v USING (r) JOIN c{rounds} USING (n)"""


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer_file()
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), file), file)
    n_tokens = (F.length("ids") / 4).cast("long")
    return rows.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op6_lm_score": op6_lm_score,
    "op5_decontaminate": op5_decontaminate,
    "op2_near_duplicates": op2_near_duplicates,
    "op4_html_text": op4_html_text,
    "op10_warc": op10_warc,
    "op3_token_files": op3_token_files,
    "op9_media": op9_media,
    "op7_quality": op7_quality,
    "op1_url_filter": op1_url_filter,
    "op8_mix_sources": op8_mix_sources,
    "op11_importance": op11_importance,
    "op12_centroids": op12_centroids,
    "op13_bpe": op13_bpe,
}
SQL = {"op10_warc": OP10_SQL, "op1_url_filter": OP1_SQL, "op8_mix_sources": OP8_SQL, "op11_importance": OP11_SQL, "op12_centroids": _op12_sql()}
