"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import audio, langid, line_dedup, mixing, pii, pq_dedup, quality_fm, sentencepiece_bpe, simhash, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = sentencepiece_bpe.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[F.col(f"url_judgement.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def _trained_by_hand() -> tuple[list[float], float]:
    """The regression's weights by plain loops in the primal form: the constants of the SQL below."""
    import math
    from collections import Counter

    rows = []
    for url, y in url_filter.labelled():
        rest = url.split("://", 1)[1]
        text = f"^{rest.split('#')[0].split('?')[0]}$"
        codes, found = [ord(c) for c in text], set()
        for n in url_filter.ORDERS:
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 131 + c) % 1000003
                found.add(h % url_filter.BUCKETS)
        rows.append((sorted(found), y))
    count = Counter(b for found, _ in rows for b in found)
    idf = {b: math.log(len(rows) / n) for b, n in count.items()}
    weights, bias = [0.0] * url_filter.BUCKETS, 0.0
    for _ in range(url_filter.STEPS):
        errors = [y - 1 / (1 + math.exp(-(bias + sum(weights[b] * idf[b] for b in found) / math.sqrt(len(found))))) for found, y in rows]
        shrink = 1 - url_filter.RATE * url_filter.PENALTY
        weights, bias = [w * shrink for w in weights], bias * shrink + url_filter.RATE * url_filter.BIAS**2 * sum(errors)
        for (found, _), e in zip(rows, errors, strict=True):
            for b in found:
                weights[b] += url_filter.RATE * e * idf[b] / math.sqrt(len(found))
    return [w * idf.get(b, 0.0) for b, w in enumerate(weights)], bias


def op2_sql() -> str:
    weights, bias = _trained_by_hand()
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    grams = " || ".join(f"list_transform(range(1, greatest(1, len(c) - {n - 2})), lambda i: list_reduce(list_prepend(CAST({n} AS BIGINT), c[i:i + {n - 1}]), lambda h, x: (h * 131 + x) % 1000003) % {url_filter.BUCKETS})" for n in url_filter.ORDERS)
    return f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
w AS (SELECT CAST(string_split('{",".join(f"{x:.9g}" for x in weights)}', ',') AS DOUBLE[]) AS w),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM a),
f AS (SELECT page_id, arg_min(rule_host || rule_path, (-length(rule_host || rule_path), rule_host || rule_path)) AS rule, arg_min(rule_verdict, (-length(rule_host || rule_path), rule_host || rule_path)) AS rule_verdict
      FROM b JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
c AS (SELECT page_id, list_transform(range(1, length(s) + 1), lambda i: CAST(unicode(substr(s, i, 1)) AS BIGINT)) AS c FROM (SELECT page_id, '^' || host || lower(path) || '$' AS s FROM b)),
g AS (SELECT page_id, list_distinct({grams}) AS g FROM c),
m AS (SELECT page_id, {bias:.12g} + coalesce(list_sum(list_transform(g, lambda x: w[x + 1])), 0) / sqrt(greatest(len(g), 1)) AS margin FROM g, w)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN margin >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN f USING (page_id) JOIN m USING (page_id)
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.round("__mix_target", 6).alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM s WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), source IS NULL, source)),
f AS (SELECT min_by(level, source_size / CAST(weight AS DOUBLE)) AS fixed FROM l WHERE level * weight < source_size * 2.0),
t AS (SELECT source, source_size, CASE WHEN fixed IS NULL OR fixed * weight >= source_size * 2.0 THEN source_size * 2.0 ELSE fixed * weight END AS target,
        CASE WHEN source_size = 0 THEN 0.0 WHEN fixed IS NULL OR fixed * weight >= source_size * 2.0 THEN 2.0 ELSE CAST(fixed * weight AS DOUBLE) / source_size END AS rate
      FROM l, f)
SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target,
  size * CAST(floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.describe(audio.store(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.sha2("tensors", 256).alias("tensors_sha256"), "feature")


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.id_remainder(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.aggregate("__line_spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    return line_dedup.dedup_lines(docs).select("doc_id", F.coalesce(spans, F.lit(0)).alias("lines_removed"), "text")


OP7_SQL = r"""
WITH l AS (SELECT doc_id, p, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(13)) AS h, row_number() OVER o AS q, CAST(sum(w) OVER o AS BIGINT) AS upto, CAST(sum(w) OVER o AS BIGINT) - w AS before
      FROM l WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT a.doc_id, a.q AS s, min(b.q) AS t FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.upto >= a.before + 40 AND b.q >= a.q GROUP BY ALL
      UNION SELECT b.doc_id, max(a.q) AS s, b.q AS t FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.upto >= a.before + 40 AND b.q >= a.q GROUP BY b.doc_id, b.q),
k AS (SELECT r.doc_id, s, t, list(h ORDER BY q) AS run FROM r JOIN f ON r.doc_id = f.doc_id AND f.q BETWEEN s AND t GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM k),
x AS (SELECT DISTINCT f.doc_id, f.p, f.q FROM g JOIN f ON g.doc_id = f.doc_id AND f.q BETWEEN g.s AND g.t WHERE nth > 1),
m AS (SELECT l.doc_id, l.p, l.line, CASE WHEN l.w > 0 THEN x.p IS NOT NULL ELSE
        coalesce(last_value(CASE WHEN l.w > 0 THEN x.p IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.p), false)
        AND coalesce(first_value(CASE WHEN l.w > 0 THEN x.p IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) END AS gone
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.p = x.p)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count_if(gone) AS n, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id) USING (doc_id)
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="op9")
    return masked.select("doc_id", F.size("__pii_kinds").alias("n_replaced"), F.array_join("__pii_kinds", ",").alias("kinds"), "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (langid.id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    scored = quality_fm.predict(docs.select("doc_id", held_out, "n_chars", "text"), quality_fm.fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_urls": op2_urls,
    "op3_mixing": op3_mixing,
    "op4_audio": op4_audio,
    "op5_embedding": op5_embedding,
    "op6_language": op6_language,
    "op7_lines": op7_lines,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
}


def __getattr__(name: str) -> dict[str, str]:
    """ORACLE is made when it is asked for: the SQL of operator 2 holds the weights, which plain Python trains for it."""
    if name != "ORACLE":
        raise AttributeError(name)
    return {"op2_urls": op2_sql(), "op3_mixing": OP3_SQL, "op7_lines": OP7_SQL}
