"""The registered queries of this subpackage, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import (
    decontaminate, fill_middle, hmm, language, mixing, mtree, quality, radix, sharding, simhash, style_tree, url_lists, zone_maps,
)
from spanwise.llm.common import table

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes: sources weigh 5, 2, 1 and share 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


ORACLES["op2_mixing"] = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS size,
    coalesce(CASE WHEN length(text) > 0 THEN 0.05::DOUBLE + 0.95::DOUBLE * (length(translate(text, '{mixing.NOISE}', ''))::DOUBLE / length(text)) END,
      1.0::DOUBLE) AS weight
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((CAST('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), 1, 13)
    AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS k
  FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS position FROM totals),
weighted AS (SELECT *, CASE position % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2.0::DOUBLE * source_size AS cap FROM numbered),
levels AS (
  SELECT *, row_number() OVER fill AS place, cap / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
  FROM weighted
  WINDOW fill AS (ORDER BY cap / w, position), earlier AS (ORDER BY cap / w, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE ratio > level), 0) * w) AS target
  FROM levels),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM aimed),
ordered AS (
  SELECT k.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ASC NULLS LAST, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM ordered"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes along the Hilbert curve of language, source and size."""
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from labelled texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model, names = language.fit(docs.where(language.in_training()))
    return language.predict(docs, model, names).select("doc_id", (~language.in_training()).alias("held_out"), "lang_pred", "score")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents, copied or paraphrased."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector with all others."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op8_mtree"] = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query
def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents by a hidden Markov model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = hmm.score(docs, docs.where(hmm.in_training()))
    return scored.withColumn("held_out", ~hmm.in_training())


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from labels that are not held out."""
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~quality.in_training()).alias("held_out"), "score", "predicted")


@query
def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return style_tree.main_texts(table(spark, sf_dir, "pages"))


@query
def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the list entries that were active when they were fetched; times and entries follow from the pages."""
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge(url_lists.captures_of(pages), url_lists.entries_of(pages))


_HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.+$', ''), '')"
_STEPS = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '')"
ORACLES["op7_url_lists"] = f"""
WITH parsed AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 518400) AS fetched, {_HOST} AS host, {_STEPS} AS steps,
    page_id // 7 AS turn FROM pages),
given AS (
  SELECT CASE WHEN turn % 3 = 0 THEN 'spam' ELSE 'adult' END AS list,
    CASE turn % 4 WHEN 2 THEN 'host' WHEN 3 THEN 'domain' ELSE 'prefix' END AS kind,
    CASE turn % 4 WHEN 2 THEN host WHEN 3 THEN array_to_string(string_split(host, '.')[-3:], '.')
      ELSE host || '/' || array_to_string(steps[1:2], '/') END AS name,
    TIMESTAMP '2024-01-01' + to_days(((turn * 37) % 360)::INTEGER) AS valid_from, turn % 5 >= 2 AS listed
  FROM parsed WHERE page_id % 7 = 0 AND host IS NOT NULL AND len(string_split(host, '.')) >= 3),
folded AS (SELECT list, kind, name, valid_from, bool_and(listed) AS listed FROM given GROUP BY ALL),
spans AS (
  SELECT *, lead(valid_from, 1, TIMESTAMP '9999-12-31') OVER (PARTITION BY list, kind, name ORDER BY valid_from) AS valid_to FROM folded),
names AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS name FROM parsed WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, fetched, 'domain', array_to_string(string_split(host, '.')[n:], '.')
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM parsed WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, url, fetched, 'prefix', host || '/' || array_to_string(steps[1:n], '/')
    FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS n FROM parsed WHERE host IS NOT NULL)),
met AS (
  SELECT n.*, s.list, list_position(['prefix', 'host', 'domain'], n.kind) AS rank FROM names n JOIN spans s
  ON n.kind = s.kind AND n.name = s.name AND s.listed AND s.valid_from <= n.fetched AND n.fetched < s.valid_to),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS hits,
    row_number() OVER (PARTITION BY page_id ORDER BY rank, length(name) DESC, name, list) AS place FROM met)
SELECT p.page_id, p.url, p.fetched, b.page_id IS NULL AS allowed, coalesce(b.hits, 0) AS hits, b.list, b.kind, b.name
FROM parsed p LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (page_id)"""


@query
def op11_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds, with the cost of each cluster."""
    placed, centroids = zone_maps.cluster(table(spark, sf_dir, "embeddings"))
    digests = spark.createDataFrame(
        [(i, zone_maps.centroid_digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    return placed.join(F.broadcast(digests), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ASSIGN = """near{n} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT k.vec_id, k.v, a.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - a.mid[i]) * (k.v[i] - a.mid[i])))::BIGINT AS d,
      row_number() OVER (PARTITION BY k.row ORDER BY d, a.c) AS place FROM kept k, mids{n} a) WHERE place = 1)"""
_MOVE = """mids{n} AS MATERIALIZED (
  SELECT o.c, coalesce(m.mid, o.mid) AS mid FROM mids{p} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS mid FROM (
      SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{p}, range(1, 65) AS r(i) GROUP BY c, i) GROUP BY c) m USING (c))"""
ORACLES["op11_zone_maps"] = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
mids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS mid FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
{", ".join(_ASSIGN.format(n=n) + ", " + _MOVE.format(n=n + 1, p=n) for n in range(3))}, {_ASSIGN.format(n=3)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256 FROM near3 JOIN mids3 USING (c)"""


@query
def op12_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; the largest doc_id stays."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256")
    return radix.exact_copies(table(spark, sf_dir, "documents"), own=[digest])


ORACLES["op12_radix"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for fill-in-the-middle, with digests of the result and of the text rebuilt from it."""
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op13_fill_middle"] = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
numbered AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
cut AS (
  SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
    array_to_string(units[greatest(one, two) + 1:], '') AS suffix FROM numbered)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut"""
