"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thawline.llm import decontam, htmltext, jaccard, knn, langid, merkle, mixing, neardup, secrets, spelling, suffixes, tokenfiles, toxicity
from thawline.llm.common import bucket_of, shared_dir, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    profiles = langid.learn_profiles(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    found = langid.identify(rows, profiles)
    return found.select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: toxic, else high or low by quality."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", kind.alias("domain"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, domains_of(table(spark, sf_dir, "labels")), {"high": 0.95, "low": 0.04, "toxic": 0.01}, keep_text=False)
    p = {f"p_{d}": F.element_at("posterior", i + 1) for i, d in enumerate(("high", "low", "toxic"))}
    return out.withColumns(p).select("doc_id", "source", "n_tokens", *p, "rate", (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, keep_text: bool = False) -> DataFrame:
    """Columns of ``docs`` with score and predicted; learned from labels whose crc32(doc_id) mod 3 isn't 1."""
    labels = toxicity.may_learn(table(spark, sf_dir, "labels"), bucket_of("doc_id", 3) != 1)
    return toxicity.score(docs, toxicity.fit(docs, labels), keep_text=keep_text)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    scored = toxicity_scores(spark, docs.select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/thawline/{uuid.uuid4().hex}/tokens.orc"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfiles.token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", spelling.UPPER, spelling.LOWER)
    tampered = F.when(bucket_of("doc_id", 3) == 0, merkle.leaf([lowered if c == "text" else F.col(c) for c in columns]))
    found = merkle.manifest(table(spark, sf_dir, "documents"), columns, changed=tampered)
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_main_text": op5_main_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_top_k": op10_top_k,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a value as text, but for the last complement.
CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST({0} AS VARCHAR), '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(words) < 10 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 9], ' ') FOR i IN range(1, len(words) - 8)] END) AS x, least(len(words), 10) AS m FROM b WHERE len(words) > 0
), ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, unnest([{{'x': array_to_string(words[i:i + m - 1], ' '), 'i': i}} FOR i IN range(1, len(words) - m + 2)], recursive := true)
  FROM d, ms WHERE len(words) >= m
), h AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (x, m)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
""",
    "op2_language_id": rf"""
WITH d AS (SELECT doc_id, lang, text, xor({CRC32.format('doc_id')}, 4294967295) % 4 = 2 AS held_out FROM documents),
w AS (SELECT doc_id, lang, held_out, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM d WHERE text IS NOT NULL),
wn AS (SELECT doc_id, lang, held_out, w, count(*) AS m FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, held_out, m, unnest(list_concat([w[i:i] FOR i IN range(1, len(w) + 1)], ['_' || w[1:1], w[-1:] || '_'], [w[i:i + 1] FOR i IN range(1, len(w))],
  CASE WHEN len(w) = 1 THEN ['_' || w || '_'] ELSE list_concat(['_' || w[1:2], w[-2:] || '_'], [w[i:i + 2] FOR i IN range(1, len(w) - 1)]) END)) AS g FROM wn),
n AS (SELECT doc_id, lang, held_out, g, list_reduce([CASE c WHEN '_' THEN 1 ELSE CAST(unicode(c) AS BIGINT) END FOR c IN string_split(g, '')], lambda a, b: a * 2097152 + b) AS k, sum(m) AS n FROM g GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, any_value(k)) - 1 AS r FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY r < 400),
t AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) - 1 AS r FROM n QUALIFY r < 400),
a AS (SELECT doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 400 ELSE abs(p.r - t.r) END) AS away, count(*) AS m FROM t CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = t.g GROUP BY ALL),
s AS (SELECT doc_id, min_by(lang, {{'a': away, 'l': lang}}) AS lang, max(1 - away / (400.0::DOUBLE * m)) / sum(1 - away / (400.0::DOUBLE * m)) AS score FROM a GROUP BY doc_id)
SELECT d.doc_id, held_out, coalesce(s.lang, 'und') AS lang_pred, round(coalesce(score, 0.0), 6) AS score FROM d LEFT JOIN s USING (doc_id)
""",
    "op3_suffix_dedup": rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest([{{'x': md5(array_to_string(words[i:i + 49], ' ')), 'start': i - 1}} FOR i IN range(1, len(words) - 48)], recursive := true)
  FROM w WHERE len(words) >= 50
), g AS (SELECT x, min(doc_id) AS first_doc_id FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
k AS (SELECT doc_id, start, first_doc_id, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 0 ELSE 1 END AS new FROM s JOIN g USING (x)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM k)
SELECT doc_id, CAST(min(start) AS INT) AS start_word, CAST(max(start) + 50 AS INT) AS end_word, CAST(max(start) + 50 - min(start) AS INT) AS n_words, min(first_doc_id) AS first_doc_id
FROM i GROUP BY doc_id, span
""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w
), e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.shingles) + len(q.shingles) - n)
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM s JOIN r ON r.a = s.doc_id GROUP BY ALL
""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), r AS (
  SELECT doc_id, {LOWER.format("run")} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL)
), d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, list_transform(flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END FOR c IN string_split(doc_id || ':' || run, '')]), lambda x: CAST(x AS BIGINT)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h FROM b, t),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), g AS (
  SELECT word, n, unnest([{{'k': word, 'kind': 1}}] || [{{'k': substr(word, 1, i - 1) || substr(word, i + 1), 'kind': 0}} FOR i IN range(1, length(word) + 1)], recursive := true) FROM w
), s AS (SELECT word, n, unnest([substr(word, 1, i - 1) || '_' || substr(word, i + 1) FOR i IN range(1, length(word) + 1)]) AS k FROM w),
l AS (
  SELECT a.word, b.word AS other FROM s a JOIN s b ON a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word FROM g a JOIN g b ON a.k = b.k AND a.kind = 0 AND b.kind = 1
  UNION SELECT b.word, a.word FROM g a JOIN g b ON a.k = b.k AND a.kind = 0 AND b.kind = 1
), o AS (SELECT l.word, l.other, w.n AS other_n, row_number() OVER (PARTITION BY l.word ORDER BY w.n DESC, l.other) AS r, count(*) OVER (PARTITION BY l.word) AS n_near FROM l JOIN w ON w.word = l.other),
f AS (SELECT w.word, w.n, coalesce(o.n_near, 0) AS n_near, CASE WHEN o.other_n >= 10 * w.n THEN o.other END AS form, CASE WHEN o.other_n >= 10 * w.n THEN o.other_n END AS form_n FROM w LEFT JOIN o ON o.word = w.word AND o.r = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.at WHERE e.form IS NULL
""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE v AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':', '-') AS size, coalesce(text, '') AS text, xor({CRC32.format('doc_id')}, 4294967295) % 3 = 0 AS tampered FROM documents
), d AS (SELECT doc_id, lang, sha256(head || size || text) AS leaf, CASE WHEN tampered THEN sha256(head || size || {LOWER.format("text")}) END AS changed FROM v),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM d)),
p AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf, changed FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
a AS (
  SELECT 0 AS level, tree, pos, n, leaf AS h FROM p
  UNION ALL SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY level, tree, pos // 8, (n + 7) // 8
), sub AS (SELECT tree, level, h FROM a WHERE n = 1),
b AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM g) AS n, h FROM sub
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY level, pos // 8, (n + 7) // 8
), runs AS (
  SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM a WHERE n > 1 GROUP BY ALL
), top AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM b WHERE n > 1 GROUP BY ALL),
step AS (
  SELECT r.tree, r.level, r.run, r.hs FROM runs r
  UNION ALL SELECT s.tree, s.level + t.level, t.run, t.hs FROM sub s JOIN top t ON t.run = s.tree // CAST(pow(8, t.level + 1) AS BIGINT)
), f AS (
  SELECT doc_id, tree, 0 AS level, pos, pos // 8 AS run, leaf, coalesce(changed, leaf) AS h, '' AS proof FROM p
  UNION ALL
  SELECT f.doc_id, f.tree, f.level + 1, q.nxt, q.nxt // 8, f.leaf, q.h, q.proof FROM f JOIN sub ON sub.tree = f.tree JOIN step s ON s.tree = f.tree AND s.level = f.level
    AND s.run = CASE WHEN f.level = sub.level THEN f.tree // 8 ELSE f.run END,
    LATERAL (SELECT CASE WHEN f.level = sub.level THEN f.tree ELSE f.pos END AS here) o,
    LATERAL (SELECT o.here // 8 AS nxt, sha256(array_to_string(s.hs[:o.here % 8] || [f.h] || s.hs[o.here % 8 + 2:], '')) AS h, f.proof || array_to_string(s.hs[:o.here % 8] || s.hs[o.here % 8 + 2:], '') AS proof) q
), last AS (SELECT * FROM f QUALIFY level = max(level) OVER (PARTITION BY doc_id, leaf)),
root AS (SELECT h FROM b WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, last.h AS folded_root, last.h = root.h AS verified FROM last JOIN sub USING (tree), root
""",
    "op13_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
