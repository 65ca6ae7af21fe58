"""One query per operator over its whole table; the digests that the contracts name are derived here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieledger.llm import annsearch, bytepair, collocations, langid, licences, minhash, mixing, packing, periodicity, pii, tokencount, toxicity, vecdedup
from tieledger.sources.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    texts = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.report(docs, licences.fit(docs))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_report(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("y"))
    model = toxicity.fit(docs, known)
    texts = docs.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held_out"))
    scored = toxicity.score(texts, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(docs, pii.fit(docs))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole document before and after two edits that its own text gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = tokencount.counted(docs).withColumn("edits", tokencount.derived_edits(F.col("doc_id"), F.col("text")))
    after = tokencount.recounted(edited)
    return after.select(
        "doc_id",
        F.col("tree.n_chars").cast("long").alias("n_chars"),
        F.col("tree.n_tokens").cast("long").alias("n_tokens"),
        F.size("tree.leaf_tokens").alias("n_leaves"),
        F.size("edits").alias("n_edits"),
        F.col("tree_after.n_chars").cast("long").alias("n_chars_after"),
        F.col("tree_after.n_tokens").cast("long").alias("n_tokens_after"),
        "chars_encoded",
    )


def op11_byte_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_licence_scan": op3_licence_scan,
        "op4_source_mixing": op4_source_mixing,
        "op5_nearest_vectors": op5_nearest_vectors,
        "op6_toxicity": op6_toxicity,
        "op7_personal_data": op7_personal_data,
        "op8_near_vectors": op8_near_vectors,
        "op9_near_documents": op9_near_documents,
        "op10_token_counts": op10_token_counts,
        "op11_byte_pair_codes": op11_byte_pair_codes,
        "op12_collocations": op12_collocations,
        "op13_periodic_runs": op13_periodic_runs,
    }


#: Ends of both: links (x, y) of rows (id) -> the smallest id that links lead to.
_COMPONENTS = "both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach(x, y) AS (SELECT id, id FROM rows_ UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON b.x = reach.y), least AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY 1)"

_NEAR_VECTORS = f"""WITH RECURSIVE rows_ AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: cast(e AS double)) AS v FROM embeddings),
ok AS (SELECT * FROM rows_ WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_sum(list_transform(v, lambda e: e * e)) > 0),
links AS (SELECT DISTINCT a.id AS x, b.id AS y FROM ok a JOIN ok b ON b.label = a.label AND a.id < b.id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93), {_COMPONENTS}
SELECT r.id AS vec_id, (SELECT count(*) FROM links l WHERE l.x = r.id OR l.y = r.id) AS n_links, component_id, component_id = r.id AS kept FROM rows_ r JOIN least USING (id)"""

_NEAR_DOCUMENTS = f"""WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
rows_ AS (SELECT id, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM words WHERE len(w) > 0 UNION ALL SELECT id, [] FROM words WHERE len(w) = 0),
sets AS (SELECT min(id) AS id, hash(list_sort(s)) AS h, any_value(s) AS s, len(any_value(s)) AS n FROM rows_ WHERE len(s) > 0 GROUP BY 2),
each AS (SELECT id, n, unnest(s) AS g FROM sets), pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS both_, any_value(a.n) AS na, any_value(b.n) AS nb FROM each a JOIN each b ON b.g = a.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * both_ >= 75 * (na + nb - both_) UNION SELECT k.id, r.id FROM rows_ r JOIN sets k ON k.h = hash(list_sort(r.s)) WHERE len(r.s) > 0 AND r.id <> k.id), {_COMPONENTS}
SELECT id AS doc_id, len(s) AS n_shingles, component_id, component_id = id AS kept FROM rows_ JOIN least USING (id)"""


_COLLOCATIONS = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL), sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
parts AS (SELECT *, array_to_string(list_slice(w, 1, j), ' ') AS x, array_to_string(list_slice(w, j + 1, k), ' ') AS y FROM found, (VALUES (1), (2)) t(j) WHERE j < k),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, c.w, c.j, l.f AS l, r.f AS r, (1000000 * c.a * c.a) // (l.f * r.f) AS score FROM parts c JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = c.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase FROM found WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer d USING (lang, phrase) WHERE NOT (b.k = 2 AND coalesce(100 * d.a >= 50 * b.a, false))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Those whose whole result SQL can give: by comparing all pairs, or counting all phrases."""
    return {"op8_near_vectors": _NEAR_VECTORS, "op9_near_documents": _NEAR_DOCUMENTS, "op12_collocations": _COLLOCATIONS}
