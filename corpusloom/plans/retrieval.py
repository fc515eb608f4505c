"""Queries on chunks, vectors, corrections and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import memory as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as S
from corpusloom.plans.text import PARA_SQL, SPACE, docs
from corpusloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def asked(spark: SparkSession, d: str) -> list[float]:
    """The query vector of these queries: the one of vec_id 0."""
    return list(table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


ASKED = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


@query(
    "chunk_windows",
    rf"""WITH {PARA_SQL}, w AS (SELECT doc_id, para, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS w FROM para),
  t AS (SELECT *, CAST(greatest(30, least(120, floor(sum(len(w)) OVER (PARTITION BY doc_id) / 40))) AS BIGINT) AS width FROM w),
  p AS (SELECT doc_id, para, width, w, unnest(range(0, len(w), width)) AS start FROM t WHERE len(w) >= 8), q AS (SELECT doc_id, para, start // width AS piece, w[start + 1 : start + width] AS p FROM p)
  SELECT doc_id, para, piece, array_to_string(p, ' ') AS chunk FROM q WHERE len(p) >= 8""",
)
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return R.window_chunks(S.paragraphs(docs(spark, d)))


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return R.recursive_chunks(docs(spark, d), ["doc_id"])


@query("chunk_sentences")
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return R.sentence_chunks(S.paragraphs(docs(spark, d)), ["doc_id", "para"])


@query("hash_embeddings")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return R.embed(table(spark, d, "eval_items").select("item_id", "text"))


@query("vector_topk", f"SELECT * FROM (SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {ASKED}))), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {ASKED}) DESC, vec_id LIMIT 10) WHERE score >= 0.3")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    x = R.top_k(table(spark, d, "embeddings"), asked(spark, d), "vec_id", 10, 0.3, "embedding")
    return x.select("vec_id", F.round("score", 6).alias("score"))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_inner_product(CAST(embedding AS DOUBLE[]), " + ASKED + "), 6) AS dot FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(v) for v in asked(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.dot(F.col("embedding"), q), 6).alias("dot"))


@query("distance_similarity", f"SELECT vec_id, round(1 - pow(list_distance(CAST(embedding AS DOUBLE[]), {ASKED}), 2) / 2, 6) AS similarity FROM embeddings")
def distance_similarity(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(v) for v in asked(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(V.distance_similarity(V.squared_distance(F.col("embedding"), q)), 6).alias("similarity"))


@query("threshold_hits", f"SELECT vec_id, label FROM embeddings WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), {ASKED}) >= 0.25")
def threshold_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(R.scores(table(spark, d, "embeddings"), asked(spark, d), "embedding") >= 0.25).select("vec_id", "label")


@query(
    "centroid_similarity",
    """WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), c AS (SELECT label, k, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY 1), u AS (SELECT c.label, k, v / n AS u FROM c JOIN n ON c.label = n.label)
  SELECT a.label AS a, b.label AS b, round(sum(a.u * b.u), 4) AS score FROM u a JOIN u b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2""",
)
def centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    return R.centroid_similarity(table(spark, d, "embeddings"), "label", "embedding")


@query(
    "doc_similarity_bestmatch",
    """WITH u AS (SELECT label, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
  s AS (SELECT a.label AS a, b.label AS b, a.vec_id AS i, b.vec_id AS j, list_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label < b.label),
  r AS (SELECT a, b, avg(m) AS r FROM (SELECT a, b, i, max(s) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2), c AS (SELECT a, b, avg(m) AS c FROM (SELECT a, b, j, max(s) AS m FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT r.a, r.b, round((r + c) / 2, 4) AS score FROM r JOIN c ON r.a = c.a AND r.b = c.b""",
)
def doc_similarity_bestmatch(spark: SparkSession, d: str) -> DataFrame:
    return R.best_match(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("thinned_vectors", "WITH n AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT vec_id, label FROM n WHERE n <= 20 OR i % CAST(ceil(n / 20) AS BIGINT) = 0")
def thinned_vectors(spark: SparkSession, d: str) -> DataFrame:
    return R.thinned(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 20)


@query("metadata_filter", "SELECT id, doc, para_idx FROM mem_chunks WHERE project = 'default' AND kind = 'passage' AND model = 'nomad-64'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mem_chunks").filter("project = 'default' and kind = 'passage' and model = 'nomad-64'").select("id", "doc", "para_idx")


@query(
    "search_passages",
    """WITH v AS (SELECT *, CAST(list_filter(vec, lambda x: x IS NOT NULL) AS DOUBLE[]) AS v FROM mem_chunks WHERE vec IS NOT NULL), g AS (SELECT * FROM v WHERE len(v) = 64 AND len(vec) = 64 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
  q AS (SELECT v AS q FROM g WHERE dim = 64 ORDER BY id LIMIT 1),
  s AS (SELECT kind, doc, para_idx, ref, text[1:700] AS text, id, greatest(0, least(1, list_cosine_similarity(v, q))) AS s FROM g, q),
  b AS (SELECT *, row_number() OVER (PARTITION BY kind, doc, para_idx, ref ORDER BY s DESC, id) AS r FROM s WHERE s >= 0.3)
  SELECT kind, doc, para_idx, ref, text, round(s, 3) AS score FROM b WHERE r = 1 ORDER BY round(s, 3) DESC, doc, para_idx, kind LIMIT 4""",
)
def search_passages(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "mem_chunks")
    q = x.filter((F.col("dim") == 64) & (F.size("vec") == 64) & (V.norm(F.col("vec")) > 0)).orderBy("id").select("vec").first()[0]
    return R.passages(x.filter(V.norm(F.col("vec")) > 0), list(q), 4, 0.3)


@query("unsynced_notes", rf"SELECT DISTINCT id, project, source FROM annotations WHERE length(regexp_replace(coalesce(quote, ''), '^{SPACE}|{SPACE}$', '', 'g')) >= 5 AND id NOT IN (SELECT ref FROM mem_chunks WHERE kind = 'note' AND ref IS NOT NULL)")
def unsynced_notes(spark: SparkSession, d: str) -> DataFrame:
    return R.unsynced_notes(table(spark, d, "annotations"), table(spark, d, "mem_chunks")).select("id", "project", "source").distinct()


@query("documents_to_index", """WITH p AS (SELECT DISTINCT project, doc, para_idx, text FROM mem_chunks WHERE text IS NOT NULL AND doc IS NOT NULL), h AS (SELECT project, doc, sha256(string_agg(text, chr(10) || chr(10) ORDER BY para_idx, text)) AS doc_hash FROM p GROUP BY 1, 2) SELECT project, doc, doc_hash FROM h WHERE substr(doc_hash, 1, 1) NOT IN ('0', '1')""")
def documents_to_index(spark: SparkSession, d: str) -> DataFrame:
    """Those whose hash isn't in the index (here: an index that holds the hashes beginning with 0 or 1)."""
    p = table(spark, d, "mem_chunks").filter("text is not null and doc is not null").select("project", "doc", F.col("para_idx").alias("para"), "text").distinct()
    none = R.to_index(p, spark.createDataFrame([], "project string, doc string, doc_hash string"), ["project", "doc"])
    return R.to_index(p, none.filter("substring(doc_hash, 1, 1) in ('0', '1')"), ["project", "doc"])


@query("without_source", "SELECT id, project, doc FROM mem_chunks m WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.project = m.project AND a.source = m.doc)")
def without_source(spark: SparkSession, d: str) -> DataFrame:
    """The index after deleting the annotated documents."""
    gone = table(spark, d, "annotations").select("project", F.col("source").alias("doc")).distinct()
    return table(spark, d, "mem_chunks").select("id", "project", "doc").join(gone, ["project", "doc"], "left_anti").select("id", "project", "doc")


@query("replaced_rows", "SELECT id, project, doc, 'old' AS state FROM mem_chunks m WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.project = m.project AND a.source = m.doc) UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), project, source, 'new' FROM annotations")
def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "mem_chunks").select("id", "project", "doc", F.lit("old").alias("state"))
    new = table(spark, d, "annotations").select("project", F.col("source").alias("doc"), F.lit("new").alias("state")).distinct()
    return R.replace_rows(old, new, ["project", "doc"])


CORR = "(SELECT DISTINCT correction_id, question, question_embedding, correct_answer FROM corrections WHERE len(question_embedding) = 64)"


@query(
    "correction_lookup",
    f"""WITH c AS {CORR}, q AS (SELECT CAST(question_embedding AS DOUBLE[]) AS q FROM c WHERE list_inner_product(question_embedding, question_embedding) > 0 ORDER BY correction_id LIMIT 1)
  SELECT correction_id, question, correct_answer, round(greatest(0, least(1, list_cosine_similarity(CAST(question_embedding AS DOUBLE[]), q))), 6) AS score FROM c, q WHERE list_cosine_similarity(CAST(question_embedding AS DOUBLE[]), q) >= 0.85 ORDER BY score DESC, correction_id LIMIT 1""",
)
def correction_lookup(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "corrections").select("correction_id", "question", "question_embedding", "correct_answer").distinct()
    ok = x.filter((F.size("question_embedding") == 64) & (V.norm(F.col("question_embedding")) > 0))
    return M.corrected(x, list(ok.orderBy("correction_id").select("question_embedding").first()[0]))


@query("correction_listing", "SELECT correction_id, question, correct_answer FROM (SELECT DISTINCT correction_id, question, correct_answer FROM corrections) ORDER BY correction_id DESC LIMIT 1000")
def correction_listing(spark: SparkSession, d: str) -> DataFrame:
    """The newest 1,000, without their vectors (the store's own limit)."""
    return table(spark, d, "corrections").select("correction_id", "question", "correct_answer").distinct().orderBy(F.desc("correction_id")).limit(1000)


@query("correction_store", "WITH c AS (SELECT DISTINCT correction_id, question FROM corrections), s AS (SELECT * FROM c ORDER BY correction_id DESC LIMIT 1000), n AS (SELECT *, row_number() OVER (ORDER BY correction_id) - 1 AS i FROM s) SELECT correction_id, question FROM n WHERE i <> 3")
def correction_store(spark: SparkSession, d: str) -> DataFrame:
    """The store after all corrections were added and the one at index 3 was deleted."""
    x = table(spark, d, "corrections").select("correction_id", "question").distinct()
    return M.delete_correction(M.add_corrections(M.clear_corrections(x), x), 3)


@query("fewshot_rejects", "SELECT project, task, ihash, id, output_text FROM mem_feedback WHERE lower(action) = 'reject' QUALIFY row_number() OVER (PARTITION BY project, task, ihash ORDER BY id DESC) <= 2")
def fewshot_rejects(spark: SparkSession, d: str) -> DataFrame:
    return M.rejects(table(spark, d, "mem_feedback"))


@query("retention", "SELECT id, project, task FROM mem_feedback QUALIFY row_number() OVER (PARTITION BY project, task ORDER BY id DESC) <= 5")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return M.keep_recent(table(spark, d, "mem_feedback").select("id", "project", "task"), ["project", "task"], "id", 5)


@query("override_latest", "SELECT project, task, ihash, final_text AS text, action = 'edit' AS edited FROM (SELECT * FROM mem_feedback QUALIFY row_number() OVER (PARTITION BY project, task, ihash ORDER BY id DESC) = 1) WHERE action IN ('accept', 'edit') AND coalesce(final_text, '') <> ''")
def override_latest(spark: SparkSession, d: str) -> DataFrame:
    return M.overrides(table(spark, d, "mem_feedback"))


@query(
    "feedback_status",
    """WITH r AS (SELECT CASE WHEN action IS NULL OR action NOT IN ('accept', 'edit', 'reject') THEN 'action must be accept, edit or reject' WHEN trim(coalesce(task, '')) = '' OR trim(coalesce(input_text, '')) = '' THEN 'task and input are required' WHEN action <> 'reject' AND trim(coalesce(final_text, '')) = '' THEN 'final text is required' ELSE 'recorded' END AS status FROM mem_feedback) SELECT status, count(*) AS n FROM r GROUP BY 1""",
)
def feedback_status(spark: SparkSession, d: str) -> DataFrame:
    good, bad = M.record(table(spark, d, "mem_feedback"))
    return good.select(F.lit("recorded").alias("status")).union(bad.select("reason")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fewshot_rank",
    """WITH k AS (SELECT task FROM mem_feedback WHERE project = 'default' GROUP BY 1 ORDER BY count(*) DESC, task LIMIT 1), x AS (SELECT * FROM mem_feedback WHERE project = 'default' AND task = (SELECT task FROM k) AND action IN ('accept', 'edit') ORDER BY id DESC LIMIT 200),
  y AS (SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS i, count(*) OVER () AS n FROM x WHERE ihash <> 'none' AND coalesce(final_text, '') <> ''), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY final_text ORDER BY id DESC) = 1)
  SELECT id, action = 'edit' AS edited, round(0.5 + 0.1::DOUBLE * (1 - i / n) + CASE WHEN action = 'edit' THEN 0.08::DOUBLE ELSE 0 END, 6) AS score FROM z ORDER BY score DESC, id DESC LIMIT 3""",
)
def fewshot_rank(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "mem_feedback")
    task = x.filter("project = 'default'").groupBy("task").count().orderBy(F.desc("count"), "task").first()[0]
    return M.examples(x, "default", task, "none").select("id", "edited", "score")


@query("cache_join", "WITH c AS (SELECT ihash, max(output_text) AS answer FROM mem_feedback WHERE coalesce(output_text, '') <> '' GROUP BY 1), q AS (SELECT DISTINCT ihash FROM mem_feedback) SELECT q.ihash, c.answer IS NOT NULL AS hit FROM q LEFT JOIN c ON q.ihash = c.ihash")
def cache_join(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "mem_feedback")
    cache = x.filter("coalesce(output_text, '') <> ''").groupBy("ihash").agg(F.max("output_text").alias("answer"))
    hits, misses = M.cached(x.select("ihash").distinct(), cache, "ihash")
    return hits.select("ihash", F.lit(True).alias("hit")).union(misses.select("ihash", F.lit(False)))


@query("annotation_latest", "SELECT id, project, source, created_at FROM (SELECT DISTINCT id, project, source, created_at FROM annotations) QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1")
def annotation_latest(spark: SparkSession, d: str) -> DataFrame:
    return M.keep_recent(table(spark, d, "annotations").select("id", "project", "source", "created_at").distinct(), ["id"], "created_at", 1)


@query("upserted", "SELECT pair_id, max(origin) AS origin FROM mini_llms WHERE origin <> 'rewrite' GROUP BY 1 UNION ALL SELECT DISTINCT pair_id, 'renewed' FROM mini_llms WHERE origin = 'rewrite'")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "mini_llms").groupBy("pair_id").agg(F.max("origin").alias("origin"))
    return M.upsert(x, x.filter("origin = 'rewrite'").select("pair_id", F.lit("renewed").alias("origin")), ["pair_id"])


@query("routed_questions", "SELECT DISTINCT pair_id, CASE WHEN contains(upper(output), 'CODE') THEN 'CODE' WHEN contains(upper(output), 'MULTILINGUAL') THEN 'MULTILINGUAL' ELSE 'GENERAL' END AS route, contains(upper(output), 'YES') AND NOT contains(split_part(upper(output), 'YES', 1), 'NO') AS passes FROM mini_llms WHERE output IS NOT NULL")
def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "mini_llms").filter("output is not null").select("pair_id", "output").distinct()
    return x.select("pair_id", T.route(F.col("output")).alias("route"), T.critique_passes(F.col("output")).alias("passes"))


@query("numbered_context", "WITH c AS (SELECT doc, para_idx, text, row_number() OVER (PARTITION BY doc ORDER BY para_idx, text) AS r FROM (SELECT DISTINCT doc, para_idx, text FROM mem_chunks WHERE project = 'default' AND text IS NOT NULL AND doc IS NOT NULL)) SELECT doc, string_agg('[' || r || '] ' || text, chr(10) || chr(10) ORDER BY r) AS context FROM c GROUP BY 1")
def numbered_context(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "mem_chunks").filter("project = 'default' and text is not null and doc is not null").select("doc", "para_idx", "text").distinct()
    return M.prompts(x, "doc", "para_idx", "text")


@query("rag_answers")
def rag_answers(spark: SparkSession, d: str) -> DataFrame:
    """The question pipeline with a stand-in model, for the questions with ids divisible by 50."""
    c = table(spark, d, "corrections").select("correction_id", "question", "question_embedding", "correct_answer").distinct()
    good = c.filter((F.size("question_embedding") == 64) & (V.norm(F.col("question_embedding")) > 0))
    q = good.filter("correction_id % 50 = 0").select(F.col("correction_id").alias("question_id"), "question", F.col("question_embedding").alias("vec"))
    chunks = table(spark, d, "mem_chunks").filter("model = 'nomad-64' and size(vec) = 64 and text is not null").select("vec", "text")

    def stub(x: DataFrame) -> DataFrame:
        return x.withColumn("answer", F.coalesce(T.excerpt(F.col("context"), 20), F.concat(F.lit("About: "), "question"))).withColumn("verdict", F.when(F.length("answer") > 40, "YES, it does").otherwise("NO"))

    return M.answer(q, good.filter("correction_id % 100 <> 0"), chunks, stub)
