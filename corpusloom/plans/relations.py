"""Queries on corpus_analysis, graph_data, entities and annotations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import tabular as B
from corpusloom.plans import as_bigint
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


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """project, id, term, score: clean distinct keywords of each document, with their best score."""
    x = table(spark, d, "corpus_analysis").select("id", "project", F.explode("keywords").alias("k")).select("id", "project", F.lower(F.trim("k.term")).alias("term"), "k.score")
    return x.filter("term is not null and term <> ''").groupBy("project", "id", "term").agg(F.max("score").alias("score"))


KW = """kw AS (SELECT project, id, term, max(score) AS score FROM (SELECT id, project, lower(trim(k.term)) AS term, k.score AS score FROM (SELECT id, project, unnest(keywords) AS k FROM corpus_analysis)) WHERE term IS NOT NULL AND term <> '' GROUP BY 1, 2, 3)"""
LINKS = "lk AS (SELECT DISTINCT project, source, target FROM graph_data)"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_data").select("project", "source", "target").distinct()


@query(
    "keyword_graph",
    f"""WITH {KW}, n AS (SELECT project, id, count(*) AS n FROM kw GROUP BY 1, 2),
  p AS (SELECT a.project, a.id AS source, b.id AS target, list(a.term ORDER BY a.term) AS shared_keywords, count(*) AS c FROM kw a JOIN kw b ON a.project = b.project AND a.term = b.term AND a.id < b.id GROUP BY 1, 2, 3)
  SELECT p.project, source, target, shared_keywords, round(c / (x.n + y.n - c), 4) AS weight FROM p JOIN n x ON p.project = x.project AND p.source = x.id JOIN n y ON p.project = y.project AND p.target = y.id WHERE c >= 2""",
)
def keyword_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.keyword_links(keywords(spark, d).select("project", "id", "term"), "id", ["project"])


@query(
    "graph_nodes",
    f"""WITH {KW}, r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM kw), h AS (SELECT id, list(term ORDER BY rank) AS top_keywords FROM r WHERE rank <= 5 GROUP BY 1),
  c AS (SELECT DISTINCT id, filename, filetype, word_count, coalesce(len(citations), 0) AS citation_count FROM corpus_analysis) SELECT c.*, top_keywords FROM c LEFT JOIN h ON c.id = h.id""",
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.corpus import top

    x = table(spark, d, "corpus_analysis").select("id", "filename", "filetype", "word_count", F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0)).alias("citation_count")).distinct()
    return G.nodes(x, top(keywords(spark, d), ["id"], 5, F.desc("score"), F.asc("term")).select("id", "term", "rank"), "id")


@query("graph_neighbours", f"WITH {LINKS}, b AS (SELECT source AS node, target AS neighbour FROM lk UNION SELECT target, source FROM lk) SELECT * FROM b UNION SELECT node, node FROM b")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(links(spark, d))


@query("isolated_nodes", f"WITH {LINKS} SELECT DISTINCT id FROM corpus_analysis WHERE id NOT IN (SELECT source FROM lk) AND id NOT IN (SELECT target FROM lk)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.isolated(table(spark, d, "corpus_analysis").select("id").distinct(), links(spark, d))


@query("broken_documents", "SELECT DISTINCT id, project, doc FROM mem_chunks m WHERE NOT EXISTS (SELECT 1 FROM corpus_analysis c WHERE c.filename = m.doc AND c.filetype = 'pdf')")
def broken_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose document isn't among the analysed PDF files."""
    return G.broken_references(table(spark, d, "mem_chunks").select("id", "project", "doc").distinct(), "doc", table(spark, d, "corpus_analysis").filter("filetype = 'pdf'"), "filename").select("id", "project", "doc")


@query("link_labels", f"WITH {LINKS}, c AS (SELECT DISTINCT id, filename FROM corpus_analysis) SELECT lk.source, lk.target, c.filename AS label, c.id IS NOT NULL AS found FROM lk LEFT JOIN c ON lk.target = c.id")
def link_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of each link's target, missing ones marked."""
    c = table(spark, d, "corpus_analysis").select(F.col("id").alias("target"), F.col("filename").alias("label")).distinct()
    return G.lookup(links(spark, d).select("source", "target"), c, "target").select("source", "target", "label", "found")


@query(
    "incremental_status",
    """WITH a AS (SELECT doc_id, md5(text) AS f FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS f FROM documents WHERE doc_id % 3 <> 0)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.f IS NOT DISTINCT FROM b.f THEN 'reused' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""",
)
def incremental_status(spark: SparkSession, d: str) -> DataFrame:
    """Two states of one folder: the operator compares manifests, so the table is read as two of them."""
    x = table(spark, d, "documents")
    before = x.filter("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("f"))
    after = x.filter("doc_id % 3 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("f"))
    return G.incremental(before, after, "doc_id", "f")


@query("indexed_status", "SELECT filename, CASE WHEN filename IN (SELECT doc FROM mem_chunks WHERE doc IS NOT NULL) THEN 'indexed' ELSE 'unindexed' END AS status FROM (SELECT DISTINCT filename FROM corpus_analysis)")
def indexed_status(spark: SparkSession, d: str) -> DataFrame:
    return G.indexed_status(table(spark, d, "corpus_analysis").select("filename"), table(spark, d, "mem_chunks").select(F.col("doc").alias("filename")), "filename")


@query("annotated_passages", "WITH a AS (SELECT DISTINCT id, project, source, para_idx FROM annotations), c AS (SELECT DISTINCT project, doc, para_idx, id AS chunk_id FROM mem_chunks) SELECT a.id, a.project, a.source, a.para_idx, chunk_id FROM a JOIN c ON a.project = c.project AND a.source = c.doc AND a.para_idx = c.para_idx")
def annotated_passages(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations").select("id", "project", "source", "para_idx").distinct()
    c = table(spark, d, "mem_chunks").select("project", F.col("doc").alias("source"), "para_idx", F.col("id").alias("chunk_id")).distinct()
    return a.join(c, ["project", "source", "para_idx"]).select("id", "project", "source", "para_idx", "chunk_id")


@query("entity_paragraphs", "SELECT project, para, count(*) AS entities, sum(mention_count) AS mentions FROM (SELECT entity_id, project, mention_count, unnest(paras) AS para FROM (SELECT DISTINCT entity_id, project, mention_count, paras FROM entities)) GROUP BY 1, 2")
def entity_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "entities").select("entity_id", "project", "mention_count", "paras").distinct()
    return x.select("project", "mention_count", F.explode("paras").alias("para")).groupBy("project", "para").agg(F.count(F.lit(1)).alias("entities"), F.sum("mention_count").alias("mentions"))


@query(
    "entity_totals",
    """WITH e AS (SELECT DISTINCT entity_id, project, label, text, mention_count, paras FROM entities), t AS (SELECT label, text, sum(mention_count) AS n FROM e GROUP BY 1, 2),
  p AS (SELECT label, text, list(DISTINCT p ORDER BY p) AS paras FROM (SELECT label, text, unnest(paras) AS p FROM e) GROUP BY 1, 2) SELECT t.label, t.text, n, coalesce(paras, []) AS paras FROM t LEFT JOIN p ON t.label = p.label AND t.text = p.text ORDER BY n DESC, t.label, t.text LIMIT 500""",
)
def entity_totals(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most frequent entities with their paragraphs."""
    x = table(spark, d, "entities").select("entity_id", "project", "label", "text", "mention_count", "paras").distinct()
    g = x.groupBy("label", "text").agg(F.sum("mention_count").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("paras", F.array().cast("array<int>")))))).alias("paras"))
    return g.orderBy(F.desc("n"), "label", "text").limit(500)


@query("clean_entities", r"""SELECT entity_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '^[ \t.,;:!?"“”‘’()\[\]—-]+|[ \t.,;:!?"“”‘’()\[\]—-]+$', '', 'g'), '[’'']s$', '') AS name FROM (SELECT DISTINCT entity_id, text FROM entities)""")
def clean_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("entity_id", "text").distinct().select("entity_id", T.clean_entity(F.col("text")).alias("name"))


@query("name_titles")
def name_titles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "entities").filter("label = 'PERSON'").select("entity_id", "text").distinct()
    return x.withColumn("t", T.title_split(F.col("text"))).select("entity_id", "t.core", "t.gender", "t.title")


@query("merged_aliases", "WITH n AS (SELECT DISTINCT project, lower(trim(text)) AS name, text FROM entities WHERE text IS NOT NULL), p AS (SELECT DISTINCT project, lower(trim(text)) AS name, unnest(paras) AS para FROM entities WHERE text IS NOT NULL), a AS (SELECT project, name, list(text ORDER BY text) AS aliases FROM n GROUP BY 1, 2), b AS (SELECT project, name, list(para ORDER BY para) AS paras FROM p GROUP BY 1, 2) SELECT a.project, a.name, aliases, coalesce(paras, []) AS paras FROM a LEFT JOIN b ON a.project IS NOT DISTINCT FROM b.project AND a.name = b.name")
def merged_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Spellings and paragraphs of each name of a project, merged without regard to case."""
    return G.merged_sets(table(spark, d, "entities").filter("text is not null").select("project", F.lower(F.trim("text")).alias("name"), "text", "paras"), ["project", "name"], "text", "paras").withColumnRenamed("text", "aliases")


@query("annotation_export", "SELECT DISTINCT project, source, para_idx, id, coalesce(quote, '') AS quote, coalesce(note, '') AS note FROM annotations")
def annotation_export(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "annotations").select("project", "source", "para_idx", "id", F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("note", F.lit("")).alias("note")).distinct()
    return x.orderBy("project", "source", "para_idx", "id")


@query("think_answer", r"""SELECT DISTINCT pair_id, trim(instruction) AS think, trim(output) AS answer FROM mini_llms WHERE instruction IS NOT NULL AND output IS NOT NULL AND NOT contains(output, '</think>') AND trim(instruction, ' ') = trim(instruction) AND trim(output, ' ') = trim(output)""")
def think_answer(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of a thinking model, taken apart again."""
    x = table(spark, d, "mini_llms").filter("instruction is not null and output is not null and not contains(output, '</think>')")
    text = F.concat(F.lit("<think>"), "instruction", F.lit("</think>"), "output")
    return x.select("pair_id", T.think_split(text).alias("t")).select("pair_id", "t.think", "t.answer").distinct()


@query("rescued_json", """SELECT id, json_extract_string(extra, '$.lang') AS lang, CAST(json_extract_string(extra, '$.words') AS INT) AS words FROM mem_chunks WHERE extra IS NOT NULL""")
def rescued_json(spark: SparkSession, d: str) -> DataFrame:
    """The object inside a model's chatter."""
    said = F.concat(F.lit("Here it is: "), "extra", F.lit(" - done"))
    x = table(spark, d, "mem_chunks").filter("extra is not null").select("id", T.json_rescue(said).alias("j"))
    return x.select("id", F.get_json_object("j", "$.lang").alias("lang"), F.get_json_object("j", "$.words").cast("int").alias("words"))


@query("valid_labels", r"""SELECT id, term, (length(trim(term)) > 0 AND length(trim(term)) <= 34 AND len(list_filter(regexp_split_to_array(term, '[\s\p{Z}]+'), lambda x: x <> '')) <= 4 AND NOT regexp_matches(lower(trim(term)), '^(here|sure|the topic|topic|label|this|i |as an)')) AS valid FROM (SELECT DISTINCT id, k.term AS term FROM (SELECT id, unnest(keywords) AS k FROM corpus_analysis)) WHERE term IS NOT NULL""")
def valid_labels(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "corpus_analysis").select("id", F.explode("keywords.term").alias("term")).filter("term is not null").distinct()
    return x.select("id", "term", T.valid_label(F.col("term")).alias("valid"))


@query("change_signature", "SELECT project, string_agg(filename || ':' || word_count, '|' ORDER BY filename) AS signature FROM (SELECT DISTINCT project, filename, word_count FROM corpus_analysis) GROUP BY 1")
def change_signature(spark: SparkSession, d: str) -> DataFrame:
    """One string a project that changes with its files."""
    x = table(spark, d, "corpus_analysis").select("project", "filename", "word_count").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("filename", "word_count")))
    return x.groupBy("project").agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["filename"], F.lit(":"), s["word_count"].cast("string"))), "|").alias("signature"))


@query("upload_guard", "SELECT doc_id, CASE WHEN title IS NULL THEN 'no name' WHEN filetype IS NULL OR filetype NOT IN ('pdf', 'txt', 'md', 'csv') THEN 'type not allowed' WHEN n_chars > 100000000 THEN 'too large' WHEN title IN (SELECT filename FROM corpus_analysis WHERE filename IS NOT NULL) THEN 'exists' ELSE 'accepted' END AS status FROM documents")
def upload_guard(spark: SparkSession, d: str) -> DataFrame:
    """Which files may be added."""
    known = table(spark, d, "corpus_analysis").select(F.col("filename").alias("title"))
    return G.upload_status(table(spark, d, "documents").select("doc_id", "title", "filetype", "n_chars"), known, "title", "filetype", "n_chars").select("doc_id", "status")


@query("ingested", "WITH c AS (SELECT title AS name, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE title IS NOT NULL), b AS (SELECT name, arg_max(text, {'n': length(text), 't': text}) AS text FROM c WHERE length(trim(text)) >= 20 GROUP BY 1), s AS (SELECT filename AS name, excerpt AS text FROM corpus_analysis) SELECT name, text FROM b UNION ALL SELECT name, text FROM s WHERE name NOT IN (SELECT name FROM b)")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken in beside the excerpts that are there."""
    store = table(spark, d, "corpus_analysis").select(F.col("filename").alias("name"), F.col("excerpt").alias("text"))
    return B.ingest(store, table(spark, d, "documents").select(F.col("title").alias("name"), "text"), "name", "text")


@query("correction_stats", "SELECT count(*) AS corrections, min(saved_at) AS first, max(saved_at) AS last, round(avg(length(question)), 4) AS question_length, round(avg(length(correct_answer)), 4) AS answer_length FROM (SELECT DISTINCT correction_id, saved_at, question, correct_answer FROM corrections)")
def correction_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "corrections").select("correction_id", "saved_at", "question", "correct_answer").distinct()
    return x.agg(F.count(F.lit(1)).alias("corrections"), F.min("saved_at").alias("first"), F.max("saved_at").alias("last"), F.round(F.avg(F.length("question")), 4).alias("question_length"), F.round(F.avg(F.length("correct_answer")), 4).alias("answer_length"))


@query("distinct_sources", "SELECT DISTINCT project, doc FROM mem_chunks WHERE doc IS NOT NULL")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mem_chunks").filter("doc is not null").select("project", "doc").distinct()


@query("memory_status", """SELECT project, model, count(DISTINCT doc) FILTER (WHERE kind = 'passage') AS docs, count(*) FILTER (WHERE kind = 'passage') AS passages, count(*) FILTER (WHERE kind = 'note') AS notes FROM mem_chunks GROUP BY 1, 2""")
def memory_status(spark: SparkSession, d: str) -> DataFrame:
    p, n = F.col("kind") == "passage", F.col("kind") == "note"
    return table(spark, d, "mem_chunks").groupBy("project", "model").agg(F.count_distinct(F.when(p, F.col("doc"))).alias("docs"), F.count(F.when(p, 1)).alias("passages"), F.count(F.when(n, 1)).alias("notes"))


@query("verified_names", r"""WITH e AS (SELECT DISTINCT project, text FROM entities WHERE label = 'GPE' AND text IS NOT NULL AND regexp_full_match(text, '[A-Za-z]+')), w AS (SELECT project, word, count(*) AS n FROM (SELECT project, unnest(regexp_extract_all(text, '\b[A-Za-z]+\b')) AS word FROM mem_chunks WHERE text IS NOT NULL) GROUP BY 1, 2)
  SELECT e.project, e.text, coalesce(n, 0) AS n FROM e LEFT JOIN w ON e.project = w.project AND e.text = w.word""")
def verified_names(spark: SparkSession, d: str) -> DataFrame:
    """How often a proposed one-word name stands in the texts of its project: an equi-join on the word."""
    e = table(spark, d, "entities").filter("label = 'GPE'").select("project", "text").distinct().filter(F.col("text").rlike("^[A-Za-z]+$"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"{T.EDGE}([A-Za-z]+){T.EDGE}"), F.lit(1))
    w = table(spark, d, "mem_chunks").select("project", F.explode(words).alias("text")).groupBy("project", "text").agg(F.count(F.lit(1)).alias("n"))
    return e.join(w, ["project", "text"], "left").na.fill(0, ["n"])


as_bigint(SQL, "entity_paragraphs", "mentions")
as_bigint(SQL, "entity_totals", "n")
