"""Queries on documents.text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import extraction as X
from corpusloom.operators import structure as S
from corpusloom.plans import as_bigint
from corpusloom.session import spread, table

STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + ")"
WORD_SQL = r"[a-zA-Z][a-zA-Z\-'']+"
SPACE = r"[\s\p{Z}\x{000B}\x{0085}]+"
CITATION_SQL = T.CITATION.replace("'", "''")
# Words by which a language is told.
HINTS = {
    "en": "the and of to was that with his her for".split(),
    "es": "el la de que y en los las un una por con su".split(),
    "fr": "le la les des et est une que dans pour qui pas".split(),
    "de": "der die das und ist nicht ein eine mit den zu von".split(),
    "it": "il di che e la per un una non sono con gli".split(),
    "pt": "o a de que e do da em um uma para com os não".split(),
}
# The default lexicon of topics; lexicon_scores() takes any.
LEXICON = {
    "time": "year years time day days week century minutes seconds daily stages later last".split(),
    "space": "room building page main window museum gallery place city house".split(),
    "people": "people readers visitors everyone nobody somebody reader author".split(),
    "mind": "think thought mind know believe idea memory remember patience".split(),
    "language": "language word vocabulary corpus transcript paragraph passage text".split(),
    "knowledge": "research study analysis result evidence theory system experiment sample notes".split(),
}
TRACKED = ["corpus", "window", "archive", "vocabulary", "notebook", "museum"]
LEXICON_SQL = "(VALUES " + ", ".join(f"('{t}', '{w}')" for t, ws in LEXICON.items() for w in ws) + ") AS lexicon(topic, word)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def tok_sql(where: str = "TRUE") -> str:
    return f"""tok AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM (
      SELECT doc_id, list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: lower(x)) AS t FROM documents WHERE text IS NOT NULL AND {where}))"""


CONTENT = f"length(word) >= 4 AND word NOT IN {STOPS}"
PARA_SQL = rf"""blk AS (SELECT doc_id, unnest(b) AS raw, generate_subscripts(b, 1) AS block FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[\s\p{{Z}}\x{{000B}}\x{{0085}}]+|[\s\p{{Z}}\x{{000B}}\x{{0085}}]+$', '', 'g'), '\n\s*\n+') AS b FROM documents WHERE text IS NOT NULL)),
  st AS (SELECT doc_id, block, regexp_replace(raw, '^[\s\p{{Z}}\x{{000B}}\x{{0085}}]+|[\s\p{{Z}}\x{{000B}}\x{{0085}}]+$', '', 'g') AS raw FROM blk),
  hd AS (SELECT doc_id, block, raw, (regexp_matches(raw, '^\s{{0,3}}#{{1,6}}\s+[^\n]*$') AND NOT contains(raw, chr(10))) AS heading FROM st),
  tx AS (SELECT doc_id, block, heading, trim(regexp_replace(CASE WHEN heading THEN regexp_extract(raw, '^\s{{0,3}}#{{1,6}}\s+(.*)$', 1) ELSE regexp_replace(raw, '{SPACE}', ' ', 'g') END, '^{SPACE}|{SPACE}$', '', 'g')) AS text FROM hd),
  pw AS (SELECT *, len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) AS words FROM tx),
  para AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS para, text, words, heading FROM pw WHERE words > 0)"""
PTOK_SQL = f"""ptok0 AS (SELECT doc_id, para, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM (
    SELECT doc_id, para, list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: lower(x)) AS t FROM para)),
  ptok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para ORDER BY pos) - 1 AS at FROM ptok0 WHERE {CONTENT})"""
TOPT_SQL = """tc AS (SELECT doc_id, word, count(*) AS n, min(para * 1000000 + pos) AS first FROM ptok GROUP BY 1, 2),
  topt AS (SELECT doc_id, word AS term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM tc QUALIFY rank <= 10)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query(
    "tfidf_keywords",
    f"""WITH {tok_sql()}, tf AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM tok WHERE {CONTENT} GROUP BY 1, 2),
  s AS (SELECT doc_id, word, first, n / sum(n) OVER (PARTITION BY doc_id) * (ln(((SELECT count(*) FROM documents) + 1) / (count(*) OVER (PARTITION BY word) + 1)) + 1) AS raw FROM tf)
  SELECT doc_id, word AS term, round(raw, 5) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, first) AS rank FROM s QUALIFY rank <= 12""",
)
def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return C.tfidf(docs(spark, d))


@query(
    "tfidf_paragraphs",
    f"""WITH {PARA_SQL}, {PTOK_SQL}, f AS (SELECT doc_id, word, count(*) AS n FROM ptok GROUP BY 1, 2), df AS (SELECT doc_id, word, count(DISTINCT para) AS df FROM ptok GROUP BY 1, 2),
  np AS (SELECT doc_id, count(*) AS np FROM para GROUP BY 1)
  SELECT f.doc_id, f.word, n, df, round(n * ln((np + 1) / (df + 1)), 2) AS tfidf FROM f JOIN df ON f.doc_id = df.doc_id AND f.word = df.word JOIN np ON f.doc_id = np.doc_id WHERE n >= 3""",
)
def tfidf_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF within a document: its paragraphs are the collection."""
    p = S.paragraphs(docs(spark, d))
    per = S.placed_tokens(p).groupBy("doc_id", "word", "para").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id", "word").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("df"))
    size = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("np"))
    return per.filter("n >= 3").join(size, "doc_id").select("doc_id", "word", "n", "df", F.round(F.col("n") * F.log((F.col("np") + 1) / (F.col("df") + 1)), 2).alias("tfidf"))


@query(
    "tfidf_l2",
    r"""WITH tok AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\b[a-z]{3,}\b')) AS word FROM eval_items),
  tf AS (SELECT item_id, word, count(*) AS n FROM tok GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), size AS (SELECT count(*) AS docs FROM eval_items),
  r AS (SELECT item_id, tf.word, (1 + ln(n)) * (ln((1 + docs) / (1 + df)) + 1) AS raw FROM tf JOIN df ON tf.word = df.word CROSS JOIN size WHERE df >= 2 AND df <= 0.6 * docs)
  SELECT item_id, word AS term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)), 6) AS weight FROM r""",
)
def tfidf_l2(spark: SparkSession, d: str) -> DataFrame:
    return C.tfidf_l2(table(spark, d, "eval_items"), "item_id")


@query("word_freq_by_lang", f"WITH {tok_sql()} SELECT lang, word, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 20")
def word_freq_by_lang(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return C.token_rows(x, ["lang"]).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query("document_frequency", f"WITH {tok_sql()} SELECT word, count(DISTINCT doc_id) AS df FROM tok WHERE {CONTENT} GROUP BY 1")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return C.document_frequency(C.term_frequency(C.content(C.token_rows(docs(spark, d), ["doc_id"])), ["doc_id"]))


@query(
    "corpus_stats",
    rf"""WITH {tok_sql()}, pw AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first, ({CONTENT}) AS kept FROM tok GROUP BY 1, 2),
  a AS (SELECT doc_id, sum(n) AS total_words, count(*) AS unique_words, sum(CASE WHEN kept THEN n ELSE 0 END) AS filtered_words, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS unique_filtered,
     sum(CASE WHEN kept THEN n * length(word) ELSE 0 END) AS letters, arg_min(word, first - 1000000 * length(word)) FILTER (WHERE kept) AS longest FROM pw GROUP BY 1),
  b AS (SELECT doc_id, length(text) AS character_count, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS total_sentences FROM documents)
  SELECT b.doc_id, coalesce(total_words, 0) AS total_words, coalesce(unique_words, 0) AS unique_words, CASE WHEN total_words > 0 THEN round(unique_words / total_words, 3) ELSE 0 END AS vocabulary_diversity,
    coalesce(total_sentences, 0) AS total_sentences, CASE WHEN total_sentences > 0 THEN round(coalesce(total_words, 0) / total_sentences, 1) ELSE 0 END AS avg_sentence_length,
    coalesce(filtered_words, 0) AS filtered_words, coalesce(unique_filtered, 0) AS unique_filtered, coalesce(total_words, 0) - coalesce(filtered_words, 0) AS stopwords_removed, character_count,
    coalesce(longest, '') AS longest_word, CASE WHEN filtered_words > 0 THEN round(letters / filtered_words, 1) ELSE 0 END AS avg_word_length
  FROM b LEFT JOIN a ON a.doc_id = b.doc_id""",
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.statistics(docs(spark, d))


@query(
    "readability",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\b[a-záéíóúüñ'']{2,}\b') AS w,
     len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '[\s\p{Z}\x{000B}\x{0085}]+'), lambda x: x <> '')) > 2)) AS sentences FROM documents WHERE text IS NOT NULL),
  m AS (SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS types, sentences,
     coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(regexp_replace(x, '[^a-z]', '', 'g'), '[aeiouy]{1,2}'))))), 0) AS syl FROM w),
  e AS (SELECT *, CASE WHEN sentences > 0 THEN words / sentences ELSE 0 END AS asl, CASE WHEN words > 0 THEN syl / words ELSE 0 END AS asw FROM m),
  f AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * asl - 84.6::DOUBLE * asw)) AS ease0 FROM e)
  SELECT doc_id, words, types, sentences, round(asl, 1) AS avg_sentence_length, CASE WHEN words > 0 THEN round(types / words * 100, 1) ELSE 0 END AS density, round(ease0, 0) AS ease,
    CASE WHEN ease0 > 70 THEN 'easy' WHEN ease0 > 50 THEN 'standard' WHEN ease0 > 30 THEN 'difficult' ELSE 'very difficult' END AS readability FROM f""",
)
def readability(spark: SparkSession, d: str) -> DataFrame:
    return C.readability(docs(spark, d))


def _ngram_sql(n: int) -> str:
    parts = " || ' ' || ".join(["word"] + [f"lead(word, {i}) OVER w" for i in range(1, n)])
    return f"""WITH {tok_sql()}, c AS (SELECT * FROM tok WHERE {CONTENT}), g AS (SELECT {parts} AS ngram FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1 ORDER BY n DESC, ngram LIMIT 20"""


@query("top_bigrams", _ngram_sql(2))
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return C.ngrams(docs(spark, d), 2)


@query("top_trigrams", _ngram_sql(3))
def top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return C.ngrams(docs(spark, d), 3)


@query("word_length_hist", f"WITH {tok_sql()} SELECT least(length(word), 15) AS length, count(*) AS n FROM tok GROUP BY 1")
def word_length_hist(spark: SparkSession, d: str) -> DataFrame:
    return C.word_lengths(docs(spark, d))


@query(
    "kwic_search",
    rf"""WITH s AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS place FROM (SELECT doc_id,
   list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM documents))
  SELECT doc_id, place, sentence FROM s WHERE contains(lower(sentence), 'vocabulary') ORDER BY doc_id, place LIMIT 20""",
)
def kwic_search(spark: SparkSession, d: str) -> DataFrame:
    return C.kwic(docs(spark, d), "vocabulary")


@query("kwic_highlight", r"SELECT doc_id, regexp_replace(text, '(vocabulary|corpora|corpus)', '**\1**', 'gi') AS marked FROM documents WHERE regexp_matches(lower(text), 'corpus|corpora|vocabulary')")
def kwic_highlight(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).filter(F.lower("text").rlike("corpus|corpora|vocabulary"))
    return x.select("doc_id", C.highlight(F.col("text"), ["corpus", "corpora", "vocabulary"]).alias("marked"))


@query("excerpt", rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN '...' ELSE '' END AS excerpt, len(w) AS words FROM w""")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.word_count(F.col("text")).alias("words"))


@query("clip_text", rf"SELECT doc_id, CASE WHEN length(text) > 120 THEN regexp_replace(text[1:119], '{SPACE}$', '') || '…' ELSE text END AS clipped FROM documents")
def clip_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.clip(F.col("text"), 120).alias("clipped"))


@query("markdown_text", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '[#*_`>\-\[\]()]', ' ', 'g') AS plain FROM documents")
def markdown_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.markdown_to_text(F.col("text")).alias("plain"))


@query("paragraph_split", f"WITH {PARA_SQL} SELECT doc_id, para, text, words, heading FROM para")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return S.paragraphs(docs(spark, d))


DISPLAY_SQL = rf"""db AS (SELECT doc_id, unnest(b) AS raw, generate_subscripts(b, 1) - 1 AS block FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{2,}}') AS b FROM documents WHERE text IS NOT NULL)),
  ds AS (SELECT doc_id, block, regexp_replace(raw, '^{SPACE}|{SPACE}$', '', 'g') AS raw FROM db),
  dw AS (SELECT *, len(list_filter(regexp_split_to_array(raw, '{SPACE}'), lambda x: x <> '')) AS words FROM ds WHERE raw <> ''),
  dt AS (SELECT *, ((block = 0 AND words < 15) OR regexp_matches(raw, '^#{{1,4}}\s') OR regexp_matches(raw, '^[A-Z][A-Z\s]{{5,40}}$')) AS is_title FROM dw),
  disp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS para, raw, words, is_title, (NOT is_title AND words < 20) AS is_section FROM dt)"""


@query("display_paragraphs", f"WITH {DISPLAY_SQL} SELECT * FROM disp")
def display_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return S.display_paragraphs(docs(spark, d))


@query(
    "sentence_stats",
    rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '{SPACE}'), lambda x: x <> '')) > 2)) AS sentences,
   greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^{SPACE}|{SPACE}$', '', 'g') <> ''))) AS pieces FROM documents WHERE text IS NOT NULL""",
)
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"), T.sentence_count(F.col("text")).alias("pieces"))


@query(
    "token_counts",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z][a-zA-Z\-'']+')) AS plain, len(regexp_extract_all(lower(text), '\b[a-záéíóúüñ'']{2,}\b')) AS accented,
   len(regexp_extract_all(lower(text), '\b[a-z'']{2,}\b')) AS ascii FROM documents WHERE text IS NOT NULL""",
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(T.tokens(t)).alias("plain"), F.size(T.tokens_accented(t)).alias("accented"), F.size(T.tokens_ascii(t)).alias("ascii"))


@query("token_counts_letters")
def token_counts_letters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(T.tokens_letters(t)).alias("letters"), F.size(T.tokens_alpha(t)).alias("alpha"))


@query("structure_topics", f"WITH {PARA_SQL}, {PTOK_SQL}, {TOPT_SQL} SELECT doc_id, term, n AS count, rank FROM topt")
def structure_topics(spark: SparkSession, d: str) -> DataFrame:
    return S.top_terms(S.placed_tokens(S.paragraphs(docs(spark, d))))


@query(
    "cooccurrence_topics",
    f"""WITH {PARA_SQL}, {PTOK_SQL}, {TOPT_SQL},
  pr AS (SELECT a.doc_id, a.word AS term, b.word AS related, count(*) AS together FROM ptok a JOIN topt t ON a.doc_id = t.doc_id AND a.word = t.term
    JOIN ptok b ON a.doc_id = b.doc_id AND a.para = b.para AND b.at BETWEEN a.at - 6 AND a.at + 6 AND b.at <> a.at AND b.word <> a.word GROUP BY 1, 2, 3)
  SELECT doc_id, term, related, together, row_number() OVER (PARTITION BY doc_id, term ORDER BY together DESC, related) AS rank FROM pr QUALIFY rank <= 5""",
)
def cooccurrence_topics(spark: SparkSession, d: str) -> DataFrame:
    t = S.placed_tokens(S.paragraphs(docs(spark, d)))
    return S.related_terms(t, S.top_terms(t))


@query(
    "word_track",
    f"""WITH {PARA_SQL}, {PTOK_SQL}, {TOPT_SQL},
  c AS (SELECT *, list_concat(coalesce(list(word) OVER (PARTITION BY doc_id, para ORDER BY "at" ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []), coalesce(list(word) OVER (PARTITION BY doc_id, para ORDER BY "at" ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), []))[1:6] AS colocates FROM ptok)
  SELECT c.doc_id, c.para, c.at, c.word, colocates FROM c JOIN topt t ON c.doc_id = t.doc_id AND c.word = t.term""",
)
def word_track(spark: SparkSession, d: str) -> DataFrame:
    t = S.placed_tokens(S.paragraphs(docs(spark, d)))
    return S.word_track(t, S.top_terms(t))


@query("cloud_terms", f"WITH {PARA_SQL}, {PTOK_SQL}, {TOPT_SQL.replace('rank <= 10', 'rank <= 30')} SELECT doc_id, term, n AS count, rank FROM topt")
def cloud_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.top_terms(S.placed_tokens(S.paragraphs(docs(spark, d))), n=30)


@query(
    "collocates",
    f"""WITH {tok_sql()}, c AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS at FROM tok WHERE {CONTENT}),
  p AS (SELECT a.word, b.word AS collocate, count(*) AS n FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.at BETWEEN a.at - 5 AND a.at + 5 AND a.at <> b.at AND a.word <> b.word
    WHERE a.word IN ({", ".join(f"'{w}'" for w in TRACKED)}) GROUP BY 1, 2)
  SELECT word, collocate, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, collocate) AS rank FROM p QUALIFY rank <= 8""",
)
def collocates(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of tracked words within each document's content words: arrays, no join of tokens with tokens."""
    words = F.filter(T.tokens(F.col("text")), lambda w: (F.length(w) >= 4) & ~w.isin(T.STOPWORDS))
    x = docs(spark, d).select(words.alias("w")).select("w", F.posexplode("w").alias("i", "word")).filter(F.col("word").isin(TRACKED))
    near = F.concat(F.slice("w", F.greatest(F.lit(1), F.col("i") - 4), F.least(F.lit(5), F.col("i"))), F.slice("w", F.col("i") + 2, F.lit(5)))
    pairs = x.select("word", F.explode(near).alias("collocate")).filter("word <> collocate").groupBy("word", "collocate").agg(F.count(F.lit(1)).alias("n"))
    return C.top(pairs, ["word"], 8, F.desc("n"), F.asc("collocate"))


@query(
    "lexicon_topics",
    f"""WITH {tok_sql()}, f AS (SELECT doc_id, word, count(*) AS n FROM tok GROUP BY 1, 2), h AS (SELECT doc_id, topic, f.word, n FROM f JOIN {LEXICON_SQL} ON f.word = lexicon.word)
  SELECT doc_id, topic, sum(n) AS freq, list(word ORDER BY n DESC, word)[1:6] AS related FROM h GROUP BY 1, 2""",
)
def lexicon_topics(spark: SparkSession, d: str) -> DataFrame:
    freq = C.token_rows(docs(spark, d), ["doc_id"]).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return C.lexicon_scores(freq, spark.createDataFrame([(t, w) for t, ws in LEXICON.items() for w in ws], "topic string, word string"), ["doc_id"])


@query(
    "pertinent_topic",
    f"""WITH {PARA_SQL}, pt AS (SELECT doc_id, para, unnest(list_transform(regexp_extract_all(text, '{WORD_SQL}'), lambda x: lower(x))) AS word FROM para),
  h AS (SELECT doc_id, para, topic, count(*) AS n FROM pt JOIN {LEXICON_SQL} ON pt.word = lexicon.word GROUP BY 1, 2, 3)
  SELECT doc_id, para, topic, n FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, para ORDER BY n DESC, topic) = 1""",
)
def pertinent_topic(spark: SparkSession, d: str) -> DataFrame:
    """The topic of each paragraph with most hits."""
    words = S.paragraphs(docs(spark, d)).select("doc_id", "para", F.explode(T.tokens(F.col("text"))).alias("word"))
    lexicon = F.broadcast(spark.createDataFrame([(t, w) for t, ws in LEXICON.items() for w in ws], "topic string, word string"))
    n = words.join(lexicon, "word").groupBy("doc_id", "para", "topic").agg(F.count(F.lit(1)).alias("n"))
    return C.top(n, ["doc_id", "para"], 1, F.desc("n"), F.asc("topic")).select("doc_id", "para", "topic", "n")


@query(
    "top_word_of_paragraph",
    f"""WITH {PARA_SQL}, {PTOK_SQL}, c AS (SELECT doc_id, para, word, count(*) AS n, min(pos) AS first FROM ptok GROUP BY 1, 2, 3)
  SELECT doc_id, para, word, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, para ORDER BY n DESC, first) = 1""",
)
def top_word_of_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return S.top_word(S.paragraphs(docs(spark, d)))


@query(
    "active_cloud_word",
    f"""WITH {PARA_SQL}, {PTOK_SQL}, {TOPT_SQL.replace('rank <= 10', 'rank <= 30')}, c AS (SELECT p.doc_id, p.para, p.word, count(*) AS here, max(t.n) AS everywhere FROM ptok p JOIN topt t ON p.doc_id = t.doc_id AND p.word = t.term GROUP BY 1, 2, 3)
  SELECT doc_id, para, word, here FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, para ORDER BY here DESC, everywhere DESC, word) = 1""",
)
def active_cloud_word(spark: SparkSession, d: str) -> DataFrame:
    """The cloud word that a paragraph holds most often."""
    t = S.placed_tokens(S.paragraphs(docs(spark, d)))
    cloud = S.top_terms(t, n=30).select("doc_id", F.col("term").alias("word"), F.col("count").alias("everywhere"))
    n = t.join(cloud, ["doc_id", "word"]).groupBy("doc_id", "para", "word").agg(F.count(F.lit(1)).alias("here"), F.max("everywhere").alias("everywhere"))
    return C.top(n, ["doc_id", "para"], 1, F.desc("here"), F.desc("everywhere"), F.asc("word")).select("doc_id", "para", "word", "here")


@query(
    "inverted_index",
    rf"""WITH {PARA_SQL}, w AS (SELECT doc_id, para, unnest(list_distinct(regexp_extract_all(lower(text), '\b[a-z'']{{2,}}\b'))) AS word FROM para)
  SELECT doc_id, word, list(para ORDER BY para) AS paras FROM w WHERE word IN ({", ".join(f"'{w}'" for w in TRACKED)}) GROUP BY 1, 2""",
)
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return S.inverted_index(S.paragraphs(docs(spark, d)), TRACKED)


@query(
    "word_positions",
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '\b[a-z'']{{2,}}\b') AS t FROM documents WHERE text IS NOT NULL),
  b AS (SELECT doc_id, len(t) AS total, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM a)
  SELECT doc_id, word, pos, round(least(pos / total, 0.9999::DOUBLE), 6) AS position FROM b WHERE word IN ({", ".join(f"'{w}'" for w in TRACKED)})""",
)
def word_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.word_positions(docs(spark, d), TRACKED)


@query(
    "tracked_words",
    f"""WITH {PARA_SQL}, {PTOK_SQL}, {TOPT_SQL}, seeds AS (SELECT DISTINCT doc_id, word FROM ptok0 WHERE word IN ({", ".join(f"'{w}'" for w in TRACKED)}))
  SELECT doc_id, term AS word FROM topt UNION SELECT doc_id, word FROM seeds""",
)
def tracked_words(spark: SparkSession, d: str) -> DataFrame:
    """The top words of a document and the seeds that it holds."""
    p = S.paragraphs(docs(spark, d))
    seeds = p.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word")).filter(F.col("word").isin(TRACKED))
    return S.top_terms(S.placed_tokens(p)).select("doc_id", F.col("term").alias("word")).union(seeds).distinct()


@query(
    "paragraph_arcs",
    f"""WITH {PARA_SQL}, a AS (SELECT doc_id, para, greatest(words / sum(words) OVER (PARTITION BY doc_id), 0.004::DOUBLE) + 0.015::DOUBLE AS w FROM para),
  b AS (SELECT doc_id, para, w, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(w) OVER (PARTITION BY doc_id) AS t FROM a)
  SELECT doc_id, para, round(s / t * 6.143559::DOUBLE, 6) AS start, round((s + w) / t * 6.143559::DOUBLE, 6) AS "end" FROM b""",
)
def paragraph_arcs(spark: SparkSession, d: str) -> DataFrame:
    return S.arcs(S.paragraphs(docs(spark, d)))


@query("ring_sizes", f"""WITH {PARA_SQL} SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, para) AS ring, round(6.283185307179586::DOUBLE * words / max(words) OVER (PARTITION BY doc_id), 6) AS angle FROM para""")
def ring_sizes(spark: SparkSession, d: str) -> DataFrame:
    return S.rings(S.paragraphs(docs(spark, d)))


@query(
    "stacked_marks",
    f"""WITH {PARA_SQL}, a AS (SELECT doc_id, para AS id, round(words / 100, 4) AS angle FROM para), b AS (SELECT *, CAST(round(angle * 170) AS BIGINT) AS bucket FROM a)
  SELECT doc_id, id, angle, bucket, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY angle, id) - 1 AS level FROM b""",
)
def stacked_marks(spark: SparkSession, d: str) -> DataFrame:
    return S.stacked(S.paragraphs(docs(spark, d)).select("doc_id", F.col("para").alias("id"), F.round(F.col("words") / 100, 4).alias("angle")))


@query(
    "systematic_sample",
    f"""WITH {DISPLAY_SQL}, a AS (SELECT *, CASE WHEN is_title OR is_section THEN 0 ELSE 1 END AS rest FROM disp),
  b AS (SELECT *, sum(1 - rest) OVER (PARTITION BY doc_id) AS kept, sum(rest) OVER (PARTITION BY doc_id) AS others, sum(rest) OVER (PARTITION BY doc_id ORDER BY para) - 1 AS nth FROM a)
  SELECT doc_id, para, words, is_title, is_section FROM b WHERE rest = 0 OR nth % CAST(greatest(1, ceil(others / greatest(1, 3 - kept))) AS BIGINT) = 0""",
)
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.systematic(S.display_paragraphs(docs(spark, d)), most=3).drop("raw")


@query(
    "first_middle_last",
    f"""WITH {PARA_SQL}, a AS (SELECT doc_id, para, words, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM para)
  SELECT doc_id, para, words, i FROM a WHERE i = 0 OR i = floor(n / 2) OR i = n - 1""",
)
def first_middle_last(spark: SparkSession, d: str) -> DataFrame:
    return S.first_middle_last(S.paragraphs(docs(spark, d)).select("doc_id", "para", "words"), "doc_id", "para")


@query(
    "merged_paragraphs",
    f"""WITH {PARA_SQL}, j AS (SELECT project, doc_id, para FROM para JOIN documents USING (doc_id) WHERE project IS NOT NULL) SELECT project, row_number() OVER (PARTITION BY project ORDER BY doc_id, para) - 1 AS merged, doc_id, para FROM j""",
)
def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return S.merged_paragraphs(S.paragraphs(x).select("doc_id", "para").join(x.filter("project is not null").select("doc_id", "project"), "doc_id"))


@query(
    "paragraph_of_word",
    f"""WITH {PARA_SQL}, s AS (SELECT doc_id, para, words, sum(words) OVER (PARTITION BY doc_id ORDER BY para) AS hi FROM para), p AS (SELECT doc_id, unnest([0, 50, 150]) AS word_no FROM documents)
  SELECT p.doc_id, word_no, para, round((word_no - (hi - words)) / words, 4) AS share FROM p JOIN s ON p.doc_id = s.doc_id AND word_no >= hi - words AND word_no < hi""",
)
def paragraph_of_word(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return S.paragraph_at(S.paragraphs(x), x.select("doc_id", F.explode(F.array(F.lit(0), F.lit(50), F.lit(150))).alias("word_no")))


DATES_SQL = rf"""pl AS (SELECT doc_id, regexp_replace(text, '{CITATION_SQL}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
  rg AS (SELECT doc_id, list_zip(regexp_extract_all(t, '\b{T.YEAR}\s*[-–—]\s*{T.YEAR}\b', 1), regexp_extract_all(t, '\b{T.YEAR}\s*[-–—]\s*{T.YEAR}\b', 2)) AS z, regexp_extract_all(t, '\b{T.YEAR}\b', 1) AS y FROM pl),
  rr AS (SELECT doc_id, CAST(unnest(z)[1] AS INT) AS s, CAST(unnest(z)[2] AS INT) AS e, generate_subscripts(z, 1) AS o FROM rg),
  r1 AS (SELECT doc_id, s, e, min(o) AS o FROM rr WHERE s <= e GROUP BY 1, 2, 3),
  ys AS (SELECT DISTINCT doc_id, CAST(unnest(y) AS INT) AS s FROM rg),
  y1 AS (SELECT ys.* FROM ys WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.doc_id = ys.doc_id AND (r1.s = ys.s OR r1.e = ys.s))),
  al AS (SELECT doc_id, s, e, 'range' AS kind, 0 AS g, o FROM r1 UNION ALL SELECT doc_id, s, NULL, 'single', 1, s FROM y1),
  dt AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, o) - 1 AS i, s AS start, e AS "end", kind FROM al)"""


@query("date_extraction", f"WITH {DATES_SQL} SELECT * FROM dt")
def date_extraction(spark: SparkSession, d: str) -> DataFrame:
    return X.dates(docs(spark, d))


@query("timeline", f"""WITH {DATES_SQL} SELECT doc_id || '-date' || i AS event_id, doc_id, start, "end", kind FROM dt""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return X.timeline(docs(spark, d))


@query("timeline_ticks", f"""WITH {DATES_SQL}, m AS (SELECT min(start) AS lo, max(coalesce("end", start)) AS hi FROM dt) SELECT unnest(range(CAST(ceil(lo / 25) * 25 AS BIGINT), hi + 1, 25)) AS tick FROM m""")
def timeline_ticks(spark: SparkSession, d: str) -> DataFrame:
    return X.ticks(X.timeline(docs(spark, d)))


@query(
    "citations",
    rf"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{CITATION_SQL}') AS c FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(c) AS citation, generate_subscripts(c, 1) AS o FROM a),
  f AS (SELECT doc_id, citation, min(o) AS o FROM b GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS i, citation FROM f QUALIFY i < 25""",
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    return X.citations(docs(spark, d))


@query("paragraph_citations", rf"""WITH {PARA_SQL}, a AS (SELECT doc_id, para, regexp_extract_all(text, '{CITATION_SQL}') AS c FROM para) SELECT doc_id, para, generate_subscripts(c, 1) - 1 AS i, unnest(c) AS citation FROM a""")
def paragraph_citations(spark: SparkSession, d: str) -> DataFrame:
    return X.paragraph_citations(S.paragraphs(docs(spark, d)))


@query(
    "citation_notes",
    rf"""WITH {PARA_SQL}, a AS (SELECT doc_id, para, text, count(*) OVER (PARTITION BY doc_id) AS n, regexp_extract_all(text, '{T.NOTE}', 0) AS r, regexp_extract_all(text, '{T.NOTE}', 1) AS au, regexp_extract_all(text, '{T.NOTE}', 2) AS yr FROM para)
  SELECT doc_id, para, generate_subscripts(r, 1) - 1 AS i, unnest(r) AS ref, unnest(au) AS author, unnest(yr) AS year, round(para / n, 4) AS fraction, text[1:130] || '…' AS context FROM a""",
)
def citation_notes(spark: SparkSession, d: str) -> DataFrame:
    return X.notes(S.paragraphs(docs(spark, d)))


_LANG_SQL = " UNION ALL ".join(f"SELECT doc_id, '{lang}' AS language, len(list_filter(w, lambda x: x IN ({', '.join(repr(h) for h in hs)}))) AS hits FROM w" for lang, hs in HINTS.items())


@query("lang_detect", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text[1:20000]), '\p{{L}}+') AS w FROM documents WHERE text IS NOT NULL), s AS ({_LANG_SQL})
  SELECT doc_id, language, hits FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, language) = 1""")
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return C.language(docs(spark, d), HINTS)


@query("corpus_totals", rf"""SELECT coalesce(project, '') AS project, count(*) AS files, sum(length(text)) AS characters, sum(len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> ''))) AS words FROM documents GROUP BY 1""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select(F.coalesce("project", F.lit("")).alias("project"), F.length("text").alias("c"), T.word_count(F.col("text")).alias("w"))
    return x.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("c").alias("characters"), F.sum("w").alias("words"))


@query("quality_notes", f"""WITH {PARA_SQL}, a AS (SELECT doc_id, count(*) AS paragraphs, sum(words) AS words FROM para GROUP BY 1)
  SELECT doc_id, coalesce(paragraphs, 0) AS paragraphs, coalesce(words, 0) AS words FROM documents LEFT JOIN a USING (doc_id) WHERE coalesce(paragraphs, 0) < 5 OR coalesce(words, 0) < 300""")
def quality_notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents too short to say much about."""
    x = docs(spark, d)
    a = S.paragraphs(x).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("words").alias("words"))
    return x.select("doc_id").join(a, "doc_id", "left").na.fill(0).filter("paragraphs < 5 or words < 300")


@query("global_max", rf"""WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) AS words, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^{SPACE}|{SPACE}$', '', 'g') <> ''))) AS sentences FROM documents WHERE text IS NOT NULL)
  SELECT max(words) AS max_words, max(sentences) AS max_sentences, round(max(words / sentences), 4) AS max_sentence_length FROM w""")
def global_max(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).filter("text is not null").select(T.word_count(F.col("text")).alias("words"), T.sentence_count(F.col("text")).alias("sentences"))
    return x.agg(F.max("words").alias("max_words"), F.max("sentences").alias("max_sentences"), F.round(F.max(F.col("words") / F.col("sentences")), 4).alias("max_sentence_length"))


@query(
    "word_association",
    f"""WITH {tok_sql()}, e AS (SELECT word, count(*) AS freq FROM tok WHERE {CONTENT} GROUP BY 1), n AS (SELECT word, count(*) AS n FROM tok JOIN documents USING (doc_id) WHERE {CONTENT} AND lower(trim(source)) = 'essays' GROUP BY 1),
  s AS (SELECT n.word, n, round(n * ln((n / (SELECT sum(n) FROM n)) / (freq / (SELECT sum(freq) FROM e))), 4) AS score FROM n JOIN e ON n.word = e.word WHERE n >= 2)
  SELECT word, n, score FROM s WHERE score > 0 ORDER BY score DESC, word LIMIT 8""",
)
def word_association(spark: SparkSession, d: str) -> DataFrame:
    """Words over-represented in the essays."""
    x = docs(spark, d)
    every = C.content(C.token_rows(x, [])).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    near = C.content(C.token_rows(x.filter(F.lower(F.trim("source")) == "essays"), [])).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return C.association(near, every)


@query("html_escaped", """SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.html_escape(F.col("text")).alias("escaped"))


@query("document_hashes", rf"""SELECT doc_id, md5(doc_id || '.txt')[1:10] AS short_id, sha256(text) AS text_hash, sha256('topics|' || lower(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))))[1:32] AS input_hash FROM documents""")
def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.short_id(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("short_id"), F.sha2("text", 256).alias("text_hash"), T.input_hash(F.lit("topics"), F.col("text")).alias("input_hash"))


@query("cloud_cover")
def cloud_cover(spark: SparkSession, d: str) -> DataFrame:
    return S.set_cover(S.paragraphs(docs(spark, d)))


REFLOW_SQL = r"""WITH l AS (SELECT doc_id, text, list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}\x{000B}\x{0085}\x{001C}-\x{001F}]+|[\s\p{Z}\x{000B}\x{0085}\x{001C}-\x{001F}]+$', '', 'g')) AS lines FROM documents),
  u AS (SELECT *, coalesce(list_aggregate(list_filter(list_transform(lines, lambda x: length(x)), lambda n: n > 20), 'median'), 80) AS usual FROM l),
  m AS (SELECT doc_id, text, array_to_string(list_transform(list_filter(lines, lambda x: NOT regexp_matches(x, '^[0-9]{1,4}$')), lambda x: CASE WHEN x = '' THEN chr(1) WHEN length(x) < 0.6 * usual AND regexp_matches(x, '[.!?:"”’)\]]$') THEN x || chr(10) || chr(1) ELSE x END), chr(10)) AS j FROM u),
  h AS (SELECT doc_id, text, replace(regexp_replace(regexp_replace(j, '-\n(\p{Ll})', '\1', 'g'), '\n*\x01[\n\x01]*', chr(1), 'g'), chr(10), ' ') AS j FROM m)
  SELECT doc_id, CASE WHEN text IS NOT NULL THEN replace(regexp_replace(j, '^\x01|\x01$', '', 'g'), chr(1), chr(10) || chr(10)) END AS text FROM h"""


@query("axis_steps", "WITH w AS (SELECT doc_id, greatest(n_chars / 12.0, 1) AS share FROM documents), p AS (SELECT doc_id, share, pow(10, floor(log10(share))) AS power FROM w) SELECT doc_id, CAST(power * CASE WHEN share / power <= 1 THEN 1 WHEN share / power <= 2 THEN 2 WHEN share / power <= 5 THEN 5 ELSE 10 END AS BIGINT) AS step FROM p")
def axis_steps(spark: SparkSession, d: str) -> DataFrame:
    """The step of an axis along each document."""
    return table(spark, d, "documents").select("doc_id", S.axis_step(F.col("n_chars")).alias("step"))


@query("reflowed", REFLOW_SQL)
def reflowed(spark: SparkSession, d: str) -> DataFrame:
    return S.reflow(docs(spark, d))


as_bigint(SQL, "corpus_stats", "total_words", "filtered_words", "unique_filtered", "stopwords_removed")
as_bigint(SQL, "lexicon_topics", "freq")
as_bigint(SQL, "corpus_totals", "characters", "words")
as_bigint(SQL, "quality_notes", "words")
