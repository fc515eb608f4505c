"""Corpus operators: tokens, frequencies, TF-IDF, statistics, n-grams, keyword in context.

Documents have an id column and a text column.  Null and empty texts have no
tokens; they still count as documents where a number of documents is used.
Ties in rankings go to the token that comes first, then to the smaller token.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def token_rows(df: DataFrame, keys: Sequence[str], text: str = "text", tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """keys, pos (from 0), word."""
    return df.select(*keys, F.posexplode(tokenizer(F.col(text))).alias("pos", "word"))


def content(tokens: DataFrame, least: int = 4, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """Tokens of enough letters that aren't stop words."""
    return tokens.filter((F.length("word") >= least) & ~F.col("word").isin(list(stopwords)))


def term_frequency(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, word, n, first."""
    return tokens.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """word, df: one row of tf is one document that holds the word."""
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def top(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def tfidf(df: DataFrame, key: str = "doc_id", text: str = "text", top_n: int = 12, least: int = 4, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """key, term, score, rank: share of the document's tokens times ln((N + 1) / (df + 1)) + 1."""
    tf = term_frequency(content(token_rows(df, [key], text), least, stopwords), [key])
    total = tf.groupBy(key).agg(F.sum("n").alias("total"))
    size = df.agg(F.count(F.lit(1)).alias("docs"))
    idf = document_frequency(tf).crossJoin(F.broadcast(size)).select("word", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    scored = tf.join(idf, "word").join(total, key).withColumn("raw", F.col("n") / F.col("total") * F.col("idf"))
    return top(scored, [key], top_n, F.desc("raw"), F.asc("first")).select(key, F.col("word").alias("term"), F.round("raw", 5).alias("score"), "rank")


def tfidf_l2(df: DataFrame, key: str, text: str = "text", max_share: float = 0.6, least_docs: int = 2) -> DataFrame:
    """key, term, weight: (1 + ln n) * (ln((1 + N) / (1 + df)) + 1), rows of length 1."""
    tf = term_frequency(token_rows(df, [key], text, T.tokens_letters), [key])
    size = df.agg(F.count(F.lit(1)).alias("docs"))
    kept = document_frequency(tf).crossJoin(F.broadcast(size)).filter((F.col("df") >= least_docs) & (F.col("df") <= max_share * F.col("docs")))
    raw = tf.join(kept, "word").select(key, "word", ((1 + F.log("n")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("raw"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, key).select(key, F.col("word").alias("term"), F.round(F.col("raw") / F.col("length"), 6).alias("weight"))


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", stopwords: Sequence[str] = T.STOPWORDS, least: int = 4) -> DataFrame:
    """One row a document: counts of words, sentences and characters, diversity, averages, the longest word."""
    words = token_rows(df, [key], text)
    kept = (F.length("word") >= least) & ~F.col("word").isin(list(stopwords))
    per_word = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).withColumn("kept", kept)
    agg = per_word.groupBy(key).agg(
        F.sum("n").alias("total_words"),
        F.count(F.lit(1)).alias("unique_words"),
        F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("filtered_words"),
        F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("unique_filtered"),
        F.sum(F.when(F.col("kept"), F.col("n") * F.length("word")).otherwise(0)).alias("letters"),
        F.max(F.when(F.col("kept"), F.struct(F.length("word").alias("l"), (-F.col("first")).alias("f"), F.col("word").alias("w")))).alias("longest"),
    )
    base = df.select(key, F.size(T.sentences_after(F.col(text))).alias("total_sentences"), F.length(text).alias("character_count"))
    n, s, k = F.coalesce("total_words", F.lit(0)), F.col("total_sentences"), F.coalesce("filtered_words", F.lit(0))
    return base.join(agg, key, "left").select(
        key,
        n.alias("total_words"),
        F.coalesce("unique_words", F.lit(0)).alias("unique_words"),
        F.when(n > 0, F.round(F.col("unique_words") / n, 3)).otherwise(0.0).alias("vocabulary_diversity"),
        F.greatest(s, F.lit(0)).alias("total_sentences"),
        F.when(s > 0, F.round(n / s, 1)).otherwise(0.0).alias("avg_sentence_length"),
        k.alias("filtered_words"),
        F.coalesce("unique_filtered", F.lit(0)).alias("unique_filtered"),
        (n - k).alias("stopwords_removed"),
        "character_count",
        F.coalesce("longest.w", F.lit("")).alias("longest_word"),
        F.when(k > 0, F.round(F.col("letters") / k, 1)).otherwise(0.0).alias("avg_word_length"),
    )


def readability(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence length, syllables a word, reading ease and its name, density of types."""
    words = T.tokens_accented(F.col(text))
    x = df.select(key, words.alias("w"), F.size(T.sentences(F.col(text))).alias("sentences"))
    n = F.size("w")
    syl = T.total_syllables(F.col("w"))
    asl = F.when(F.col("sentences") > 0, n / F.col("sentences")).otherwise(0.0)
    asw = F.when(n > 0, syl / n).otherwise(0.0)
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * asw))
    return x.filter("w is not null").select(
        key,
        n.alias("words"),
        F.size(F.array_distinct("w")).alias("types"),
        "sentences",
        F.round(asl, 1).alias("avg_sentence_length"),
        F.when(n > 0, F.round(F.size(F.array_distinct("w")) / n * 100, 1)).otherwise(0.0).alias("density"),
        F.round(ease, 0).alias("ease"),
        F.when(ease > 70, "easy").when(ease > 50, "standard").when(ease > 30, "difficult").otherwise("very difficult").alias("readability"),
    )


def ngrams(df: DataFrame, n: int, key: str = "doc_id", text: str = "text", top_n: int = 20, stopwords: Sequence[str] = T.STOPWORDS, least: int = 4) -> DataFrame:
    """The most frequent runs of n content words within a document: ngram, n."""
    words = F.filter(T.tokens(F.col(text)), lambda w: (F.length(w) >= least) & ~w.isin(list(stopwords)))
    x = df.select(key, words.alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return x.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ngram").limit(top_n)


def word_lengths(df: DataFrame, text: str = "text", most: int = 15) -> DataFrame:
    """length (the last one holds all longer words), n."""
    words = df.select(F.explode(T.tokens(F.col(text))).alias("w"))
    return words.groupBy(F.least(F.length("w"), F.lit(most)).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def kwic(df: DataFrame, term: str, key: str = "doc_id", text: str = "text", most: int = 20) -> DataFrame:
    """The first sentences that hold a term, in order of document and place: key, place, sentence."""
    s = df.select(key, F.posexplode(T.sentences_after(F.col(text))).alias("place", "sentence"))
    return s.filter(F.contains(F.lower("sentence"), F.lit(term.lower()))).orderBy(key, "place").limit(most)


def highlight(column: Column, terms: Sequence[str], begin: str = "**", end: str = "**") -> Column:
    """Terms (longest first, any case) between marks."""
    import re

    longest = sorted(set(terms), key=lambda t: (-len(t), t))
    return F.regexp_replace(column, "(?i)(" + "|".join(re.escape(t) for t in longest) + ")", f"{begin}$1{end}")


def association(near: DataFrame, everywhere: DataFrame, least: int = 2, top_n: int = 8) -> DataFrame:
    """Words over-represented near something: near(word, n) against everywhere(word, freq)."""
    totals = near.agg(F.sum("n").alias("near_total")).crossJoin(everywhere.agg(F.sum("freq").alias("all_total")))
    x = near.filter(F.col("n") >= least).join(everywhere, "word").crossJoin(F.broadcast(totals))
    score = F.col("n") * F.log((F.col("n") / F.col("near_total")) / (F.col("freq") / F.col("all_total")))
    return x.select("word", "n", F.round(score, 4).alias("score")).filter("score > 0").orderBy(F.desc("score"), "word").limit(top_n)


def lexicon_scores(freq: DataFrame, lexicon: DataFrame, keys: Sequence[str] = (), top_n: int = 6) -> DataFrame:
    """Topics of a lexicon(topic, word) in freq(keys, word, n): keys, topic, freq, related."""
    hit = freq.join(lexicon, "word")  # broadcast by the planner if the lexicon is small
    best = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word")))), 1, top_n), lambda s: s["word"])
    return hit.groupBy(*keys, "topic").agg(F.sum("n").alias("freq"), best.alias("related"))


def language(df: DataFrame, hints: dict[str, Sequence[str]], key: str = "doc_id", text: str = "text", head: int = 20_000) -> DataFrame:
    """key, language: most hint words among the first characters; ties to the smaller name."""
    words = F.regexp_extract_all(F.lower(F.substring(text, 1, head)), F.lit(r"(\p{L}+)"), F.lit(1))
    x = df.select(key, words.alias("w")).filter("w is not null")

    def score(lang: str) -> Column:
        return F.struct((-F.size(F.filter("w", lambda v: v.isin(list(hints[lang]))))).alias("m"), F.lit(lang).alias("language"))

    ordered = F.array_sort(F.array(*map(score, hints)))
    return x.select(key, ordered[0]["language"].alias("language"), (-ordered[0]["m"]).alias("hits"))
