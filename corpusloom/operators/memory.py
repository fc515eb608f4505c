"""Corrections, feedback, caches and the question pipeline.

State is a table; each operator takes the table and returns the new one, to be
written as a new version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators.retrieval import nearest
from corpusloom.operators.tabular import newest
from corpusloom.session import cut


def corrected(corrections: DataFrame, query: Sequence[float], least: float = 0.85) -> DataFrame:
    """The stored answer whose question is closest to the query, if it is close enough; ties to the smaller id."""
    s = V.cosine(F.col("question_embedding"), F.array(*[F.lit(float(x)) for x in query]))
    x = corrections.filter(F.size("question_embedding") == len(query)).withColumn("score", s).filter(F.col("score") >= least)
    return x.orderBy(F.desc("score"), "correction_id").limit(1).select("correction_id", "question", "correct_answer", F.round("score", 6).alias("score"))


def keep_recent(table: DataFrame, keys: Sequence[str], by: str, keep: int) -> DataFrame:
    """Retention: the newest ``keep`` rows of each key."""
    return newest(table, keys, by, keep)


def record(feedback: DataFrame, most: int = 600) -> tuple[DataFrame, DataFrame]:
    """(accepted rows clipped to ``most`` characters, rejected rows with a reason)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (
        F.when(~F.coalesce(F.col("action").isin("accept", "edit", "reject"), F.lit(False)), "action must be accept, edit or reject")
        .when(blank("task") | blank("input_text"), "task and input are required")
        .when((F.col("action") != "reject") & blank("final_text"), "final text is required")
    )
    x = feedback.withColumn("reason", reason)
    good = x.filter("reason is null").drop("reason")
    for c in ("input_text", "output_text", "final_text"):
        good = good.withColumn(c, F.substring(F.trim(F.col(c)), 1, most))
    return good.withColumn("ihash", T.input_hash(F.col("task"), F.col("input_text"))), x.filter("reason is not null")


def overrides(feedback: DataFrame) -> DataFrame:
    """project, task, ihash, text, edited: the newest judgement of each input, where it accepts or edits."""
    last = newest(feedback, ["project", "task", "ihash"], "id")
    return last.filter(F.col("action").isin("accept", "edit") & (F.coalesce("final_text", F.lit("")) != "")).select("project", "task", "ihash", F.col("final_text").alias("text"), (F.col("action") == "edit").alias("edited"))


def examples(feedback: DataFrame, project: str, task: str, ihash: str, query: Sequence[float] | None = None, limit: int = 3, recent: int = 200) -> DataFrame:
    """input_text, final_text, edited, score: earlier answers to learn from.

    Of the newest accepted or edited rows, one for each answer, scored by
    similarity (0.5 where unknown), recency and a bonus for edits.
    """
    x = feedback.filter((F.col("project") == project) & (F.col("task") == task) & F.col("action").isin("accept", "edit")).orderBy(F.desc("id")).limit(recent)
    x = x.filter((F.col("ihash") != ihash) & (F.coalesce("final_text", F.lit("")) != ""))
    w = Window.partitionBy("project")  # at most ``recent`` rows
    x = x.withColumn("i", F.row_number().over(w.orderBy(F.desc("id"))) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    x = newest(x, ["final_text"], "id")
    sim = F.lit(0.5)
    if query is not None:
        q = F.array(*[F.lit(float(v)) for v in query])
        sim = F.when(F.size("vec") == len(query), F.coalesce(V.dot(F.col("vec"), q), F.lit(0.5))).otherwise(0.5)
    score = sim + 0.1 * (1 - F.col("i") / F.col("n")) + F.when(F.col("action") == "edit", 0.08).otherwise(0.0)
    return x.select("id", T.clip(F.col("input_text"), 300).alias("input_text"), T.clip(F.col("final_text"), 300).alias("final_text"), (F.col("action") == "edit").alias("edited"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(limit)


def rejects(feedback: DataFrame, most: int = 2) -> DataFrame:
    """project, task, ihash, id, output_text: the newest rejected answers of each input, to be avoided."""
    return newest(feedback.filter(F.lower("action") == "reject"), ["project", "task", "ihash"], "id", most).select("project", "task", "ihash", "id", "output_text")


def add_corrections(store: DataFrame, rows: DataFrame, most: int = 1000, order: str = "correction_id") -> DataFrame:
    """The store with rows added; beyond ``most`` the oldest go first (the store's own limit)."""
    both = store.unionByName(rows, allowMissingColumns=True)
    return both.orderBy(F.desc(order)).limit(most)


def delete_correction(store: DataFrame, index: int, order: str = "correction_id") -> DataFrame:
    """The store (of bounded size) without its row at an index, the oldest at 0; an index out of range deletes nothing."""
    kept = store.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) - 1)
    return kept.filter(F.col("_at") != index).drop("_at")


def clear_corrections(store: DataFrame) -> DataFrame:
    return store.filter(F.lit(False))


def cached(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests answered from the cache, those that aren't); empty answers aren't cached."""
    good = cache.filter(F.coalesce("answer", F.lit("")) != "").select(key, "answer")
    return requests.join(good, key), requests.join(good.select(key), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of equal keys replaced."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def prompts(hits: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, context: numbered texts joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return hits.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s[text])), "\n\n").alias("context"))


def answer(
    questions: DataFrame,
    corrections: DataFrame,
    chunks: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    k: int = 3,
    memory: float = 0.85,
    threshold: float = 0.3,
    retries: int = 2,
) -> DataFrame:
    """question_id, answer, path: memory, else retrieval, else the model alone; answers that fail the critic are tried again.

    questions: question_id, question, vec: a stated set, compared with all
    corrections and, where those have no answer, with all chunks; see
    retrieval.nearest().  model and fallback take (question_id, question,
    context) and add answer and verdict (the critic's words).
    """
    q = questions.select("question_id", "question", F.col("vec").alias("qv"))
    known = cut(nearest(q, corrections, "question_embedding", ["correct_answer"], 1, memory).select("question_id", F.col("correct_answer").alias("answer"), F.array(F.lit("memory")).alias("path")))
    open_ = q.join(known, "question_id", "left_anti")
    context = prompts(nearest(open_, chunks, "vec", ["text"], k, threshold), "question_id", "r", "text")
    todo = open_.join(context, "question_id", "left").select("question_id", "question", "context", F.when(F.col("context").isNull(), F.array(F.lit("model"))).otherwise(F.array(F.lit("retrieval"))).alias("path"))
    done = known
    for turn in range(retries + 1):
        f = model if turn == 0 or fallback is None else fallback
        tried = cut(f(todo))
        last = turn == retries
        passed = T.critique_passes(F.col("verdict"))
        ok = tried if last else tried.filter(passed)
        mark = F.when(passed, F.col("path")).otherwise(F.concat("path", F.array(F.lit("unverified"))))
        done = done.union(ok.select("question_id", "answer", mark.alias("path")))
        if last:
            break
        todo = tried.filter(~passed).select("question_id", "question", "context", F.concat("path", F.array(F.lit(f"retry {turn + 1}"))).alias("path"))
    return done
