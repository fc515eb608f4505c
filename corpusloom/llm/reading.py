"""Reading level of documents: familiar words and sentence length.

Method.  The high-frequency list of each language is the head of its words by
document frequency over the whole corpus.  A document's measures are the share
of its words outside heads of several lengths, and the length of its sentences
(mean, median and quartiles); a softmax regression trained here on a bounded
sample of rated documents (``label_rows``) turns them into a level.

Defined results: null, blank and stub texts (no full sentence) get no row;
labels without a level and labels of missing documents are left out; with no
label at all every document gets ``default_level``; rows repeated under one id
count once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.pairs import function_words

HEADS = (25, 50, 100, 150, 200, 300, 400, 600)  # lengths of the familiar lists
LEVELS = 4
LABEL_ROWS = 40_000  # labels that the model is trained on, at most
FLUSH = 200_000  # words counted before a worker hands its counts on
LANGUAGES = ("en", "de", "fr", "es", "other")
Hints = dict[str, frozenset[str]]

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|\n+")
_FULL = re.compile(r"[.!?…][\"”»)\]]*\s*$")
RUNNING_WORDS = 8  # a line of so many words is a sentence even without a full stop


def language_of(words: set[str], hints: Hints) -> str:
    """The language with most of its function words among the words."""
    best, most = "other", 0
    for lang, known in hints.items():
        n = len(words & known)
        if n > most:
            best, most = lang, n
    return best


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        if t:
            yield i, t.lower()


def document_frequencies(documents: DataFrame, hints: Hints) -> DataFrame:
    """(lang, word, df): documents of each language that hold the word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[str]] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            langs, words, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "df"])

        for batch in batches:
            for _, text in _texts(batch):
                words = set(_WORD.findall(text))
                counts[language_of(words, hints)].update(words)
            if sum(map(len, counts.values())) > FLUSH:
                yield flush()
        yield flush()

    return documents.select("doc_id", "text").mapInArrow(work, "lang string, word string, df long").groupBy("lang", "word").agg(F.sum("df").alias("df"))


def familiar(documents: DataFrame, hints: Hints, length: int = HEADS[-1]) -> dict[str, dict[str, int]]:
    """Rank of each of the ``length`` words of a language found in most documents (a bounded list)."""
    w = Window.partitionBy("lang").orderBy(F.desc("df"), "word")
    head = document_frequencies(documents, hints).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= length).collect()
    ranks: dict[str, dict[str, int]] = defaultdict(dict)
    for row in head:
        ranks[row["lang"]][row["word"]] = row["r"] - 1
    return dict(ranks)


def sentences(text: str) -> list[list[str]]:
    """The words of each full sentence."""
    out = []
    for s in _SENTENCE.split(text):
        words = _WORD.findall(s)
        if (len(words) >= 2 and _FULL.search(s)) or len(words) >= RUNNING_WORDS:
            out.append(words)
    return out


def measures(texts: Iterator[tuple[int, str]], ranks: dict[str, dict[str, int]], hints: Hints) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ids, language numbers, measures) of the texts that have a full sentence."""
    ids: list[int] = []
    langs: list[int] = []
    lengths: list[int] = []
    per_doc: list[int] = []
    rank: list[int] = []
    for i, text in texts:
        found = sentences(text)
        if not found:
            continue
        words = [w for s in found for w in s]
        lang = language_of(set(words), hints)
        get = ranks.get(lang, {}).get
        rank += [get(w, 1 << 20) for w in words]
        lengths += map(len, found)
        per_doc.append(len(found))
        ids.append(i)
        langs.append(LANGUAGES.index(lang))
    if not ids:
        return [], np.zeros(0, int), np.zeros((0, 4 + len(HEADS)))
    n, r, docs = np.array(lengths), np.array(rank), np.array(per_doc)
    of = np.repeat(np.arange(len(docs)), docs)
    words = np.bincount(of, n)
    word_of = np.repeat(of, n)
    outside = [np.bincount(word_of, r >= k, len(docs)) / words for k in HEADS]
    order = np.lexsort((n, of))
    begin = np.cumsum(docs) - docs

    def quantile(q: float) -> np.ndarray:
        return n[order][begin + ((docs - 1) * q + 0.5).astype(int)]

    return ids, np.array(langs), np.stack([words / docs, quantile(0.25), quantile(0.5), quantile(0.75), *outside], axis=1)


class Model:
    """Softmax regression over the measures, with terms of their own for each language."""

    def __init__(self, langs: np.ndarray, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 600):
        self.mean, self.size = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(langs, x)
        n, d = z.shape
        w, m, v = np.zeros((d, LEVELS)), np.zeros((d, LEVELS)), np.zeros((d, LEVELS))
        want = np.eye(LEVELS)[y]
        for k in range(1, steps + 1):
            p = z @ w
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = z.T @ (p - want) / n + penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.weights = w

    def _design(self, langs: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.size
        own = np.eye(len(LANGUAGES))[langs]
        return np.concatenate([np.ones((len(z), 1)), z, own, (own[:, :, None] * z[:, None, :]).reshape(len(z), -1)], axis=1)

    def levels(self, langs: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (self._design(langs, x) @ self.weights).argmax(axis=1) + 1


def train(documents: DataFrame, labels: DataFrame, ranks: dict[str, dict[str, int]], hints: Hints, label_rows: int = LABEL_ROWS) -> Model | None:
    """A model of at most label_rows labels (doc_id, level); None without labels."""
    rows = labels.filter(F.col("level").between(1, LEVELS)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("level").cast("int").alias("level"))
    rated = rows.orderBy(F.xxhash64("doc_id", "level"), "doc_id").limit(label_rows).collect()
    if not rated:
        return None
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(i,) for i in {r["doc_id"] for r in rated}], "doc_id long")
    texts = documents.join(F.broadcast(wanted), "doc_id", "left_semi")  # at most label_rows ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, x = measures(_texts(batch), ranks, hints)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "lang", "x"])

    known = {r["doc_id"]: (r["lang"], r["x"]) for r in texts.mapInArrow(work, "doc_id long, lang long, x array<double>").collect()}
    use = sorted((r["doc_id"], r["level"]) for r in rated if r["doc_id"] in known)
    if not use:
        return None
    return Model(np.array([known[i][0] for i, _ in use]), np.array([known[i][1] for i, _ in use]), np.array([y - 1 for _, y in use]))


def levels(documents: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, default_level: int = 2) -> DataFrame:
    """(doc_id, level) of each document with a full sentence; documents: doc_id, text; labels: doc_id, level."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hints = function_words()
    ranks = familiar(docs, hints)
    model = train(docs, labels, ranks, hints, label_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, x = measures(_texts(batch), ranks, hints)
            y = model.levels(langs, x) if model and len(ids) else np.full(len(ids), default_level)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32())], ["doc_id", "level"])

    return docs.mapInArrow(work, "doc_id long, level int")
