"""Topics by non-negative factorisation, character clusters, scaling and regression."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# ---------------------------------------------------------------- topics

ROUNDS = 6  # of subspace iteration for the start of a factorisation
TOP_WORDS, TOP_PARAS = 10, 5


class Sparse:
    """A sparse matrix by its entries, as products with thin matrices need it."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.values, self.shape = values, (int(rows.max()) + 1, int(cols.max()) + 1)
        self.by_row, self.by_col = self._sorted(rows, cols), self._sorted(cols, rows)

    def _sorted(self, main: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(main, kind="stable")
        held, first = np.unique(main[order], return_index=True)
        return other[order], self.values[order][:, None], held, first

    @staticmethod
    def _product(side: tuple[np.ndarray, ...], size: int, m: np.ndarray) -> np.ndarray:
        other, values, held, first = side
        out = np.zeros((size, m.shape[1]))
        out[held] = np.add.reduceat(values * m[other], first, axis=0)
        return out

    def dot(self, h: np.ndarray) -> np.ndarray:
        """self @ h"""
        return self._product(self.by_row, self.shape[0], h)

    def tdot(self, w: np.ndarray) -> np.ndarray:
        """self.T @ w"""
        return self._product(self.by_col, self.shape[1], w)


def leading(x: Sparse, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k leading singular vectors and values, by subspace iteration."""
    v = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], k)))[0]
    for _ in range(ROUNDS):
        v = np.linalg.qr(x.tdot(x.dot(v)))[0]
    u, s, turn = np.linalg.svd(x.dot(v), full_matrices=False)
    return u, s, v @ turn.T


def nmf(x: Sparse, k: int, steps: int = 500, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative w (rows by k) and h (columns by k) with x ~ w @ h.T, by multiplicative updates.

    They start from the heavier of the positive and the negative part of each
    pair of singular vectors, and stop when the error falls no further.
    """
    u, s, v = leading(x, k)
    sides = [(np.maximum(u, 0), np.maximum(v, 0)), (np.maximum(-u, 0), np.maximum(-v, 0))]
    weight = np.stack([np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0) for a, b in sides])
    pick = weight.argmax(axis=0)
    w, h = (np.where(pick == 0, sides[0][i], sides[1][i]) for i in (0, 1))
    scale = np.sqrt(s * weight.max(axis=0))
    w, h = (m / np.maximum(np.linalg.norm(m, axis=0), 1e-12) * scale + 1e-4 for m in (w, h))
    whole, first, last = float((x.values**2).sum()), None, None
    for step in range(steps):
        xt = x.tdot(w)
        h *= xt / (h @ (w.T @ w) + 1e-12)
        xh, hh = x.dot(h), h.T @ h
        if step % 10 == 0:
            error = math.sqrt(max(0.0, whole - 2 * float((xh * w).sum()) + float(((w.T @ w) * hh).sum())))
            first = error if first is None else first
            if last is not None and last - error < tolerance * first:
                break
            last = error
        w *= xh / (w @ hh + 1e-12)
    return w, h


def topic_count(pieces: int) -> int:
    return int(max(3, min(8, round(math.sqrt(pieces) / 1.6))))


def counted_terms(chunks: DataFrame, key: str, stopwords: Sequence[str]) -> DataFrame:
    """key, piece_no, para, pieces, word, n: words of three letters or more of each piece, of documents of four pieces or more.

    Rows are dealt out by document once; all counts are then local to a partition.
    """
    numbered = F.row_number().over(Window.partitionBy(key).orderBy("para", "piece")) - 1
    pieces = chunks.repartition(key).withColumn("piece_no", numbered).withColumn("pieces", F.count(F.lit(1)).over(Window.partitionBy(key)))
    words = F.regexp_extract_all(F.lower("chunk"), F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,}(?![\p{L}\p{N}_])"), 0)
    each = pieces.filter("pieces >= 4").select(key, "piece_no", "para", "pieces", F.explode(words).alias("word")).filter(~F.col("word").isin(list(stopwords)))
    return each.groupBy(key, "piece_no", "para", "pieces", "word").agg(F.count(F.lit(1)).alias("n"))


def tfidf_matrix(terms: pd.DataFrame) -> tuple[Sparse | None, np.ndarray]:
    """(matrix of pieces by words, words): sublinear TF-IDF with rows of length 1, of words in at most 0.6 of the pieces (and in two of them, from 20 pieces on)."""
    words, cols = np.unique(terms["word"].to_numpy(dtype=str), return_inverse=True)
    n = int(terms["pieces"].iloc[0]) if len(terms) else 0
    df = np.bincount(cols, minlength=len(words))
    good = (df >= (2 if n >= 20 else 1)) & (df <= 0.6 * n)
    keep = good[cols]
    if not keep.any():
        return None, words[:0]
    rows, at = terms["piece_no"].to_numpy()[keep], cols[keep]
    x = (1 + np.log(terms["n"].to_numpy()[keep])) * (np.log((1 + n) / (1 + df[at])) + 1)
    x /= np.sqrt(np.bincount(rows, x * x))[rows]
    return Sparse(rows, (np.cumsum(good) - 1)[at], x), words[good]


def topics(terms: pd.DataFrame, k: int | None = None) -> list[tuple[int, float, list[str], list[float], list[int]]]:
    """(topic, share, words, their weights, paragraphs) of one document's rows of counted_terms(), largest share first."""
    x, words = tfidf_matrix(terms)
    n = int(terms["pieces"].iloc[0]) if len(terms) else 0
    k = min(k or topic_count(n), n - 1, len(words) - 1)
    if x is None or k < 2:
        return []
    w, h = nmf(x, min(k, *x.shape))
    para_of = dict(zip(terms["piece_no"], terms["para"]))
    shares = w.sum(axis=0) / (w.sum() or 1.0)
    found = []
    for t in sorted(range(w.shape[1]), key=lambda t: -shares[t]):
        best = [j for j in np.lexsort((words, -h[:, t]))[:TOP_WORDS] if h[j, t] > 1e-9]
        loads: dict[int, float] = defaultdict(float)
        for piece, para in para_of.items():
            if piece < len(w):
                loads[para] = max(loads[para], float(w[piece, t]))
        paras = sorted((p for p, v in loads.items() if v > 1e-9), key=lambda p: (-loads[p], p))[:TOP_PARAS]
        if len(best) >= 3:
            found.append((t + 1, round(float(shares[t]), 4), [str(words[j]) for j in best], [round(float(h[j, t]), 4) for j in best], [int(p) for p in paras]))
    return found


def document_topics(chunks: DataFrame, key: str = "doc_id", stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """key, topic, share, words, weights, paras; chunks: key, para, piece, chunk.

    Documents of fewer than four pieces, null and empty chunks and documents
    with too few different words have no topics.  A document's factorisation is
    one task's work; only its non-zero weights are held.
    """

    def work(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(x[key].iloc[0], *r) for r in topics(x)], columns=[key, "topic", "share", "words", "weights", "paras"])

    schema = f"{key} {chunks.schema[key].dataType.simpleString()}, topic int, share double, words array<string>, weights array<double>, paras array<int>"
    return counted_terms(chunks, key, sorted({*stopwords, *english_stopwords()})).groupBy(key).applyInPandas(work, schema)


def english_stopwords() -> list[str]:
    """Spark's own English list."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def known_topics(found: DataFrame, words: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """key, topic, name, related, freq, paras: topics whose words stand in the text, named by their first word.

    words: key, word, freq.  Of each topic the first ``most`` such words count
    and at least three are needed; where a name is taken within the document,
    the second word is added.
    """
    w = Window.partitionBy(key, "topic").orderBy("pos")
    kept = found.select(key, "topic", "paras", F.posexplode("words").alias("pos", "word")).join(words.filter("freq > 0"), [key, "word"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    listed = kept.groupBy(key, "topic").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("s"), F.sum("freq").alias("freq"), F.first("paras").alias("paras")).filter(F.size("s") >= 3)
    related = listed.select(key, "topic", F.transform("s", lambda x: x["word"]).alias("related"), "freq", "paras")
    taken = F.row_number().over(Window.partitionBy(key, F.col("related")[0]).orderBy("topic")) > 1
    return related.withColumn("name", F.when(taken, F.concat_ws(" · ", F.col("related")[0], F.col("related")[1])).otherwise(F.col("related")[0])).select(key, "topic", "name", "related", "freq", "paras")


def proposed_topics(proposals: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, label, name, related, freq of topics that a model proposed, without words that the text lacks and without empty ones.

    proposals: key, answer (JSON: a list ``clusters`` of ``name`` and ``related``; anything else gives no rows); words: key, word, freq.
    """
    shape = "struct<clusters:array<struct<name:string,related:array<string>>>>"
    each = proposals.select(key, F.posexplode(F.from_json("answer", shape)["clusters"]).alias("topic", "c")).select(key, "topic", F.col("c.name").alias("label"), F.posexplode("c.related").alias("pos", "word"))
    kept = each.join(words.filter("freq > 0"), [key, "word"])
    sums = kept.groupBy(key, "topic", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"), F.sum("freq").alias("freq"))
    return sums.select(key, "label", F.col("s")[0]["word"].alias("name"), F.transform("s", lambda x: x["word"]).alias("related"), "freq")


# ---------------------------------------------------------------- characters


def place_names(names: Iterable[tuple[Sequence[str], str | None, str | None]]) -> list[tuple[int, list[int]]]:
    """(cluster, clusters that it may also mean) of each name (parts in lower case, gender, title), in the order given.

    Clusters are found through an index of name parts.  A name of several parts
    joins the first cluster of full names of a gender that isn't another, which
    has all its parts, or only parts of it, or the same first and last part.  A
    single part joins the only cluster of full names that holds it, else the
    cluster of the same single part whose title isn't another; where several
    clusters of full names hold it, it may mean each of them.
    """
    lead: list[tuple[tuple[str, ...], str | None]] = []  # parts and title that a cluster began with
    genders: list[str | None] = []
    holders: dict[str, set[int]] = defaultdict(set)  # by part: clusters of full names
    single: dict[str, list[int]] = defaultdict(list)
    out = []
    for parts, gender, title in names:
        parts = tuple(parts)
        suits = lambda c: None in (gender, genders[c]) or gender == genders[c]  # noqa: B023, E731
        also: list[int] = []
        if len(parts) > 1:
            mine = set(parts)
            met = sorted(c for c in set().union(*(holders[p] for p in mine)) if suits(c))
            home = next((c for c in met if mine <= set(lead[c][0]) or mine >= set(lead[c][0]) or (parts[0], parts[-1]) == (lead[c][0][0], lead[c][0][-1])), None)
        else:
            also = sorted(filter(suits, holders[parts[0]]))
            home = also.pop() if len(also) == 1 else next((c for c in single[parts[0]] if suits(c) and (title is None or lead[c][1] in (None, title))), None)
        if home is None:
            home = len(lead)
            lead.append((parts, title))
            genders.append(None)
            if len(parts) == 1:
                single[parts[0]].append(home)
            out.append((home, also))
        else:
            out.append((home, []))
        genders[home] = genders[home] or gender
        if len(lead[home][0]) > 1:
            for p in parts:
                holders[p].add(home)
    return out


def project_characters(entities: DataFrame, key: str = "project", least: int = 3, head: int = 500, most: int = 40) -> DataFrame:
    """key, canonical, aliases (text, count), count, paras, tokens, ambiguous, candidates, gender: see place_names().

    A project's ``head`` most frequent persons and ``most`` largest clusters
    count (the operator's own limits).  Only the places are found name by name;
    what a cluster holds is added up by Spark.  A single name that mostly stands
    in lower case is noise unless it is frequent.  Null names, counts as 0, null
    paragraphs as none; repeated names are added up.
    """
    from corpusloom.operators.corpus import top

    persons = entities.filter((F.col("label") == "PERSON") & F.col("text").isNotNull() & F.col(key).isNotNull())
    paras = F.array_distinct(F.flatten(F.collect_list(F.coalesce("paras", F.array().cast("array<int>")))))
    merged = persons.groupBy(key, "text").agg(F.sum(F.coalesce("mention_count", F.lit(0))).cast("int").alias("count"), F.sum(F.coalesce("lower_count", F.lit(0))).cast("int").alias("lower"), paras.alias("paras"))
    x = top(merged, [key], head, F.desc("count"), F.asc("text")).withColumn("t", T.title_split(F.col("text"))).select(key, "text", "count", "lower", "paras", "t.core", "t.gender", "t.title")
    noise = (F.size("core") == 1) & F.col("title").isNull() & (F.col("lower") > F.col("count")) & (F.col("count") < 3 * least)
    x = x.filter((F.size("core") > 0) & ~noise)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["core"].map(len)).sort_values(["size", "count", "text"], ascending=[False, False, True]).reset_index(drop=True)
        placed = place_names(([p.lower() for p in core], g or None, t or None) for core, g, t in zip(pdf["core"], pdf["gender"].where(pdf["gender"].notna(), None), pdf["title"].where(pdf["title"].notna(), None)))
        shown: dict[int, str] = {}
        for (c, _), core in zip(placed, pdf["core"]):
            shown.setdefault(c, " ".join(core))
        return pdf.assign(cluster=[c for c, _ in placed], at=range(len(pdf)), candidates=[[shown[a] for a in also] for _, also in placed])[[key, "cluster", "at", "text", "count", "paras", "core", "gender", "candidates"]]

    schema = f"{key} string, cluster int, at int, text string, count int, paras array<int>, core array<string>, gender string, candidates array<string>"
    placed = x.groupBy(key).applyInPandas(work, schema)
    lower = F.transform(F.flatten(F.collect_list("core")), F.lower)
    alias = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "at", "text")))
    clusters = placed.groupBy(key, "cluster").agg(
        F.sum("count").cast("int").alias("count"), alias.alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("paras")))).alias("paras"), F.array_sort(F.array_distinct(lower)).alias("tokens"),
        F.min_by("core", "at").alias("core"), F.min_by("candidates", "at").alias("candidates"), F.min_by("gender", F.when(F.col("gender").isNotNull(), F.col("at"))).alias("gender"),
    ).filter(F.col("count") >= least)
    largest = top(clusters, [key], most, F.desc("count"), F.asc("cluster"))
    name = F.when(F.size("core") > 1, F.array_join("core", " ")).otherwise(F.col("names")[0]["text"])
    again = F.row_number().over(Window.partitionBy(key, "name").orderBy(F.desc("count"), "cluster"))
    return largest.withColumn("name", name).withColumn("again", again).select(
        key,
        F.when(F.col("again") > 1, F.concat("name", F.lit(" ("), F.col("again").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("canonical"),
        F.transform("names", lambda n: F.struct(n["text"].alias("text"), (-n["n"]).alias("count"))).alias("aliases"),
        "count", "paras", "tokens", (F.size("candidates") > 0).alias("ambiguous"), "candidates", "gender",
    )


def may_merge(a: Sequence[str], b: Sequence[str], others: Iterable[Sequence[str]]) -> bool:
    """Whether two clusters with these name parts can mean one person.

    Full names only if one holds the other; else if they share a part, or if
    one is a single part that no other cluster uses (a nickname).
    """
    x, y = set(a), set(b)
    if min(len(x), len(y)) > 1:
        return x <= y or y <= x
    used = set().union(*others)
    return bool(x & y) or any(len(z) == 1 and not z & used for z in (x, y))


def decided_characters(clusters: Sequence[dict], decision: dict, first: int = 12) -> list[dict]:
    """Clusters (name, aliases, freq, paras, tokens, ambiguous) after a model's decision on the ``first`` of them, by number from 1.

    ``discard`` drops those below half of the largest frequency; ``merge``
    joins groups to their most frequent member where may_merge() allows it;
    ``descriptions`` of up to 160 characters are kept.  Numbers that name
    nothing and fields of a wrong type change nothing.
    """
    seen = [dict(c, desc=c.get("desc") or "") for c in clusters]
    shown = seen[:first]
    number = lambda i: type(i) is int and 1 <= i <= len(shown)
    for i, text in (decision.get("descriptions") if isinstance(decision.get("descriptions"), dict) else {}).items():
        clean = text.strip().strip("\"'") if isinstance(text, str) else ""
        if str(i).isdigit() and number(int(i)) and 0 < len(clean) <= 160 and not clean.lower().startswith(("here", "the following")):
            shown[int(i) - 1]["desc"] = clean
    most = max((c["freq"] for c in shown), default=0)
    gone = {i - 1 for i in decision.get("discard") or () if number(i) and 2 * shown[i - 1]["freq"] < most}
    for group in decision.get("merge") or ():
        members = sorted({i - 1 for i in group if number(i)} - gone, key=lambda i: (-shown[i]["freq"], i)) if isinstance(group, list) else []
        for j in members[1:]:
            lead, other = shown[members[0]], shown[j]
            if may_merge(lead["tokens"], other["tokens"], (c["tokens"] for c in seen if c is not lead and c is not other)):
                lead["freq"] += other["freq"]
                for field in ("aliases", "paras", "tokens"):
                    lead[field] = list(dict.fromkeys([*lead[field], *other[field]]))
                lead["paras"].sort()
                lead["ambiguous"] = lead["ambiguous"] and other["ambiguous"]
                lead["desc"] = lead["desc"] or other["desc"]
                gone.add(j)
    return sorted((c for i, c in enumerate(seen) if i not in gone), key=lambda c: -c["freq"])


def related_terms(clusters: DataFrame, tokens: DataFrame, key: str = "project", most: int = 8) -> DataFrame:
    """key, canonical, term, score, rank: words that stand over-often in the paragraphs of a cluster.

    clusters: key, canonical, paras, tokens; tokens: key, para, word.  The score
    is count * ln(share in the paragraphs / share in the whole text), for words
    of three occurrences there (two where those paragraphs have up to 1,500
    words); name parts themselves don't count.
    """
    counts = tokens.groupBy(key, "para", "word").agg(F.count(F.lit(1)).alias("n"))
    freq = counts.groupBy(key, "word").agg(F.sum("n").alias("freq"))
    whole = freq.groupBy(key).agg(F.sum("freq").alias("whole"))
    spans = clusters.select(key, "canonical", F.explode(F.array_distinct("paras")).alias("para"))
    here = spans.join(counts, [key, "para"])
    inside = here.groupBy(key, "canonical", "word").agg(F.sum("n").alias("c"))
    size = inside.groupBy(key, "canonical").agg(F.sum("c").alias("size"))
    x = inside.join(size, [key, "canonical"]).join(freq, [key, "word"]).join(whole, key).join(clusters.select(key, "canonical", "tokens"), [key, "canonical"])
    least = F.when(F.col("size") > 1500, 3).otherwise(2)
    score = F.col("c") * F.log((F.col("c") / F.col("size")) / (F.col("freq") / F.col("whole")))
    x = x.filter((F.col("c") >= least) & (F.col("freq") >= least) & ~F.array_contains("tokens", F.col("word"))).select(key, "canonical", F.col("word").alias("term"), F.round(score, 6).alias("score")).filter("score > 0")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(key, "canonical").orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= most)


# ---------------------------------------------------------------- regression


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean over their population deviation; a constant column becomes 0."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.mean), ("s", F.stddev_pop))])
    x = df.crossJoin(F.broadcast(row))
    return x.select(*[c for c in df.columns if c not in columns], *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in columns])


def linear_fit(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """feature, coefficient of the least-squares fit; one aggregation gives the normal equations, the driver solves them."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = F.col(target).cast("double")
    n = len(cols)
    rows = df.na.drop(subset=[*features, target])
    sums = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(cols[i] * y).alias(f"y{i}") for i in range(n)]).first()
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        b[i] = sums[f"y{i}"] or 0.0
        for j in range(i, n):
            a[i, j] = a[j, i] = sums[f"x{i}_{j}"] or 0.0
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(["intercept", *features], beta)], "feature string, coefficient double")


def predict(df: DataFrame, fit: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with prediction; fit has as many rows as features and one."""
    beta = {r["feature"]: r["coefficient"] for r in fit.collect()}
    p = F.lit(beta["intercept"])
    for f in features:
        p = p + F.lit(beta[f]) * F.col(f)
    return df.withColumn("prediction", p)


def errors(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """n, mae, r2."""
    e = F.col(target) - F.col(prediction)
    n = F.count(e)
    ss = F.sum(e * e)
    return df.agg(n.alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(1 - ss / F.regr_syy(F.col(target), F.col(target)), 6).alias("r2"))
