"""All similar pairs between set-valued records: T-occurrence list merging.

Method.  Records with the same set are folded into one class.  Each class is
routed to the inverted lists of the rarest terms of its prefix (a pair that
reaches the threshold shares one of them); the lists are partitioned by that
term, hot terms are spread over pairs of parts.  In a partition every class
probes the lists of its own terms: the longest lists are put aside, the short
ones are merged with a heap that skips to the next id able to occur often
enough, and the ids found are looked up in the long lists by binary search.
A pair is emitted by the rarest term that both sets hold, hence once.

Defined results: null sets and sets below ``least_terms`` take no part; terms
are compared after trimming and lower-casing, null and blank ones dropped;
rows repeated under one record count once; an empty table gives no pairs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import shuffle_partitions

GROUP_ROWS = 20_000  # routed sets of one task's turn, on average
HOT_MEMBERS = 2000  # records of one set whose pairs one task makes
HOT_ROWS = 4000  # classes of one list in one task; longer lists are spread over several
PREFIX = 5  # lists that a set is routed to, on average
EPS = 1e-9


def term_set(terms: Column) -> Column:
    """The distinct terms of an array of strings, trimmed, lower-cased, sorted, without null and blank ones."""
    clean = F.transform(terms, lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != ""))))


def classes_of(records: DataFrame, least_terms: int) -> tuple[DataFrame, DataFrame]:
    """(classes: cid, terms), (members: cid, rec) of records: rec string, terms array<string> as from term_set()."""
    named = records.filter(F.size("terms") >= least_terms).select("rec", "terms", F.xxhash64("terms").alias("cid"))
    return named.select("cid", "terms").groupBy("cid").agg(F.first("terms").alias("terms")), named.select("cid", "rec").distinct()


def _merge_skip(lists: list[np.ndarray], longest: list[np.ndarray], begin: int, need: list[int], least: int) -> list[int]:
    """Positions >= begin that occur in at least need[position] lists, by a heap over the short lists.

    least: the smallest need.  With m long lists put aside, an id must occur
    in least - m short ones; positions that can't are skipped.
    """
    t = least - len(longest)
    at = [bisect_left(x, begin) for x in lists]
    heap = [(x[i], k) for k, (x, i) in enumerate(zip(lists, at)) if i < len(x)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= t:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= t:
            count = len(popped)
            for x in longest:
                if count >= need[top]:
                    break
                i = bisect_left(x, top)
                count += i < len(x) and x[i] == top
            if count >= need[top]:
                out.append(top)
            goal = top + 1
        else:
            while heap and len(popped) < t - 1:  # these lists can't reach t together before the next head
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            goal = heap[0][0]
            goal = max(goal, top + 1)
        for k in popped:
            x = lists[k]
            at[k] = bisect_left(x, goal, at[k])
            if at[k] < len(x):
                heapq.heappush(heap, (x[at[k]], k))
    return out


def _need(n: int, m: int, threshold: float) -> int:
    """Least overlap of sets of n and m terms at a Jaccard threshold."""
    return ceil(threshold / (1 + threshold) * (n + m) - EPS)


def probe(word: int, sets: list[tuple[int, list[int]]], indexed: list[tuple[int, list[int]]] | None, threshold: float) -> list[tuple[int, int, int]]:
    """(cid, cid, overlap) of similar pairs whose rarest common term is ``word``.

    sets probe the inverted lists of ``indexed``, or of themselves if None.
    Terms come rarest first.
    """
    alone = indexed is None
    index = sorted(sets if alone else indexed, key=lambda s: (len(s[1]), s[0]))
    sizes = [len(s[1]) for s in index]
    lists: dict[int, list[int]] = {}
    for i, (_, terms) in enumerate(index):
        for t in terms:
            lists.setdefault(t, []).append(i)
    found = []
    for me, (cid, terms) in enumerate(index if alone else sets):
        n = len(terms)
        begin = me + 1 if alone else bisect_left(sizes, ceil(threshold * n - EPS))
        end = bisect_left(sizes, int(n / threshold + EPS) + 1)
        if begin >= end:
            continue
        need = [_need(n, m, threshold) for m in range(sizes[begin], sizes[end - 1] + 1)]
        low = sizes[begin]
        least = need[0]
        mine = sorted((lists[t] for t in terms if t in lists), key=len)
        if len(mine) < least:
            continue
        aside = min(least - 1, sum(len(x) > 8 * (1 + len(mine[0])) for x in mine))
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        own = None
        for at in _merge_skip(short, long, begin, _Need(sizes, need, low), least):
            if at >= end:
                break
            other, theirs = index[at]
            if other == cid:
                continue
            own = own or set(terms)
            common = [t for t in theirs if t in own]
            if common[0] == word and len(common) >= _need(n, len(theirs), threshold):
                found.append((min(cid, other), max(cid, other), len(common)))
    return found


class _Need:
    """need by position, from need by size."""

    def __init__(self, sizes: list[int], need: list[int], low: int):
        self.sizes, self.need, self.low = sizes, need, low

    def __getitem__(self, at: int) -> int:
        i = self.sizes[at] - self.low
        return self.need[i] if i < len(self.need) else 1 << 30


def similar_classes(classes: DataFrame, threshold: float, rows: int | None = None) -> DataFrame:
    """Pairs (a < b, overlap) of class ids whose sets have a Jaccard similarity of at least ``threshold``.

    rows: an estimate of the number of classes, which decides the number of groups only; counted if None.
    """
    spark = classes.sparkSession
    rows = classes.count() if rows is None else rows
    tokens = classes.select("cid", F.explode("terms").alias("t")).select("cid", F.xxhash64("t").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        tokens.join(often, "t")
        .groupBy("cid")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda s: s["t"]).alias("terms"))
    )
    n = F.size("terms")
    prefix = F.slice("terms", F.lit(1), (n - F.ceil(n * threshold - EPS) + 1).cast("int"))
    routed = ranked.select(F.explode(prefix).alias("word"), "cid", "terms")
    hot = routed.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select("word", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts"))
    placed = (
        routed.join(hot, "word", "left")
        .withColumn("own", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        .select(
            "word",
            F.when(F.col("other") < 0, -1).otherwise(F.least("own", "other")).alias("p"),
            F.when(F.col("other") < 0, -1).otherwise(F.greatest("own", "other")).alias("q"),
            F.when(F.col("other") < 0, -1).otherwise(F.col("own")).alias("own"),
            "cid",
            "terms",
        )
    )
    groups = max(shuffle_partitions(spark) * 4, rows * PREFIX // GROUP_ROWS)
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64("word", "p", "q"), F.lit(groups)).cast("int"))

    def work(data: pa.Table) -> pa.Table:
        word, p, q, own, cid = (data.column(x).to_numpy() for x in ("word", "p", "q", "own", "cid"))
        terms = data.column("terms").combine_chunks()
        order = np.lexsort((q, p, word))
        edge = np.flatnonzero(np.r_[True, (np.diff(word[order]) != 0) | (np.diff(p[order]) != 0) | (np.diff(q[order]) != 0), True])
        out = []
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s < 2:
                continue
            at = order[s:e]
            sets = list(zip(cid[at].tolist(), terms.take(pa.array(at)).to_pylist()))
            if p[at[0]] == q[at[0]]:
                out += probe(int(word[at[0]]), sets, None, threshold)
            else:
                left = own[at] == p[at[0]]
                out += probe(int(word[at[0]]), [x for x, y in zip(sets, left) if y], [x for x, y in zip(sets, left) if not y], threshold)
        a, b, common = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "overlap": pa.array(common, pa.int32())})

    return bucketed.groupBy("bucket").applyInArrow(work, "a long, b long, overlap int")


def similar_pairs(records: DataFrame, threshold: float = 0.6, least_terms: int = 1, rows: int | None = None) -> DataFrame:
    """All pairs (rec_a < rec_b by code point) of records whose sets reach the threshold.

    Pairs of records with the same set count; for a report that stays linear
    in the input use similar_classes() with classes_of(), which keep copies folded.
    """
    classes, members = classes_of(records, least_terms)
    pairs = similar_classes(classes, threshold, rows).select("a", "b")
    # Members in parts of HOT_MEMBERS: pairs of a set of many copies are made part by part, in several tasks.
    parts = members.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / HOT_MEMBERS).cast("int").alias("parts"))
    split = members.join(parts.filter("parts > 1"), "cid", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("rec"), F.col("parts")).cast("int")
    mine = split.select(F.col("cid").alias("a"), F.col("rec").alias("ra"), part.alias("pa"), "parts")
    theirs = split.select(F.col("cid").alias("b"), F.col("rec").alias("rb"), part.alias("pb"))
    each = parts.select("cid", "parts")
    spread = pairs.join(each.select(F.col("cid").alias("a"), F.col("parts").alias("na")), "a").join(each.select(F.col("cid").alias("b"), F.col("parts").alias("nb")), "b")
    spread = spread.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("a", "b", "pa", "pb")
    across = spread.join(mine.drop("parts"), ["a", "pa"]).join(theirs, ["b", "pb"]).select("ra", "rb")
    copies = split.select(F.col("cid").alias("a"), F.col("rec").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pa"))
    same = mine.join(copies, ["a", "pa"]).filter(F.col("ra") < F.col("rb")).select("ra", "rb")
    return across.union(same).select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))
