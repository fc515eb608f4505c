"""Mixing sources to target weights, in tokens of a public tokenizer.

Method.  Token counts give each source's natural share s.  Source weights are
w ~ s * (t / s)**a for target shares t: a = 1 is the target, a = 0 the natural
mixture; a is bisected to the largest value at which no source needs more
repetitions than it may have.  Without targets, w ~ s**a with a bisected to a
target entropy.  Each source's budget is then realised as whole passes over its
documents and one pass over the head of a permutation; each use goes to a block
by its place in the pass, so every block holds the mixture, and has a position
there: in order of block and position the uses are permuted block by block.

Defined results: sources are compared after trimming and lower-casing; null
and blank sources, null and empty texts, and sources without a target are not
used; a target without documents reaches share 0, and the others share its
part; where even a = 0 needs too many repetitions, budgets are cut to what the
repetitions allow and the shares reached are reported as they are.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a rank file that the driver reads and ships with the job
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096  # of the permutation of a source; only one of them is ever sorted
BLOCKS = 64


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def clean_source(source: Column) -> Column:
    x = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.when(x != "", x)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents with a source and a text."""

    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: about a megabyte

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean_source(F.col("source")).alias("source"), "text")
    return rows.filter("source is not null and text is not null and text <> ''").mapInArrow(work, "doc_id long, source string, tokens long").filter("tokens > 0")


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def normal(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total else weights


def bisect(good: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The largest x in [low, high] that is good, where smaller ones are."""
    if good(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def tempered(shares: dict[str, float], target_entropy: float) -> dict[str, float]:
    """w ~ s**a with the entropy wanted (between that of a = 1 and the uniform one)."""
    most = math.log(max(1, sum(s > 0 for s in shares.values())))
    goal = min(target_entropy, most)
    a = bisect(lambda x: entropy(normal({k: s**x for k, s in shares.items() if s > 0})) >= goal - 1e-12, 0.0, 8.0)
    return normal({k: s**a for k, s in shares.items() if s > 0})


def largest_total(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest size at which all targets with documents can be met exactly."""
    t = normal({k: x for k, x in targets.items() if tokens.get(k) and x > 0 and repeats.get(k, 0) > 0})
    return int(min((repeats[k] * tokens[k] / x for k, x in t.items()), default=0))


def mixture_weights(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Weights on the way from natural to target shares, as far as the repetitions allow at this size."""
    live = {k: n for k, n in tokens.items() if n > 0 and targets.get(k, 0) > 0 and repeats.get(k, 0) > 0}
    s, t = normal({k: float(n) for k, n in live.items()}), normal({k: targets[k] for k in live})

    def weights(a: float) -> dict[str, float]:
        return normal({k: s[k] * (t[k] / s[k]) ** a for k in live})

    if not live:
        return {}
    return weights(bisect(lambda a: all(w * total <= repeats[k] * live[k] * (1 + 1e-9) for k, w in weights(a).items()), 0.0, 1.0))


class Mixture:
    """A mixture: ``uses`` (one row a use of a document) and ``shares`` (one row a source)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 7, blocks: int = BLOCKS):
        spark = documents.sparkSession
        rows = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").collect()  # settings: one row a source
        self.targets = {r["source"]: float(r["target_share"] or 0) for r in rows}
        self.repeats = {r["source"]: int(r["max_repeats"] or 0) for r in rows}
        counted = cut(token_counts(documents, tokenizer))
        sizes = counted.join(F.broadcast(spark.createDataFrame([(k,) for k in self.targets] or [("",)], "source string")), "source", "left_semi")
        self.tokens = {r["source"]: int(r["n"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
        self.total = largest_total(self.tokens, self.targets, self.repeats) if total is None else total
        self.weights = mixture_weights(self.tokens, self.targets, self.repeats, self.total)
        plan = []
        for k, w in self.weights.items():
            budget = min(w * self.total, float(self.repeats[k] * self.tokens[k]))
            whole = min(int(budget / self.tokens[k] + 1e-9), self.repeats[k])
            plan.append((k, budget, whole, max(0.0, budget - whole * self.tokens[k]), budget / self.tokens[k]))
        budgets = spark.createDataFrame(plan, "source string, budget double, whole int, rest double, passes double")
        self.uses = self._uses(sizes, budgets, seed, blocks)

    def _uses(self, sizes: DataFrame, budgets: DataFrame, seed: int, blocks: int) -> DataFrame:
        place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 32))
        docs = sizes.join(F.broadcast(budgets), "source").withColumn("place", place).withColumn("bucket", F.floor(F.col("place") / ((1 << 32) // BUCKETS)).cast("int"))
        # Head of the permutation: whole buckets by the sums before them, and the one that the budget cuts by a running sum.
        sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        edges = before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"), "n")
        placed = docs.join(edges, ["source", "bucket"])
        inside = F.col("before") + F.col("n") <= F.col("rest")
        cutting = (~inside) & (F.col("before") < F.col("rest"))
        run = F.sum("tokens").over(Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        head = placed.filter(cutting).withColumn("run", F.col("before") + F.coalesce(run, F.lit(0))).filter(F.col("run") + F.col("tokens") / 2 <= F.col("rest"))
        cols = ["doc_id", "source", "tokens", "place", "passes"]
        once = placed.filter(inside).select(*cols, F.col("whole").alias("turn")).union(head.select(*cols, F.col("whole").alias("turn")))
        rounds = docs.filter("whole > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("turn"))
        # each pass has a permutation of its own; the last is the one whose head is taken
        mixed = F.when(F.col("turn") * 1.0 + 1 <= F.col("passes"), F.pmod(F.xxhash64("place", "turn"), F.lit(1 << 32))).otherwise(F.col("place"))
        at = (F.col("turn") + mixed / (1 << 32)) / F.col("passes")
        block = F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("int")
        order = F.xxhash64("doc_id", "turn", F.lit(seed + 1)).alias("position")
        return rounds.union(once).select(block.alias("block"), order, "doc_id", "source", (F.col("turn") + 1).alias("use"), "tokens")

    def shares(self) -> DataFrame:
        """source, target_share, weight, available_tokens, reached_tokens, reached_share, documents, most_uses."""
        spark = self.uses.sparkSession
        asked = spark.createDataFrame(
            [(k, t, self.weights.get(k, 0.0), self.tokens.get(k, 0), self.repeats[k]) for k, t in self.targets.items()],
            "source string, target_share double, weight double, available_tokens long, max_repeats int",
        )
        got = self.uses.groupBy("source").agg(F.sum("tokens").alias("reached_tokens"), F.count_distinct("doc_id").alias("documents"), F.max("use").alias("most_uses"))
        total = F.sum("reached_tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as sources
        return (
            asked.join(got, "source", "left")
            .na.fill(0, ["reached_tokens", "documents", "most_uses"])
            .withColumn("reached_share", F.when(total > 0, F.col("reached_tokens") / total).otherwise(0.0))
        )
