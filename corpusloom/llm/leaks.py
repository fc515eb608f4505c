"""Passages of evaluation items in documents: q-gram lemma filtering and banded alignment.

Method.  Texts become streams of lower-case words with one separator.  The
items' character q-grams are indexed by position.  Each document is scanned
for places where q-grams of the items are dense; their hits are counted in
diagonal bands that overlap by half.  A band counts if it holds as many q-grams
as the q-gram lemma demands of that very item, by the lengths of its words and
the edit budget (lemma()), and is verified by aligning its words with the
item's: a sparse alignment, which visits the equal words of the band only.

The index is broadcast a part at a time: ``matches`` cuts the items into parts
of at most ``part_chars`` characters, scans once a part and drops its index
before the next, so that memory stays bounded however many items there are.

Defined results: null and empty texts hold nothing; the first sentence of an
item doesn't count where several items begin with it (an instruction); items
of fewer than ``least_words`` words never match; rows repeated under one id
count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

Q = 12  # characters of a q-gram
BAND = 32  # diagonals of a band; bands overlap by half
DENSE, WITHIN = 8, 96  # a place counts if so many of this many characters begin a q-gram of the items; fewer if the lemma allows an item fewer
BITS = 22
CHUNK = 2_000_000  # bytes scanned at once
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEP = 32


def clean_run(least: int) -> int:
    """Words of the longest unchanged run that a passage of ``least`` words or more has for certain.

    c changed words need max(least, 10 c) words and cut them into c + 1 runs.
    """
    return min(-(-(max(least, 10 * c) - c) // (c + 1)) for c in range(least + 1))


def lemma(sizes: list[int], least: int, q: int = Q) -> int:
    """Least number of q-grams that a passage of ``least`` words of an item shares with its changed copy on one diagonal.

    sizes: the lengths of the item's words.  That is the least that any run of
    clean_run() words has, with the separators around it; 1 at least, as
    shorter ones share none for certain.
    """
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n + 1)
    run = clean_run(least)
    return max(1, min((ends[i + run] - ends[i] + 1 - q + 1 for i in range(len(sizes) - run + 1)), default=1))


def plain(text: Column) -> Column:
    """Lower case, without tags and entities, words broken by a hyphen at a line end joined."""
    x = F.lower(text)
    x = F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, r"</?[a-z][^<>]{0,200}>|<!--.{0,200}?-->", " ")).otherwise(x)
    x = F.when(F.contains(x, F.lit("&")), F.regexp_replace(F.regexp_replace(x, r"&(#0?39|apos|rsquo|lsquo);", "'"), r"&(#?[a-z0-9]{2,8});", " ")).otherwise(x)
    return F.when(F.contains(x, F.lit("](")), F.regexp_replace(x, r"\]\([^()\s]{0,300}\)", "] ")).otherwise(x)


# Bytes: 0 separates words, 1 is dropped, others stay.
_CLASS = np.full(256, 2, np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _CLASS[_b] = 0
for _b in b"-'`*_":
    _CLASS[_b] = 1


def stream(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the word stream, their positions in raw) of UTF-8 text in lower case."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    lead = lead[lead < len(raw) - 2]
    a, b, c = raw[lead], raw[lead + 1], raw[lead + 2]
    two = lead[(a == 0xC2) & (b < 0xC0)]  # Latin-1 signs: spaces, quotation marks, soft hyphen
    if len(two):
        soft = raw[two + 1] == 0xAD
        for at, code in ((two[soft], 1), (two[~soft], 0)):
            kind[at] = kind[at + 1] = code
    three = lead[(a == 0xE2) & (b == 0x80)]  # general punctuation
    if len(three):
        z = raw[three + 2]
        drop = (z == 0x90) | (z == 0x91) | (z == 0x98) | (z == 0x99) | (z <= 0x8F) & (z >= 0x8B)  # hyphens, apostrophes, zero width
        for at, code in ((three[drop], 1), (three[~drop], 0)):
            kind[at] = kind[at + 1] = kind[at + 2] = code
    hyphen = np.flatnonzero((raw[:-1] == 45) & (raw[1:] == 10)) if len(raw) > 1 else np.zeros(0, int)
    if len(hyphen):  # a word broken at the line end
        ok = hyphen[(hyphen > 0)]
        ok = ok[_CLASS[raw[ok - 1]] == 2]
        kind[ok + 1] = 1
    at = np.flatnonzero(kind != 1)
    text = raw[at].copy()
    sep = kind[at] == 0
    text[sep] = SEP
    keep = np.ones(len(at), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    return text[keep], at[keep]


def _grams(text: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each position."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(text)
    first = np.ndarray(n, np.dtype("<u8"), data, 0, (1,))
    rest = np.ndarray(n, np.dtype("<u4"), data, 8, (1,))
    h = first * K1
    h ^= rest.astype(np.uint64) * K2
    h ^= h >> np.uint64(29)
    h *= K1
    return h


class Index:
    """Positions of the items' q-grams, and the items' words."""

    def __init__(self, items: list[tuple[int, str]], least_words: int):
        self.least_words = least_words
        items = [x for x in items if len(bytes(stream(np.frombuffer((" " + x[1] + "  ").encode(), np.uint8))[0]).split()) >= least_words]
        self.ids = [i for i, _ in items]
        self.words: list[list[bytes]] = []
        self.starts: list[np.ndarray] = []
        hashes, where, which = [], [], []
        for k, (_, text) in enumerate(items):
            s = stream(np.frombuffer((" " + text + "  ").encode(), np.uint8))[0]
            self.words.append(bytes(s).split())
            self.starts.append(np.flatnonzero((s[:-1] == SEP) & (s[1:] != SEP)) + 1 if len(s) > 1 else np.zeros(0, int))
            h = _grams(s)
            hashes.append(h)
            where.append(np.arange(len(h), dtype=np.int32))
            which.append(np.full(len(h), k, np.int32))
        self.shared = np.array([lemma([len(w) for w in ws], least_words) for ws in self.words] or [1])
        self.dense = min(DENSE, int(self.shared.min()))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, self.begin = np.unique(h[order], return_index=True)
        self.begin = np.append(self.begin, len(h))
        self.where = (np.concatenate(where) if where else np.zeros(0, np.int32))[order]
        self.which = (np.concatenate(which) if which else np.zeros(0, np.int32))[order]
        self.held = np.zeros(1 << BITS, bool)
        self.held[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def scan(self, raw: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(number of the text, item id) of each passage in texts that end at ``ends`` of raw, a newline after each."""
        s, at = stream(raw)
        h = _grams(s)
        if not len(h) or not len(self.keys):
            return []
        hit = self.held[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        places = np.flatnonzero(hit)
        if not len(places):
            return []
        lo, hi = np.maximum(places - WITHIN // 2, 0), np.minimum(places + WITHIN // 2, len(h))
        places = places[total[hi] - total[lo] >= self.dense]
        key = np.searchsorted(self.keys, h[places])
        key[key == len(self.keys)] = 0
        real = self.keys[key] == h[places]
        places, key = places[real], key[real]
        if not len(places):
            return []
        text_of = np.searchsorted(ends, at[places], side="right")
        n = self.begin[key + 1] - self.begin[key]
        found: set[tuple[int, int]] = set()
        # expand the hits of a few texts at a time: the postings of common q-grams are many
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // 4_000_000)) + 1).tolist(), len(places)]
        cand: list[np.ndarray] = []
        for b, e in zip(cuts[:-1], cuts[1:]):
            rep = np.repeat(np.arange(b, e), n[b:e])
            if not len(rep):
                continue
            off = np.arange(len(rep)) - np.repeat(np.cumsum(n[b:e]) - n[b:e], n[b:e])
            post = self.begin[key[rep]] + off
            item = self.which[post].astype(np.int64)
            diag = places[rep] - self.where[post] + (1 << 20)
            for shift in (0, BAND // 2):
                code = (item << 40) | ((diag + shift) // BAND) * 2 + (shift > 0)
                codes, count = np.unique(code, return_counts=True)
                codes = codes[count >= self.shared[codes >> 40]]
                if len(codes):
                    ok = np.isin(code, codes)
                    cand.append(np.stack([item[ok], places[rep[ok]], self.where[post[ok]], text_of[rep[ok]]], axis=1))
        if not cand:
            return []
        c = np.concatenate(cand)
        pair = c[:, 3] * len(self.ids) + c[:, 0]
        order = np.argsort(pair, kind="stable")
        c, pair = c[order], pair[order]
        edge = np.flatnonzero(np.r_[True, np.diff(pair) != 0, True])
        word_at = np.flatnonzero(np.r_[s[0] != SEP, (s[:-1] == SEP) & (s[1:] != SEP)])
        for x, y in zip(edge[:-1], edge[1:]):
            item, text = int(c[x, 0]), int(c[x, 3])
            if self.aligned(s, word_at, item, c[x:y, 1], c[x:y, 2], text, ends, at):
                found.add((text, self.ids[item]))
        return sorted(found)

    def aligned(self, s: np.ndarray, word_at: np.ndarray, item: int, where: np.ndarray, there: np.ndarray, text: int, ends: np.ndarray, at: np.ndarray) -> bool:
        """Whether the words around the hits hold a passage of the item: runs of equal words, chained within the band."""
        mine = self.words[item]
        begin = np.searchsorted(at, ends[text - 1] if text else 0)
        end = np.searchsorted(at, ends[text])
        for d in _clusters(where - there):
            near = where[np.abs(where - there - d) <= 2 * BAND]
            lo, hi = max(begin, near.min() - 2 * BAND), min(end, near.max() + 2 * BAND + Q)
            i, j = np.searchsorted(word_at, (lo, hi))
            first = word_at[i] if i < len(word_at) else hi
            theirs = bytes(s[first:hi]).split()
            if passage(mine, theirs, self.least_words):
                return True
        return False


def _clusters(diags: np.ndarray) -> list[int]:
    """Representative diagonals, a band or more apart."""
    d = np.unique(diags)
    groups = np.split(d, np.flatnonzero(np.diff(d) > BAND) + 1)
    return [int(g[len(g) // 2]) for g in groups]


def passage(a: list[bytes], b: list[bytes], least: int) -> bool:
    """Whether b holds ``least`` running words of a, at most one changed in ten, ends included.

    Maximal runs of equal words are chained; a gap costs the larger number of
    words that it skips on either side.  A chain is dropped only where another
    starts no later at no more cost, or where the rest of a can't make up for
    its cost; so no more than a tenth of a's words remain at a run.  Gaps of
    2 * least / 9 words or more need no chain: a passage with a gap of g words
    has 9 g others or more, and so a side of ``least`` words that is a passage.
    """
    gap = -(-2 * least // 9) + 1
    at: dict[bytes, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    # chains that end before a place in (a, b): (start in a, changed words so far)
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, w in enumerate(a):
        for j in at.get(w, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 1
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                return True
            chains = [(i, 0)]
            for x in range(gap):
                for y in range(gap):
                    chains += [(start, cost + max(x, y)) for start, cost in best.get((i - x, j - y), ())]
            chains.sort()
            front: list[tuple[int, int]] = []
            for start, cost in chains:
                if (not front or cost < front[-1][1]) and 10 * cost <= len(a) - start:
                    size = i + n - start
                    if size >= least and 10 * cost <= size:
                        return True
                    front.append((start, cost))
            best[i + n, j + n] = front
    return False


def strip_instructions(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Items without a first sentence that several of them share."""
    first = {}
    for i, text in items:
        m = re.match(r"\s*[^.!?:]*[.!?:]+\s+", text)
        first[i] = m.group(0) if m else ""
    seen: dict[str, int] = {}
    for x in first.values():
        seen[x.strip().lower()] = seen.get(x.strip().lower(), 0) + 1
    return [(i, t[len(first[i]) :] if first[i] and seen[first[i].strip().lower()] > 1 and len(t) > len(first[i]) else t) for i, t in items]


def matches(documents: DataFrame, items: DataFrame, least_words: int = 12, part_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) of each document that holds a passage of an item.

    documents: doc_id, text; items: item_id, text, which the driver reads
    whole (they are held-out material, of bounded size).
    """
    spark = documents.sparkSession
    rows = [(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), plain(F.col("text")).alias("text")).dropDuplicates(["item_id"]).filter("text is not null").sort("item_id").toLocalIterator()]
    rows = strip_instructions(rows)
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in rows:
        if size + len(row[1]) > part_chars and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(row)
        size += len(row[1])
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text")).filter("text is not null")
    out = None
    for part in parts:
        index = spark.sparkContext.broadcast(Index(part, least_words))  # at most part_chars positions

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                texts = batch.column("text")
                begin = 0
                sizes = np.asarray(pa.compute.binary_length(texts)).astype(np.int64)
                edges = np.cumsum(sizes)
                while begin < len(ids):
                    end = max(begin + 1, int(np.searchsorted(edges, (edges[begin - 1] if begin else 0) + CHUNK, side="right")))
                    found = index.value.scan(*_joined(texts.slice(begin, end - begin)))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([int(ids[begin + t]) for t, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], ["doc_id", "item_id"])
                    begin = end

        one = docs.mapInArrow(work, "doc_id long, item_id long")
        if len(parts) > 1:  # one index at a time
            one = cut(one)
            index.unpersist()
        out = one if out is None else out.union(one)
    return out.distinct()


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, two newlines and a sign no item has after each, and their ends."""
    data = [t.encode() + b"\n\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\n" for t in texts.to_pylist()]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(x) for x in data])
