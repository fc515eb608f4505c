"""Set join, vector join and leak search against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import leaks, sets, vectors


def jaccard(a, b):
    return len(a & b) / len(a | b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=9), min_size=2, max_size=14), st.sampled_from([0.4, 0.6, 0.8]))
def test_probe_equals_brute_force(found, t):
    found = [s for i, s in enumerate(found) if s not in found[:i]]
    often = {w: sum(w in s for s in found) for w in range(13)}
    ranked = [(i, sorted(s, key=lambda w: (often[w], w))) for i, s in enumerate(found)]
    got = set()
    for w in range(13):
        rows = [r for r in ranked if w in r[1][: len(r[1]) - int(-(-len(r[1]) * t // 1) if len(r[1]) * t % 1 else len(r[1]) * t) + 1]]
        got |= {(a, b) for a, b, _ in sets.probe(w, rows, None, t)}
        half = len(rows) // 2
        cross = {(a, b) for a, b, _ in sets.probe(w, rows[:half], rows[half:], t)}
        assert cross <= {(a, b) for a, b, _ in sets.probe(w, rows, None, t)}
    want = {(i, j) for i, j in itertools.combinations(range(len(found)), 2) if jaccard(found[i], found[j]) >= t - 1e-9}
    assert got == want


def test_similar_pairs_with_hot_terms(spark, monkeypatch):
    monkeypatch.setattr(sets, "HOT_ROWS", 5)
    monkeypatch.setattr(sets, "HOT_MEMBERS", 3)
    rng = random.Random(1)
    data = {f"r{i}": {"hot", *(f"w{rng.randrange(12)}" for _ in range(5))} for i in range(60)} | {"copy1": {"hot", "a", "b", "c", "d"}, "copy2": {"hot", "a", "b", "c", "d"}} | {f"more{i}": {"hot", "a", "b", "c", "d"} for i in range(12)} | {f"near{i}": {"hot", "a", "b", "c", "e"} for i in range(7)}
    rows = [(k, [" " + w.upper() + " " for w in v] + [None, " "]) for k, v in data.items()] + [("null", None), ("empty", [])]
    df = spark.createDataFrame(rows + rows[:3], "rec string, raw array<string>").withColumn("terms", sets.term_set(F.col("raw"))).withColumn("cid", F.lit(0))
    got = {tuple(r) for r in sets.similar_pairs(df.select("rec", "terms"), 0.6, 5).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(data), 2) if min(len(data[a]), len(data[b])) >= 5 and jaccard(data[a], data[b]) >= 0.6}
    assert got == want and ("copy1", "copy2") in got
    assert sets.similar_pairs(df.select("rec", "terms").limit(0)).count() == 0


def clustered(rng, n, dim):
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(keys, x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(keys)):
        order = sorted((j for j in range(len(keys)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], keys[j]))[:k]
        out |= {(keys[i], keys[j]) for j in order}
    return out


@pytest.mark.parametrize("hot", [None, 40])
def test_nearest_recall(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(vectors, "HOT_ROWS", hot)
    rng = np.random.default_rng(3)
    x = clustered(rng, 1200, 64)
    x[100:130] = x[100]  # a group of copies, with ties to the smaller keys
    keys = [f"t:{i}" for i in range(len(x))]
    rows = [(k, "m", 64, v.tolist()) for k, v in zip(keys, x)]
    odd = [("t:null", "m", 64, None), ("t:zero", "m", 64, [0.0] * 64), ("t:short", "m", 64, [1.0] * 32), ("t:nan", "m", 64, [float("nan")] * 64), ("t:hole", "m", 64, [None] * 64), ("u:0", "other", 64, x[0].tolist())]
    df = spark.createDataFrame(rows + rows[:2] + odd, "key string, model string, dim int, vec array<float>").withColumn("cosine", F.lit("x"))
    got = {(r["key"], r["other"]) for r in vectors.nearest(df, 5, 0.85).collect()}
    want = brute(keys, x, 5, 0.85)
    assert len(got & want) / len(want) >= 0.97
    assert len(got - want) <= 0.03 * len(want)
    assert {b for a, b in got if a == "t:129"} == {b for a, b in want if a == "t:129"}
    assert vectors.nearest(df.limit(0), 5, 0.85).count() == 0


def test_exact_mode_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT_ROWS", 200)
    x = clustered(np.random.default_rng(8), 700, 24)
    keys = [f"t:{i}" for i in range(len(x))]
    df = spark.createDataFrame([(k, "m", 24, v.tolist()) for k, v in zip(keys, x)], "key string, model string, dim int, vec array<float>")
    assert {(r["key"], r["other"]) for r in vectors.nearest(df, 5, 0.7, exact=True).collect()} == brute(keys, x, 5, 0.7)


def test_models_and_dimensions_do_not_mix(spark, monkeypatch):
    rng = np.random.default_rng(9)
    wide = rng.normal(size=3000)
    rows = [(f"{m}:{d}:{i}", m, d, (wide[:d] * (1 + 0.001 * i)).tolist()) for m in ("a", "b") for d in (3, 64, 3000) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, model string, dim int, vec array<float>")
    for level in (((2,), 2), ((32, 4), 2)):
        monkeypatch.setattr(vectors, "LEVELS", (level,))
        got = {(r["key"], r["other"]) for r in vectors.nearest(df, 5, 0.9).collect()}
        assert got == {(a[0], b[0]) for a in rows for b in rows if a != b and a[1:3] == b[1:3]}


@given(st.integers(1, 7), st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), max_size=60), st.integers(1, 20))
def test_heaps_hold_the_largest(k, pushed, batch):
    heaps, want = vectors.Heaps(4, k), [[] for _ in range(4)]
    for b in range(0, len(pushed), batch):
        part = pushed[b : b + batch]
        heaps.push(np.array([w for w, _ in part], int), np.array([v / 50 for _, v in part], np.float32))
        for w, v in part:
            want[w].append(np.float32(v / 50))
    for row, values in zip(heaps.values, want):
        best = sorted(values, reverse=True)[:k]
        assert sorted((v for v in row if v > -2), reverse=True) == best and row[0] == min(row)


def test_integer_products_are_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-127, 128, (5, 2500)).astype(np.int8) for _ in range(2))
    assert (vectors.products(a.astype(np.float32), b.astype(np.float32)) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_levels_keep_their_recall():
    rng = np.random.default_rng(5)
    x = clustered(rng, 4000, 64)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    top = np.argsort(-s, axis=1)[:, :5]
    pairs = [(i, j) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.85]
    a, b = np.array(pairs).T
    for second, tables in vectors.LEVELS:
        hit = np.zeros(len(a), bool)
        for t in range(tables):
            c = vectors.cells(x, t, second)
            hit |= c[a] == c[b]
        assert hit.mean() >= 0.975, (second, hit.mean())


def test_quantisation_bound_holds():
    x = clustered(np.random.default_rng(7), 300, 96)
    codes, scale, rest = vectors.quantise(x)
    approx = (codes.astype(np.float64) @ codes.T.astype(np.float64)) * scale[:, None] * scale[None, :]
    bound = rest[:, None] * (1 + rest[None, :]) + rest[None, :] * (1 + 1e-6) + 1e-6
    assert (np.abs(approx - x.astype(np.float64) @ x.T.astype(np.float64)) <= bound).all()


WORDS = [a + b for a in "ba ke ti mo lu ra se no".split() for b in "lor dan mix vet pus gan rit sol".split()]


def sentence(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(9)) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n)]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(sentence(rng, rng.randrange(20, 45)))) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        body = sentence(rng, 120)
        if d % 3 == 0:
            i, text = items[rng.randrange(30)]
            words = text.split()
            n = rng.choice([6, 9, 13, 18])
            at = rng.randrange(len(words) - n + 1)
            part = words[at : at + n]
            if n == 18:
                part[9] = "changed"
            if n >= 13:
                want.add((d, i))
            shown = [("<b>" + w.upper() + "</b>,") if rng.random() < 0.2 else w for w in part]
            body[50:50] = shown
        docs.append((d, ("\n" if d % 2 else " ").join(body)))
    docs += [(900, None), (901, ""), (902, "word " * 300_000)]
    df = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("item_id", F.lit(0))
    it = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    got = {tuple(r) for r in leaks.matches(df, it, 12).collect()}
    assert got == want
    assert {tuple(r) for r in leaks.matches(df, it, 12, part_chars=500).collect()} == want
    assert leaks.matches(df.limit(0), it).count() == 0 and leaks.matches(df, it.limit(0)).count() == 0


def test_instructions_do_not_count():
    items = [(1, "Read this. One two."), (2, "Read this. Three four."), (3, "Alone here. Five.")]
    assert leaks.strip_instructions(items) == [(1, "One two."), (2, "Three four."), (3, "Alone here. Five.")]


@pytest.mark.parametrize("b, found", [("x a b c d e f g h i j k l y", True), ("a b c d e f g h i j k", False), ("a b c d e f X h i j k l", True), ("a b X d e f X h i j k l", False), ("a b c d e f h i j k l m", True)])
def test_passage(b, found):
    assert leaks.passage([w.encode() for w in "a b c d e f g h i j k l m".split()], [w.encode() for w in b.split()], 12) is found


def test_passage_after_many_changed_runs():
    a = [b"%d" % i for i in range(40)]
    for runs in range(9):
        b = [b"x" if i < 3 * runs and i % 3 == 2 or i == 3 * runs + 7 else w for i, w in enumerate(a)][: 3 * runs + 15]
        assert leaks.passage(a, b, 12), runs


@pytest.mark.parametrize("n", [12, 13])
def test_passage_with_one_changed_word(n):
    a = [b"%d" % i for i in range(n)]
    assert [k for k in range(1, n - 1) if not leaks.passage(a, [b"x" if i == k else w for i, w in enumerate(a)], 12)] == []


def test_lemma_holds_for_short_and_long_words():
    rng = random.Random(5)
    assert leaks.clean_run(12) == 6
    for letters in (1, 2, 3, 7):
        words = ["".join(rng.choice("abcdefghij") for _ in range(letters)) for _ in range(40)]
        need = leaks.lemma([len(w) for w in words], 12)
        for at in range(28):
            for change in range(1, 11):
                part = words[at : at + 12]
                runs = [part[:change], part[change + 1 :]]
                assert max(sum(map(len, r)) + len(r) + 1 - leaks.Q + 1 for r in runs) >= need or need == 1


@pytest.mark.parametrize("letters", [2, 3, 8])
def test_one_changed_word_anywhere_is_found(spark, letters):
    rng = random.Random(letters)
    words = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters))) for _ in range(40)]
    docs = []
    for k in range(1, 11):
        part = words[5:17]
        part[k] = "zzz"
        docs.append((k, "before it all " + " ".join(part) + " after it all"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = leaks.matches(df, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"), 12)
    assert {r["doc_id"] for r in got.collect()} == set(range(1, 11))


def all_chains(a, b, least):
    """passage() without dropping anything."""
    best = {}
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] != b[j]:
                continue
            chains = {(i, 0)}
            for (p, q), before in list(best.items()):
                x, y = i - p - 1, j - q - 1
                if 0 <= x <= 4 and 0 <= y <= 4:
                    chains |= {(s, c + max(x, y)) for s, c in before if c + max(x, y) <= len(a)}
            if any(i + 1 - s >= least and 10 * c <= i + 1 - s for s, c in chains):
                return True
            best[i, j] = chains
    return False


@settings(max_examples=80, deadline=None)
@given(st.integers(12, 26), st.lists(st.tuples(st.integers(0, 25), st.sampled_from(["change", "drop", "add"])), max_size=5))
def test_passage_equals_all_chains(n, edits):
    a = [b"%d" % i for i in range(n)]
    b = list(a)
    for at, kind in edits:
        if kind == "change":
            b[at % len(b)] = b"x"
        elif kind == "add":
            b.insert(at % len(b), b"x")
        else:
            del b[at % len(b)]
    assert leaks.passage(a, b, 12) is all_chains(a, b, 12)


def test_stream_joins_hyphens():
    raw = np.frombuffer("the salt-stained, half‑burnt ob-\nject's “end”".encode(), np.uint8)
    assert bytes(leaks.stream(raw)[0]).split() == [b"the", b"saltstained", b"halfburnt", b"objects", b"end"]
    assert pa.array([1]) is not None
