"""Scans, names, reading levels and mixtures on small inputs."""

import math
import os
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import mixing, names, reading, scans

# ---------------------------------------------------------------- scans

CLEAN = ["The statistical transcript explains the vocabulary of every document", "A weighted annotation reduces the similarity of the archive", "Well-known readers prefer the printed catalogue", "Pre- and post-war notes remain in the collection", "The co-editor wrote a long-term plan"]


def test_damages_and_paragraphs(spark):
    rows = [("t", f"c{i}", "x_1.pdf", s + ".") for i, s in enumerate(CLEAN * 3)]
    page = "CHAPTER 2. Blue Window\nThe statis-\ntical transcr1pt explains the\n12\nvocabu¬\nlary of every documcnt. Well-\nknown readers prefer the pre-\nand post-war notes.\n- 14 -"
    rows += [("t", "page", "blue_window_7.pdf", page), ("t", "page", "blue_window_7.pdf", page), ("t", "null", None, None), ("t", "empty", "a.pdf", ""), ("t", "list", None, "Boxes:\n14\n9\n22"), ("t", "year", None, "It stopped working in\n1723.")]
    df = spark.createDataFrame(rows, "src_table string, row_id string, doc string, text string").selectExpr("*", "1 as line_no")
    found = scans.damages(df)
    got = {(r["row_id"], r["line_no"], r["defect"], r["repaired"]) for r in found.collect()}
    assert got == {
        ("page", 0, "header", ""), ("page", 1, "hyphen", "statistical"), ("page", 2, "misread", "transcript"), ("page", 3, "page_number", ""),
        ("page", 4, "hyphen", "vocabulary"), ("page", 5, "misread", "document"), ("page", 5, "hyphen", "well-known"), ("page", 8, "page_number", ""),
    }
    text = {r["row_id"]: r["paragraph"] for r in scans.paragraphs(df, found).collect()}
    assert text["page"] == "The statistical transcript explains the vocabulary of every document. Well-known readers prefer the pre- and post-war notes."
    assert scans.damages(df.limit(0)).count() == 0


def test_copies_and_size_do_not_hide_misread_words(spark):
    page = "Every transcr1pt was\nkept here"
    for copies, times in ((60, 1), (1, 1), (1, 10)):
        rows = [("t", f"c{i}", None, f"{s} {i}") for i, s in enumerate(CLEAN * 20 * times)]
        scanned = [page] * copies + [f"A transcr1pt number {i}\nwas kept" for i in range(2 * times)]
        rows += [("t", f"s{i}", None, s) for i, s in enumerate(scanned)]
        found = scans.damages(spark.createDataFrame(rows, "src_table string, row_id string, doc string, text string"))
        hits = {r["row_id"] for r in found.collect() if r["repaired"] == "transcript"}
        assert hits == {f"s{i}" for i, s in enumerate(scanned) if "transcr1pt" in s}


def test_a_frequent_word_is_no_misread_word(spark):
    rows = [("t", f"c{i}", None, f"the man {i} is old") for i in range(40)] + [("t", f"s{i}", None, f"the map {i}\nis old") for i in range(20)]
    found = scans.damages(spark.createDataFrame(rows, "src_table string, row_id string, doc string, text string"))
    assert [r for r in found.collect() if r["defect"] == "misread"] == []


def test_words_beyond_the_proposals_are_looked_up(spark):
    rows = [("t", f"c{i}", None, f"{s} {i}") for i, s in enumerate(CLEAN * 4)]
    rows += [("t", "three", None, "The sfafisfical note\nis old"), ("t", "broken", None, "The sfafis-\nfical note is old"), ("t", "none", None, "The sfafisficxl note\nis old")]
    found = scans.damages(spark.createDataFrame(rows, "src_table string, row_id string, doc string, text string"))
    got = {(r["row_id"], r["defect"], r["repaired"]) for r in found.collect() if r["repaired"] == "statistical"}
    assert got == {("three", "misread", "statistical"), ("broken", "hyphen", "statistical")}


def test_deletions_of_words_are_never_broadcast(spark):
    noisy = spark.createDataFrame([("word", "transcr1ption", 1), ("word", "docurnent", 1)], "kind string, token string, n long")
    lexicon = spark.createDataFrame([("transcription",), ("document",), ("elsewhere",)], "word string")
    near = scans.near_words(noisy, lexicon)
    assert sorted((r["token"], r["word"]) for r in near.collect()) == [("docurnent", "document"), ("transcr1ption", "transcription")]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_loss_is_that_of_the_cheapest_proposal():
    editor = scans.Editor([("transcr1pt", "transcript"), ("docurnent", "document"), ("firsf", "first")] * 3, ["transcript", "document"])
    for noisy in ("sfatistlcal", "docurnenf", "vvindow", "annotatlon"):
        for word, loss in editor.proposals(noisy, 9_999):
            assert editor.loss(noisy, word, 9) == pytest.approx(loss) or editor.loss(noisy, word, 9) < loss
    assert editor.loss("sfafisfical", "statistical", 2) is None and editor.loss("sfafisfical", "statistical", 3) > 0


def test_without_weights_nothing_is_edited(spark):
    rows = [("t", f"c{i}", "x_1.pdf", s + ".") for i, s in enumerate(CLEAN * 3)]
    rows.append(("t", "page", "blue_window_7.pdf", "CHAPTER 2. Blue Window\nThe statis-\ntical transcr1pt explains the\n12\nvocabu¬\nlary of every documcnt."))
    df = spark.createDataFrame(rows, "src_table string, row_id string, doc string, text string")
    assert scans.damages(df).count() == 6 and scans.damages(df, zeroed=True).count() == 0


def test_the_line_model_goes_by_place_and_repetition():
    body = ["The weighted annotation explains the vocabulary of", "every document in the archive that is kept here", "and nothing else reduces it in any way at all."]
    pages = [[f"BLUE WINDOW | Chapter {i}", *body, f"- {i} -"] if i % 2 else [f"{i}", *body[:2], f"Blue Window {i}", body[2]] for i in range(40)] + [["Boxes:", "14", "9", "22", *body] for _ in range(20)]
    examples = [(scans.line_features(p, i, ["blue", "window"]), 3 if k else 1, k) for p in pages for i, k in enumerate(scans.furniture(p, ["blue", "window"])) if scans.is_short(p[i])]
    model = scans.LineModel(examples)
    page = ["J. Author | Notes 3", *body, "Kept where the light is.", "17"]
    kinds = lambda again, title: [model.label(scans.line_features(page, i, title), again if i == 0 else 3 if i == 5 else 1) for i in (0, 4, 5)]
    assert kinds(3, []) == ["header", "", "page_number"] and kinds(1, ["blue", "window"]) == ["", "", "page_number"]
    model.model.weights.clear()
    assert kinds(3, []) == ["", "", ""]


def test_clean_texts_may_have_line_ends(spark):
    rows = [("t", f"c{i}", None, f"{a}.\n\n{b}.") for i, (a, b) in enumerate(zip(CLEAN * 3, CLEAN[1:] * 4))] + [("t", "page", None, "Every transcr1pt was kept and the statis-\ntical note")]
    got = {(r["row_id"], r["repaired"]) for r in scans.damages(spark.createDataFrame(rows, "src_table string, row_id string, doc string, text string")).collect()}
    assert got == {("page", "transcript"), ("page", "statistical")}


@pytest.mark.parametrize("lines, kinds", [(["17", "text here", "xiv"], ["page_number", "", "page_number"]), (["page 3 of 90", "", "a"], ["page_number", "blank", ""]), (["THE BLUE WINDOW   12", "Blue Window — Author", "the blue window is open."], ["header", "header", ""])])
def test_furniture(lines, kinds):
    assert scans.furniture(lines, ["blue", "window"]) == kinds


@given(st.text("abc", min_size=1, max_size=7), st.text("abc", min_size=1, max_size=7))
def test_alignment_rebuilds_the_word(noisy, word):
    assert "".join(scans.align(noisy, word)) == word


def test_editor_learns_an_unlisted_confusion():
    rng = random.Random(0)
    words = ["".join(rng.choice("aeionrstlm") for _ in range(8)) for _ in range(300)]
    pairs = [(w.replace("s", "z", 1), w) for w in words if "s" in w]
    train, held = pairs[:-30], pairs[-30:]
    editor = scans.Editor(train, words[:150])
    hit = sum(w in [p for p, _ in editor.proposals(x)][:12] for x, w in held)
    assert hit >= 0.9 * len(held)


# ---------------------------------------------------------------- names


def test_entities(spark):
    texts = {
        "a": ["Jacqueline Bukorenthal", "Bukorenthal, Jacqueline", "BUKORENTHAL Jacqueline", "Jackie Bukorenthal", "Jacqueline Bukorenthäl's", "J. Bukorenthal", "Dr. Jacqueline Bukorentahl", "JacquelineBukorenthal", "Mx. Bukorenthal"],
        "b": ["Robert Sijigurrand", "R. Sijigurrand", "Bob Sijigurrand"], "c": ["Zachary Sijigurrand", "Z.K. Sijigurrand"],
        "d": ["Dutopistad Museum of Decorative Arts", "The Dutopistad Museum for Decorative Arts", "D.M.D.A.", "Museum of Decorative Arts, Dutopistad", "dutopistad museum of decorative arts"],
        "e": ["Dutopistad University of Decorative Arts"], "alone": ["Sijigurrand"],
    }
    rows, want, i = [], set(), 0
    for key, group in texts.items():
        ids = []
        for t in group:
            rows.append((i, "p", t, "PERSON" if i % 2 else "ORG"))
            ids.append(i)
            i += 1
        want |= {(x, y) for x in ids for y in ids if x < y}
    rows += [(100, "q", "Jacqueline Bukorenthal", "PERSON"), (101, "p", "Jacqueline Bukorenthal", "GPE"), (102, "p", None, "ORG"), (103, None, "X Y", "ORG"), (104, "p", "--", "ORG")]
    df = spark.createDataFrame(rows + rows[:3], "entity_id long, project string, text string, label string").selectExpr("*", "0 as key")
    assert {tuple(r) for r in names.variant_pairs(df).collect()} == want
    assert names.variant_pairs(df.limit(0)).count() == 0


def _linked(spark, texts):
    rows = [(i, "p", t, "PERSON") for i, t in enumerate(texts)]
    return {tuple(sorted((texts[r[0]], texts[r[1]]))) for r in names.variant_pairs(spark.createDataFrame(rows, "entity_id long, project string, text string, label string")).collect()}


def test_short_and_far_misspellings_are_linked(spark):
    texts = ["Robert Kemp", "Robert  Kemp", "R. Kemp", "Robert Kenp", "Zachary Wumozustadberg", "Zachary  Wumozustadberg", "Zachary Wunozustadbeg", "Zachary Wunozuszadbog"]
    got = _linked(spark, texts)
    assert {("Robert Kemp", "Robert Kenp"), ("Zachary Wumozustadberg", "Zachary Wunozustadbeg")} <= got
    assert not any("Zachary Wunozuszadbog" in x for x in got)


def test_all_names_go_through_the_join(spark, monkeypatch):
    texts = ["Robert Kemp", "Kemp, Robert", "R. Kemp", "D.M.D.A.", "DMDA"]
    assert len(_linked(spark, texts)) == 4
    empty = names.similar_cores
    monkeypatch.setattr(names, "similar_cores", lambda cores: empty(cores).limit(0))
    assert _linked(spark, texts) == set()


def test_pairs_of_a_hot_name_are_split(spark, monkeypatch):
    monkeypatch.setattr(names, "HOT_MEMBERS", 7)
    rows = [(i, "p", "Robert Sijigurrand", "PERSON") for i in range(40)]
    got = [tuple(r) for r in names.variant_pairs(spark.createDataFrame(rows, "entity_id long, project string, text string, label string")).collect()]
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


@pytest.mark.parametrize("a, b, yes", [("abcde", "abde", True), ("abcde", "abdce", True), ("abcde", "abxde", True), ("abcde", "axxde", False), ("", "a", True), ("ab", "ba", True)])
def test_near(a, b, yes):
    assert names.near(a, b) is yes and names.near(b, a) is yes


# ---------------------------------------------------------------- reading


def test_levels(spark):
    rng = random.Random(4)
    easy, hard = "the cat sat on a mat and it is red".split(), "epistemological heterogeneity adumbrates historiographical connoisseurship notwithstanding palimpsestic".split()

    def text(level):
        pool, n = (easy, 5) if level == 1 else (easy + hard * 3, 26)
        return " ".join(" ".join(rng.choice(pool) for _ in range(n)).capitalize() + "." for _ in range(8))

    truth = {i: 1 if i % 2 else 4 for i in range(200)}
    docs = [(i, text(v)) for i, v in truth.items()] + [(900, None), (901, " "), (902, "TODO"), (903, "n/a")]
    df = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").dropDuplicates().selectExpr("*", "9 as level")
    labels = spark.createDataFrame([(i, "r", v) for i, v in truth.items() if i < 120] + [(5, "s", None), (777, "s", 2)], "doc_id long, rater string, level int")
    got = {r["doc_id"]: r["level"] for r in reading.levels(df, labels).collect()}
    assert set(got) == set(truth) and sum(got[i] == truth[i] for i in range(120, 200)) >= 76
    assert {r["level"] for r in reading.levels(df, labels.limit(0)).collect()} == {2}
    assert reading.levels(df.limit(0), labels).count() == 0


# ---------------------------------------------------------------- mixtures

needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary here")


@needs_tokenizer
def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(5, 60))), src) for i, src in enumerate(["big"] * 800 + [" BIG "] * 100 + ["mid"] * 150 + ["small"] * 40 + ["other"] * 20)]
    docs += [(5000, None, "big"), (5001, "", "mid"), (5002, "text", None), (5003, "text", " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as tokens")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("gone", 0.05, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, targets)
    uses = m.uses.collect()
    n = Counter(u["doc_id"] for u in uses)
    limit = {"big": 1, "mid": 2, "small": 3}
    assert all(n[u["doc_id"]] <= limit[u["source"]] for u in uses) and len({(u["doc_id"], u["use"]) for u in uses}) == len(uses)
    shares = {r["source"]: r for r in m.shares().collect()}
    assert shares["gone"]["reached_share"] == 0 and sum(r["reached_share"] for r in shares.values()) == pytest.approx(1)
    for k, t in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert shares[k]["reached_share"] == pytest.approx(t / 0.95, abs=0.01)
    tokens = Counter()
    for u in uses:
        tokens[u["source"]] += u["tokens"]
    assert all(tokens[k] <= limit[k] * m.tokens[k] for k in tokens)
    # a size that the targets can't have: weights move towards the natural shares, and no document is used too often
    large = mixing.Mixture(df, targets, total=int(sum(m.tokens.values())))
    assert max(Counter(u["doc_id"] for u in large.uses.collect()).values()) <= 3 and large.weights["small"] < 0.15 / 0.95
    assert mixing.Mixture(df.limit(0), targets).uses.count() == 0


def test_weights():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    for goal in (0.9, 1.0, 1.09):
        assert mixing.entropy(mixing.tempered(shares, goal)) == pytest.approx(goal, abs=1e-6)
    assert mixing.tempered(shares, 9.9)["a"] == pytest.approx(1 / 3, abs=1e-6)
    assert mixing.mixture_weights({"a": 10}, {}, {}, 5) == {} and mixing.largest_total({}, {}, {}) == 0
    w = mixing.mixture_weights({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 60)
    assert w["b"] * 60 <= 20 * (1 + 1e-6) and w["b"] * 60 > 19.9 and math.isclose(sum(w.values()), 1)
