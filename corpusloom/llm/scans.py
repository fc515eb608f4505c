"""Noise in text from scanned pages: furniture, broken words, misread words.

Method.  Averaged perceptrons trained here make every edit.  A line model tells
page furniture (running headers, page numbers) by where a line stands on its
page (lines from its start and end, what stands beside it), how it looks, and
in how many texts of the document it stands again.  A character editor predicts
for each character of a suspicious word to keep, replace, delete or insert, and
for each line end after a hyphen to join the word, with or without the hyphen,
or not.  Only operations that it has learned are open to it; without weights
nothing is edited.  Its cheapest results are looked up in the lexicon by a
join, and the cheapest that is a word is the repair; words none of whose first
results is one are looked up among all near words of the lexicon, at the
editor's price.

Lexicon: the words of texts whose line ends, if any, all end a sentence.

Training, on bounded samples: ``train_words`` suspicious words aligned with the
only nearest word of the lexicon, as many words of the lexicon and line ends
made by breaking them, as many of the corpus's own line ends whose word the
lexicon settles, and ``train_lines`` short lines labelled by what furniture()
can be sure of.  ``common_words`` bounds the part of the lexicon that the
workers hold to skip frequent words at once; all others go through the join.

Defined results: null and empty texts, and texts without a line break, have no
rows; rows repeated under one id count once; equal findings on one line are
one row; a null document name leaves a header only its place and its repetition.
"""

from __future__ import annotations

import heapq
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut, dealt

COMMON_WORDS = 20_000
TRAIN_WORDS = 2_000
TRAIN_LINES = 8_000
LEXICON_LEAST = 2  # times that a word of the lexicon occurs in unbroken texts
FLUSH = 200_000
PROPOSALS = 60  # cheapest results of the editor that are looked up first; words without a hit are looked up among all words near them
CHANGES = 3  # of a word looked up that way
SHARE = 0.1  # a misread form isn't more frequent than this share of the word that it should be, as far as its count can tell
EPOCHS = 25  # of the line model
LINE_WORDS = 8  # a running header or page number has no more words
BREAK = "\x1f"  # between the parts of a broken word
KEEP, JOIN, HYPHEN = "=", "join", "hyphen"  # operations of the editor; any other is what a character becomes

HYPHENS = "-­‐‑¬"
_EDGE = ".,;:!?¡¿\"“”„«»‹›()[]{}…—–*_`'’‘|<>/\\"


def bare(token: str) -> str:
    """A token in lower case without punctuation around it."""
    return token.lower().strip(_EDGE)


def has_letter(token: str) -> bool:
    return any(ch.isalpha() for ch in token)


# ---------------------------------------------------------------- furniture

_NUMBER = re.compile(r"^\W*(?:(?:page|pages|pag|pág|página|p|pg|seite|s|fol|folio|f)\b\.?\s*)?(\d{1,4}|[ivxlc]{1,7})\s*(?:(?:of|/|von|de|sur|aus)\s*\d{1,4}\s*)?\W*$", re.I)
_ROMAN = re.compile(r"^(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_ENDS = re.compile(r"[.!?:;…][\"”»)\]]*$")
_CHAPTER = re.compile(r"\b(?:chapter|kapitel|chapitre|capítulo|section|part|teil|partie|parte)\s*(?:\d+|[ivxlc]+)\b\.?", re.I)


def title_words(doc: str | None) -> list[str]:
    """The words of a document's name, without its number and ending."""
    if not doc:
        return []
    return [w.lower() for w in re.findall(r"[^\W\d_]+", doc.rsplit(".", 1)[0].rsplit("/", 1)[-1])]


@lru_cache(maxsize=1 << 17)
def _close(a: str, b: str) -> bool:
    """Whether a may be b with a few characters misread."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or len(b) < 4:
        return False
    return distance(a, b, 2) <= (1 if len(b) < 7 else 2)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        last = row
    return last[-1]


def is_header(line: str, title: list[str]) -> bool:
    """A line that holds the title and little else: a number, a chapter, an author."""
    if not title:
        return False
    rest = _CHAPTER.sub(" ", line)
    words = re.findall(r"[^\W_]+(?:[!@|][^\W_]+)*", rest.lower())
    words = [w for w in words if not w.isdigit()]
    n = len(title)
    if not n <= len(words) <= n + 3 or (_ENDS.search(line.strip()) and len(words) > n + 1):
        return False
    for i in range(len(words) - n + 1):
        pairs = list(zip(words[i : i + n], title))
        if all(_close(w, t) for w, t in pairs) or (any(w == t for w, t in pairs) and sum(distance(w, t, 4) for w, t in pairs) <= 3):
            left = words[:i] + words[i + n :]
            return all(w in ("the", "a", "der", "die", "das", "le", "la", "les", "el", "los", "of", "by", "von", "de", "par", "por") for w in left) or bool(re.search(r"[—–|:·•-]\s*\S+\s*\S*\s*$", line)) or len(left) <= 1
    return False


def furniture(lines: list[str], title: list[str]) -> list[str]:
    """What can be told of each line by the document's name and its neighbours, to train the line model: 'header', 'page_number', 'blank' or ''."""
    kinds = []
    numbers = [bool(_is_number(x)) for x in lines]
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            kinds.append("blank")
        elif is_header(text, title):
            kinds.append("header")
        elif numbers[i]:
            before = lines[i - 1].strip() if i else ""
            listed = (i > 0 and numbers[i - 1]) or (i + 1 < len(lines) and numbers[i + 1]) or before.endswith(":")
            year = re.fullmatch(r"\W*(1\d{3}|20\d{2})[.,;)]*", text) and before and not _ENDS.search(before)
            kinds.append("" if listed or year else "page_number")
        else:
            kinds.append("")
    return kinds


@lru_cache(maxsize=1 << 14)
def _is_number(line: str) -> bool:
    m = _NUMBER.match(line.strip())
    return bool(m) and (m[1].isdigit() or bool(_ROMAN.match(m[1])))


def unbroken(text: str) -> bool:
    """Whether every line end of a text ends a sentence: no scanned page."""
    return all(not x.strip() or _ENDS.search(x.strip()) for x in text.split("\n")[:-1])


def repeated_form(line: str) -> str:
    """A line without its numbers, case and marks, as it stands again on other pages."""
    return "#" if _is_number(line) else " ".join(re.findall(r"[^\W\d_]+", line.lower()))


_LINE_WORD = re.compile(r"[^\W_]+(?:[!@|][^\W_]+)*")
_YEAR = re.compile(r"\W*(1\d{3}|20\d{2})[.,;)]*")
_MARK = re.compile("[|·—–•]")


class Page:
    """The lines of a text, with where each stands among those that aren't blank."""

    def __init__(self, text: str, title: list[str]):
        self.lines, self.title = lines_of(text), title
        self.filled = [k for k, x in enumerate(self.lines) if x.strip()]
        self.place = {k: n for n, k in enumerate(self.filled)}
        self.usual = sorted(len(self.lines[k]) for k in self.filled)[len(self.filled) // 2] if self.filled else 0
        self.headers: dict[int, bool] = {}

    def beside(self, place: int) -> str:
        return self.lines[self.filled[place]].strip() if 0 <= place < len(self.filled) else ""

    def header(self, place: int) -> bool:
        """Whether the line at a place holds the title and little else."""
        if place not in self.headers:
            line = self.beside(place)
            self.headers[place] = is_short(line) and is_header(line, self.title)
        return self.headers[place]

    def features(self, i: int) -> list[str]:
        """Place and looks of a short line."""
        line, first = self.lines[i].strip(), self.place[i]
        last = len(self.filled) - 1 - first
        words = _LINE_WORD.findall(line.lower())
        before, after = self.beside(first - 1), self.beside(first + 1)
        number = _is_number(line)
        near = sum(any(_close(w, t) for w in words) for t in self.title)
        letters = [ch for ch in line if ch.isalpha()]
        beside = "N" if _is_number(before) or _is_number(after) else "C" if before.endswith(":") else "_"
        runs = "H" if first and self.header(first - 1) else bool(before) and not _ENDS.search(before)  # a sentence is open where the line stands
        goes = bool(after) and (after[:1].islower() or after[:1].isdigit())
        kind = "n" if number else "t"
        stop = bool(_ENDS.search(line))
        out = [
            kind, f"{kind}first{min(first, 2)}", f"{kind}last{min(last, 2)}", f"{kind}page{min(len(self.filled), 3)}", f"{kind}beside{beside}", f"{kind}runs{runs}{goes}", f"{kind}edge{first == 0 or last == 0}{runs}{goes}", f"year{bool(_YEAR.fullmatch(line))}{runs}",
            f"{kind}words{min(len(words), LINE_WORDS)}", f"short{4 * len(line) < 3 * self.usual}", f"caps{bool(letters) and all(c.isupper() for c in letters)}", f"named{all(w[:1].isupper() for w in line.split())}",
            f"stop{stop}", f"mark{bool(_MARK.search(line))}", f"digits{any(c.isdigit() for c in line)}{number}", f"chapter{bool(_CHAPTER.search(line))}",
        ]
        if self.title:
            held = "all" if near == len(self.title) else "some" if near else "none"
            alone = len(words) - near
            return out + [f"title{held}", f"title{held}{min(alone, 4)}", f"title{held}{stop}{min(alone, 2)}", f"titled{self.header(first)}"]
        return untitled(out)


def line_features(lines: list[str], i: int, title: list[str]) -> list[str]:
    """Place and looks of a short line, see Page."""
    return Page("\n".join(lines), title).features(i)


class LineModel:
    """header, page_number or '' for a short line, by an averaged perceptron."""

    LABELS = ("", "header", "page_number")

    def __init__(self, examples: list[tuple[list[str], int, str]]):
        known = [(tuple(self.joined(f, n)), label) for f, n, label in examples]
        # a third again without what the document's name tells, for texts without one
        rng = random.Random(7)
        known += [(tuple(self.joined(untitled(f), n)), label) for f, n, label in examples if rng.random() < 1 / 3]
        distinct = sorted(set(known))
        rng.shuffle(distinct)
        self.model = Perceptron().train([(list(f), label, list(self.LABELS)) for f, label in distinct], EPOCHS)

    @staticmethod
    def joined(features: list[str], repeats: int) -> list[str]:
        mark = "u" if features[0].startswith("u") else ""
        return [*features, f"{mark}again{min(repeats, 3)}"]

    def label(self, features: list[str], repeats: int) -> str:
        f = self.joined(features, repeats)
        return max(self.LABELS, key=lambda x: (self.model.score(f, x), x == ""))


def untitled(features: list[str]) -> list[str]:
    """The features of a line without what the document's name tells, apart from those of titled ones."""
    return ["u" + x for x in features if not x.startswith("title")]


class Perceptron:
    """Averaged perceptron over sparse features; the labels that compete come with each example."""

    def __init__(self) -> None:
        self.weights: dict[tuple, float] = {}

    def score(self, features: Iterable[str], label: str) -> float:
        get = self.weights.get
        return sum(get((f, label), 0.0) for f in features)

    def train(self, examples: list[tuple[list[str], str, list[str]]], epochs: int = 4) -> "Perceptron":
        total: dict[tuple, float] = defaultdict(float)
        at: dict[tuple, int] = {}
        w: dict[tuple, float] = defaultdict(float)
        step = 0

        def add(key: tuple, by: float) -> None:
            total[key] += w[key] * (step - at.get(key, 0))
            at[key] = step
            w[key] += by

        for _ in range(epochs):
            for features, label, rivals in examples:
                step += 1
                best = max(rivals, key=lambda r: (sum(w[f, r] for f in features), r != label, r))  # a label must win alone
                if best != label:
                    for f in features:
                        add((f, label), 1.0)
                        add((f, best), -1.0)
        for key in list(w):
            add(key, 0.0)
        self.weights = {k: v / max(1, step) for k, v in total.items() if v}
        return self


def align(noisy: str, word: str) -> list[str]:
    """What each character of the noisy word becomes: itself, another, nothing, or more than one character."""
    n, m = len(noisy), len(word)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                cost[i][j] = min(cost[i - 1][j - 1] + 2 * (noisy[i - 1] != word[j - 1]), cost[i - 1][j] + 2, cost[i][j - 1] + 2)
            else:
                cost[i][j] = 2 * (i + j)
    out = [""] * n
    i, j = n, m
    tail = ""
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + 2 * (noisy[i - 1] != word[j - 1]) and not (noisy[i - 1] != word[j - 1] and cost[i][j] == cost[i - 1][j] + 2):
            out[i - 1] = word[j - 1] + tail
            tail = ""
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 2:
            out[i - 1] = tail
            tail = ""
            i -= 1
        else:
            tail = word[j - 1] + tail
            j -= 1
    if tail and n:
        out[0] = tail + out[0]
    return out


def _around(word: str, i: int) -> list[str]:
    p = "^^" + word + "$$"
    k = i + 2
    return ["b", "c" + p[k], "l" + p[k - 1 : k + 1], "r" + p[k : k + 2], "w" + p[k - 1 : k + 2], "L" + p[k - 2 : k + 1], "R" + p[k : k + 3], "n" + p[k - 1] + p[k + 1]]


class Editor:
    """Edits a noisy word: each character is kept, replaced, deleted or followed by an insertion, a line end joined or not.

    An operation is open for a character only where training gave it weight.
    """

    def __init__(self, pairs: list[tuple[str, str]], words: list[str], ends: Iterable[tuple[str, str, str, str, str]] = ()):
        aligned = [(noisy, align(noisy, word)) for noisy, word in pairs]
        seen = Counter((ch, op) for noisy, ops in aligned for ch, op in zip(noisy, ops) if op != ch)
        # a pair far apart may be of two words by chance: its operations must stand elsewhere too
        changed = [[(ch, op) for ch, op in zip(noisy, ops) if op != ch] for noisy, ops in aligned]
        edits = [x for x, c in zip(aligned, changed) if len(c) < 2 or all(seen[y] > 1 for y in c)] + [(w, list(w)) for w in words]
        rivals: dict[str, dict[str, None]] = defaultdict(dict)
        for word, ops in edits:
            for ch, op in zip(word, ops):
                if op != ch:
                    rivals[ch][op] = None
        examples = []
        for word, ops in edits:
            for i, (ch, op) in enumerate(zip(word, ops)):
                if ch in rivals:
                    examples.append((_around(word, i), KEEP if op == ch else op, [KEEP, *rivals[ch]]))
        examples += [(self.end_features(a, sign, b, flags), label, [KEEP, JOIN, HYPHEN]) for a, sign, b, flags, label in ends]
        self.model = Perceptron().train(examples)
        self.learn()

    def learn(self) -> None:
        """The operations open for each character: those that carry weight."""
        self.options: dict[str, list[str]] = defaultdict(list)
        for f, op in sorted(self.model.weights):
            if f[0] == "c" and op not in (KEEP, JOIN, HYPHEN):
                self.options[f[1:]].append(op)

    def changes(self, noisy: str) -> list[tuple[float, int, str]]:
        """(loss, place, what the character becomes) of each open operation, cheapest first."""
        out = []
        for i, ch in enumerate(noisy):
            if rivals := self.options.get(ch):
                around = _around(noisy, i)
                keep = self.model.score(around, KEEP)
                out += [(1.0 + max(0.0, keep - self.model.score(around, op)), i, op) for op in rivals]
        return sorted(out)

    def proposals(self, noisy: str, most: int = PROPOSALS) -> list[tuple[str, float]]:
        """(word, loss) of the ``most`` cheapest edits of a word, itself first at no loss."""
        whole = unicodedata.normalize("NFKC", noisy)  # ligatures
        out = {noisy: 0.0}
        if whole != noisy:
            out[whole] = 0.5
        changes = self.changes(whole)
        heap: list[tuple[float, tuple[int, ...]]] = [(changes[0][0], (0,))] if changes else []
        while heap and len(out) < most:  # sets of changes in order of their loss
            loss, chosen = heapq.heappop(heap)
            nxt = chosen[-1] + 1
            places = {changes[c][1] for c in chosen}
            if nxt < len(changes):
                heapq.heappush(heap, (loss - changes[chosen[-1]][0] + changes[nxt][0], (*chosen[:-1], nxt)))
            if len(places) < len(chosen):  # two changes of one character
                continue
            letters = list(whole)
            for c in chosen:
                letters[changes[c][1]] = changes[c][2]
            if word := "".join(letters):
                out.setdefault(word, loss)
            if nxt < len(changes):
                heapq.heappush(heap, (loss + changes[nxt][0], (*chosen, nxt)))
        return sorted(out.items(), key=lambda x: (x[1], x[0]))

    def loss(self, noisy: str, word: str, most: int = CHANGES) -> float | None:
        """The least loss of turning a noisy word into this word by up to ``most`` changes, if open operations can."""
        noisy = unicodedata.normalize("NFKC", noisy)
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}  # (place in word, changes), loss
        for i, ch in enumerate(noisy):
            after: dict[tuple[int, int], float] = {}
            rivals = self.options.get(ch, ())
            if rivals:
                around = _around(noisy, i)
                keep = self.model.score(around, KEEP)
                costs = [(op, 1.0 + max(0.0, keep - self.model.score(around, op))) for op in rivals]
            for (j, k), loss in states.items():
                steps = [((j + 1, k), loss)] if word.startswith(ch, j) else []
                if rivals and k < most:
                    steps += [((j + len(op), k + 1), loss + cost) for op, cost in costs if word.startswith(op, j)]
                for key, x in steps:
                    if x < after.get(key, 1e9):
                        after[key] = x
            states = after
        return min((x for (j, _), x in states.items() if j == len(word)), default=None)

    @staticmethod
    def end_features(a: str, sign: str, b: str, flags: str) -> list[str]:
        """flags: which of a+b, a-b, an edit of a+b, a, a-, b the lexicon has (J, H, E, L, S, R)."""
        return ["|", "|s" + sign, "|a" + a[-1:], "|A" + a[-2:], "|z" + b[:1], "|Z" + b[:2], f"|n{min(len(a), 6)}", f"|m{min(len(b), 6)}", "|x" + a[-1:] + b[:1], "|f" + flags, *("|f" + x for x in flags)]

    def end(self, a: str, sign: str, b: str, flags: str) -> str:
        """JOIN, HYPHEN or KEEP for a line end."""
        f = self.end_features(a, sign, b, flags)
        return max((KEEP, JOIN, HYPHEN), key=lambda x: (self.model.score(f, x), x == KEEP))


FLAGS = "JHELSR"


def flags_of(a: str, b: str, known: Callable[[str], bool], edited: bool) -> str:
    """Flags of a line end, see Editor.end_features()."""
    has = (known(a + b), known(f"{a}-{b}"), edited, known(a), known(a + "-"), known(b))
    return "".join(f for f, x in zip(FLAGS, has) if x)


def made_ends(words: list[str], known: Callable[[str], bool], most: int) -> list[tuple[str, str, str, str, str]]:
    """(a, sign, b, flags, operation) of line ends made from words of the lexicon: broken within, at their hyphen, and after a hanging hyphen."""
    rng = random.Random(7)
    out = []
    plain = [w for w in words if len(w) >= 4 and w.isalpha()]
    for w in words[:most]:
        sign = rng.choice(HYPHENS)
        if w.endswith("-") and len(w) > 2 and plain:
            b = rng.choice(plain[:200])
            a, label = w[:-1], KEEP
        elif "-" in w[1:-1]:
            a, b = w.split("-", 1)
            label = HYPHEN
        elif len(w) >= 4 and w.isalpha():
            k = rng.randrange(2, len(w) - 1)
            a, b, label = w[:k], w[k:], JOIN
        else:
            continue
        flags = flags_of(a, b, known, False)
        if label == JOIN:
            out.append((a, sign, b, "".join(f for f in flags if f != "J") + "E" if rng.random() < 0.3 else flags, label))
        else:
            out += [(a, sign, b, flags, label)] * 3
        if rng.random() < 0.25:  # of a word that the lexicon lacks
            out.append((a, sign, b, "".join(f for f in flags if f in "LSR"), label))
    return out


def depth(word: str) -> int:
    """Edits within which a word without a proposal in the lexicon is looked up: none for short ones, whose changes are all proposed."""
    return 0 if len(word) < 5 else 2 if len(word) < 8 else CHANGES


def forms(kind: str, token: str) -> set[str]:
    """What a finding may stand for before it is edited."""
    return {token.replace(BREAK, "")} if kind == "break" else {token, bare(token)} - {""}


def near_words(missing: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(kind, token, often, form, word) of all lexicon words within depth() edits of a form of a token.

    Words within k edits of each other have a form in common that deletes k characters or less.
    Both sides have hundreds of rows a word, which Spark's estimates don't know, so neither may be broadcast.
    """

    def of_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = ((k, t, n, f, d) for k, t, n in zip(x["kind"], x["token"], x["n"]) for f in forms(k, t) if depth(f) for d in _deletions(f, depth(f)))
            yield from _framed(rows, ["kind", "token", "often", "form", "part"])

    def of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield from _framed(((w, d) for w in x["word"] for d in _deletions(w, depth(w) or 1)), ["word", "part"])

    a = missing.mapInPandas(of_tokens, "kind string, token string, often long, form string, part string").withColumn("part", F.xxhash64("part"))
    b = dealt(lexicon.filter(F.length("word") > 3).select("word")).mapInPandas(of_words, "word string, part string").withColumn("part", F.xxhash64("part"))
    return a.hint("merge").join(b.hint("merge"), "part").select("kind", "token", "often", "form", "word").distinct()


def _framed(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded size."""
    rows = iter(rows)
    while some := list(islice(rows, FLUSH // 4)):
        yield pd.DataFrame(some, columns=columns)


def looked_up(missing: DataFrame, lexicon: DataFrame, model) -> DataFrame:
    """(kind, token, often, word, loss, role) of all near words that the editor's operations lead to."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["loss"] = [model.value.loss(f, w, depth(f)) for f, w in zip(x["form"], x["word"])]
            x = x[x["loss"].notna()]
            yield x.assign(loss=x["loss"].astype(float) + 0.2 * (x["kind"] == "break"), role=0)[["kind", "token", "often", "word", "loss", "role"]]

    return near_words(missing, lexicon).mapInPandas(score, "kind string, token string, often long, word string, loss double, role int")


def training_pairs(noisy: DataFrame, lexicon: DataFrame) -> list[tuple[str, str]]:
    """Suspicious words of a sample with the only nearest word of the lexicon."""
    near = near_words(noisy, lexicon).withColumn("far", F.levenshtein("form", "word")).filter(F.col("far") <= F.when(F.length("form") < 5, 0).when(F.length("form") < 8, 2).otherwise(CHANGES))
    best = near.groupBy("form").agg(F.min(F.struct("far", "word")).alias("w"), F.array_sort(F.collect_list("far")).alias("all"))
    rows = best.filter((F.size("all") == 1) | (F.get("all", F.lit(0)) < F.get("all", F.lit(1)))).select("form", "w.word").collect()
    return sorted((r[0], r[1]) for r in rows if r[0] != r[1])


def _deletions(word: str, depth: int) -> set[str]:
    out = {word}
    layer = {word}
    for _ in range(depth):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


# ---------------------------------------------------------------- pipeline


def lines_of(text: str) -> list[str]:
    return (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text).split("\n")


def is_short(line: str) -> bool:
    """Whether a line may be furniture."""
    return bool(line.strip()) and len(line.split()) <= LINE_WORDS


def findings(text: str, title: list[str], again: dict[int, int], model: LineModel, common: set[str]) -> Iterator[tuple[int, str, str, str]]:
    """(line, kind, token, sign): furniture lines, words not common, and breaks of a word with the sign that ends its line."""
    page = Page(text, title)
    lines = page.lines
    kinds = ["blank" if not x.strip() else model.label(page.features(i), again.get(i, 1)) if is_short(x) else "" for i, x in enumerate(lines)]
    running = [i for i, k in enumerate(kinds) if not k]
    tokens = {i: lines[i].split() for i in running}
    for i, k in enumerate(kinds):
        if k in ("header", "page_number"):
            yield i, k, "", ""
    for at, i in enumerate(running):
        words = tokens[i]
        if not words:
            continue
        last = words[-1]
        if at + 1 < len(running) and len(last) > 1 and last[-1] in HYPHENS and last[-2].isalnum() | (last[-2] in "!@"):
            nxt = tokens[running[at + 1]]
            if nxt:
                a, b = last[:-1].lower().lstrip(_EDGE), nxt[0].lower().rstrip(_EDGE)
                if a and b and b[0].isalnum() | (b[0] in "!@"):
                    yield i, "break", a + BREAK + b, last[-1]
                    words = words[:-1]
                    tokens[running[at + 1]] = nxt[1:]
        for w in words:
            x = bare(w)
            if x and x not in common and has_letter(x):
                low = w.lower()
                if low.strip(_EDGE.replace("!", "").replace("|", "")) != x:
                    x = low.strip(_EDGE.replace("!", "").replace("|", ""))  # the mark may be a misread letter; both forms are proposed
                yield i, "word", x, ""


def lexicon_of(texts: DataFrame) -> DataFrame:
    """(word, n, total): words of the texts that unbroken() holds of, how often they stand there, and in all texts with copies of a text counted once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter[str]] = defaultdict(Counter)  # by the copies that count of unbroken texts
        for x in batches:
            for t, copies in zip(x["text"], x["copies"]):
                counts[(copies if "\n" not in t else 1) if unbroken(t) else 0].update(t.lower().split())
            if sum(map(len, counts.values())) > FLUSH:
                yield from (_counted(c, copies) for copies, c in counts.items())
                counts.clear()
        yield from (_counted(c, copies) for copies, c in counts.items())

    once = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return once.mapInPandas(work, "word string, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter(F.col("n") >= LEXICON_LEAST)


def _counted(counts: Counter, copies: int) -> pd.DataFrame:
    words: Counter[str] = Counter()
    for w, n in counts.items():
        w = bare(w)
        if w and has_letter(w):
            words[w] += n
    x = pd.DataFrame({"word": list(words.keys()), "total": list(words.values())}, columns=["word", "total"]).astype({"word": str, "total": "int64"})
    return x.assign(n=x["total"] * copies)[["word", "n", "total"]]


def pages_of(broken: DataFrame) -> DataFrame:
    """(src_table, row_id, doc, text, again): again has, of short lines that stand in several texts of the document, the line and the number of texts."""

    def short_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(s, r, d, h, i, repeated_form(y)) for s, r, d, h, t in zip(x["src_table"], x["row_id"], x["doc"], x["h"], x["text"]) for i, y in enumerate(lines_of(t)) if is_short(y)]
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "doc", "h", "line_no", "form"])

    named = broken.filter(F.col("doc").isNotNull()).withColumn("h", F.xxhash64("text"))
    forms_ = named.select("src_table", "row_id", "doc", "h", "text").mapInPandas(short_lines, "src_table string, row_id string, doc string, h long, line_no int, form string").filter("form <> ''")
    often = forms_.select("doc", "form", "h").distinct().groupBy("doc", "form").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1")
    again = forms_.join(often, ["doc", "form"]).groupBy("src_table", "row_id").agg(F.collect_list(F.struct("line_no", "n")).alias("again"))
    return broken.join(again, ["src_table", "row_id"], "left")


def _again(cell) -> dict[int, int]:
    return {} if cell is None else {r["line_no"]: r["n"] for r in cell}


def line_model(pages: DataFrame, train_lines: int = TRAIN_LINES) -> LineModel:
    """The line model trained on short lines of a bounded sample of pages."""

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for row, doc, text, cell in zip(x["row_id"], x["doc"], x["text"], x["again"]):
                page, again = Page(text, title_words(doc)), _again(cell)
                rows += [(f"{row}:{i}", page.features(i), again.get(i, 1), kind) for i, kind in enumerate(furniture(page.lines, page.title)) if kind != "blank" and is_short(page.lines[i])]
            yield pd.DataFrame(rows, columns=["at", "features", "n", "label"])

    sample = dealt(pages.orderBy(F.xxhash64("src_table", "row_id")).limit(train_lines // 2)).mapInPandas(examples, "at string, features array<string>, n int, label string")
    rows = sample.orderBy(F.xxhash64("at"), "at").limit(train_lines).collect()
    return LineModel(sorted((list(r["features"]), r["n"], r["label"]) for r in rows))


def damages(texts: DataFrame, common_words: int = COMMON_WORDS, train_words: int = TRAIN_WORDS, train_lines: int = TRAIN_LINES, zeroed: bool = False) -> DataFrame:
    """(src_table, row_id, line_no, defect, repaired) of texts: src_table, row_id, doc, text.

    ``zeroed`` drops the weights after training: nothing is left then, as only
    they make edits.
    """
    spark = texts.sparkSession
    texts = texts.filter(F.col("text").isNotNull())
    lexicon = cut(lexicon_of(texts))
    head = [r["word"] for r in lexicon.orderBy(F.desc("n"), "word").limit(common_words).collect()]
    words = frozenset(head)
    broken = texts.filter(F.col("text").contains("\n")).select("src_table", "row_id", "doc", "text").dropDuplicates(["src_table", "row_id"])
    pages = cut(pages_of(broken))
    lines = line_model(pages, train_lines)
    if zeroed:
        lines.model.weights.clear()
    shared = spark.sparkContext.broadcast((lines, words))  # bounded by train_lines and common_words

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, common = shared.value
        for x in batches:
            rows = [(s, i, *f) for s, i, doc, t, cell in zip(x["src_table"], x["row_id"], x["doc"], x["text"], x["again"]) for f in findings(t, title_words(doc), _again(cell), lines, common)]
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "line_no", "kind", "token", "sign"])

    found = cut(dealt(pages).mapInPandas(find, "src_table string, row_id string, line_no int, kind string, token string, sign string"))
    # A form counts once however many copies of its text there are: in the first row of each text.
    first = pages.groupBy(F.sha2("text", 256)).agg(F.min(F.struct("src_table", "row_id")).alias("r")).select("r.*", F.lit(1).alias("first"))
    odd = found.filter(F.col("kind").isin("word", "break")).join(first, ["src_table", "row_id"], "left").groupBy("kind", "token").agg(F.count("first").alias("n"), F.min("sign").alias("sign"))
    odd = cut(odd)

    # Training, on bounded samples.
    noisy = odd.filter("kind = 'word'").orderBy(F.desc("n"), "token").limit(2 * train_words)
    pairs = [x for x in training_pairs(noisy, lexicon) if x[0] not in words][:train_words]
    known = words.__contains__
    ends = made_ends(head, known, train_words)
    for r in odd.filter("kind = 'break'").orderBy(F.xxhash64("token")).limit(train_words).collect():
        a, b = r["token"].split(BREAK)
        flags = flags_of(a, b, known, False)
        if set(flags) & set("JH") or {"L", "R"} <= set(flags) or {"S", "R"} <= set(flags):
            ends.append((a, r["sign"], b, flags, JOIN if "J" in flags else HYPHEN if "H" in flags else KEEP))
    editor = Editor(pairs, head[:train_words], ends)
    if zeroed:
        editor.model.weights.clear()
        editor.learn()
    model = spark.sparkContext.broadcast(editor)  # bounded by train_words

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = model.value
        for x in batches:
            rows: list[tuple] = []
            for kind, token, n in zip(x["kind"], x["token"], x["n"]):
                rows.append((kind, token, n, None, 0.0, len(FLAGS)))  # the finding itself
                if kind == "word":
                    for form in {token, bare(token)} - {""}:
                        rows += [(kind, token, n, w, loss, 0) for w, loss in editor.proposals(form)]
                else:
                    a, b = token.split(BREAK)
                    rows += [(kind, token, n, w, loss + 0.2, 0) for w, loss in editor.proposals(a + b)]
                    rows += [(kind, token, n, w, 0.0, FLAGS.index(f)) for f, w in (("H", f"{a}-{b}"), ("L", a), ("S", a + "-"), ("R", b))]
            yield pd.DataFrame(rows, columns=["kind", "token", "often", "word", "loss", "role"])

    proposed = dealt(odd).mapInPandas(propose, "kind string, token string, often long, word string, loss double, role int")
    known = cut(proposed.join(lexicon, "word", "left").filter(F.col("n").isNotNull() | (F.col("role") == len(FLAGS))))
    missing = dealt(odd.select("kind", "token", "n").join(known.filter("role = 0"), ["kind", "token"], "left_anti"))
    known = known.unionByName(looked_up(missing, lexicon, model).join(lexicon, "word"))
    # A form too frequent to be a misreading of the word is a word of its own; twice the deviation of its count is allowed for.
    known = known.filter((F.col("kind") == "break") | (F.col("loss") == 0) | (F.col("often") - 2 * F.sqrt("often") <= F.col("total") * SHARE))
    value = F.struct((F.col("loss") - F.log1p(F.coalesce("n", F.lit(0))) * 0.12).alias("cost"), "word")
    role = lambda f: F.max(F.col("role") == FLAGS.index(f))
    whole = F.max((F.col("role") == 0) & (F.col("word") == F.replace(F.col("token"), F.lit(BREAK), F.lit(""))))
    best = known.groupBy("kind", "token").agg(
        F.min(F.when(F.col("role") == 0, value)).alias("hit"), whole.alias("whole"), F.max((F.col("role") == 0) & (F.col("loss") == 0.0)).alias("sound"), *(role(f).alias(f) for f in "HLSR")
    )
    asked = best.join(odd.select("kind", "token", "sign"), ["kind", "token"]).select("kind", "token", "sign", "hit.word", "whole", "sound", *"HLSR")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = model.value
        for x in batches:
            out = []
            for kind, token, sign, word, whole, sound, *has in x.itertuples(index=False):
                fixed = None
                if kind == "word":
                    fixed = None if sound else word
                else:
                    a, b = token.split(BREAK)
                    flags = ("J" if whole else "") + ("H" if has[0] else "") + ("E" if word and not whole else "") + "".join(f for f, y in zip("LSR", has[1:]) if y)
                    act = editor.end(a, sign, b, flags)
                    fixed = f"{a}-{b}" if act == HYPHEN else None if act == KEEP else a + b if whole or not word else word
                out.append(fixed)
            yield x[["kind", "token"]].assign(repaired=pd.Series(out, index=x.index, dtype=object))

    best = asked.mapInPandas(decide, "kind string, token string, repaired string").filter(F.col("repaired").isNotNull())
    defect = F.when(F.col("kind") == "word", "misread").otherwise("hyphen")
    edited = found.filter(F.col("kind").isin("word", "break")).join(best, ["kind", "token"]).select("src_table", "row_id", "line_no", defect.alias("defect"), "repaired")
    plain = found.filter(F.col("kind").isin("header", "page_number")).select("src_table", "row_id", "line_no", F.col("kind").alias("defect"), F.lit("").alias("repaired"))
    return edited.union(plain).distinct()


def paragraphs(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(src_table, row_id, paragraph): each text as one continuous paragraph, repaired by the rows of damages()."""
    per = found.groupBy("src_table", "row_id").agg(F.collect_list(F.struct("line_no", "defect", "repaired")).alias("found"))
    rows = texts.filter(F.col("text").isNotNull()).dropDuplicates(["src_table", "row_id"]).join(per, ["src_table", "row_id"], "left").select("src_table", "row_id", "text", "found")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["paragraph"] = [repair(t, f if f is not None else []) for t, f in zip(x["text"], x["found"])]
            yield x[["src_table", "row_id", "paragraph"]]

    return rows.mapInPandas(work, "src_table string, row_id string, paragraph string")


def _cased(like: str, word: str) -> str:
    """word in the case of the token it replaces."""
    letters = [ch for ch in like if ch.isalpha()]
    if len(letters) > 1 and all(ch.isupper() for ch in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def repair(text: str, found: Iterable) -> str:
    """The running text with furniture removed, broken words joined and misread words replaced; blank lines keep paragraphs apart."""
    by: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for f in found:
        by[f["line_no"]].append((f["defect"], f["repaired"]))
    lines = [x.split() if not any(d in ("header", "page_number") for d, _ in by[i]) else None for i, x in enumerate(text.split("\n"))]
    out: list[str] = []
    skip = False
    for i, words in enumerate(lines):
        if words is None:
            continue
        if not words:
            if out and out[-1] != "\n\n":
                out.append("\n\n")
            continue
        if skip:
            words, skip = words[1:], False
        joined = next((r for d, r in by[i] if d == "hyphen"), None)
        fixes = [r for d, r in by[i] if d == "misread"]
        for k, w in enumerate(words):
            if joined is not None and k == len(words) - 1:
                nxt = next((x for x in lines[i + 1 :] if x), None)
                tail = re.search(r"[^\w]*$", nxt[0])[0] if nxt else ""
                lead = re.match(r"[^\w]*", w)[0]
                out.append(lead + _cased(w, joined) + tail)
                skip = nxt is not None
                continue
            fix = next((r for r in fixes if bare(w) != r and distance(bare(w), r, 4) <= 4 and bare(w)[:1] + bare(w)[-1:] and _likely(bare(w), r)), None)
            if fix is not None:
                lead, tail = re.match(r"[^\w@]*", w)[0], re.search(r"[^\w@!]*$", w)[0]
                out.append(lead + _cased(w, fix) + tail)
            else:
                out.append(w)
    return " ".join(out).replace(" \n\n ", "\n\n").strip()


def _likely(noisy: str, word: str) -> bool:
    return distance(noisy, word, 4) <= max(1, min(4, len(word) // 2))
