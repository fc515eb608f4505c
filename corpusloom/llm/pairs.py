"""Defects of question-answer and instruction-response pairs.

Each answer is run through, in this order: an emptiness check, greedy string
tiling against the question (copy), a refusal grammar over clauses, script and
language checks, and a pushdown parser for fences, brackets, quotations, lists
and markup with a model of sentence endings (truncated).  The first that
applies names the defect.

Languages are told by character n-grams, trained on a bounded sample of the
corpus's own texts (``language_rows``) that function words settle.

The ending model is counted here over the sentences with a full stop of all
distinct answers: for runs of up to six words (words that stand in for each
other count as one), how often a sentence ends or goes on after them.  Counts
are added up map-side and joined to the answers that ask for them; only the
words that count as themselves are broadcast (``MARKED`` at most).

Defined results: a null answer is empty; a null question can't be copied and
has no language, so only empty, refusal and truncated apply; rows repeated
under one id count once; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, dealt

MARKED = 400_000  # words that count as themselves in runs: those with this share (1 in MARKED) of all words, so no more than that
FLUSH = 200_000  # counts that a worker holds before it gives them on
TILE_WORDS = 2  # shortest tile
COPY_SHARE = 0.8  # share of the answer's words in tiles
COPY_WORDS = 4  # shortest answer that counts as a copy
LANGUAGE_ROWS = 5_000  # texts that the language model is trained on at most
SAMPLE_CHARS = 2_000  # of each of those (whole texts are judged)
SURE = 25.0  # log odds from which on a language counts as told

# Answers without content, compared in lower case and without marks around them.
PLACEHOLDERS = frozenset(
    "none null nil nan n/a na tbd todo tba undefined unknown empty blank missing placeholder lorem xxx "
    "(none) (empty) (blank) (null) [none] [empty] [blank] [null]".split()
) | frozenset(
    [
        "no answer", "no response", "no output", "not available", "not applicable", "no content", "no answer given", "answer here", "your answer here", "insert answer here",
        "keine antwort", "ohne antwort", "nicht verfügbar", "k.a", "pas de réponse", "aucune réponse", "sans réponse", "non disponible", "sin respuesta", "ninguna respuesta", "no disponible",
    ]
)

# Names of languages in requests.
LANGUAGE_NAMES = {
    "en": "english englisch englischen anglais inglés ingles",
    "de": "german deutsch deutschen deutsche allemand alemán aleman",
    "fr": "french französisch französischen français francais francés frances",
    "es": "spanish spanisch spanischen espagnol español espanol castellano",
}
_NAMED = re.compile(r"\b(" + "|".join(w for x in LANGUAGE_NAMES.values() for w in x.split()) + r")\b", re.I)
_LANGUAGE_OF = {w: lang for lang, x in LANGUAGE_NAMES.items() for w in x.split()}

# Words of the refusal grammar by class, all four languages together; * stands for any ending.
CLASSES = {
    "S": "i i'm i'd i'll i've me my we we're we'd us our assistant* language_model ich mir mich wir uns meine* unser* assistent* von_mir je j m me moi mes nous yo mi nosotr* asistente puedo podré debo quiero prefiero niego tengo dispongo",  # who speaks
    "N": "not no cannot can't won't couldn't don't doesn't wouldn't isn't unable never nicht kein* ausserstande außerstande nein ne n pas aucun* rien impossible interdit imposible negar* nunca",  # negation
    "M": "can could may will would must able allowed permitted authori* possible going kann darf möchte will werde könnte muss möglich erlaubt gestattet peux puis dois souhaite veux peut saurais droit permis puedo podré debo puede permitido autorizad* posible quiero",  # modality
    "D": "decline refuse rather prefer keep_quiet weigere ablehnen lehne préfère refuse m'abstenir abstenir prefiero niego",  # declining
    "T": "answer* respond* reply* help* assist* provid* explain* discuss* comment* tell share offer* go_into talk* speak* leave give beantwort* antwort* helf* sprech* auskunft auskünfte sagen geben äußern répon* aid* parl* dire traiter fournir donn* renseign* respon* contest* ayud* habl* decir dar coment*",  # acts of answering
    "Q": "this that it these those one something question* request* topic* subject* matter information sie es das dies* diese* dazu hierzu dabei darüber darauf frage* thema anfrage ce cela ça cette ces y en sujet demande question eso esto esa ese esta este tema pregunta petición solicitud información",  # what was asked
    "K": "know* access* knowledge zugang zugriff wissen accès savoir acceso saber",  # means of answering
    "L": "beyond outside against exceeds off_limits übersteigt außerhalb ausserhalb jenseits dépasse dehors hors supera fuera excede",  # limits
    "P": "guideline* polic* rule* principle* remit scope power* möglichkeit* zuständigkeit* richtlinie* compétence* moyens alcance posibilidades competencia*",  # what limits a speaker
    "A": "appropriate proper right angebracht passend approprié convenable apropiado adecuado",  # fitness
    "E": "another_source other_source fachperson",  # elsewhere
}
IDIOMS = ("language model", "keep quiet", "off limits", "off-limits", "go into", "another source", "von mir")
# Words that carry no weight in a clause.
LIGHT = frozenset(
    "a an the to of for with on about at in by and or so as is are was were am be been being have has had do does did you your what told open well just also very any anything "
    "zu über mit von für auf der die den dem ein eine gibt habe ist bin sein ihnen dir euch leider gilt bitte fragen "
    "à de d l le la les du des sur avec est suis être ai avez vous te votre malheureusement mais que qu ce il être par "
    "a de con sobre el los las un una que le les te está estoy he ha ese queda como pero".split()
)
_STEMS = sorted(((w.replace("_", " ").rstrip("*"), w.endswith("*"), c) for c, ws in CLASSES.items() for w in ws.split()), key=lambda x: -len(x[0]))
_EXACT: dict[str, str] = {}
for _w, _stem, _c in ((w.replace("_", " "), w.endswith("*"), c) for c, ws in CLASSES.items() for w in ws.split()):
    if not _stem and _c not in _EXACT.get(_w, ""):
        _EXACT[_w] = _EXACT.get(_w, "") + _c
# Clauses that decline, over the classes of their words in order; x is a word of no class, W one of the question.
_DECLINES = re.compile(
    "|".join(
        [
            r"(?=.*S)(?=.*N)(?=.*T)",  # someone does not answer: I can't help, je ne peux pas répondre, no me está permitido responder
            r"(?=.*S)(?=.*D)(?=.*[TQWN])",  # I decline to explain X, prefiero no hablar
            r"(?=.*S)(?=.*N).*K[QW]*$",  # I have no way of knowing that
            r"N+T(?=[^S]*$)",  # no comment on X, aucune réponse ne peut être donnée
            r"T.*N.*A",  # helping would not be appropriate
            r"[QW].*L.*S.*[MTPQ]|[QW].*L.*P|[QW]+L+S$|LS+P",  # this is beyond what I can offer, off limits for me, against my guidelines
            r"E[QW]*$",  # another source for that
        ]
    )
)
_CLAUSE = re.compile(r"[,;:()—–]+|\b(?:however|but|so|and then|aber|sondern|mais|pero)\b", re.I)
STRANGE = 1  # words of no class that a declining clause may have


@lru_cache(maxsize=1 << 16)
def _kinds(w: str) -> str:
    """The classes of a word."""
    return _EXACT.get(w) or next((c for stem, open_, c in _STEMS if open_ and w.startswith(stem)), "")


def word_classes(clause: str, asked: frozenset[str]) -> str:
    """The classes of the words of a clause, without light ones; asked: the words of the question."""
    text = clause.lower().replace("’", "'")
    for k, idiom in enumerate(IDIOMS):
        text = re.sub(rf"\b{idiom}\b", f"idiom{k}", text)
    out = []
    for w in re.findall(r"\w+(?:'t|'m|'d|'ll|'ve|'re)?", text):
        if m := re.fullmatch(r"idiom(\d+)", w):
            w = IDIOMS[int(m[1])].replace("-", " ")
        kinds = _kinds(w)
        if kinds:
            out.append(kinds)
        elif w in asked:
            out.append("W")
        elif w not in LIGHT:
            out.append("x")
    return "".join(out)


def declines(clause: str, asked: frozenset[str]) -> bool:
    """Whether a clause declines the request: nobody else's act, and no object but the request or what the question names."""
    kinds = word_classes(clause, asked)
    return kinds.count("x") <= STRANGE and bool(_DECLINES.search(kinds)) and not re.search(r"T[^x]*x[^x]*$", kinds.replace("W", ""))


# Sentences that only go along with a refusal.
COURTESIES = re.compile(
    r"^\W*(thanks?|thank you|sorry|my apologies|apologies|i['’]m sorry|hmm|with regret|unfortunately|as an? (\w+ )*(assistant|model)|i hope|perhaps|please|let me know|is there anything|that is an interesting|"
    r"danke|es tut mir leid|leider|tut mir leid|bitte|ich bitte|ich hoffe|merci|je suis désolée?|désolée?|malheureusement|posez|j['’]espère|en tant qu|gracias|lo siento|por desgracia|lamento|espero|pruebe|como asistente)\b",
    re.I,
)

_WORD = re.compile(r"\w+(?:['’]\w+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|\n+")
_ZERO = re.compile("[​‌‍⁠﻿­]")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only a placeholder without content."""
    if answer is None:
        return True
    bare = _ZERO.sub("", _TAGS.sub(" ", answer)).strip().lower()
    if not any(ch.isalnum() for ch in bare):
        return not any(unicodedata.category(ch) in ("So", "Sc") for ch in bare)
    return bare in PLACEHOLDERS or bare.strip(" \t\n.!?-–—_*'\"`()[]{}<>:") in PLACEHOLDERS


class Runs:
    """A suffix automaton of the words of a question: what of an answer stands in it, in time linear in both."""

    def __init__(self, question: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in question:
            here = self._state(self.size[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = here
                p = self.link[p]
            if p < 0:
                self.link[here] = 0
            else:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[here] = q
                else:
                    twin = self._state(self.size[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[here] = twin
            last = here

    def _state(self, size: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def ending(self, answer: list[str]) -> list[int]:
        """For each word of the answer the length of the longest stretch of the question that ends with it."""
        at, n, out = 0, 0, []
        for w in answer:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.size[at]
            if w in self.next[at]:
                at = self.next[at][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def tiles(answer: list[str], question: list[str], least: int = TILE_WORDS) -> int:
    """Words of the answer in tiles of the question: greedy string tiling, longest tiles first.

    A stretch of the question may tile the answer more than once, as a
    question given back twice is still a copy.
    """
    longest = Runs(question).ending(answer)
    free = [[0, len(answer)]]  # stretches without a tile, in order
    covered = 0
    for i in sorted(range(len(answer)), key=lambda x: -longest[x]):
        if longest[i] < least:
            break
        k = bisect_right(free, [i, len(answer) + 1]) - 1
        if k < 0 or free[k][1] <= i:
            continue
        begin, end = free[k]
        n = min(longest[i], i + 1 - begin)  # the tile shrinks where an earlier one lies
        if n >= least:
            covered += n
            free[k : k + 1] = [x for x in ([begin, i + 1 - n], [i + 1, end]) if x[0] < x[1]]
    return covered


_WRAPPER = re.compile(r"^\W*(you asked|you wrote|question|q|answer|a|frage|antwort|réponse|pregunta|respuesta)\s*:\s*", re.I | re.M)


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer gives back the question only."""
    if not question:
        return False
    a, q = words(_WRAPPER.sub(" ", answer)), words(question)
    if len(a) < min(COPY_WORDS, len(q)) or not a:
        return False
    held = set(q)
    if sum(w in held for w in a) < COPY_SHARE * len(a):
        return False
    return tiles(a, q) >= COPY_SHARE * len(a)


def is_refusal(answer: str, question: str | None = None) -> bool:
    """Whether the answer declines: a clause declines the request, and there is little besides courtesies."""
    asked = frozenset(words(question or ""))
    refused, content, total = False, 0, 0
    for s in _SENTENCE.split(answer.replace("’", "'")):
        n = len(words(s))
        if not n:
            continue
        if any(declines(c, asked) for c in _CLAUSE.split(s) if c.strip()):
            refused = True
            total += n
        elif not COURTESIES.match(s):
            content += n
    return refused and content <= max(6, total // 2)


def script(text: str) -> str:
    """The script that most letters belong to."""
    seen: Counter[str] = Counter()
    for ch in text:
        if ch.isalpha():
            seen["LATIN" if ch < "ɐ" else unicodedata.name(ch, "OTHER").split(" ")[0]] += 1
    return seen.most_common(1)[0][0] if seen else ""


class Languages:
    """Tells languages by character n-grams: naive Bayes over n-grams of one to three letters within words."""

    SIZES = (1, 2, 3)

    def __init__(self, labelled: Iterable[tuple[str, str]] = ()):
        counts: dict[str, Counter[str]] = {}
        for lang, text in labelled:
            counts.setdefault(lang, Counter()).update(self.grams(words(text)))
        self.names = sorted(counts)
        self.memo: dict[str, list[float]] = {}  # scores of words seen
        every = {g for c in counts.values() for g in c}
        totals = {k: sum(c.values()) + len(every) for k, c in counts.items()}
        self.table = {g: [math.log((counts[k][g] + 1) / totals[k]) for k in self.names] for g in every}

    @classmethod
    def grams(cls, tokens: Iterable[str]) -> Iterator[str]:
        for w in tokens:
            if not w.isdigit():
                p = f"^{w}$"
                for n in cls.SIZES:
                    yield from (p[i : i + n] for i in range(len(p) - n + 1))

    def tell(self, text: str, without: frozenset[str] = frozenset()) -> tuple[str, float]:
        """(language, margin): the likeliest and the log odds against the next, by the words but those left out; ('', 0) if nothing speaks for any."""
        kind = script(text)
        if kind not in ("LATIN", ""):
            return kind, math.inf
        score = [0.0] * len(self.names)
        if len(self.memo) > FLUSH:
            self.memo.clear()
        for w in words(text):
            if w not in without:
                if w not in self.memo:
                    self.memo[w] = [sum(x) for x in zip(*(self.table[g] for g in self.grams([w]) if g in self.table))] or [0.0] * len(score)
                score = [a + b for a, b in zip(score, self.memo[w])]
        if len(score) < 2 or not any(score):
            return "", 0.0
        best, second = sorted(range(len(score)), key=lambda i: -score[i])[:2]
        return self.names[best], score[best] - score[second]


def function_words() -> dict[str, frozenset[str]]:
    """Function words by language: Spark's own lists."""
    from pyspark.ml.feature import StopWordsRemover

    names = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}
    return {k: frozenset(StopWordsRemover.loadDefaultStopWords(n)) for k, n in names.items()}


def seeds() -> dict[str, frozenset[str]]:
    """Function words that only one of the languages has."""
    lists = function_words()
    return {k: x - frozenset().union(*(y for j, y in lists.items() if j != k)) for k, x in lists.items()}


def settled(text: str, seeds: dict[str, frozenset[str]]) -> str | None:
    """The language whose function words a text holds, if it holds two or more, and three times as many as of any other."""
    tokens = words(text)
    n = sorted(((sum(w in s for w in tokens), k) for k, s in seeds.items()), reverse=True)
    return n[0][1] if n and n[0][0] >= 2 and n[0][0] >= 3 * (n[1][0] if len(n) > 1 else 0) else None


def languages(texts: DataFrame, language_rows: int = LANGUAGE_ROWS) -> Languages:
    """The model trained on a bounded sample of texts: text."""
    rows = texts.filter(F.col("text").isNotNull()).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct().orderBy(F.xxhash64("text"), "text").limit(language_rows).collect()
    known = seeds()
    return Languages((lang, r["text"]) for r in rows if (lang := settled(r["text"], known)))


def requested(question: str) -> set[str]:
    """Languages that a question names."""
    return {_LANGUAGE_OF[m.lower()] for m in _NAMED.findall(question)}


def is_foreign(question: str | None, answer: str, model: Languages) -> bool:
    """Whether the answer is in a language other than the question's, without being asked for.  Words of both, as names, don't count."""
    if not question:
        return False
    shared = frozenset(words(question)) & frozenset(words(answer))
    mine, margin = model.tell(answer, shared)
    theirs, other = model.tell(question, shared)
    if not mine or not theirs or mine == theirs or margin < SURE or other < SURE:
        return False
    return mine not in requested(question)


_VOID = {"br", "hr", "img", "input", "meta", "link"}
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»"}
_ENDINGS = frozenset(_PAIRS.values())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>")
_TOKEN = re.compile(r"(?P<fence>```+|~~~+)|(?P<code>`)|(?P<strong>\*\*)|(?P<tag></?[a-zA-Z][a-zA-Z0-9]*[^<>]*>)|(?P<quote>\")|(?P<bracket>[()\[\]{}“”„«»])|(?P<block>\n[ \t]*\n)")
_MARKER = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s*$")
_LOOSE = frozenset(["p", "li"])  # elements whose end may be left out


class Frame(NamedTuple):
    """What is open: its kind, what closes it, and where it began."""

    kind: str
    closer: str
    at: int


def parse(text: str) -> tuple[list[Frame], list[int]]:
    """(frames still open at the end, places of closers that cross another frame), by a pushdown parser.

    Only the frame on top of the stack can be closed.  A fence or code span
    holds nothing but its own end; emphasis and quotations end with their block
    at the latest; a closer whose opener lies deeper crosses it and closes
    nothing; one without any opener is text.
    """
    stack: list[Frame] = []
    crossed: list[int] = []

    def close(mark: str, at: int) -> bool:
        if stack and stack[-1].closer == mark:
            stack.pop()
            return True
        if any(f.closer == mark for f in stack):
            crossed.append(at)
        return False

    for m in _TOKEN.finditer(text):
        kind, mark, at = m.lastgroup or "", m[0], m.start()
        top = stack[-1] if stack else None
        if top and top.kind in ("fence", "code"):
            if (kind == top.kind and mark.startswith(top.closer)) or (top.kind == "code" and kind == "block"):
                stack.pop()
        elif kind == "block":
            while stack and stack[-1].kind in ("strong", "quote"):
                stack.pop()
        elif kind in ("fence", "code"):
            stack.append(Frame(kind, mark[:3], at))
        elif kind == "tag":
            slash, name, empty = _TAG.match(mark).groups()
            if slash:
                while stack and stack[-1].kind == "tag" and stack[-1].closer != name.lower() and stack[-1].closer in _LOOSE:
                    stack.pop()
                close(name.lower(), at)
            elif name.lower() not in _VOID and not empty:
                stack.append(Frame("tag", name.lower(), at))
        elif kind in ("quote", "strong"):
            if not close(mark, at) and not any(f.closer == mark for f in stack) and not (kind == "quote" and at and text[at - 1].isdigit()):  # 5" is a measure
                stack.append(Frame(kind, mark, at))
        elif mark in _ENDINGS and stack and stack[-1].closer == mark:
            stack.pop()
        elif mark in _PAIRS:
            stack.append(Frame("bracket", _PAIRS[mark], at))
        else:
            close(mark, at)
    return [f for f in stack if not (f.kind == "tag" and f.closer in _LOOSE)], crossed


def open_at_end(text: str) -> bool:
    """Whether a fence, bracket, quotation, tag, emphasis or list item is still open at the end."""
    if parse(text)[0]:
        return True
    lines = text.rstrip().split("\n")
    return len(lines) > 1 and bool(_MARKER.match(lines[-1]))


_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")


def sentences(text: str) -> Iterator[list[str]]:
    """The words of each sentence with a full stop."""
    for s in _SENTENCE.split(text):
        s = s.strip().rstrip("\"”»)*`")
        if s.endswith((".", "!", "?")) and not s.endswith(("...", "…")):
            tokens = words(_ITEM.sub("", s))
            if len(tokens) > 2:
                yield tokens


class Endings:
    """How often a sentence ends, or goes on, after a run of up to six words."""

    RUN, SEEN, FREQUENT, FILLERS = 6, 3, 3, 6

    def __init__(self, texts: Iterable[str] = ()):
        found = [tokens for text in texts for tokens in sentences(text)]
        counts = Counter(w for tokens in found for w in tokens)
        self.known = {w for w, n in counts.items() if n >= self.FREQUENT}
        self.prefixes = {x for w in self.known for x in self.prefixes_of(w)}
        self.slots = self._slots(found)
        self.marked = self.known - self.slots
        ends: Counter[tuple] = Counter()
        goes: Counter[tuple] = Counter()
        for tokens in found:
            for run, last in self.runs(tokens):
                (ends if last else goes)[run] += 1
        self.table = {k: (ends[k], goes[k]) for k in ends.keys() | goes.keys() if ends[k] + goes[k] >= self.SEEN}

    @staticmethod
    def prefixes_of(w: str) -> list[str]:
        return [] if any(ch.isdigit() for ch in w) else [w[:k] for k in range(1, len(w))]

    def runs(self, tokens: list[str]) -> Iterator[tuple[tuple, bool]]:
        """The runs of a sentence, and whether it ends after them."""
        run = ["^", *(self._mask(w) for w in tokens)]
        for i in range(1, len(run)):
            for n in range(1, min(self.RUN, i + 1) + 1):
                yield tuple(run[i - n + 1 : i + 1]), i == len(run) - 1

    def asked(self, tokens: list[str]) -> list[tuple]:
        """The runs that goes_on() looks up for these words."""
        run = ["^", *(self._mask(w) for w in tokens)]
        return list({tuple(run[-n:]) for n in range(1, min(self.RUN, len(run)) + 1)} | {tuple(run[:3]), (tokens[-1],)})

    def _slots(self, sentences: list[list[str]]) -> set[str]:
        """Words that mostly stand where many others can: between two words that hold six or more fillers."""
        fillers: dict[tuple[str, str], set[str]] = {}
        around: dict[str, Counter[tuple[str, str]]] = {}
        for tokens in sentences:
            run = ["^", *tokens, "$"]
            for a, w, b in zip(run, run[1:], run[2:]):
                fillers.setdefault((a, b), set()).add(w)
                around.setdefault(w, Counter())[a, b] += 1
        return {w for w, seen in around.items() if sum(n for k, n in seen.items() if len(fillers[k]) >= self.FILLERS) >= 0.5 * sum(seen.values())}

    def _mask(self, w: str) -> str:
        if w[0].isdigit():
            return "0"
        return w if w in self.marked else "*"

    def chance(self, tokens: list[str]) -> float:
        """The chance that a sentence ends after these words."""
        run = ["^", *(self._mask(w) for w in tokens)]
        for n in range(min(self.RUN, len(run)), 0, -1):
            if hit := self.table.get(tuple(run[-n:])):
                return (hit[0] + 0.02) / (sum(hit) + 0.04)
        return 0.5

    def begins(self, tokens: list[str]) -> bool:
        """Whether sentences begin with the first two of these words."""
        return ("^", self._mask(tokens[0]), self._mask(tokens[1])) in self.table

    def never_last(self, word: str) -> bool:
        hit = self.table.get((word,))
        return word in self.known and word not in self.slots and hit is not None and sum(hit) >= 10 and hit[0] <= 0.004 * sum(hit)


def last_words(question: str | None, answer: str) -> bool | tuple[list[str], bool, bool, bool]:
    """Whether a real answer breaks off before its end, where that shows without the ending model.

    Else what the model is asked: the last sentence's words (of more than
    eight only the first two and the last six), whether the last begins a word
    of the pair, is in lower case, and whether there is no other sentence.
    """
    text = _ZERO.sub("", answer).rstrip()
    if open_at_end(text):
        return True
    if text.endswith(("...", "…")):
        text = text.rstrip(".… ")
        if len(words(text)) < 3:
            return False
    elif text.endswith((".", "!", "?", '"', "”", "»", "`", "]", "}", "|", "*", "。", "！", "？", ">")):
        return False
    elif text.endswith((",", ":", ";", "(", "–", "—", "-")):
        return len(words(text)) > 2 or ":" == text[-1]
    elif text.endswith(")"):
        return False
    last = _ITEM.sub("", _SENTENCE.split(text)[-1])
    tokens = words(last)
    if not tokens:
        return False
    end = tokens[-1]
    if not last[-1].isalnum():
        return False
    named = any(w != end and len(w) > len(end) and w.startswith(end) for w in words((question or "") + " " + text))
    lower = re.findall(r"\w+", last)[-1].islower()
    whole = len(words(text)) == len(tokens)
    return (tokens if len(tokens) <= 8 else tokens[:2] + tokens[-6:]), named, lower, whole


def breaks_off(tokens: list[str], named: bool, lower: bool, whole: bool, endings: Endings) -> bool:
    """Whether a sentence breaks off with these words, by the ending model; arguments as of last_words()."""
    end = tokens[-1]
    if end not in endings.known and not any(ch.isdigit() for ch in end):
        if len(tokens) > 1 and (named or (end in endings.prefixes and (lower or len(tokens) > 3))):
            return True
    if whole and len(tokens) <= 4:
        return len(tokens) > 2 and endings.begins(tokens) and endings.never_last(end)
    return endings.chance(tokens) < 0.05


def is_truncated(question: str | None, answer: str, endings: Endings) -> bool:
    """Whether a real answer breaks off before its end."""
    seen = last_words(question, answer)
    return seen if isinstance(seen, bool) else breaks_off(*seen, endings)


def plain_defect(question: str | None, answer: str | None, model: Languages = Languages()) -> str | None:
    """empty, copy, refusal, language or None."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer, question):
        return "refusal"
    if is_foreign(question, answer, model):
        return "language"
    return None


def defect(question: str | None, answer: str | None, endings: Endings, model: Languages = Languages()) -> str | None:
    """empty, copy, refusal, language, truncated or None."""
    return plain_defect(question, answer, model) or ("truncated" if is_truncated(question, answer, endings) else None)


def _flushed(batches: Iterator[pd.DataFrame], keys: Callable[[str], Iterable[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Counts of the keys of each answer, added up here as far as FLUSH of them."""
    counts: Counter[tuple] = Counter()

    def out() -> pd.DataFrame:
        x = pd.DataFrame(list(counts), columns=columns)
        x["n"] = pd.Series(list(counts.values()), dtype="int64")
        counts.clear()
        return x

    for x in batches:
        for text in x["answer"]:
            counts.update(keys(text))
            if len(counts) > FLUSH:
                yield out()
    yield out()


def word_counts(answers: DataFrame) -> DataFrame:
    """(w, n, slot) of each word of the sentences in distinct answers; slot: mostly stands where FILLERS or more others can."""

    def triples(text: str) -> Iterator[tuple]:
        for tokens in sentences(text):
            run = ["^", *tokens, "$"]
            yield from zip(run, run[1:], run[2:])

    around = answers.mapInPandas(lambda x: _flushed(x, triples, ["a", "w", "b"]), "a string, w string, b string, n long").groupBy("a", "w", "b").agg(F.sum("n").alias("n"))
    around = cut(around)
    wide = around.groupBy("a", "b").count().filter(F.col("count") >= Endings.FILLERS).select("a", "b", F.lit(1).alias("wide"))
    return around.join(wide, ["a", "b"], "left").groupBy("w").agg(F.sum("n").alias("n"), (2 * F.sum(F.when(F.col("wide") == 1, F.col("n")).otherwise(0)) >= F.sum("n")).alias("slot"))


def truncated(asking: DataFrame, answers: DataFrame) -> DataFrame:
    """Those of asking (tokens, named, lower, whole, distinct) that break off, by the endings in the distinct answers."""
    spark = asking.sparkSession
    counted = cut(word_counts(answers))
    total = counted.agg(F.sum("n")).first()[0] or 0
    known = counted.filter(F.col("n") >= Endings.FREQUENT)
    model = Endings()
    model.marked = {r[0] for r in known.filter(~F.col("slot") & (F.col("n") * MARKED >= total)).select("w").toLocalIterator()}
    shared = spark.sparkContext.broadcast(model)  # n * MARKED >= total holds for at most MARKED words

    def runs(text: str) -> Iterator[tuple]:
        for tokens in sentences(text):
            for run, last in shared.value.runs(tokens):
                yield " ".join(run), last

    def lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["run"] = [[" ".join(r) for r in shared.value.asked(list(t))] for t in x["tokens"]]
            yield x

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"end": sorted({p for w in x["w"] for p in Endings.prefixes_of(w)})}, columns=["end"], dtype=str)

    schema = "tokens array<string>, named boolean, lower boolean, whole boolean"
    asking = cut(asking.mapInPandas(lookups, schema + ", run array<string>"))
    table = answers.mapInPandas(lambda x: _flushed(x, runs, ["run", "last"]), "run string, last boolean, n long").groupBy("run").agg(F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).alias("ends"), F.sum("n").alias("n")).filter(F.col("n") >= Endings.SEEN)
    key = ["tokens", "named", "lower", "whole"]
    hits = asking.select(*key, F.explode("run").alias("run")).join(table, "run").groupBy(*key).agg(F.collect_list(F.struct("run", "ends", "n")).alias("hits"))
    end = F.element_at("tokens", -1).alias("end")
    ends = asking.select(end).distinct()
    begun = ends.join(known.mapInPandas(prefixes, "end string").distinct(), "end").withColumn("prefix", F.lit(True))
    facts = ends.join(known.select(F.col("w").alias("end"), F.lit(True).alias("known"), "slot"), "end", "left").join(begun, "end", "left")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Endings()
        one.marked = shared.value.marked
        for x in batches:
            keep = []
            for tokens, named, lower, whole, found, known, slot, prefix in zip(*(x[c] for c in (*key, "hits", "known", "slot", "prefix"))):
                tokens = list(tokens)
                one.known, one.slots, one.prefixes = ({tokens[-1]} if y is True else set() for y in (known, slot, prefix))
                one.table = {tuple(h["run"].split(" ")): (h["ends"], h["n"] - h["ends"]) for h in (found if found is not None else ())}
                keep.append(breaks_off(tokens, named, lower, whole, one))
            yield x.loc[keep, key]

    return asking.select(*key, end).join(facts, "end").join(hits, key, "left").mapInPandas(decide, schema)


def defects(df: DataFrame, language_rows: int = LANGUAGE_ROWS) -> DataFrame:
    """(src_table, row_id, defect) of each defective pair; df: src_table, row_id, question, answer."""
    texts = df.select(F.col("question").alias("text")).union(df.select(F.col("answer").alias("text")))
    model = df.sparkSession.sparkContext.broadcast(languages(texts, language_rows))  # n-grams of three letters of a bounded sample
    rows = df.select("src_table", F.col("row_id").cast("long").alias("row_id"), "question", "answer").dropDuplicates(["src_table", "row_id"])
    schema = "src_table string, row_id long, defect string, tokens array<string>, named boolean, lower boolean, whole boolean"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for table, i, q, a in zip(x["src_table"], x["row_id"], x["question"], x["answer"]):
                found = plain_defect(q, a, model.value)
                seen = last_words(q, a) if found is None else False
                if seen is True:
                    found = "truncated"
                if found or seen:
                    out.append((table, i, found, *((None,) * 4 if found else seen)))
            yield pd.DataFrame(out, columns=["src_table", "row_id", "defect", "tokens", "named", "lower", "whole"])

    seen = cut(dealt(rows).mapInPandas(work, schema))
    key = ["tokens", "named", "lower", "whole"]
    asking = seen.filter(F.col("defect").isNull())
    answers = df.filter(F.col("answer").isNotNull()).select("answer").distinct()
    late = asking.join(truncated(asking.select(*key).distinct(), answers), key).select("src_table", "row_id", F.lit("truncated").alias("defect"))
    return seen.filter(F.col("defect").isNotNull()).select("src_table", "row_id", "defect").union(late)
