"""Variant spellings of the names of persons and organisations.

Method.  A name is read into tokens (titles, possessives, case and accents
aside): a person's surname and given name or initials, an organisation's
founder, kind and subject, or an acronym; lists of nicknames, titles and kinds
are evidence for the reading.  The rare token is the core.  Every name then
meets the cores of its project, its own among them, by a set-similarity join on
q-grams: prefix-filtered (only the rarest q-grams of each are joined) and keyed
by length and place too, so that a frequent q-gram makes no long list.  What
meets is verified by a soft weighted token similarity: tokens weigh the more
the rarer they are, the core matches by its edit similarity, other tokens if
they are equal, abbreviated or nicknames.  A name that meets nothing is linked
to nothing.  Initials, bare surnames, short names and acronyms are linked where
only one entity of the project fits them, by counts per core and not by
comparing the names of a group with each other.

Defined results: rows with a null project, text or id, or another label, and
names without a letter take no part; a name that fits several entities is
linked to none of them; rows repeated under one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, dealt

PARTNERS = 12  # a token that stands beside so many others is a common one
COMMON_SHARE = 0.001  # ... and beside at least this share of all names
Q = 2
SOFT = 0.75
RARE = 0.1  # a lone surname is a misspelling only up to this share of the right one's names (or of two names)
TWO_EDITS = 10  # letters of a core from which on two edits are allowed
BARE = 5  # letters of a core from which on a lone surname may be a misspelling
HOT_MEMBERS = 2_000  # rows of one entity whose pairs one task makes

# Nicknames by given name, in folded spelling.
NICKNAMES = {
    "alexander": "alex sandy sasha xander lex alec", "bartholomew": "bart barty tolly", "christopher": "chris kit topher kester", "dolores": "lola lolita dolly loli", "elizabeth": "liz beth lizzie eliza betty bess libby",
    "etienne": "tienne titi steve", "francisco": "paco pancho frank curro quico", "friederike": "fritzi rike frieda friedel", "genevieve": "ginette gen eve viva genny veva", "guadalupe": "lupe lupita pita",
    "heinrich": "heinz heiner henry harry hein", "ignacio": "nacho iggy nacio", "isidore": "izzy dore isi izy", "jacqueline": "jackie jacqui jacky", "johannes": "jo hans hannes johann jan", "jose": "pepe chepe pepito",
    "katherine": "kate kathy kit katie kay kitty kat", "lucinda": "lucy cindy lucia luce", "margaret": "maggie meg peggy daisy greta madge margie", "nicholas": "nick niko nico klaus nicky", "ottoline": "otti tilly lina otto",
    "penelope": "penny nell nelly pen", "raphael": "rafe rafa raph rafi", "robert": "rob bob bobby robbie bert", "susannah": "sue zanna susie suki sanna", "theodore": "ted theo teddy dora", "ursula": "ulla uschi ursel sula",
    "victoria": "vicky tori vic vita toria", "wilhelmina": "willa mina minna wilma billie helma", "william": "bill will liam billy willy", "yolanda": "yoli yola landa yolie", "zachary": "zach zack zak",
    "anthony": "tony", "edward": "ed eddie ned", "james": "jim jimmy jamie", "john": "johnny jack", "joseph": "joe joey", "michael": "mike mick", "richard": "dick rick richie", "thomas": "tom tommy", "charles": "charlie chuck", "matthew": "matt", "samuel": "sam", "daniel": "dan danny", "patricia": "pat patty trish", "rebecca": "becky", "maria": "mari maruja", "juan": "juanito", "antonio": "toni tono", "georg": "schorsch jorg", "josef": "sepp jupp", "anna": "anni", "helene": "lene leni",
}
_FULL: dict[str, list[str]] = {}
for _given, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        _FULL.setdefault(_n, []).append(_given)
TITLES = frozenset("dr prof professor mr mrs ms mx miss sir dame lady lord herr frau mme monsieur madame senor senora don dona doctor".split())
# Kinds of organisations and their abbreviations.
KINDS = {
    "museum": "mus", "library": "lib libr", "laboratory": "lab labs labor", "institute": "inst institut", "university": "univ uni", "foundation": "fdn found fnd", "society": "soc", "department": "dept dep dpt", "academy": "acad", "college": "coll", "centre": "center ctr cent",
    "association": "assoc assn", "archive": "arch archives", "school": "sch", "council": "", "committee": "cttee", "company": "co", "bureau": "", "gallery": "gall", "observatory": "obs", "hospital": "hosp", "ministry": "min", "agency": "", "union": "", "club": "", "corporation": "corp",
}
_KIND = {a: k for k, x in KINDS.items() for a in [k, *x.split()]}
_SMALL = frozenset("of for the and f a an at in de la le les des du der die das und fur von y el los las et pour &".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:[-][^\W\d_]+)*\.?|&")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ł", "l")
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).lower()


def near(a: str, b: str) -> bool:
    """Whether one edit (insertion, deletion, replacement, swap of neighbours) separates them at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def tokens(text: str) -> list[str]:
    """The tokens of a name as written, without possessive and parentheses; run-together words apart."""
    text = unicodedata.normalize("NFC", text)
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"['’`´]s\b", "", text, flags=re.I)
    text = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])", " ", text)
    text = re.sub(r"\b([^\W\d_])\.(?=[^\W\d_])", r"\1. ", text)
    return _TOKEN.findall(text)


def acronym_of(text: str) -> str | None:
    """The letters of a name that is an acronym only."""
    bare = text.strip()
    m = re.fullmatch(r"(?:[A-ZÀ-Þ]\.\s?){2,8}[A-ZÀ-Þ]?\.?|[A-ZÀ-Þ]{2,6}", bare)
    return re.sub(r"[^a-z]", "", fold(bare)) if m else None


class Reader:
    """Reads names, given the common tokens of the corpus."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self.known = set(common) | set(NICKNAMES)
        self.by_size: dict[int, list[str]] = {}
        for w in sorted(self.known, key=lambda w: (-common.get(w, 0), w)):
            self.by_size.setdefault(len(w), []).append(w)
        self.memo: dict[str, str | None] = {}

    def kind(self, t: str) -> str | None:
        t = t.rstrip(".")
        if t in _KIND:
            return _KIND[t]
        if len(t) >= 5:
            for k in KINDS:
                if near(t, k):
                    return k
        return None

    def usual(self, t: str) -> str | None:
        """The common token that t is, or is one edit away from."""
        if t in self.known:
            return t
        if len(t) < 4:
            return None
        if t not in self.memo:
            hit = None
            for size in (len(t), len(t) - 1, len(t) + 1):
                hit = hit or next((w for w in self.by_size.get(size, ()) if near(t, w)), None)
            self.memo[t] = hit
        return self.memo[t]

    def word(self, t: str) -> str:
        """A subject word of an organisation: its common form, also from an abbreviation."""
        bare = t.rstrip(".")
        if t.endswith(".") and len(bare) >= 3:
            full = [w for w in self.common if w.startswith(bare) and len(w) > len(bare)]
            if full:
                return max(full, key=lambda w: (self.common[w], w))
        return self.usual(bare) or bare

    def givens(self, t: str) -> list[str]:
        """The given names that a token may stand for."""
        if t in NICKNAMES:
            return [t]
        if t in _FULL:
            return _FULL[t]
        hit = self.usual(t)
        if hit and (hit in NICKNAMES or (hit != t and hit not in _FULL)):
            return [hit]
        if len(t) >= 4:
            for n, full in _FULL.items():
                if len(n) >= 4 and near(t, n):
                    return full
        return [t]

    def is_given(self, t: str) -> bool:
        return t in NICKNAMES or t in _FULL or (t in self.common and t not in _KIND) or any(g in NICKNAMES for g in self.givens(t))

    def read(self, text: str) -> dict | None:
        if short := acronym_of(text):
            if len(short) <= 6 and ("." in text or len(short) <= 5):
                return {"form": "acronym", "core": short, "acronym": short}
        raw = tokens(text)
        low = [fold(t) for t in raw]
        kinds = [self.kind(t) for t in low]
        if any(kinds) and len(low) >= 2:
            return self._organisation(text, low, kinds)
        return self._person(text, raw, low)

    def _organisation(self, text: str, low: list[str], kinds: list[str | None]) -> dict | None:
        at = next(i for i, k in enumerate(kinds) if k)
        rest = [t for i, t in enumerate(low) if i != at and t.rstrip(".") not in _SMALL]
        words = [(t, self.word(t)) for t in rest]
        if not words:
            return None
        # the founder: the word that is least common; ties go to the place where founders stand
        tail = "," in text or at == 0
        founder = min(range(len(words)), key=lambda i: (self.common.get(words[i][1], 0), words[i][1] != words[i][0].rstrip("."), -i if tail else i))
        core = words[founder][0].rstrip(".")
        subject = [w for i, (_, w) in enumerate(words) if i != founder]
        return {"form": "org", "core": core, "kind": kinds[at], "subject": " ".join(subject), "acronym": core[:1] + kinds[at][:1] + "".join(w[:1] for w in subject)}

    def _person(self, text: str, raw: list[str], low: list[str]) -> dict | None:
        pairs = [(r, t.rstrip(".")) for r, t in zip(raw, low) if t != "&" and t.rstrip(".") not in ("the",)]
        while len(pairs) > 1 and pairs[0][1] in TITLES:
            pairs = pairs[1:]
        initials = [t for r, t in pairs if len(t) == 1]
        full = [(r, t) for r, t in pairs if len(t) > 1]
        if not full:
            return None
        if len(full) == 1:
            return {"form": "initial" if initials else "bare", "core": full[0][1], "initial": initials[0] if initials else None}
        if "," in text:
            surname = 0
        elif full[0][0].isupper() and not full[-1][0].isupper() and len(full[0][1]) > 2:
            surname = 0
        else:
            first, last = self.is_given(full[0][1]), self.is_given(full[-1][1])
            surname = 0 if last and not first else len(full) - 1
        rest = [t for i, (_, t) in enumerate(full) if i != surname]
        return {"form": "full", "core": full[surname][1], "givens": self.givens(rest[0])}


def read_names(names: DataFrame, common: dict[str, int], total: int) -> DataFrame:
    """The reading of each name; rest: the weight of its tokens but the core, the sum of ln(names / names that hold the token)."""
    reader = names.sparkSession.sparkContext.broadcast(Reader(common))  # bounded: see common_tokens()

    def rest(r: dict) -> float:
        words = r.get("givens", [])[:1] + ([r["kind"]] if r.get("kind") else []) + r.get("subject", "").split()
        known = sum(log(total / min(total, max(1, common.get(w, 1)))) for w in words)
        return known + (log(26) if r.get("initial") else 0.0)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for project, text in zip(x["project"], x["text"]):
                r = reader.value.read(text)
                if r:
                    rows.append((project, text, r["form"], r["core"], r.get("givens", []), r.get("initial"), r.get("kind"), r.get("subject", ""), r.get("acronym"), rest(r)))
            yield pd.DataFrame(rows, columns=["project", "text", "form", "core", "givens", "initial", "kind", "subject", "acronym", "rest"])

    return names.mapInPandas(work, "project string, text string, form string, core string, givens array<string>, initial string, kind string, subject string, acronym string, rest double")


def common_tokens(names: DataFrame, partners: int = PARTNERS) -> dict[str, int]:
    """Tokens that stand beside many others, with the number of names that hold them.

    There are at most tokens-per-name / COMMON_SHARE of them.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for text in x["text"]:
                ts = sorted({fold(t).rstrip(".") for t in tokens(text)})
                ts = [t for t in ts if len(t) > 1 and t not in _SMALL and t not in TITLES]
                rows += [(t, u) for t in ts for u in ts if u != t]
            yield pd.DataFrame(rows, columns=["token", "partner"])

    pairs = names.mapInPandas(work, "token string, partner string")
    total = names.count()
    counted = pairs.groupBy("token", "partner").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("n"))
    rows = counted.filter((F.col("partners") >= partners) & (F.col("n") >= COMMON_SHARE * total)).collect()
    return {r["token"]: int(r["n"]) for r in rows}


def similar_cores(cores: DataFrame) -> DataFrame:
    """(project, family, core, other): cores of a project few edits apart, each with itself too, by a prefix-filtered q-gram join.

    One edit changes Q q-grams, a swap Q + 1, so cores k edits apart share one
    of the Q * k + 2 rarest q-grams of each, at places and with lengths that
    differ by k at most: those are part of the join's key.
    """
    padded = F.concat(F.lit("^"), "core", F.lit("$"))
    places = F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.struct(F.substring(padded, i, F.lit(Q)).alias("g"), i.alias("at")))
    edits = F.when(F.length("core") < TWO_EDITS, 1).otherwise(2)
    exploded = cores.select("project", "family", "core", F.inline(places))
    often = exploded.groupBy("g").agg(F.count_distinct("core").alias("often"))
    rarest = (
        exploded.join(F.broadcast(often) if Q <= 2 else often, "g")  # two letters: bounded by the alphabet
        .groupBy("project", "family", "core")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "g", "at"))), 1, Q * edits + 2).alias("gs"))
        .select("project", "family", "core", F.length("core").alias("size"), edits.alias("k"), F.explode("gs").alias("x"))
        .select("project", "family", "core", "size", "k", "x.g", "x.at")
    )
    around = lambda c: F.sequence(F.col(c) - F.col("k"), F.col(c) + F.col("k"))
    other = rarest.select("project", "family", F.col("core").alias("other"), "g", "k", F.explode(around("size")).alias("size"), "at").withColumn("at", F.explode(around("at"))).drop("k")
    swap = (F.length("core") == F.length("other")) & (F.array_sort(F.split("core", "")) == F.array_sort(F.split("other", "")))
    lev = F.levenshtein("core", "other", 3)
    near = (lev == 1) | ((lev == 2) & (swap | (F.least(F.length("core"), F.length("other")) >= TWO_EDITS)))
    return (
        rarest.drop("k")
        .join(other, ["project", "family", "g", "size", "at"])
        .select("project", "family", "core", "other")
        .distinct()
        .filter((F.col("core") == F.col("other")) | near)
    )


def _one(count: Column, value: Column) -> Column:
    return F.when(count == 1, value)


def entity_keys(names: DataFrame) -> DataFrame:
    """(project, text, key): names with equal keys mean the same entity; names: distinct project, text."""
    common = common_tokens(names)
    total = max(2, names.count())
    read = cut(read_names(dealt(names), common, total).withColumn("family", F.when(F.col("form").isin("full", "initial", "bare"), "person").otherwise(F.col("form"))))
    placed = read.filter(F.col("family") != "acronym")
    cores = read.groupBy("project", "family", "core").agg(F.count(F.lit(1)).alias("n"))
    spellings = similar_cores(cores.select("project", "family", "core"))
    sized = cores.select("project", "family", F.col("core").alias("other"), F.col("n").alias("other_n"))
    options = spellings.join(sized, ["project", "family", "other"]).join(cores, ["project", "family", "core"])
    # only the rarer spelling may be the mistake; a core that meets itself may stay
    options = cut(options.filter((F.col("other") == F.col("core")) | (F.col("other_n") > F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other") < F.col("core")))))
    own = options.filter(F.col("other") == F.col("core")).select("project", "family", "core")
    options = options.filter(F.col("other") != F.col("core"))

    # What each core is known with: given names of persons, kind and subject of organisations.
    known = (
        placed.filter(F.col("form").isin("full", "org"))
        .select("project", "family", "core", F.explode(F.when(F.col("form") == "full", F.col("givens")).otherwise(F.array(F.concat_ws("|", "kind", "subject")))).alias("detail"))
        .groupBy("project", "family", "core", "detail")
        .agg(F.count(F.lit(1)).alias("detail_n"))
    )
    mine = placed.withColumn(
        "details",
        F.when(F.col("form") == "full", F.col("givens")).when(F.col("form") == "org", F.array(F.concat_ws("|", "kind", "subject"))).otherwise(F.array(F.lit(None).cast("string"))),
    )
    moves = mine.join(options, ["project", "family", "core"]).select("project", "text", "form", "core", "family", "initial", "kind", "subject", "rest", F.explode("details").alias("detail"), "n", "other", "other_n")
    theirs = known.select("project", "family", F.col("core").alias("other"), F.col("detail").alias("their"))
    fits = (
        F.when(F.col("form") == "full", F.col("detail") == F.col("their"))
        .when(F.col("form") == "initial", F.col("their").startswith(F.col("initial")))
        .when(F.col("form") == "bare", F.lit(True))
        .when(F.col("subject") == "", F.col("their").startswith(F.concat("kind", F.lit("|"))))
        .otherwise(F.col("detail") == F.col("their"))
    )
    # Soft weighted token similarity: the core matches by its edit similarity, a fitting rest wholly.
    weight = F.log(F.lit(float(total)) / F.least(F.col("other_n"), F.lit(total / 2)))
    alike = 1 - F.levenshtein("core", "other") / F.greatest(F.length("core"), F.length("other"))
    soft = (weight * alike + F.col("rest")) / (weight + F.col("rest"))
    alone = placed.filter("form in ('full', 'org')").select("project", "family", "core").distinct().withColumn("stands", F.lit(True))
    accepted = (
        moves.join(theirs, ["project", "family", "other"])
        .filter(fits & (soft >= SOFT))
        .join(alone, ["project", "family", "core"], "left")
        .filter(F.col("form").isin("full", "org") | (F.col("stands").isNull() & (F.length("core") >= BARE) & (F.col("n") <= F.greatest(F.lit(2), F.col("other_n") * RARE))))
        .groupBy("project", "text")
        .agg(F.max(F.struct("other_n", "other")).alias("to"))
        .select("project", "text", F.col("to.other").alias("core"))
    )
    # Names whose core met another take that; the rest those that met their own.
    met = placed.join(own, ["project", "family", "core"])
    settled = met.withColumnRenamed("core", "own").join(accepted, ["project", "text"], "left").withColumn("core", F.coalesce("core", "own")).drop("own")
    settled = cut(dealt(settled))  # used by every rule below

    # Persons: a nickname of several given names takes the one that its surname is known with.
    full = settled.filter("form = 'full'").select("project", "text", "core", F.explode("givens").alias("given"), F.size("givens").alias("m"))
    sure = full.filter("m = 1").groupBy("project", "core", "given").agg(F.count(F.lit(1)).alias("seen"))
    chosen = (
        full.join(sure, ["project", "core", "given"], "left")
        .groupBy("project", "text", "core")
        .agg(F.max(F.struct(F.coalesce("seen", F.lit(0)), "given")).alias("best"), F.sum(F.when(F.col("seen").isNotNull(), 1).otherwise(0)).alias("fit"), F.max("m").alias("m"))
        .filter("m = 1 or fit <= 1")
        .select("project", "text", "core", F.col("best.given").alias("given"))
    )
    chosen = cut(chosen)
    persons = chosen.select("project", "core", "given").distinct()
    by_initial = persons.groupBy("project", "core", F.substring("given", 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("k"), F.min("given").alias("given"))
    initials = settled.filter("form = 'initial'").join(by_initial, ["project", "core", "initial"], "left")
    lettered = initials.select("project", "text", "core", F.when(F.col("k").isNull(), F.concat("initial", F.lit("."))).otherwise(_one(F.col("k"), F.col("given"))).alias("given"))
    everyone = persons.union(lettered.filter("given is not null").select("project", "core", "given")).distinct()
    by_core = everyone.groupBy("project", "core").agg(F.count(F.lit(1)).alias("k"), F.min("given").alias("given"))
    bare = (
        settled.filter("form = 'bare'")
        .join(by_core, ["project", "core"], "left")
        .select("project", "text", "core", F.when(F.col("k").isNull(), F.lit("")).otherwise(_one(F.col("k"), F.col("given"))).alias("given"))
    )
    people = chosen.union(lettered).union(bare).filter("given is not null").select("project", "text", F.concat_ws("|", F.lit("p"), "core", "given").alias("key"))

    # Organisations: a name without a subject, and an acronym, go to the only one that fits.
    orgs = settled.filter("form = 'org'")
    whole = orgs.filter("subject <> ''").withColumn("key", F.concat_ws("|", F.lit("o"), "core", "kind", "subject"))
    distinct = whole.groupBy("project", "key").agg(F.min("core").alias("core"), F.min("kind").alias("kind"), F.min("subject").alias("subject"))
    by_kind = distinct.groupBy("project", "core", "kind").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key"))
    short = orgs.filter("subject = ''").drop("key").join(by_kind, ["project", "core", "kind"], "left").select(
        "project", "text", F.when(F.col("k").isNull(), F.concat_ws("|", F.lit("o"), "core", "kind")).otherwise(_one(F.col("k"), F.col("key"))).alias("key")
    )
    letters = F.concat(F.substring("core", 1, 1), F.substring("kind", 1, 1), F.array_join(F.transform(F.split("subject", " "), lambda w: F.substring(w, 1, 1)), ""))
    by_letters = distinct.withColumn("core", letters).groupBy("project", "core").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key"))
    acronyms = read.filter("form = 'acronym'").join(own, ["project", "family", "core"]).join(by_letters, ["project", "core"], "left").select(
        "project", "text", F.when(F.col("k").isNull(), F.concat_ws("|", F.lit("a"), "core")).otherwise(_one(F.col("k"), F.col("key"))).alias("key")
    )
    return people.union(whole.select("project", "text", "key")).union(short.filter("key is not null")).union(acronyms.filter("key is not null"))


def linked(entities: DataFrame) -> DataFrame:
    """(project, key, entity_id): one row an entity row, its key naming what it means; entities: entity_id, project, text, label."""
    rows = (
        entities.filter(F.col("label").isin("PERSON", "ORG") & F.col("text").isNotNull() & F.col("project").isNotNull() & F.col("entity_id").isNotNull())
        .select(F.col("entity_id").cast("long").alias("entity_id"), "project", "text")
        .dropDuplicates(["entity_id"])
    )
    rows = cut(rows)
    names = rows.select("project", "text").distinct()
    return rows.join(entity_keys(names), ["project", "text"]).select("project", "key", "entity_id")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(entity_a, entity_b), a < b: all pairs of rows of a project that mean the same entity.

    The rows of an entity with more than HOT_MEMBERS are split: each part meets
    all rows in a task of its own.
    """
    keys = cut(linked(entities))
    sizes = keys.groupBy("project", "key").agg(F.ceil(F.count(F.lit(1)) / HOT_MEMBERS).cast("int").alias("parts")).filter("parts > 1")
    split = keys.join(sizes, ["project", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = split.select("project", "key", F.col("entity_id").alias("entity_a"), F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int").alias("part"))
    b = split.select("project", "key", F.col("entity_id").alias("entity_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["project", "key", "part"]).filter("entity_a < entity_b").select("entity_a", "entity_b").distinct()
