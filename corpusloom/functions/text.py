"""Column functions over text: tokenizers, sentences, paragraphs, patterns, clean-up.

All are built-in expressions that stay inside code generation.  A null text
gives a null result; an empty text gives an empty array, 0 or an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, date and citation patterns, and the word boundary that ASCII engines use.
WORD = r"[a-zA-Z][a-zA-Z\-']+"
ACCENTED = r"[a-záéíóúüñ']{2,}"
ASCII = r"[a-z']{2,}"
LETTERS = r"[\p{L}]{3,}"
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
YEAR = r"(1[0-9]{3}|20[0-4][0-9])"
NAME = r"[A-Z][a-zA-Z\.\-]+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z\.\-]+)?(?:\s+et al\.?)?"
PLAIN_YEAR = r"(?:1[0-9]{3}|20[0-4][0-9])"
CITATION = rf"\({NAME},?\s*{PLAIN_YEAR}\)|{NAME}\s*\({PLAIN_YEAR}\)"
NOTE = r"\(([A-Z][a-záéíóú\-]+(?:\s+(?:and|&)\s+[A-Z][a-záéíóú\-]+)?(?:\s+et\s+al\.?)?),?\s*(\d{4}[a-z]?)\)"

# Words that keyword extraction leaves out.
STOPWORDS = (
    "the and that this with from have has had was were are for not but you your they their them what which when where who whom whose how why "
    "into onto than then there here also such some more most much many very just only about after before because while during between through under over again further once "
    "each these those being been would could should might will shall must can may its it's however therefore thus hence chapter section page figure table etc i.e e.g"
).split()


def tokens(text: Column) -> Column:
    """Words of letters, hyphens and apostrophes, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower)


def tokens_accented(text: Column) -> Column:
    """Words with the accented letters of Spanish, between ASCII boundaries."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{EDGE}({ACCENTED}){EDGE}"), F.lit(1))


def tokens_ascii(text: Column) -> Column:
    """Words of ASCII letters and apostrophes, between ASCII boundaries."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{EDGE}({ASCII}){EDGE}"), F.lit(1))


def tokens_letters(text: Column) -> Column:
    """Runs of three or more letters of any alphabet, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<![\\p{{L}}\\p{{N}}_])({LETTERS})(?![\\p{{L}}\\p{{N}}_])"), F.lit(1))


def tokens_alpha(text: Column) -> Column:
    """Lower-case words of letters only; clitics such as 's are cut off (an approximation of a trained tokenizer)."""
    plain = F.regexp_replace(F.lower(text), r"(?<=\p{L})(n['’]t|['’](s|re|ve|ll|d|m))(?![\p{L}])", " ")
    return F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\p{N}_\-])(\p{L}+)(?![\p{L}\p{N}_\-])"), F.lit(1))


def spaced_words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(spaced_words(text))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, n: int = 40) -> Column:
    """The first n words, and dots if there are more."""
    w = spaced_words(text)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, "...").otherwise(""))


def clip(text: Column, n: int) -> Column:
    """At most n characters; a longer text ends with an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(text)


def short_number(n: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.2M."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", F.round(n / 1_000_000, 1)))
        .when(n >= 1_000, F.format_string("%.1fk", F.round(n / 1_000, 1)))
        .otherwise(n.cast("string"))
    )


def sentences(text: Column) -> Column:
    """Pieces between . ! and ? with more than two words."""
    return F.filter(F.split(text, r"[.!?]+"), lambda s: word_count(s) > 2)


def sentences_after(text: Column) -> Column:
    """Sentences with their marks: split after . ! or ? and white space."""
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """Pieces between . ! and ? that aren't blank, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: strip(s) != "")))


def syllables(word: Column) -> Column:
    """Vowel groups of at most two letters, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(F.lower(word), "[^a-z]", ""), F.lit("[aeiouy]{1,2}")))


def total_syllables(words: Column) -> Column:
    """Sum of syllables() over an array of lower-case words, by three passes over the joined words."""
    joined = F.regexp_replace(F.array_join(words, " "), "[^a-z ]", "")
    return F.regexp_count(joined, F.lit("[aeiouy]{1,2}")) + F.size(words) - F.regexp_count(joined, F.lit("[aeiouy][a-z]*"))


def markdown_to_text(text: Column) -> Column:
    """Without fenced code; the signs of markup become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"[#*_`>\-\[\]()]", " ")


def html_escape(text: Column) -> Column:
    x = F.replace(text, F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    x = F.replace(x, F.lit(">"), F.lit("&gt;"))
    return F.replace(x, F.lit('"'), F.lit("&quot;"))


def citations(text: Column, most: int = 25) -> Column:
    """Distinct citations in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CITATION})"), F.lit(1))), 1, most)


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")


def year_ranges(text: Column) -> Column:
    """Distinct ranges (start, end) with start <= end, outside citations, in order of appearance."""
    spans = F.regexp_extract_all(without_citations(text), F.lit(rf"(?<!\w)({YEAR}\s*[-–—]\s*{YEAR})(?!\w)"), F.lit(1))
    pairs = F.transform(spans, lambda x: F.struct(F.substring(x, 1, 4).cast("int").alias("s"), F.right(x, F.lit(4)).cast("int").alias("e")))
    return F.array_distinct(F.filter(pairs, lambda p: p["s"] <= p["e"]))


def years(text: Column) -> Column:
    """All years outside citations."""
    return F.transform(F.regexp_extract_all(without_citations(text), F.lit(rf"(?<!\w){YEAR}(?!\w)"), F.lit(1)), lambda x: x.cast("int"))


def single_years(all_years: Column, ranges: Column) -> Column:
    """Distinct years that no range begins or ends with, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(all_years), F.concat(F.transform(ranges, lambda p: p["s"]), F.transform(ranges, lambda p: p["e"]))))


def blocks_blank(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.split(strip(text), r"\n\s*\n+")


def blocks_double(text: Column) -> Column:
    """Blocks between two or more line ends."""
    return F.split(text, r"\n{2,}")


def think_split(text: Column) -> Column:
    """struct(think, answer) of a model's output."""
    has = F.contains(text, F.lit("</think>"))
    think = F.when(has, F.trim(F.regexp_replace(F.split(text, "</think>", 2)[0], "<think>", ""))).otherwise(F.lit(""))
    answer = F.when(has, F.trim(F.split(text, "</think>", 2)[1])).otherwise(F.trim(text))
    return F.struct(think.alias("think"), answer.alias("answer"))


def without_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def json_rescue(text: Column) -> Column:
    """The text if it is a JSON object, else its first to last brace if that is one, else null."""
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.get_json_object(x, "$").isNotNull()
    return F.when(ok(text) & F.trim(text).startswith("{"), F.trim(text)).when((block != "") & ok(block), block)


def valid_label(text: Column) -> Column:
    """A topic label: at most 34 characters and 4 words, no phrase of a talking model."""
    return (
        (F.length(F.trim(text)) > 0)
        & (F.length(F.trim(text)) <= 34)
        & (word_count(text) <= 4)
        & ~F.lower(F.trim(text)).rlike(r"^(here|sure|the topic|topic|label|this|i |as an)")
    )


def clean_entity(text: Column) -> Column:
    """Without marks around it and without a final possessive."""
    x = squeeze(text)
    x = F.regexp_replace(x, "^[ \\t.,;:!?\"“”‘’()\\[\\]—-]+|[ \\t.,;:!?\"“”‘’()\\[\\]—-]+$", "")
    return F.regexp_replace(x, "[’']s$", "")


# Titles by gender.
MALE = "mr mister sir lord monsieur herr señor senor don signor king prince duke count baron father uncle".split()
FEMALE = "mrs ms miss lady madame madam mme mlle frau señora senora doña dona signora queen princess duchess countess baroness mother aunt".split()
NEUTRAL = "dr doctor prof professor captain colonel major general saint st reverend rev sergeant inspector judge".split()


def title_split(name: Column) -> Column:
    """struct(core, gender, title) of a name: gender m, f or null by its titles, of which the first is kept."""
    parts = spaced_words(name)
    key = lambda p: F.regexp_replace(F.lower(p), r"^\.+|\.+$", "")
    titled = F.transform(F.filter(parts, lambda p: key(p).isin(MALE + FEMALE + NEUTRAL)), key)
    gendered = F.filter(titled, lambda k: k.isin(MALE + FEMALE))
    last = F.when(F.size(gendered) > 0, F.element_at(gendered, -1))
    return F.struct(
        F.filter(parts, lambda p: ~key(p).isin(MALE + FEMALE + NEUTRAL)).alias("core"),
        F.when(last.isin(MALE), "m").when(last.isin(FEMALE), "f").alias("gender"),
        F.when(F.size(titled) > 0, titled[0]).alias("title"),
    )


def input_hash(task: Column, text: Column) -> Column:
    """Hash of a task and its normalised input."""
    return F.substring(F.sha2(F.concat(task, F.lit("|"), F.lower(squeeze(text))), 256), 1, 32)


def short_id(path: Column) -> Column:
    return F.substring(F.md5(path), 1, 10)


def critique_passes(text: Column) -> Column:
    """YES occurs, and no NO before it."""
    up = F.upper(text)
    return F.contains(up, F.lit("YES")) & ~F.contains(F.split(up, "YES", 2)[0], F.lit("NO"))


def route(text: Column) -> Column:
    """CODE, MULTILINGUAL or GENERAL, from a model's answer; CODE wins."""
    up = F.upper(text)
    return F.when(F.contains(up, F.lit("CODE")), "CODE").when(F.contains(up, F.lit("MULTILINGUAL")), "MULTILINGUAL").otherwise("GENERAL")


_END = "\u0001"


def reflowed(text: Column) -> Column:
    """Hard-wrapped lines joined to paragraphs, with a blank line between those.

    Lines of a bare number of up to four digits are left out.  A paragraph ends
    at an empty line, and after a line that ends a sentence and is shorter than
    0.6 of the usual length (the median of lines above 20 characters, 80
    without any).  A hyphen before a line end and a small letter is undone.
    """
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), strip)
    long = F.array_sort(F.filter(F.transform(lines, F.length), lambda n: n > 20))
    half = F.size(long)
    middle = (F.get(long, F.floor((half - 1) / 2).cast("int")) + F.get(long, F.floor(half / 2).cast("int"))) / 2
    usual = F.coalesce(middle, F.lit(80.0))
    marked = F.transform(
        F.filter(lines, lambda x: ~x.rlike(r"^[0-9]{1,4}$")),
        lambda x: F.when(x == "", F.lit(_END)).when((F.length(x) < 0.6 * usual) & x.rlike("[.!?:\"”’)\\]]$"), F.concat(x, F.lit("\n" + _END))).otherwise(x),
    )
    x = F.regexp_replace(F.array_join(marked, "\n"), r"-\n(\p{Ll})", "$1")
    x = F.regexp_replace(F.regexp_replace(x, f"\n*{_END}[\n{_END}]*", _END), "\n", " ")
    return F.replace(F.regexp_replace(x, f"^{_END}|{_END}$", ""), F.lit(_END), F.lit("\n\n"))


def line_ends(text: Column) -> Column:
    """All line ends as line feeds."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def stamp(time: Column) -> Column:
    """A time as part of a file name: 20240131_235959."""
    return F.date_format(time, "yyyyMMdd_HHmmss")
