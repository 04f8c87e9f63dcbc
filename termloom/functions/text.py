"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and what they become, class by class, in the order of application.
BLANKS = r"[\x00-\x1F\x7F\u2028\u2029\u0092\u00A0\u1680\u180E\u2000-\u200B\u202F\u205F\u3000\uFEFF]"
REPLACED = (
    (r"[\u2010-\u2015\u2212\uFE63\u00AF]", "-"), (r"[\u2018-\u201B`]|\u2039 ?| ?\u203A", "'"), (r"[\u201C-\u201F]|\u00AB ?| ?\u00BB", '"'), ("''", '"'),
    (r"\u2026|\u0085", "..."), (r"\u20AC", "EUR"), (r"[\u25AA\u25BA\u25CF\u25D8\u2192\u2022\u00B7]", "*"),
)
LIGATURES = {
    "\uA732": "AA", "\uA733": "aa", "\u00C6": "AE", "\u00E6": "ae", "\u01F1": "DZ", "\u01F2": "Dz", "\u01F3": "dz", "\uFB03": "ffi", "\uFB00": "ff",
    "\uFB01": "fi", "\uFB04": "ffl", "\uFB02": "fl", "\uFB05": "ft", "\u0132": "IJ", "\u0133": "ij", "\u01C7": "LJ", "\u01C9": "lj", "\u01CA": "NJ",
    "\u01CC": "nj", "\u0152": "OE", "\u0153": "oe", "\u009C": "oe", "\uFB06": "st", "\uA728": "Tz", "\uA729": "tz",
}
TERM_EDGES = r"""[-'",;/%(){}\\\[\]. ©]+"""
TOKEN = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


def normalise_chars(c: Column) -> Column:
    """Blanks, dashes, quotes, ellipses, euro signs, bullets and ligatures in their plain forms (B1)."""
    c = F.trim(F.regexp_replace(F.regexp_replace(c, BLANKS, " "), " +", " "))
    for pattern, plain in REPLACED:
        c = F.regexp_replace(c, pattern, plain)
    for joined, letters in LIGATURES.items():
        c = F.replace(c, F.lit(joined), F.lit(letters))
    return c


def strip_tags(c: Column) -> Column:
    """Without tags of up to 45 characters (B2)."""
    return F.regexp_replace(c, "<[^>]{0,45}>", "")


def normalise_term(c: Column, lower: bool = True) -> Column:
    """Without punctuation at both ends, in lower case."""
    c = F.regexp_replace(F.regexp_replace(c, "^" + TERM_EDGES, ""), TERM_EDGES + "$", "")
    return F.lower(c) if lower else c


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Words, hyphenated ones whole."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def counted(words: Column) -> Column:
    """array<struct<term, weight>>: the distinct words of an array, in order, with how often each is there."""

    def runs(w: Column) -> Column:
        heads = F.array_compact(F.transform(w, lambda x, i: F.when(i == 0, i).when(w[i - 1] != x, i)))
        each = lambda h: F.transform(h, lambda x, k: F.struct(w[x].alias("term"), (F.coalesce(F.get(h, k + 1), F.size(w)) - x).cast("double").alias("weight")))
        return let(heads, each)

    return let(F.sort_array(words), runs)


def placed(words: Column) -> Column:
    """array<struct<term, positions>>: the distinct words of an array with their places, from 0, in order."""

    def runs(w: Column) -> Column:
        heads = F.array_compact(F.transform(w, lambda x, i: F.when(i == 0, i).when(w[i - 1]["term"] != x["term"], i)))
        places = lambda h, x, k: F.transform(F.slice(w, x + 1, F.coalesce(F.get(h, k + 1), F.size(w)) - x), lambda e: e["pos"])
        return let(heads, lambda h: F.transform(h, lambda x, k: F.struct(w[x]["term"].alias("term"), places(h, x, k).alias("positions"))))

    return let(F.sort_array(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))), runs)


def phrases_between(tokens_: Column, stops: Column, most: int = 6) -> Column:
    """Runs of words between stop words and signs, of at most ``most`` words, from an array of both (B6). Each expression passes
    once over the text; words hold no U+0001 or U+0002, which mark places here."""
    flagged = let(F.array_intersect(tokens_, stops), lambda here: F.transform(tokens_, lambda t: F.when(F.array_contains(here, t) | ~t.rlike(r"^[\p{L}\p{N}_]"), "\u0002").otherwise(t)))
    runs = F.transform(F.split(F.array_join(flagged, "\u0001"), "\u0002"), lambda r: F.btrim(r, F.lit("\u0001")))
    return F.transform(F.filter(runs, lambda r: (r != "") & (F.length(r) - F.length(F.replace(r, F.lit("\u0001"), F.lit(""))) < most)), lambda r: F.replace(r, F.lit("\u0001"), F.lit(" ")))


def chunk_tagged(tagged: Column, letter: Callable[[Column], Column], rule: str = "J*N+J*", most: int = 6) -> Column:
    """Phrases whose tags match ``rule``, of at most ``most`` tokens, from array<struct<token, tag>>.

    ``letter`` maps a tag to one letter of the rule; a phrase starts where the letters before it end. Each expression passes once
    over the text, however many phrases it holds. Tokens lose the characters U+0001 to U+0003, which mark places here.
    """
    letters = F.array_join(F.transform(tagged, lambda t: letter(t["tag"])), "")
    marked = F.replace(F.regexp_replace(letters, f"({rule})", "<$1>"), F.lit("<>"), F.lit(""))
    marks = F.regexp_extract_all(marked, F.lit("<?[^<>]>?"), F.lit(0))  # one a token
    words = F.transform(tagged, lambda t: F.translate(t["token"], "\u0001\u0002\u0003", ""))
    opened = lambda m: F.when(m.startswith("<"), "\u0002").otherwise("")
    closed = lambda m: F.when(m.endswith(">"), "\u0003").otherwise("")
    line = F.array_join(F.zip_with(words, marks, lambda w, m: F.concat(opened(m), w, closed(m))), "\u0001")
    runs = F.transform(F.regexp_extract_all(line, F.lit("\u0002([^\u0003]*)\u0003"), F.lit(1)), lambda r: F.split(r, "\u0001"))
    return F.transform(F.filter(runs, lambda r: F.size(r) <= most), lambda r: F.array_join(r, " "))


def sub_phrases(words: Column) -> Column:
    """All runs of neighbouring words."""
    starts = F.sequence(F.lit(1), F.size(words))
    each = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.slice(words, i, n)))
    return F.when(F.size(words) > 0, F.flatten(each)).otherwise(F.array().cast("array<array<string>>"))


# Suffix rules of the light stemmers, tried in order (Harman 1991 for English; Savoy 1999 for the others).
STEM_RULES = {
    "en": (("(?<![ea])ies$", "y"), ("(?<![aeo])es$", "e"), ("(?<![us])s$", "")),
    "fr": (("eaux$", "eau"), ("aux$", "al"), ("[xs]$", ""), ("e$", "")),
    "de": (("(?:ern|em|er|en|es)$", ""), ("[ens]$", "")),
    "es": (("ces$", "z"), ("(?:os|as|es)$", ""), ("[oae]$", "")),
}


def stem(c: Column, lang: str = "en") -> Column:
    """The first rule that matches applies; words of up to three letters stay."""
    out = c
    for pattern, new in reversed(STEM_RULES.get(lang, ())):
        out = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, new)).otherwise(out)
    return F.when(F.length(c) <= 3, c).otherwise(out)


def stem_key(term: Column, lang: str = "en", stemmer: Callable[[Column, str], Column] = stem) -> Column:
    """Stems of a term's words, joined by blanks."""
    words = F.filter(F.split(term, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: stemmer(w, lang)), " ")


# Vowels, and endings that a light stemmer takes off (after the Snowball stemmers of M. Porter), the longest that fits.
VOWELS = {"en": "aeiouy", "fr": "aeiouyâàëéêèïîôûù", "de": "aeiouyäöü", "es": "aeiouáéíóúü"}
ENDINGS = {
    "en": "ations|ation|ments|ment|nesses|ness|ings|ing|edly|ed|ies|es|ly|s",
    "fr": "issements|issement|ements|ement|ations|ation|ateurs|ateur|ences|ence|ités|ité|euses|euse|eux|ives|ive|ifs|if|antes|ants|ante|ant|ées|és|ée|er|ez|es|e|s",
    "de": "ungen|ung|heiten|heit|keiten|keit|lichen|lich|ischen|isch|ern|em|en|er|es|e|s",
    "es": "amientos|amiento|aciones|ación|adores|ador|idades|idad|mente|ados|adas|ado|ada|ando|iendo|ar|er|ir|os|as|es|o|a|e|s",
}


def region_pattern(lang: str) -> str:
    """What stays, as group 1, and an ending of the language behind it: the ending lies in the region behind the first vowel and the first
    letter after it that is none."""
    v = VOWELS[lang]
    return rf"^([^{v}]*[{v}]+[^{v}].*?)(?:{ENDINGS[lang]})$"


def region_stem(word: Column, lang: Column) -> Column:
    """A word without the ending that its language knows in its region; words of up to three letters, and those of other languages, stay."""
    out = word
    for name in ENDINGS:
        out = F.when(lang == name, F.regexp_replace(word, region_pattern(name), "$1")).otherwise(out)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def language_key(term: Column, lang: Column) -> Column:
    """Stems of a term's words by the rules of its language, joined by blanks."""
    words = F.filter(F.split(term, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: region_stem(w, lang)), " ")


def quoted(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_word(term: str) -> str:
    """Pattern of a term between non-words, in any case; runs of blanks match runs of blanks."""
    return r"(?iU)(?<![\p{L}\p{N}_])" + r"\s+".join(quoted(p) for p in term.split()) + r"(?![\p{L}\p{N}_])"


def count_term(c: Column, term: str) -> Column:
    """Whole-word occurrences."""
    return F.regexp_count(c, F.lit(whole_word(term)))


def mentions(term: str, *fields: Column) -> Column:
    """Whether a field holds the term as whole words."""
    found = F.lit(False)
    for c in fields:
        found = found | F.coalesce(c.rlike(whole_word(term)), F.lit(False))
    return found


def all_of(words: Column, *wanted: str) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) == len(set(wanted))


def any_of(words: Column, *wanted: str) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def none_of(words: Column, *unwanted: str) -> Column:
    return ~any_of(words, *unwanted)


def phrase(words: Column, *parts: str) -> Column:
    """Whether the parts follow each other; words hold no blanks."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(parts) + " "))


def is_single(term: Column) -> Column:
    """Whether a term is one word."""
    return F.instr(term, " ") == 0


def compare(c: Column, operator: str, value) -> Column:
    """A metadata predicate by name."""
    made = {
        "=": lambda: c == value, "!=": lambda: c != value, "<": lambda: c < value, ">": lambda: c > value, "<=": lambda: c <= value, ">=": lambda: c >= value,
        "in": lambda: c.isin(*value), "contains": lambda: c.contains(value), "doesnotcontain": lambda: ~c.contains(value),
        "startswith": lambda: c.startswith(value), "endswith": lambda: c.endswith(value),
    }
    if operator not in made:
        raise ValueError(f"no predicate {operator!r}")
    return made[operator]()
