"""Text functions as columns: normalisation, words, overlap measures, rule-based types.

All of them are built-in expressions, so they stay inside code generation and
reach into scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that count as one, marks that are dropped, and the two opening formulas.
LETTER_FORMS = ("أإآٱىةؤئ", "ااااي" + "ه" + "وي")
MARKS = "[\\u064B-\\u065F\\u0670]"
SHORT_MARKS = "[\\u064B-\\u0652]"
WHITE = "[\\p{Z}\\t-\\r\\x1c-\\x20\\x85]"
NOT_WORD = "[^\\p{L}\\p{N}_\\p{Z}\\t-\\r\\x1c-\\x20\\x85]"
ISTIADHA = "[اأإآٱو]?عوذ\\s*بالله\\s*من\\s*الشيطان\\s*الرجيم"
BASMALA = "(?:ب\\s*س?م?\\s*)?الله\\s*الرحمن\\s*الرحيم"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(text: Column | str) -> Column:
    """Folds letter forms, drops marks and punctuation, leaves single spaces; null counts as empty."""
    folded = F.translate(F.coalesce(_c(text), F.lit("")), *LETTER_FORMS)
    bare = F.regexp_replace(F.regexp_replace(folded, MARKS, ""), NOT_WORD, "")
    return F.trim(F.regexp_replace(bare, f"{WHITE}+", " "))


def normalize_strict(text: Column | str) -> Column:
    """The other normaliser: folds alef forms only and drops all but basic letters and spaces."""
    return F.regexp_replace(F.translate(F.coalesce(_c(text), F.lit("")), "أإآٱ", "اااا"), "[^\\u0621-\\u064A\\s]", "")


def remove_diacritics(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), SHORT_MARKS, "")


def words(text: Column | str) -> Column:
    """Words between white space, none for an empty text."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), f"{WHITE}+"), lambda w: w != "")


def normalized_words(text: Column | str) -> Column:
    return words(normalize(text))


def word_count(text: Column | str) -> Column:
    return F.size(normalized_words(text))


def first_words(text: Column | str, n: Column | int) -> Column:
    return F.array_join(F.slice(normalized_words(text), 1, n), " ")


def last_words(text: Column | str, n: int) -> Column:

    def of(found: Column) -> Column:
        taken = F.least(F.lit(n), F.size(found))
        return F.when(taken > 0, F.array_join(F.slice(found, -taken, taken), " ")).otherwise("")

    return let(normalized_words(text), of)


def first_last_words(text: Column | str, n: int) -> Column:
    return F.struct(first_words(text, n).alias("first"), last_words(text, n).alias("last"))


def coverage_ratio(text: Column | str, reference: Column | str) -> Column:
    """Words of the text for each word of the reference; 0 where the reference has none."""
    return let(word_count(reference), lambda wanted: F.when(wanted > 0, word_count(text) / wanted).otherwise(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)

    return let(F.struct(a.alias("x"), b.alias("y")), of)


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(normalized_words(a), normalized_words(b))


def bigrams(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    places = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1)))
    return let(text, lambda t: F.when(F.length(t) >= 2, F.array_distinct(F.transform(places(t), lambda i: F.substring(t, i, 2)))).otherwise(empty))


def bigram_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(bigrams(normalize(a)), bigrams(normalize(b)))


def multiset_append(first: Column | str, second: Column | str) -> Column:
    """struct(merged, overlap): the second text's words that the first has not yet used up, after the first.

    A word of the second is dropped while the first holds an occurrence of its normal form that no
    earlier word of the second has taken.
    """

    def kept(p: Column) -> Column:
        def stays(w: Column, i: Column) -> Column:
            form = F.get(p["forms"], i)
            before = F.size(F.filter(F.slice(p["forms"], 1, i + 1), lambda x: x == form))
            return before > F.size(F.filter(p["a"], lambda x: x == form))

        return F.struct(F.filter(p["b"], stays).alias("rest"), F.size(p["b"]).alias("n"))

    def merged(p: Column) -> Column:
        lead = F.trim(F.coalesce(_c(first), F.lit("")))
        none, n = F.size(p["rest"]) == 0, F.size(p["rest"])
        text = F.when(none, lead).otherwise(F.concat(lead, F.lit(" "), F.array_join(p["rest"], " ")))
        return F.struct(text.alias("merged"), (none | (n < p["n"])).alias("overlap"))

    split = let(words(second), lambda b: F.struct(normalized_words(first).alias("a"), b.alias("b"), F.transform(b, normalize).alias("forms")))
    return let(let(split, kept), merged)


def segment_type(kind: Column | str, text: Column | str) -> Column:
    """The type by its column if that names a formula, else by the text, basmala before istiadha."""
    plain = normalize(text)  # at most twice
    return F.when(_c(kind).isin("basmala", "basmalah"), "basmala").when(_c(kind) == "istiadha", "istiadha").when(plain.rlike(BASMALA), "basmala").when(plain.rlike(ISTIADHA), "istiadha")


def text_type(text: Column | str) -> Column:
    """struct(kind, id) by the text alone, istiadha before basmala; id 0 for formulas, 1 for verses."""
    plain = normalize(text)
    kind = F.when(plain.rlike(ISTIADHA), "istiadha").when(plain.rlike(BASMALA), "basmala").otherwise("ayah")
    return F.struct(kind.alias("kind"), F.when(kind == "ayah", 1).otherwise(0).alias("id"))


def group_number(path: Column | str) -> Column:
    """The first run of digits of a file name's stem if it is 1 to 114, else null."""
    name = F.element_at(F.split(_c(path), "[/\\\\]"), -1)
    number = F.try_to_number(F.substring(F.regexp_extract(F.regexp_replace(name, "\\.[^.]*$", ""), "\\d+", 0), 1, 9), F.lit("999999999")).cast("int")
    return F.when(number.between(1, 114), number)


def has_required(text: Column | str, tokens: Column) -> Column:
    """Whether every token is part of the normalised text."""
    return let(normalize(text), lambda plain: F.forall(tokens, lambda t: F.contains(plain, t)))


def quality_bucket(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.95, "excellent").when(s >= 0.85, "good").when(s >= 0.70, "acceptable").otherwise("poor")


def adaptive_threshold(n_words: Column | str, base: float = 0.85) -> Column:
    """A lower bar for short units: under 5 words 0.60, up to 15 0.75."""
    n = _c(n_words)
    return F.when(n < 5, 0.60).when(n <= 15, 0.75).otherwise(base)


def words_to_check(n_words: Column | str) -> Column:
    return F.least(F.greatest(_c(n_words), F.lit(1)), F.lit(3))


def db_to_amplitude(db: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 20.0)


def ms_to_seconds(ms: Column | str) -> Column:
    return _c(ms) / 1000.0
