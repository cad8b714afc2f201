"""Text expressions from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import ABBREVIATIONS, DIGRAPHS, DOMAIN_INSIDE, DOMAIN_PHONE, DOMAIN_TITLE, DOMAIN_WHOLE, HONORIFICS, HOUSE_LETTER, HOUSE_WORDS, LEGAL_FORMS, NO_HOUSE_PREFIX, NUMBER_AFTER, OTHER_POSTAL_CODE, POSTAL_CODES, SHORT_LEGAL_FORMS, SLASH_NUMBERS, STOPWORDS

#: A place where a word of digits begins or ends, also next to marks of Brahmic scripts.
_EDGE, _EDGE_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: A number that is a word.
NUMBER = rf"{_EDGE}(\d+){_EDGE_END}"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(c: Column, make) -> Column:
    """``make`` of a value that is worked out once, however often the result names it.

    Lambdas run without the elimination of common parts, so one that names an expression works it out at every element.
    """
    return F.get(F.transform(F.array(c), make), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """Lower case, whatever is no ASCII letter or digit as a space, squeezed; empty for null. Accents aren't folded."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "))


def alnum(c: Column) -> Column:
    """Whatever is no small ASCII letter or digit as one space a run, none at the ends: what :func:`squeeze` makes of the text once such characters are spaces, in one pass."""
    return F.trim(F.regexp_replace(c, r"[[^a-z0-9\s]\s]+", " "))


def without_legal_forms(c: Column, forms: list[str] = SHORT_LEGAL_FORMS) -> Column:
    return squeeze(F.regexp_replace(c, rf"\b({'|'.join(forms)})\b", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams, ascending; the text itself if it is shorter, none if it is empty."""
    none = F.array().cast("array<string>")

    def grams(text: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(text == "", none).when(F.length(text) < n, F.array(text)).otherwise(F.sort_array(F.array_distinct(many)))

    return once(squeeze(c), grams)


def skeleton(c: Column) -> Column:
    """Digraphs rewritten, vowels dropped but for the first letter, repeated letters written once."""
    out = F.lower(c)
    for a, b in DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.concat(F.substring(out, 1, 1), F.regexp_replace(F.substring(out, F.lit(2), F.length(out)), r"[aeiouy\s]", ""))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def soundex(c: Column) -> Column:
    """American Soundex; empty unless the text is all letters."""
    return F.when(c.rlike("^[a-zA-Z]+$"), F.soundex(c)).otherwise("")


def legal_forms_in(c: Column) -> Column:
    """The legal forms found in a text, upper case, in order; longer forms first at a place."""
    ordered = sorted(LEGAL_FORMS, key=len, reverse=True)
    return F.regexp_extract_all(F.upper(c), F.lit(rf"\b({'|'.join(ordered)})\b"), F.lit(1))


def drop_legal_forms(tokens: Column) -> Column:
    forms = literals(LEGAL_FORMS)
    return F.filter(tokens, lambda t: ~F.array_contains(forms, F.upper(t)))


def distinctive(tokens: Column, least: int = 2) -> Column:
    stop = literals(STOPWORDS)
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t) & (F.length(t) >= least))


def expand(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.transform(tokens, lambda t: F.lower(F.coalesce(F.try_element_at(table, F.upper(t)), t)))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def sorted_join(tokens: Column, by: str = " ") -> Column:
    return F.array_join(F.array_sort(tokens), by)


def strip_honorific(c: Column) -> Column:
    """The text without leading honorifics; null if there are none or nothing is left."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    out = F.regexp_replace(F.regexp_replace(text, f"(?i){HONORIFICS}", ""), r"(?U)^\s+|\s+$", "")
    return F.when((out != "") & (F.lower(out) != F.lower(text)), out)


def domain(c: Column) -> Column:
    """The body of a domain name, without hyphens; null if there is none of three characters."""
    text = F.regexp_replace(F.lower(F.trim(c)), DOMAIN_PHONE, "")
    text = F.trim(F.regexp_replace(F.trim(text), DOMAIN_TITLE, ""))
    whole, inside = F.regexp_extract(text, DOMAIN_WHOLE, 1), F.regexp_extract(text, DOMAIN_INSIDE, 1)
    body = F.replace(F.when(whole != "", whole).otherwise(inside), F.lit("-"), F.lit(""))
    return F.when(F.length(body) >= 3, body)


def postal_code(c: Column, country: Column) -> Column:
    """The last postal code by the country's form; null if there is none."""
    last = lambda digits: F.try_element_at(F.regexp_extract_all(c, F.lit(f"{_EDGE}({digits}){_EDGE_END}"), F.lit(1)), F.lit(-1))
    out = F
    for name, digits in POSTAL_CODES.items():
        out = out.when(country == name, last(digits))
    return out.otherwise(last(OTHER_POSTAL_CODE))


def first_postal_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b([0-9]{5,6})\b", 1), F.lit(""))


def leading_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit(""))


def house_number(tokens: Column) -> Column:
    """The first token if it is a number with at most a letter, else the first number of four tokens."""
    first = F.get(tokens, F.lit(0))
    return F.when(first.rlike(r"^\d+[a-z]?$"), first).otherwise(F.get(F.filter(F.slice(tokens, 1, 4), lambda t: t.rlike(r"^\d+$")), F.lit(0)))


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def _with_stripped(numbers: Column) -> Column:
    """Numbers and the same without leading zeros."""
    return F.filter(F.flatten(F.transform(numbers, lambda d: F.array(d, strip_zeros(d)))), lambda d: d != "")


def slash_parts(c: Column) -> Column:
    """Numbers joined by slashes or hyphens, as arrays of their parts."""
    found = F.regexp_extract_all(c, F.lit(rf"(?:{_EDGE}|[a-z])({SLASH_NUMBERS}){_EDGE_END}"), F.lit(1))
    return F.transform(found, lambda x: F.split(x, "[/-]"))


def slash_compounds(c: Column) -> Column:
    parts = slash_parts(c)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.array(F.array_join(p, "_"), F.array_join(p, ""))))))


def _house_pairs(c: Column) -> Column:
    pattern = F.lit(HOUSE_LETTER)
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("p"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("n"))
    return F.filter(pairs, lambda x: ~x["p"].isin(NO_HOUSE_PREFIX))


def _house_words(c: Column) -> Column:
    pattern = F.lit(HOUSE_WORDS)
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("v"))
    return F.filter(pairs, lambda x: F.length(F.regexp_replace(x["v"], "[^a-z0-9]", "")).between(1, 10))


def house_tokens(c: Column) -> Column:
    """Letters with a number (a303) and values after words like door or flat, also with the word (flat_303)."""
    bare = lambda x: F.regexp_replace(x["v"], "[^a-z0-9]", "")
    named = F.flatten(F.transform(_house_words(c), lambda x: F.array(F.concat_ws("_", x["k"], bare(x)), bare(x))))
    return F.array_sort(F.array_distinct(F.concat(F.transform(_house_pairs(c), lambda x: F.concat(x["p"], x["n"])), named)))


def numeric_atoms(c: Column) -> Column:
    """All numbers of an address, also those after letters or in compounds, with and without leading zeros."""
    alone = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))
    after = F.regexp_extract_all(c, F.lit(NUMBER_AFTER), F.lit(2))
    parts = _with_stripped(F.concat(alone, after, F.flatten(slash_parts(c))))
    pairs = F.transform(_house_pairs(c), lambda x: x["n"])
    named = F.flatten(F.transform(_house_words(c), lambda x: F.regexp_extract_all(x["v"], F.lit(r"(\d+)"), F.lit(1))))
    return F.array_distinct(F.concat(parts, pairs, named))


def by_length(numbers: Column) -> Column:
    """Shorter first, then ascending."""
    return F.transform(F.array_sort(F.transform(numbers, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def set_ratio(a: Column, b: Column, kind: str) -> Column:
    """Jaccard, cosine or containment of two arrays of distinct values; 0 if either is empty."""
    both, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    below = {"jaccard": x + y - both, "cosine": F.sqrt(x * y), "containment": F.least(x, y)}[kind]
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(both / below)


def bigram_dice(a: Column, b: Column) -> Column:
    """1 if equal, the ratio of lengths if one holds the other, else the Dice coefficient of bigrams."""
    x, y = ngrams(a, 2), ngrams(b, 2)
    dice = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    inside = (F.contains(a, b) | F.contains(b, a)) & (a != "") & (b != "")
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(inside, ratio).otherwise(dice)
