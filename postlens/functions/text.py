"""String functions (STR1-STR14) as JVM-side Column expressions.

None of them is a Python UDF: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------

# Python's string.punctuation, used by the token-class test (substring test).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# NLTK English stop-word list (179 words), in its published order.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s",
    "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d",
    "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# Labels that, before a two-letter country code, belong to the public suffix
# (co.uk, com.au, gov.br, ...); any other host ends in a one-label suffix.
SECOND_LEVEL_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "id", "ltd", "mil", "ne", "net", "nom", "or",
                       "org", "plc", "sch"]

# Basic English tokenizer rules (public torchtext definition), applied in order
# after lower-casing: pattern -> replacement.
BASIC_ENGLISH_RULES = [
    (r"'", " '  "),
    (r'"', ""),
    (r"\.", " . "),
    (r"<br />", " "),
    (r",", " , "),
    (r"\(", " ( "),
    (r"\)", " ) "),
    (r"!", " ! "),
    (r"\?", " ? "),
    (r";", " "),
    (r":", " "),
]

# Characters of the Unicode numeric types "decimal" and "digit", as a class.
UNICODE_DIGITS = (r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
                  r"\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}"
                  r"\x{2780}-\x{2788}\x{278A}-\x{2792}")

# Checkpoint file names hold numbers like 3, 1.55, -0.2.
NUMBER_PATTERN = r"([-+]?\d*\.\d+|\d+)"
SCORER_LINE_FORMAT = "%-9s precision: %.4f recall: %.4f f-score: %.4f"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_only(c) -> Column:
    """STR1: drop every character with code point >= 128."""
    return F.regexp_replace(_c(c), r"[^\x00-\x7F]", "")


def concat_fields(cols, sep: str = " ") -> Column:
    """STR2/PRJ5: null to '', cast to string, join with ``sep``.

    Unlike ``concat_ws`` the separator is always present, so four fields give
    three separators even when all are null.
    """
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.concat(*parts)


def char_len(c) -> Column:
    """STR3: number of characters, as BIGINT."""
    return F.char_length(_c(c)).cast("long")


def has_substring(c, needle: str) -> Column:
    """STR4: literal substring test."""
    return F.contains(_c(c), F.lit(needle))


def replace_literal(c, search: str, repl: str = "") -> Column:
    """STR4: replace a literal, e.g. ``' [PAD]'``."""
    return F.replace(_c(c), F.lit(search), F.lit(repl))


def url_host(c) -> Column:
    """Host part of a link, lower case; the scheme may be missing
    (``www.facebook.com/x``), user and port are left out."""
    return F.regexp_extract(
        F.lower(_c(c)), r"^\s*(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]*)", 1)


def registered_domain(c, suffixes=None) -> Column:
    """STR5: the label just before the public suffix
    (``www.facebook.com`` -> ``facebook``); '' for a null or host-less link,
    an IP address whole.

    ``suffixes`` is a list in the public suffix list's notation (``co.uk``,
    ``*.ck``, ``!www.ck``); the longest match counts, hosts without a match end
    in a one-label suffix.  Without it the rule of
    :data:`SECOND_LEVEL_LABELS` is used.
    """
    host = F.rtrim(url_host(c), F.lit("."))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    if suffixes is None:
        country = F.char_length(F.element_at(labels, -1)) == 2
        two = country & F.element_at(labels, -2).isin(*SECOND_LEVEL_LABELS)
        length = F.when((n >= 2) & two, F.lit(2)).otherwise(F.lit(1))
    else:
        plain = F.array(*[F.lit(s) for s in suffixes if s[0] not in "!*"] or [F.lit("")])
        wild = F.array(*[F.lit(s[2:]) for s in suffixes if s.startswith("*.")] or [F.lit("")])
        spared = F.array(*[F.lit(s[1:]) for s in suffixes if s.startswith("!")] or [F.lit("")])
        tails = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct(
            F.array_join(F.slice(labels, n - k + 1, k), ".").alias("t"),
            F.array_join(F.slice(labels, n - k + 2, F.greatest(k - 1, F.lit(0))), ".").alias("u"), k.alias("k")))
        fits = F.transform(tails, lambda x: F.when(F.array_contains(spared, x["t"]), 100 + x["k"] - 1)
                           .when(F.array_contains(plain, x["t"]) | ((x["k"] > 1) & F.array_contains(wild, x["u"])), x["k"])
                           .otherwise(F.lit(1)))
        best = F.array_max(fits)
        length = F.when(best >= 100, best - 100).otherwise(best)
    address = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.startswith("[")
    dom = (F.when(host.isNull() | (host == ""), F.lit(""))
           .when(address, host)
           .when(n == 1, F.element_at(labels, 1))
           .when(n <= length, F.lit(""))
           .otherwise(F.element_at(labels, -1 - length)))
    return F.coalesce(dom, F.lit(""))


def tokenize(c) -> Column:
    """STR6: lower-case word tokens with punctuation split off.

    Same tokens as applying ``BASIC_ENGLISH_RULES`` one by one, in one regex
    pass and a split: double quotes are removed, ``<br />`` becomes a space,
    ``. , ( ) ! ? '`` are padded with spaces, and the text is split at white
    space, ``;`` and ``:``.
    """
    t = F.replace(F.lower(_c(c)), F.lit('"'), F.lit(""))
    t = F.replace(t, F.lit("<br />"), F.lit(" "))
    t = F.regexp_replace(t, r"([.,()!?'])", " $1 ")
    return F.filter(F.split(t, r"[\s;:]+"), lambda x: x != F.lit(""))


def token_text(c) -> Column:
    """The tokens of :func:`tokenize`, which hold no space, with one between
    them: a third of the room that an array of them takes when it is stored."""
    return F.array_join(tokenize(c), " ")


def split_tokens(c) -> Column:
    """The tokens of a :func:`token_text`; null where there are none."""
    return F.when(_c(c) != "", F.split(_c(c), " "))


def last_numbers(c, sep: str = "val") -> Column:
    """STR7: split on ``sep`` and keep the last number of each piece (NULL
    for a piece without a number)."""
    return F.transform(
        F.split(_c(c), sep),
        lambda piece: F.try_element_at(F.regexp_extract_all(piece, F.lit(NUMBER_PATTERN), 1), F.lit(-1)),
    )


def version_tag(c) -> Column:
    """STR8: first ``version_N`` in a path, '' when absent."""
    return F.regexp_extract(_c(c), r"version_[0-9]+", 0)


def is_digits(c, unicode: bool = False) -> Column:
    """STR9: digits-only test; ``unicode=True`` also accepts the decimal digits
    of all scripts and digits in superscript, subscript, circles and the like,
    but no fractions or Roman numerals."""
    return _c(c).rlike(f"^[{UNICODE_DIGITS}]+$" if unicode else r"^[0-9]+$")


def in_punctuation(c) -> Column:
    """STR10: token is a substring of the punctuation string ('' and '()' count)."""
    return F.contains(F.lit(PUNCTUATION), _c(c))


def strip_cr(c) -> Column:
    """STR11: remove every carriage return."""
    return F.regexp_replace(_c(c), "\r", "")


def tab_fields(c) -> Column:
    """STR11: split on tab keeping empty fields."""
    return F.split(_c(c), "\t", -1)


def join_tokens(c, sep: str = " ") -> Column:
    """STR12."""
    return F.array_join(_c(c), sep)


def scorer_line(label, p, r, f) -> Column:
    """STR13: the scorer's report line."""
    return F.format_string(SCORER_LINE_FORMAT, _c(label), _c(p), _c(r), _c(f))


def file_stem(c) -> Column:
    """STR14: file name without folder and extension."""
    return F.regexp_extract(_c(c), r"([^/]+)\.[^./]+$", 1)
