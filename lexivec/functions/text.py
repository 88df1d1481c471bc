"""Column functions for text normalisation, tokenising and negation.

All functions map ``Column -> Column`` and compile to JVM expressions, so they
run inside whole-stage codegen on batch and streaming DataFrames alike.
Regexes use Java syntax; ``(?U)`` makes ``\\w``/``\\s``/``\\b`` Unicode-aware,
which matches Python 3 ``re`` on ``str`` patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.functions.tweets import tweet_tokens, url_aware_tokens  # noqa: F401

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour (patterns and lists).
# ---------------------------------------------------------------------------
URL_PATTERN = r"\bhttp[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+\b"
USER_PATTERN = r"@[A-Za-z0-9_]+\b"
NUMBER_PATTERN = r"\b-?[0-9]*[.,]?[0-9]+\b"
URL_TOKEN = "_url_"
USER_TOKEN = "_user_"
NUMBER_TOKEN = "_number_"
NEGATORS = [
    "never", "no", "nothing", "nowhere", "noone", "none", "not", "havent",
    "hasnt", "hadnt", "cant", "couldnt", "shouldnt", "wont", "wouldnt", "dont",
    "doesnt", "didnt", "isnt", "arent", "aint",
]
NEG_SUFFIX = "_NEG"
CONTEXT_END_CHARS = ".,:;!?"
# ---------------------------------------------------------------------------

OPENER_REGEX = r"(?iU)(\b(?:" + "|".join(NEGATORS) + r")\b|n't\b)"
CLOSER_REGEX = "[" + CONTEXT_END_CHARS.replace(".", r"\.").replace("?", r"\?") + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_regex(c, pattern: str, repl: str) -> Column:
    """Generic regex substitution (``re.sub`` per row)."""
    return F.regexp_replace(_col(c), pattern, repl)


def replace_urls(c) -> Column:
    """``http(s)://...`` runs become ``_url_``."""
    return F.regexp_replace(_col(c), "(?U)" + URL_PATTERN, URL_TOKEN)


def replace_users(c) -> Column:
    """``@name`` becomes ``_user_`` (``@abcé`` stays: é is a word char)."""
    return F.regexp_replace(_col(c), "(?U)" + USER_PATTERN, USER_TOKEN)


def replace_numbers(c) -> Column:
    """Numbers become ``_number_`` (``1,234,567`` -> two placeholders)."""
    return F.regexp_replace(_col(c), "(?U)" + NUMBER_PATTERN, NUMBER_TOKEN)


def remove_carriage(c) -> Column:
    """P5: delete newline and carriage-return characters."""
    return F.regexp_replace(_col(c), r"[\n\r]", "")


def collapse_space(c) -> Column:
    """Every whitespace run becomes one space (no trimming)."""
    return F.regexp_replace(_col(c), r"(?U)\s+", " ")


def lower(c) -> Column:
    """P7."""
    return F.lower(_col(c))


def split_tokens(c, sep: str = " ") -> Column:
    """Exact split on a literal separator, keeping empty tokens."""
    import re
    return F.split(_col(c), re.escape(sep), -1)


def normalize_text(c, lower_case: bool = True, tokenize=None) -> Column:
    """The normalisation chain of the generic text reader.

    Effective chain (see README, deviation D3): collapse whitespace, optional
    lower-casing, then URL, user and number placeholders.  ``tokenize`` is an
    optional ``Column -> Column`` tokenizer applied first, followed by
    carriage-return removal.
    """
    x = _col(c)
    if tokenize is not None:
        x = remove_carriage(tokenize(x))
    x = collapse_space(x)
    if lower_case:
        x = F.lower(x)
    return replace_numbers(replace_users(replace_urls(x)))


def norm_word(c) -> Column:
    """Word key for graph lexicons: digits -> ``---num---``,
    punctuation-only -> ``---punc---``, else lower case."""
    x = _col(c)
    return (F.when(x.rlike("[0-9]"), F.lit("---num---"))
             .when(x.rlike(r"(?U)^[^\w]+$"), F.lit("---punc---"))
             .otherwise(F.lower(x)))


def tokens(c) -> Column:
    """Standard tokens of a raw text: collapse whitespace, lower, split on space."""
    return split_tokens(F.lower(collapse_space(_col(c))))


# ----------------------------------------------------------------- negation

def negation_flags(toks) -> Column:
    """Per token: ``C`` closes a context (holds ``.,:;!?``), ``O`` opens one
    (negator word or ``n't``), ``.`` otherwise.  Closing wins (P15)."""
    return F.transform(_col(toks), lambda t: F.when(t.rlike(CLOSER_REGEX), F.lit("C"))
                       .when(t.rlike(OPENER_REGEX), F.lit("O")).otherwise(F.lit(".")))


def mark_negation(toks) -> Column:
    """Append ``_NEG`` to tokens inside a negated context.

    Linear-time formulation: the per-token flag string is cut into segments
    that each start at a marker (``O.....`` or ``C...``); tokens in a segment
    opened by ``O`` are negated.  No shuffle, no window, no quadratic
    accumulator, so 20,000-token documents cost the same per token.
    """
    t = _col(toks)
    flags = F.array_join(negation_flags(t), "")
    segments = F.regexp_extract_all(flags, F.lit(r"[CO]\.*|\.+"), 0)
    negated = F.array_join(F.transform(
        segments,
        lambda s: F.when(s.startswith("O"),
                         F.concat(F.lit("O"), F.repeat(F.lit("N"), F.length(s) - 1)))
                   .otherwise(s)), "")
    chars = F.slice(F.split(negated, "", -1), 1, F.size(t))
    # zip_with evaluates both array arguments once (an outer reference inside a
    # lambda would be re-evaluated per element).
    return F.zip_with(t, chars, lambda w, c: F.when(c == "N", F.concat(w, F.lit(NEG_SUFFIX))).otherwise(w))


def count_negated_contexts(toks) -> Column:
    """number of negated contexts opened.

    Here a closer only closes an open context; otherwise a negator opens one
    (so ``no,`` opens when no context is open).  Tokens map to ``B`` (both),
    ``C``, ``O`` or nothing; each match of ``C*[OB]O*[BC]?`` is one context.
    """
    t = _col(toks)
    kinds = F.transform(t, lambda w: F.when(w.rlike(CLOSER_REGEX) & w.rlike(OPENER_REGEX), F.lit("B"))
                        .when(w.rlike(CLOSER_REGEX), F.lit("C"))
                        .when(w.rlike(OPENER_REGEX), F.lit("O")).otherwise(F.lit("")))
    return F.regexp_count(F.array_join(kinds, ""), F.lit("C*[OB]O*[BC]?")).cast("long")


# ------------------------------------------------------- syntactic features

def count_all_caps(toks) -> Column:
    """tokens with a cased character and no lower-case one (``str.isupper``)."""
    return F.size(F.filter(_col(toks), lambda w: (F.upper(w) == w) & (F.lower(w) != w))).cast("long")


def count_hashtags(toks) -> Column:
    """tokens starting with ``#``."""
    return F.size(F.filter(_col(toks), lambda w: w.startswith("#"))).cast("long")


def count_elongated(toks) -> Column:
    """tokens holding one character three times in a row (case-sensitive)."""
    return F.size(F.filter(_col(toks), lambda w: w.rlike(r"(?s)(.)\1\1"))).cast("long")


def punctuation_features(text) -> Column:
    """F5 (documented form, D4): runs of ``!!+``, ``??+``, mixed ``[!?]{2,}``,
    and whether the last space-separated token holds ``!`` or ``?``."""
    x = _col(text)
    last = F.element_at(F.split(x, " ", -1), -1)
    return F.struct(
        F.regexp_count(x, F.lit("!{2,}")).cast("long").alias("excl_runs"),
        F.regexp_count(x, F.lit(r"\?{2,}")).cast("long").alias("quest_runs"),
        F.regexp_count(x, F.lit(r"[!?]{2,}")).cast("long").alias("mixed_runs"),
        last.rlike(r"[!?]").cast("int").cast("long").alias("last_excl_quest"),
    )


def emoticon_features(toks, happy: list[str], sad: list[str]) -> Column:
    """F6 (D5 fixed): presence of happy / sad emoticon tokens and the class of
    the last token (1 happy, -1 sad, 0 other)."""
    t = _col(toks)
    hs = F.array(*[F.lit(e) for e in happy]) if happy else F.array().cast("array<string>")
    ss = F.array(*[F.lit(e) for e in sad]) if sad else F.array().cast("array<string>")
    last = F.element_at(t, -1)
    return F.struct(
        F.arrays_overlap(t, hs).cast("int").alias("has_happy"),
        F.arrays_overlap(t, ss).cast("int").alias("has_sad"),
        F.when(F.array_contains(hs, last), 1).when(F.array_contains(ss, last), -1).otherwise(0).alias("last_emoticon"),
    )


# ------------------------------------------------------------------ n-grams

def ngrams(toks, n: int, sep: str = " ") -> Column:
    """Contiguous n-grams joined by ``sep``; empty when shorter than n.

    Built from ``n`` shifted slices zipped together, so the work is linear in
    the number of tokens (no per-element re-evaluation, no substring scans).
    """
    t = _col(toks)
    if n == 1:
        return t
    shifted = [F.slice(t, k, F.greatest(F.size(t) - k + 1, F.lit(0))) for k in range(1, n + 1)]
    zipped = F.arrays_zip(*shifted)
    fields = [str(k) for k in range(n)]
    grams = F.transform(zipped, lambda z: F.when(z[fields[-1]].isNotNull(),
                                                 F.concat_ws(sep, *[z[f] for f in fields])))
    return F.filter(grams, lambda g: g.isNotNull())


def char_ngrams(text, n: int) -> Column:
    """M3: character n-grams of a whole text (whitespace collapsed, lower).

    One scan: each match takes one code point and looks ahead at ``n``."""
    return F.regexp_extract_all(F.lower(collapse_space(_col(text))), F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def sklearn_words(text) -> Column:
    """Default word tokens of a count vectoriser: lower-cased ``\\w\\w+`` runs."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\b\w\w+\b"), 0)


def array_to_feature(arr, prefix: str) -> Column:
    """Nested array -> map ``prefix-i-j -> value``."""
    a = _col(arr)
    entries = F.flatten(F.transform(a, lambda row, i: F.transform(
        row, lambda v, j: F.struct(F.format_string(prefix + "-%d-%d", i, j).alias("k"), v.cast("double").alias("v")))))
    return F.map_from_entries(entries)


def string_to_feature(s, prefix: str) -> Column:
    """Whitespace tokens -> map ``prefix-i -> token``."""
    toks = F.split(F.trim(_col(s)), r"\s+")
    return F.map_from_entries(F.transform(toks, lambda t, i: F.struct(F.format_string(prefix + "-%d", i).alias("k"),
                                                                      t.alias("v"))))
