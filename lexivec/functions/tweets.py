"""Tweet tokenizers (P9, P10): a scanner that looks at each token's first character.

The scanner walks a text once.  White space parts tokens; what stands at a
token's start says which readers may take it, and each reader answers with the
end of what it can take (0: nothing).  It runs in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What an emoticon is made of, and the sign inside a number.
BROWS, EYES, NOSES, MOUTHS = "<>", ":;=8", "-oO*'", ")]([dDpP/:}{@|\\"
NUMBER_JOINTS = ",/.:-"

_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_IN_WORD = _LETTERS | frozenset("'-_")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _span(s: str, p: int, wanted) -> int:
    """End of the run of wanted characters that starts at ``p``."""
    while p < len(s) and wanted(s[p]):
        p += 1
    return p


def _digits(s: str, p: int, n: int) -> int:
    return p + n if len(s) >= p + n and s[p : p + n].isdecimal() else 0


def face(s: str, p: int) -> int:
    """An emoticon seen from either side: ``>:-)`` or ``(-:<``."""
    q = p + 1 if s[p] in BROWS else p
    if s[q : q + 1] and s[q] in EYES:
        m = q + 2 if s[q + 1 : q + 2] and s[q + 1] in NOSES else q + 1
        if s[m : m + 1] and s[m] in MOUTHS:
            return m + 1
    if s[p] in MOUTHS:
        e = p + 2 if s[p + 1 : p + 2] and s[p + 1] in NOSES else p + 1
        if s[e : e + 1] and s[e] in EYES:
            return e + 2 if s[e + 1 : e + 2] and s[e + 1] in BROWS else e + 1
    return 0


def phone(s: str, p: int) -> int:
    """Seven digits as three and four; before them an area of three, perhaps
    in parentheses, and before that a country's 0 or 1, perhaps with a plus."""
    def local(q: int) -> int:
        q = _digits(s, q, 3)
        return q and _digits(s, _span(s, q, lambda c: c.isspace() or c in ".-"), 4)

    def with_area(q: int) -> int:
        a = _digits(s, q + (s[q : q + 1] == "("), 3)
        return a and local(_span(s, a, lambda c: c.isspace() or c in ".-)"))

    q = p + (s[p] == "+")
    if s[q : q + 1] in ("0", "1"):
        q = _span(s, q + 1, lambda c: c.isspace() or c in ".-")
        if end := with_area(q) or local(q):
            return end
    return with_area(p) or local(p)


def number(s: str, p: int) -> int:
    """Two runs of digits with one joint, perhaps signed at either end."""
    a = p + (s[p] in "+-")
    b = _span(s, a, str.isdecimal)
    if b == a or s[b : b + 1] not in tuple(NUMBER_JOINTS):
        return 0
    c = _span(s, b + 1, str.isdecimal)
    return 0 if c == b + 1 else c + (s[c : c + 1] in ("+", "-"))


def joined_word(s: str, p: int) -> int:
    """Letters with apostrophes, hyphens or underscores inside; three at least."""
    end = _span(s, p, _IN_WORD.__contains__)
    while s[end - 1] not in _LETTERS:
        end -= 1
    return end if end - p > 2 else 0


def topic(s: str, p: int) -> int:
    """``#tag``: two word characters at least, apostrophes and hyphens inside."""
    if p and s[p - 1] == "#":
        return 0  # from the run's first sign there was none
    start = _span(s, p, "#".__eq__)
    end = _span(s, start, lambda c: _is_word(c) or c in "'-")
    while end > start and not _is_word(s[end - 1]):
        end -= 1
    return end if end - start > 1 and _is_word(s[start]) else 0


def dots(s: str, p: int) -> int:
    """Two dots or more, white space between them or not."""
    end = 0
    q = p
    while q < len(s) and s[q] == ".":
        end, q = q + 1, _span(s, q + 1, str.isspace)
    return end if end > p + 1 else 0


def _tag(s: str, p: int) -> int:
    return s.find(">", p + 2) + 1 if s[p + 1 : p + 2] not in ("", ">") else 0


def _link(s: str, p: int) -> int:
    """A web address with its scheme or ``www.``, up to white space, without
    the punctuation at its end."""
    low = s[p : p + 8].lower()
    if not low.startswith(("http://", "https://", "www.")):
        return 0
    end = _span(s, p, lambda c: not c.isspace() and c not in "<>\"")
    while s[end - 1] in ".,:;!?'()":
        end -= 1
    return end if end > p + 4 else 0


def _address(s: str, p: int) -> int:
    """``local@host.domain``."""
    if p and (_is_word(s[p - 1]) or s[p - 1] in ".+-"):
        return 0  # from the run's start there was none
    at = _span(s, p, lambda c: _is_word(c) or c in ".+-")
    if s[at : at + 1] != "@":
        return 0
    end = _span(s, at + 1, lambda c: _is_word(c) or c in ".-")
    while s[end - 1] in ".-":
        end -= 1
    return end if "." in s[at + 1 : end] else 0


def _arrow(s: str, p: int) -> int:
    if s[p] == "<":
        end = _span(s, p + 1, "-".__eq__)
        return end if end > p + 1 else 0
    if p and s[p - 1] == "-":
        return 0  # from the run's first sign there was none
    end = _span(s, p, "-".__eq__)
    return end + 1 if end > p and s[end : end + 1] == ">" else 0


def _end(s: str, p: int, links: bool) -> int:
    """End of the token that starts at ``p``."""
    c = s[p]
    if links:
        end = c in "hHwW" and _link(s, p) or _is_word(c) and _address(s, p) or c in "<-" and _arrow(s, p)
        if end:
            return end
    end = (c.isdecimal() or c in "+(") and phone(s, p) or face(s, p)
    if end:
        return end
    if c == "<":
        return _tag(s, p) or p + 1
    if c == "@":
        return max(p + 1, _span(s, p + 1, _is_word))
    if c == "#":
        return topic(s, p) or p + 1
    if c == ".":
        return dots(s, p) or p + 1
    if c in _LETTERS:
        return joined_word(s, p) or _span(s, p, _is_word)
    if c.isdecimal() or c in "+-":
        return number(s, p) or _span(s, p, _is_word) or p + 1 if _is_word(c) else number(s, p) or p + 1
    return max(p + 1, _span(s, p, _is_word))


def scan(s: str, links: bool = False) -> list[str]:
    """Tokens of a text.  ``links``: web and mail addresses and arrows are
    tokens as well, before all others."""
    out, p = [], 0
    while p < len(s):
        if s[p].isspace():
            p += 1
            continue
        end = _end(s, p, links)
        out.append(s[p:end])
        p = end
    return out


def bears_face(token: str) -> bool:
    return any(face(token, p) for p in range(len(token)))


def _tokens(links: bool, preserve_case: bool):
    def run(texts: pd.Series) -> pd.Series:
        found = [None if t is None else scan(t, links) for t in texts]
        if not preserve_case:
            found = [f and [t if bears_face(t) else t.lower() for t in f] for f in found]
        return pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<string>")


def tweet_tokens(text, preserve_case: bool = True) -> Column:
    """Phones, emoticons, markup tags, users, topics, words with inner
    apostrophes and hyphens, numbers with a joint, plain words, dots, and any
    other sign by itself.

    HTML entities should be decoded first (:func:`lexivec.functions.html.decode_entities`).
    With ``preserve_case=False`` every token that bears no emoticon is
    lower-cased.  Null text: null.  Letters of joined words are ASCII ones; a
    word with others is a plain word.
    """
    return _tokens(False, preserve_case)(text)


def url_aware_tokens(text, preserve_case: bool = True) -> Column:
    """P10: as :func:`tweet_tokens`, with web addresses, mail addresses and
    arrows (``-->``, ``<--``) as tokens of their own, found first (close to,
    not bit-exact with, NLTK's TweetTokenizer)."""
    return _tokens(True, preserve_case)(text)
