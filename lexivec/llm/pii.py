"""Personal data behind disguises, with offsets into the source text.

Two transducers normalise a text and remember, for each character they put
out, the source characters it stands for: one folds look-alike characters and
drops invisible ones, the other writes spelled digits and at/dot disguises as
the signs they mean.  The same four detectors run over the source text (base
spans) and over the normalised one, whose spans are mapped back; a mapped span
counts only if something in it was disguised.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, id_and_text, in_slices

KINDS = ("email", "ip", "card", "phone")

# Letters and signs that look like ASCII ones but don't decompose to them.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХҮԚԜаеоѕрсухіјһԁԛԝӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνι" "ıɡɩ" "。·•∙⋅‧∶⁄−⁺٫",
    "ABESIJKMHOPCTYXYQWaeospcyxijhdqwl" "ABEZHIKMNOPTYXopvi" "igi" "......:/-+."))
# The words for signs and digits in English, German, French and Spanish.
AT_WORDS = "at arobase arrobas arroba klammeraffe".split()
DOT_WORDS = "dot point punkt punto".split()
DASH_WORDS = "dash hyphen".split()
DIGIT_WORDS = [
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
_DIGIT = {w: str(d) for d, ws in enumerate(DIGIT_WORDS) for w in ws.split()}

#: What changed an output character: look-alike, bracketed sign, sign as a bare word, digit as a word.
FOLDED, BRACKETED, BARE, SPELLED = 1, 2, 4, 8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match ends a run of digits, so the next starts one
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str, weak: Callable[[int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, from each ``@`` outwards and so in linear time.
    A ``weak`` sign before a further address is taken for a word."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        if at < end or weak and weak(at) and text[m.end() : m.end() + 1] == "@":
            continue
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _card(found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def detected(text: str, weak: Callable[[int], bool] | None = None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; linear in the text."""
    out = [(0, a, b) for a, b in emails(text, weak)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _card(m[0])]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@cache
def _plain(code: int) -> int:
    """The ASCII code that a character stands for, -1 for an invisible one,
    its own code for all others."""
    c = chr(code)
    kind = unicodedata.category(c)
    if kind == "Cf" or code == 0x34F or 0xFE00 <= code <= 0xFE0F:
        return -1
    if c in LOOKALIKES:
        return ord(LOOKALIKES[c])
    if kind == "Nd":
        return ord("0") + unicodedata.decimal(c)
    if kind in ("Pd", "Zs"):
        return ord("-" if kind == "Pd" else " ")
    like = unicodedata.normalize("NFKC", c)
    return ord(like) if len(like) == 1 and like.isascii() else code


def folded(text: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """First transducer: the text, and for each of its characters the source
    position and whether it was exchanged; (text, None, None) if nothing was."""
    if text.isascii():
        return text, None, None
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    new = codes.astype(np.int64)
    for c in np.unique(codes[codes > 127]).tolist():
        if (to := _plain(c)) != c:
            new[codes == c] = to
    changed = new != codes
    if not changed.any():
        return text, None, None
    kept = np.flatnonzero(new >= 0)
    follows = np.searchsorted(kept, np.flatnonzero(new < 0))
    changed[kept[follows[follows < len(kept)]]] = True  # what follows a dropped character is disguised by it
    return new[kept].astype(np.uint32).tobytes().decode("utf-32-le"), kept, changed[kept]


_SIGNS = {w: "@" for w in AT_WORDS} | {w: "." for w in DOT_WORDS} | {w: "-" for w in DASH_WORDS} | {"underscore": "_"}
_TIMES = {"double": 2, "triple": 3}
_HOT = frozenset([*_DIGIT, *_SIGNS, *_TIMES, "plus"])
_GAP_TO_DIGIT = re.compile(rf" (?=[0-9]|(?:{'|'.join(_DIGIT)})(?![^\W_]))", re.I)
_MIXED_HINT = re.compile(r"[0-9](?:[oilOIL]|(?<=[oilOIL][0-9]))")
_AS_DIGITS = {ord(c): d for c, d in zip("OoIiLl", "001111")}
_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"(?=[oilOIL]{0,8}[0-9])[0-9oilOIL]*[oilOIL][0-9oilOIL]*")
_BETWEEN_DIGITS = re.compile(r"[ ]{1,2}|-|,[ ]?")
_SIGN_IN_BRACKETS = re.compile(r"[(\[{<]\s{0,3}([@.])\s{0,3}[)\]}>]")
_SIGN_SPACED = re.compile(r"[ \t]{1,3}([@.])[ \t]{1,3}(?=[A-Za-z0-9])")
_BEFORE_WORD = re.compile(r"(?P<open>\s{0,3}[(\[{<]\s{0,3})|(?P<bare>[ \t]{0,3}[-_*]|[ \t]{1,3})")
_AFTER_WORD = re.compile(r"(?P<open>\s{0,3}[)\]}>]\s{0,3})|(?P<bare>[-_*][ \t]{0,3}|[ \t]{1,3})(?=[A-Za-z0-9])")
_REACH = 7  # characters that either gap takes at most


def _sign_at(text: str, a: int, b: int) -> tuple[int, int, int] | None:
    """Bounds of a sign's word with its brackets or its gaps, and which."""
    after = _AFTER_WORD.match(text, b)
    if not after:
        return None
    way = after.lastgroup
    for start in range(max(0, a - _REACH), a):  # the widest gap first
        before = _BEFORE_WORD.fullmatch(text, start, a)
        if before and before.lastgroup == way and (way == "open" or start and text[start - 1].isascii() and text[start - 1].isalnum()):
            return start, after.end(), BARE if way == "bare" else BRACKETED
    return None


@lru_cache(512)
def _finder(hot: frozenset[str]) -> re.Pattern:
    return re.compile(rf"(?:{'|'.join(sorted(hot, key=len, reverse=True))})(?![^\W_])", re.I)


def _words_at(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, lower-cased word)`` of the words that may disguise
    something.  The set of all words says which to look for, if any."""
    hot = _HOT.intersection(_TOKEN.findall(text.lower()))
    out = []
    if hot:
        for m in _finder(frozenset(hot)).finditer(text):
            if not (m.start() and text[m.start() - 1].isalnum()):
                out.append((*m.span(), m[0].lower()))
    if _MIXED_HINT.search(text):
        out += [(*m.span(), m[0]) for m in _TOKEN.finditer(text) if m[0][0] in "0123456789oilOIL" and _MIXED.fullmatch(m[0])]
    return sorted(out)


def disguises(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, what it means, flag)`` of each disguise, in order and
    apart; time is linear in the text."""
    found: list[tuple[int, int, str, int]] = []
    times = None
    for a, b, w in _words_at(text):
        if d := _DIGIT.get(w):
            if times and text[times[1] : a] == " ":
                a, d = times[0], d * times[2]
            found.append((a, b, d, SPELLED))
        elif sign := _SIGNS.get(w):
            if bounds := _sign_at(text, a, b):
                found.append((bounds[0], bounds[1], sign, bounds[2]))
        elif w in _TIMES:
            times = (a, b, _TIMES[w])
        elif w == "plus":
            if m := _GAP_TO_DIGIT.match(text, b):
                found.append((a, m.end(), "+", SPELLED))
        else:
            found.append((a, b, w.translate(_AS_DIGITS), SPELLED))
    for m in _SIGN_IN_BRACKETS.finditer(text):
        a, b = m.span()
        found.append((len(text[max(0, a - 3) : a].rstrip()) + max(0, a - 3), b + len(text[b : b + 3]) - len(text[b : b + 3].lstrip()), m[1], BRACKETED))
    for m in _SIGN_SPACED.finditer(text):
        if m.start() and text[m.start() - 1].isascii() and text[m.start() - 1].isalnum():
            found.append((*m.span(), m[1], BARE))
    found.sort()
    out, end = [], 0
    for f in found:
        if f[0] < end <= f[1] and f[3] != SPELLED and f[1] - end > 1:
            f = (end, *f[1:])  # two signs in a row share their gap
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return [f for k, f in enumerate(out) if f[3] != SPELLED or len(f[2]) > 2 or _in_company(text, out, k)]


def _in_company(text: str, found: list[tuple[int, int, str, int]], k: int) -> bool:
    """Whether a spelled digit stands by a digit, a sign or another disguise;
    number words in prose don't."""
    a, b = found[k][:2]
    near = text[max(0, a - 2) : a] + text[b : b + 2]
    return k and a - found[k - 1][1] < 3 or k + 1 < len(found) and found[k + 1][0] - b < 3 or any(c in "0123456789+.@" for c in near)


def rewritten(text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """Second transducer: the text with signs and digits for their disguises
    and, for each of its characters, start and end in ``text`` and the flag of
    what changed it.  None where there is no disguise."""
    found = disguises(text)
    if not found:
        return None
    pieces, lengths, firsts, steps, flags = [], [], [], [], []

    def put(new: str, first: int, step: int, flag: int) -> None:
        if new:
            pieces.append(new)
            lengths.append(len(new))
            firsts.append(first)
            steps.append(step)
            flags.append(flag)

    at, spelled = 0, False
    ends = []
    for a, b, means, flag in [*found, (len(text), len(text), "", 0)]:
        digit = flag == SPELLED and means.isdigit()
        if not (spelled and digit and _BETWEEN_DIGITS.fullmatch(text, at, a)):
            if a > at:
                ends.append(0)
            put(text[at:a], at, 1, 0)
        if means:
            ends.append(b)
        put(means, a, 1 if digit and len(means) == b - a else 0, flag)
        at, spelled = b, digit
    n = np.array(lengths)
    piece = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    step = np.array(steps)[piece]
    starts = np.array(firsts)[piece] + within * step
    return "".join(pieces), starts, np.where(step == 1, starts + 1, np.array(ends)[piece]), np.array(flags, np.uint8)[piece]


def spans(text: str) -> list[tuple[int, int, int, bool, str]]:
    """``(kind, start, end, base, value)`` of each find by kind, start and
    end, in code points of ``text``; ``value`` is its normalised form.

    A disguised find that overlaps a base one of its kind stays only if no
    bare word took part.  A bare "at" makes an address only beside a disguised
    dot or a local part that isn't a plain word, so that "at" in prose and
    before a site's name stays a word.
    """
    base = detected(text)
    out = [(*s, True, text[s[1] : s[2]]) for s in base]
    plain, at, exchanged = folded(text)
    new = rewritten(plain)
    if new is None and at is None:
        return out
    if new is None:
        normal, starts, ends, flags = plain, np.arange(len(plain)), np.arange(len(plain)) + 1, np.zeros(len(plain), np.uint8)
    else:
        normal, starts, ends, flags = new
    if at is not None:
        before = np.r_[0, np.cumsum(exchanged)]
        flags = flags | np.where(before[ends] > before[starts], np.uint8(FOLDED), np.uint8(0))
        starts, ends = at[starts], at[ends - 1] + 1
    seen = set(base)
    for kind, a, b in detected(normal, lambda k: bool(flags[k] & BARE)):
        how = int(np.bitwise_or.reduce(flags[a:b]))
        s, e = int(starts[a]), int(ends[b - 1])
        if not how or (kind, s, e) in seen:
            continue
        if how & (BARE | SPELLED) and any(k == kind and x < e and s < y for k, x, y in base):
            continue
        if kind == 0:
            sign = normal.index("@", a, b)
            dots = np.flatnonzero(flags[sign + 1 : b] & (BARE | BRACKETED))
            if flags[sign] & BARE and not len(dots) and normal[a:sign].strip(".-_+%").isalpha():
                continue
        seen.add((kind, s, e))
        out.append((kind, s, e, False, normal[a:b]))
    return sorted(out)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``; no shuffle.

    ``spans``: kind, start, end (code points, end exclusive), base (found
    without normalising) and value (normalised form), by kind as in ``KINDS``,
    then start.  Null and empty texts have none; repeated rows and null ids are
    rows like others; other columns are not read, so their names can't clash;
    a text is held whole in one task, and time is linear in its length.
    """
    out = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 500):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((doc, [{"kind": KINDS[k], "start": s, "end": e, "base": own, "value": value} for k, s, e, own, value in spans(text)]))
            yield batch(out, rows)

    return id_and_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, value: string>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of all spans by kind, the digest of the base ones, and all spans
    as ``kind:start:end`` joined by commas; ``n_base_...`` count base spans."""
    def of(kind: str, base: bool):
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & (s["base"] if base else F.lit(True)))).cast("long")

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *[of(k, False).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), *[of(k, True).alias(f"n_base_{k}") for k in KINDS])
