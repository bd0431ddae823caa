"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

A value is first validated (Luhn and mod-97 check digits, octets, calendar days, number
plans), then ranked among all valid values of its format, permuted within that set, and
written back in the same format: as long, as punctuated and as valid as it was, check
digits included. The permutation depends on key and format only, so a value becomes the
same pseudonym in every document, and different values become different ones. Nothing
is looked up or gathered: the pass is narrow and needs no state.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from ._arrow import buffers
from ._shared import small_batches

#: The session setting that has the key, where none is given.
KEY_SETTING = "condensa.pii.key"
ROUNDS = 8
#: Signs that one permutation takes; longer values are permuted so many at a time.
SIGNS = 64


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): balanced Feistel over enough bits, walking until inside."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    seed = key + b"\0" + tweak.encode() + b"\0" + str(n).encode() + b"\0"
    while True:
        a, b = x >> half, x & mask
        for r in range(ROUNDS):
            f = hashlib.shake_256(seed + bytes([r]) + b.to_bytes(size, "big")).digest(size)
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        x = a << half | b
        if x < n:
            return x


@lru_cache(4096)
def _letters(block: int, kind: str) -> str:
    """The letters or digits of one kind among 256 neighbouring signs: what a sign beyond Latin-1 may become."""
    return "".join(c for c in map(chr, range(block << 8, (block + 1) << 8)) if unicodedata.category(c) == kind)


def _set_of(c: str) -> str | None:
    """The signs that one may become; None for one that stays."""
    if (found := _SET_OF.get(c)) is not None:
        return found
    kind = unicodedata.category(c)
    return _letters(ord(c) >> 8, kind) if c > "\xff" and kind in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd") else None


_SETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)]
_SET_OF = {c: s for s in _SETS for c in s}


def _mixed(parts: list[tuple[int, int]], key: bytes, tweak: str) -> list[int]:
    """Permute digits of mixed radix: (digit, radix) each."""
    x, n = 0, 1
    for d, radix in parts:
        x, n = x * radix + d, n * radix
    x = permute(x, n, key, tweak)
    out = []
    for _, radix in reversed(parts):
        x, d = divmod(x, radix)
        out.append(d)
    return out[::-1]


def by_class(s: str, key: bytes, tweak: str) -> str:
    """Digits stay digits, lower case lower case and letters those of their script; every other sign stays itself."""
    sets = [_set_of(c) for c in s]
    at = [i for i, x in enumerate(sets) if x]
    shape = "".join("." if x else c for c, x in zip(s, sets))
    out = list(s)
    for a in range(0, len(at), SIGNS):
        part = at[a : a + SIGNS]
        new = _mixed([(sets[i].index(s[i]), len(sets[i])) for i in part], key, tweak + shape + (f"\0{a}" if a else ""))
        for i, d in zip(part, new):
            out[i] = sets[i][d]
    return "".join(out)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c)
    return str(-total % 10)


def card(s: str, key: bytes) -> str | None:
    """The first digit, which names the kind of issuer, stays."""
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    new = d[0] + f"{permute(int(d[1:-1]), 10 ** (len(d) - 2), key, 'card' + d[0]):0{len(d) - 2}d}"
    return _refill(s, new + luhn_digit(new))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(s: str, key: bytes) -> str | None:
    t = s.replace(" ", "")
    if not 15 <= len(t) <= 34 or _mod97(t[4:] + t[:4]) != 1:
        return None
    body = by_class(t[4:], key, "iban" + t[:2])
    t = iter(t[:2] + f"{98 - _mod97(body + t[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(t) for c in s)


#: Signs of a country's IBANs, as registered.
_IBAN_SIGNS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}


def _iban_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where IBANs may stand in spans: from a start to where a word ends, first of the country's length, then from long to short. What is beside one may look like more of it."""
    found = [(a, e) for a, b in spans for e in range(b, a + 14, -1) if text[e - 1] != " " and (e == b or text[e] == " ")]
    return sorted(found, key=lambda x: x[1] - x[0] - text.count(" ", *x) != _IBAN_SIGNS.get(text[x[0] : x[0] + 2]))


def ip(s: str, key: bytes) -> str | None:
    """Octets keep their number of digits."""
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low = {1: 0, 2: 10, 3: 100}
    size = {1: 10, 2: 90, 3: 156}
    new = _mixed([(int(p) - low[len(p)], size[len(p)]) for p in parts], key, "ip")
    return ".".join(str(d + low[len(p)]) for d, p in zip(new, parts))


def ssn(s: str, key: bytes) -> str | None:
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if not 0 < a < 900 or a == 666 or not g or not n:
        return None
    a, g, n = _mixed([(a - 1 - (a > 666), 898), (g - 1, 99), (n - 1, 9999)], key, "ssn")
    return f"{a + 1 + (a + 1 >= 666):03d}{s[3]}{g + 1:02d}{s[6]}{n + 1:04d}"


def phone(s: str, key: bytes) -> str | None:
    """The country code stays; for code 1, so does being within the plan of area and exchange."""
    d = re.sub(r"\D", "", s)
    if s[0] != "+":
        code, plan = "", len(d) == 10
    elif d[0] == "1" and len(d) == 11:
        code, plan = "1", True
    else:
        lead = re.match(r"\+(\d{1,3})(?!\d)", s)
        code, plan = lead[1] if lead else d[:2], False
    rest = d[len(code) :]
    if not 8 <= len(d) <= 15 or len(rest) < 5 or not (s[0] == "+" or plan):
        return None
    parts, back = [], []
    for i, c in enumerate(rest):
        lo, n = (0, 10) if not plan or i not in (0, 3) else (2, 8) if c > "1" else (0, 2)
        parts.append((int(c) - lo, n))
        back.append(lo)
    return _refill(s, code + "".join(str(x + lo) for x, lo in zip(_mixed(parts, key, "phone" + code), back)))


@lru_cache(16)
def _days(century: int, late: bool) -> tuple[list[int], dict[int, int]]:
    """Ordinals of a century's days, or of those after the 12th of a month; and their ranks."""
    first, last = datetime.date(century * 100 or 1, 1, 1), datetime.date(century * 100 + 99, 12, 31)
    days = [o for o in range(first.toordinal(), last.toordinal() + 1) if not late or datetime.date.fromordinal(o).day > 12]
    return days, {o: i for i, o in enumerate(days)}


def date(s: str, key: bytes) -> str | None:
    """Calendar days, within their century. Day and month are written with two digits if one of them was."""
    sep = re.search(r"\D", s)[0]
    p = s.split(sep)
    if len(p[0]) == 4:
        order = "ymd"
    elif sep == "/":
        order = "mdy" if int(p[0]) <= 12 else "dmy"
    else:
        order = "dmy"
    v = dict(zip(order, map(int, p)))
    if not v["y"] or not 1 <= v["m"] <= 12 or not 1 <= v["d"] <= calendar.monthrange(v["y"], v["m"])[1]:
        return None
    days, rank = _days(v["y"] // 100, sep == "/" and order == "dmy")
    o = datetime.date(v["y"], v["m"], v["d"]).toordinal()
    new = datetime.date.fromordinal(days[permute(rank[o], len(days), key, "date" + order + sep)])
    # The width is part of the format only where it shows: 1/2/2003 doesn't pad, 01/02/2003 does, 11/12/2003 may.
    pad = not any(len(x) == 1 for x in p)
    return sep.join(f"{x:04d}" if k == "y" else f"{x:02d}" if pad else str(x) for k, x in zip(order, ({"y": new.year, "m": new.month, "d": new.day}[k] for k in order)))


def email(s: str, key: bytes) -> str | None:
    local, _, domain = s.rpartition("@")
    if not any(map(_set_of, local)):  # nothing that could be another
        return None
    return by_class(local, key, "mail" + domain.lower()) + "@" + domain


def secret(s: str, key: bytes) -> str | None:
    if re.fullmatch(r"[0-9a-f]+", s):
        return f"{permute(int(s, 16), 16 ** len(s), key, 'hex'):0{len(s)}x}"
    return by_class(s, key, "secret")


#: In this order; of values that overlap the earlier kind's is taken.
KINDS: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("secret", re.compile(r"""(?i:token|secret|api[_-]?key|passw(?:or)?d)["']?\s*[=:]\s*["']?([A-Za-z0-9_/+-]{16,})"""), secret),
    ("iban", re.compile(r"(?<![^\W_])(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?![^\W_]))"), iban),  # the longest at each start, see _iban_spans
    ("ip", re.compile(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)"), ip),
    ("date", re.compile(r"(?<![\d/.-])(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)"), date),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"), ssn),
    ("phone", re.compile(r"(?<!\d)(\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5})(?!\d)"), phone),
    ("card", re.compile(r"(?<![\d.])(\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|\.\d)"), card),
]
_LOCAL = re.compile(r"[\w.%+-]")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses: whatever length the part before the @ has, from its first letter or digit on."""
    at = text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            k = at
            while k and _LOCAL.match(text[k - 1]):
                k -= 1
            first = next((i for i in range(k, at) if text[i].isalnum()), None)
            if first is None and k < at and text[at - 1] != ".":
                first = at - 1
            if first is not None:
                yield first, domain.end()
        at = text.find("@", at + 1)


def replacements(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values in a text, from left to right."""
    found: list[tuple[int, int, str, str]] = []

    def add(a: int, b: int, kind: str, fn: Callable) -> None:
        if all(b <= x or a >= y for x, y, _, _ in found) and (new := fn(text[a:b], key)) is not None:
            found.append((a, b, kind, new))

    for a, b in _emails(text):
        add(a, b, "email", email)
    for kind, pattern, fn in KINDS:
        spans = [m.span(1) for m in pattern.finditer(text)]
        for a, b in _iban_spans(text, spans) if kind == "iban" else spans:
            add(a, b, kind, fn)
    return sorted(found)


def pseudonymise_text(text: str, key: bytes) -> tuple[str, int]:
    found = replacements(text, key)
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(found)


_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(48, 58), ord("@"), ord("="), ord(":")]] = True


def _column(texts: pa.Array, key: bytes) -> tuple[pa.Array, np.ndarray]:
    """The column with pseudonyms, and how many there are in each row.

    Only texts with a digit, an @ or an assignment are looked at more closely.
    """
    data, offs = buffers(texts)
    counts = np.zeros(len(texts), np.int64)
    marks = np.concatenate([[0], np.cumsum(_SIGNS[data], dtype=np.int32)])
    rows = np.flatnonzero(marks[offs[1:]] > marks[offs[:-1]])
    if not len(rows):
        return texts, counts
    new, hit = [], np.zeros(len(texts), bool)
    for i, t in zip(rows, texts.take(pa.array(rows)).to_pylist()):
        out, n = pseudonymise_text(t, key)
        if n:
            counts[i], hit[i] = n, True
            new.append(out)
    if new:
        texts = pc.replace_with_mask(texts, pa.array(hit), pa.array(new, texts.type))
    return texts, counts


def _key(df: DataFrame, key: str | None) -> bytes:
    key = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one or set {KEY_SETTING}")
    return key.encode()


def job_key(spark) -> str:
    """The session's key; without one a new one for this job alone, which nobody keeps: values are linked within it."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with the personal values in text replaced; all rows and columns stay.

    Null and empty texts stay as they are, and so do texts without a valid value; rows that
    repeat get the same pseudonyms. Texts of any length are searched whole. Of values that
    overlap that of the earlier kind is taken, the left one within a kind. Lengths in
    characters stay, but for dates written without leading zeros. An empty table stays empty.
    """
    secret_key = _key(docs, key)

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield _column(texts, secret_key)[0]

    return small_batches(docs).select(*[run(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def pseudonyms(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id, text, n_values): every row's text with pseudonyms and how many it has, 0 for a null text.

    Ids may be null or repeat, other columns don't matter; all else is as in pseudonymise.
    """
    secret_key = _key(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = _column(batch.column("text"), secret_key)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pa.array(counts)], ["doc_id", "text", "n_values"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, n_values long")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonyms(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), key=job_key(spark))
