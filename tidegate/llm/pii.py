"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, schemes, digits, plus signs, identifier cues, the fixed beginnings of
keys); at each anchor a small deterministic parser expands to the left and right and validates what it has found. Parsers move cursors
forward only, so the time is linear in the text, and every text is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.shared import bounded_batches
from tidegate.llm.words import returned, slices

#: Kinds with fixed definitions, in their order for equal starts; the others are what the cues add.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++@")
_VALUE = re.compile(r"""[ \t]{0,4}(?:is|no\.?|number|nr\.?|#)?[ \t]{0,4}[:=#]?[ \t]{0,4}["']?""", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Numbers end where no letter or digit follows.
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,33}(?![0-9A-Za-z_])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z_])")
_PASSPORT = re.compile(r"(?:[A-Z]{1,2}[0-9]{6,8}|[A-Z][0-9][A-Z0-9]{7}|[0-9]{8,9})(?![0-9A-Za-z_])")
_NUMBERS = {"number": _NUMBER, "ssn": _SSN, "passport": _PASSPORT}
_SECRET = re.compile(r"[A-Za-z0-9_\-+/.]{16,}")
#: A sign of assignment or none, then a value in quotes or up to a space.
_PASSWORD = re.compile(r"""["']?[ \t]{0,4}(?:(?:is|was|no\.?|number|nr\.?|#)(?=[ \t:=]))?[ \t]{0,4}([:=]{0,2})[ \t]{0,4}(?:"([^"\n]++)"|'([^'\n]++)'|["']?)""", re.I)
_RUN = re.compile(r"""[^\s"']*+""")

#: Fixed beginnings of keys that services hand out (fixed values), with what follows them. They begin where no letter or
#: digit stands before.
_KEY_STARTS = {
    "AKIA": re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])"), "ASIA": re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])"), "AIza": re.compile(r"[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "ghp_": re.compile(r"[0-9A-Za-z]{36,}+"), "gho_": re.compile(r"[0-9A-Za-z]{36,}+"), "ghs_": re.compile(r"[0-9A-Za-z]{36,}+"), "github_pat_": re.compile(r"[0-9A-Za-z_]{22,}+"),
    "glpat-": re.compile(r"[0-9A-Za-z_-]{20,}+"), "xoxb-": re.compile(r"[0-9A-Za-z-]{20,}+"), "xoxp-": re.compile(r"[0-9A-Za-z-]{20,}+"),
    "sk_live_": re.compile(r"[0-9A-Za-z]{16,}+"), "eyJ": re.compile(r"[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]++"),
}
_PRIVATE_KEY = "-----BEGIN "
_PRIVATE_KEY_LABEL = re.compile(r"(?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----")

#: Words before an identifier, with the kind of what follows them.
_CUES = {
    "iban": "iban", "account": "number", "konto": "number", "cuenta": "number", "compte": "number", "passport": "passport",
    "ssn": "ssn", "social security": "ssn", "token": "secret", "password": "password", "secret": "secret",
    "api_key": "secret", "api key": "secret", "apikey": "secret",
}

_FOLD = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: Characters of an IBAN by country.
_IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, what in {"@": "email", "://": "scheme", "+": "phone"}.items():
        out.add_word(text, (what, len(text)))
    for digit in "0123456789":
        out.add_word(digit, ("digit", 1))
    for cue, what in _CUES.items():
        out.add_word(cue, (what, len(cue)))
    for start in (*_KEY_STARTS, _PRIVATE_KEY):
        out.add_word(start.lower(), (start, len(start)))
    out.make_automaton()
    return out


def _folded(text: str) -> str:
    """A copy in lower case, as long as the text; where that is not so, only A-Z are folded."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN ends that begins at ``start``, 0 if none does: at its country's length, else the farthest end up to
    ``end`` that passes the check; a country whose length is known may end elsewhere only before what is no letter or digit."""
    size, ends, n = _IBAN_SIZES.get(text[start : start + 2]), [], 0
    for i in range(start, end):
        if text[i] != " ":
            n += 1
            if n == size and _iban(text[start : i + 1]):
                return i + 1
            if n >= 15 and (size is None or not text[i + 1 : i + 2].isalnum()):
                ends.append(i + 1)
    return next((i for i in reversed(ends) if _iban(text[start:i])), 0)


def _password(text: str, after: int, run: list[int]) -> tuple[int, int] | None:
    """The value that a password's cue before ``after`` names: any after a sign of assignment, else one of six characters
    or more with a digit. ``run`` keeps the run looked at last, so that cues in one run look at it once: its start, end, end
    without punctuation and last digit."""
    m = _PASSWORD.match(text, after)
    if k := m.lastindex if m.lastindex > 1 else 0:
        start, end = m.span(k)
        digit = max(text.rfind(d, start, end) for d in "0123456789")
    else:
        start = m.end()
        if not run[0] <= start < run[1]:
            end = trimmed = _RUN.match(text, start).end()
            while trimmed > start and text[trimmed - 1] in ".,;)]}>":
                trimmed -= 1
            run[:] = start, end, trimmed, max(text.rfind(d, start, end) for d in "0123456789")
        _, _, end, digit = run
    return (start, end) if start < end and (m[1] or end - start >= 6 and digit >= start) else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of KINDS.

    Per base kind the matches are leftmost and do not overlap; a match that fails its check is passed over whole. Spans
    that cues add are left out where they overlap a base span.
    """
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int]] = []
    email_from = ip_from = card_from = phone_from = password_from = key_from = 0
    run, endless = [0, 0, 0, 0], set()
    for last, (what, size) in _automaton().iter(_folded(text)):
        at = last - size + 1
        if what == "digit":
            if at >= ip_from:
                if m := _IP.match(text, at):
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        base.append(("ip", at, ip_from))
                else:
                    ip_from = _DIGITS.match(text, at).end()
            if at >= card_from:
                if m := _CARD.match(text, at):
                    card_from = m.end()
                    if card_from - at <= 40 and 14 <= len(digits := _only_digits(m[0])) <= 19 and _luhn(digits):
                        base.append(("card", at, card_from))
                else:
                    card_from = at + 1
        elif what == "email":
            if m := _DOMAIN.match(text, at + 1):
                start = at
                while start > email_from and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    email_from = m.end()
                    base.append(("email", start, email_from))
        elif what == "phone":
            if at >= phone_from and (m := _PHONE.match(text, at)):
                phone_from = m.end()
                if 10 <= len(_only_digits(m[0])) <= 15:
                    base.append(("phone", at, phone_from))
        elif what == "scheme":
            if m := _LOGIN.match(text, last + 1):
                more.append(("login", last + 1, m.end() - 1))
        elif what in _KEY_STARTS:
            if text.startswith(what, at) and not (at and text[at - 1].isalnum()) and (m := _KEY_STARTS[what].match(text, last + 1)):
                more.append(("secret", at, m.end()))
        elif what == _PRIVATE_KEY:
            if at >= key_from and (m := _PRIVATE_KEY_LABEL.match(text, last + 1)):
                end = -1 if m[0] in endless else text.find("-----END " + m[0], m.end())
                if end < 0:
                    endless.add(m[0])  # so that the rest of the text is searched once for each label
                key_from = m.end() if end < 0 else end + len("-----END " + m[0])
                more.append(("secret", at, key_from))
        elif not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
            begin = _VALUE.match(text, last + 1).end()
            if what == "password":
                if at >= password_from and (own := _password(text, last + 1, run)):
                    password_from = own[1]
                    more.append(("secret", *own))
                continue
            if what == "secret" and (m := _SECRET.match(text, begin)) and any(c.isdigit() for c in m[0]):
                more.append(("secret", begin, m.end()))
            elif what in _NUMBERS and (m := _NUMBERS[what].match(text, begin)):
                more.append(("account", begin, m.end()))
            if what in ("iban", "number"):
                # NO is Norway as well as "number"
                for start in (begin - 2, begin) if text[max(last + 1, begin - 2) : begin] == "NO" else (begin,):
                    if (m := _IBAN.match(text, start)) and (end := _iban_end(text, start, m.end())):
                        more.append(("account", start, end))
    order = lambda s: (s[1], KINDS.index(s[0]))
    base.sort(key=order)
    if more:
        ends, high = [], 0
        for s in base:
            high = max(high, s[2])
            ends.append(high)
        starts = [s[1] for s in base]
        free, reached = [], 0
        for s in sorted(set(more), key=order):
            i = bisect_left(starts, s[2])  # base spans that begin before this one ends
            if s[1] >= reached and (i == 0 or ends[i - 1] <= s[1]):
                free.append(s)
                reached = s[2]
        base = sorted(base + free, key=order)
    return base


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@returned
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(x or "")] for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])


@returned
def _mask(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.schema.field(at)
        for part in slices(batch, own.name):
            texts = [x and mask_text(x, find_spans(x)) for x in part.column(at).to_pylist()]
            yield part.set_column(at, own, pa.array(texts, own.type))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row; a null text is empty and has no spans.

    Rows are independent of each other: repeated rows give repeated results, and no shuffle takes place. Other columns
    are ignored.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in its texts replaced by their kinds; nulls and all other columns stay as they are."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_mask, at=docs.columns.index(text_col)), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text, from ``personal_data``'s rows."""
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
