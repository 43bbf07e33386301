"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text finds anchors: at-signs, plus signs, digits, scheme marks and identifier
cues. Deterministic local parsers then walk from an anchor to the boundaries of an email address, IP address, card,
phone number, URL, bank account, social security number or street address, and validate what they found.

Defined cases: a null text counts as empty and gives no spans; repeated rows each give their spans; a null id goes
through; texts may have any length (the work is linear in it); an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.kit import map_texts

#: Kinds by rank: spans that start together are listed in this order. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "ssn", "address")
BASE = KINDS[:4]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"://[^\s<>\"'\x00-\x1f]+")
_IBAN = re.compile(r"[\s:#.=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|#|:|=))*[ \t]*([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"[ \t]*(?:number|no\.?|#|:|=)?[ \t:]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_STREET = re.compile(r"(?:^|(?<=[^0-9A-Za-z]))([0-9]{1,5}[A-Za-z]?,? (?:[A-Z][A-Za-z'.-]*,? ){1,4})$")

#: Cues before an identifier, each as written in texts, with the parser to run after it.
CUES = {
    "iban": ("IBAN", "iban", "Iban"),
    "account": ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "cuenta", "Cuenta", "compte", "Compte"),
    "ssn": ("SSN", "ssn", "social security", "Social Security", "Social security"),
    "street": (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", " St.", " Ave.", " Rd.", " Blvd."),
}
#: How far left of a street cue its house number may lie, in characters.
STREET_REACH = 80


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    compact = value.replace(" ", "")
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def build_automaton() -> ahocorasick.Automaton:
    """The anchors: one automaton for all kinds."""
    out = ahocorasick.Automaton()
    for d in "0123456789":
        out.add_word(d, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        out.add_word(word, (kind, len(word)))
    for kind, words in CUES.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find_pii(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text by start, then kind; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    email_from = ip_from = card_from = digits_from = url_from = 0
    for last, (what, length) in automaton.iter(text):
        at = last - length + 1
        if what == "digit":
            if at < digits_from:
                continue
            digits_from = _DIGITS.match(text, at).end()
            if at >= ip_from and (m := _IP.match(text, at)):
                ip_from = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                    found.append(("ip", at, ip_from))
            if at >= card_from and (m := _CARD.match(text, at)):
                card_from = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", at, card_from))
        elif what == "at":
            start = at
            while start > email_from and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                email_from = m.end()
                found.append(("email", start, email_from))
        elif what == "plus":
            if m := _PHONE.match(text, at):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append(("phone", at, m.end()))
        elif what == "scheme":
            start = at
            while start > max(url_from, at - 16) and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and at >= url_from and (m := _URL_REST.match(text, at)):
                url_from = m.end()
                found.append(("url", start, url_from))
        elif what == "iban":
            if (m := _IBAN.match(text, at + length)) and _iban_ok(m.group(1)):
                found.append(("iban", *m.span(1)))
        elif what == "account":
            if m := _ACCOUNT.match(text, at + length):
                found.append(("account", *m.span(1)))
        elif what == "ssn":
            if m := _SSN.match(text, at + length):
                found.append(("ssn", *m.span(1)))
        elif what == "street":
            reach = max(0, at - STREET_REACH)
            if m := _STREET.search(text[reach : at + 1]):
                found.append(("address", reach + m.start(1), at + length))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return list(dict.fromkeys(found))


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii_spans array<struct<kind, start, end>>) for every row. Narrow: no shuffle."""

    def make():
        automaton = build_automaton()
        names = ("kind", "start", "end")
        return lambda texts: [[[dict(zip(names, s, strict=True)) for s in find_pii(t, automaton)] if t else [] for t in texts.to_pylist()]]

    return map_texts(df, [id_col], text_col, [T.StructField("pii_spans", SPANS)], make)




def span_digest(spans: F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    """kind:start:end of the spans (of some kinds), comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
