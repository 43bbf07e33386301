"""Secrets by assignment-aware lexing.

The lexer finds assignment operators, parses the name on the left and the literal on the right of each into a
name-literal pair, and keeps a table of constants so that a name assigned from another name gets that name's literal.
Literals are scored by how sensitive the target name is, then by length and character entropy. Key-shaped words
(access keys and long hexadecimal words) are lexed as tokens of their own.

Defined cases: a null text counts as empty and gives no spans; repeated rows each give their spans; a null id goes
through; texts may have any length (the work is linear in it); an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.kit import map_texts
from veilspark.llm.pii import SPANS

#: Kinds by rank. The first three are the base kinds; the others come from the name-literal pairs.
KINDS = ("assign", "access", "hex", "named", "const")
BASE = KINDS[:3]

_OPERATOR = re.compile(r"[:=]")
#: Names that end in one of these make a base pair.
_KEY = re.compile(r"(?:password|passwd|secret|token|api_?key)\Z", re.I | re.A)
_KEY_REACH = 8
_VALUE = re.compile(r" *[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: What stands between an operator's first character and its literal; quoted literals end at the next quote of their kind
#: or fail at the end of the line, bare ones at the first other character.
_OPEN = re.compile(r"[:=]=?>? *")
_QUOTED = re.compile(r"\"([^\"\n]*+)\"|'([^'\n]*+)'")
_BARE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")

#: How sensitive a target name is, by the parts it is written in.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "access": 0.4, "key": 0.4, "signing": 0.5, "encryption": 0.5,
}
#: A literal counts as a secret of kind `named` from this score, length and entropy (bits a character) on.
NAMED_SCORE, NAMED_LENGTH, NAMED_ENTROPY = 0.8, 8, 2.5
#: A name has this many characters at most.
NAME_REACH = 64


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _tail_entropies(value: str) -> list[float]:
    """The entropy of each tail of a string, from the whole string on: one pass from the right."""
    counts: Counter[str] = Counter()
    out, total = [], 0.0  # total: sum of c * log2(c)
    for n, c in enumerate(reversed(value), 1):
        k = counts[c]
        counts[c] = k + 1
        total += (k + 1) * math.log2(k + 1) - (k * math.log2(k) if k else 0.0)
        out.append(math.log2(n) - total / n)
    return out[::-1]


class _Literals:
    """The literals of one text. A bare token that holds operators is scanned once, however many literals end with it."""

    def __init__(self, text: str):
        self.text = text
        self.token = (0, 0)
        self.start_of: dict[int, int] = {}  # bare tokens by their ends
        self.tails: dict[int, list[float]] = {}
        self.strong: dict[tuple[int, int], bool] = {}  # by span, as many names may stand for one long literal

    def after(self, operator: int) -> tuple[tuple[int, int], bool] | None:
        """(span, whether it is bare) of the literal that an operator assigns."""
        at = _OPEN.match(self.text, operator).end()
        if quoted := _QUOTED.match(self.text, at):
            return quoted.span(quoted.lastindex), False
        if not self.token[0] <= at < self.token[1]:
            found = _BARE.match(self.text, at)
            if not found:
                return None
            self.token = found.span()
            self.start_of[found.end()] = at
        return (at, self.token[1]), True

    def is_identifier(self, span: tuple[int, int]) -> bool:
        found = _IDENTIFIER.match(self.text, *span)
        return bool(found) and found.end() == span[1]

    def is_strong(self, span: tuple[int, int]) -> bool:
        if span not in self.strong:
            start, end = span
            first = self.start_of.get(end, end)
            if first <= start < end:
                if end not in self.tails:
                    self.tails[end] = _tail_entropies(self.text[first:end])
                entropy = self.tails[end][start - first]
            else:
                entropy = _entropy(self.text[start:end])
            self.strong[span] = entropy >= NAMED_ENTROPY
        return self.strong[span]


def name_score(name: str) -> float:
    """Sum of what the parts of a name (snake, kebab, dotted or camel case) score, 1.5 at most."""
    parts = re.findall(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+", name)
    joined = name.lower().replace("_", "").replace("-", "")
    return min(1.5, sum(NAME_SCORES.get(p.lower(), 0.0) for p in parts) + (0.6 if "apikey" in joined else 0.0))


def _name_before(text: str, at: int) -> tuple[int, int]:
    """Bounds of the name left of an operator: blanks, then a quote, may stand between."""
    end = at
    while end and text[end - 1] == " ":
        end -= 1
    if end and text[end - 1] in "\"'":
        end -= 1
    start, least = end, max(0, end - NAME_REACH)
    while start > least and text[start - 1] in _NAME:
        start -= 1
    return start, end


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text by start, then kind; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    constants: dict[str, tuple[int, int]] = {}
    literals = _Literals(text)
    base_from = 0
    for operator in _OPERATOR.finditer(text):
        at = operator.start()
        start, end = _name_before(text, at)
        if key := _KEY.search(text, max(0, end - _KEY_REACH, base_from), end):
            if value := _VALUE.match(text, at + 1):
                base_from = value.end()
                if value.end(1) - value.start(1) >= 12:
                    found.append(("assign", key.start(), value.end()))
        literal = literals.after(at) if start < end else None
        if not literal:
            continue
        name, (span, bare) = text[start:end], literal
        names_other = bare and literals.is_identifier(span)
        known = constants.get(text[slice(*span)]) if names_other and span[1] - span[0] <= NAME_REACH else None
        constants[name] = span = known or span
        if name_score(name) < NAMED_SCORE or span[1] - span[0] < NAMED_LENGTH or names_other and not known:
            continue
        if literals.is_strong(span):
            found.append(("const" if known else "named", *span))
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return list(dict.fromkeys(found))


def detect_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secret_spans array<struct<kind, start, end>>) for every row. Narrow: no shuffle."""

    def make():
        names = ("kind", "start", "end")
        return lambda texts: [[[dict(zip(names, s, strict=True)) for s in find_secrets(t)] if t else [] for t in texts.to_pylist()]]

    return map_texts(df, [id_col], text_col, [T.StructField("secret_spans", SPANS)], make)


def mask(text: str, spans: list[tuple[str, int, int]], by: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with the secrets of its texts masked, all other columns as they are; n_chars is counted anew. Narrow."""
    plain = df

    @F.pandas_udf(T.StringType())
    def masked(texts):
        return texts.map(lambda t: mask(t, find_secrets(t)) if t else t, na_action="ignore")

    out = plain.withColumn(text_col, masked(F.col(f"`{text_col}`")))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col(f"`{text_col}`").isNull(), F.col(f"`{length_col}`")).otherwise(F.length(F.col(f"`{text_col}`")).cast(df.schema[length_col].dataType)))
    return out
