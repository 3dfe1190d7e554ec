"""Secret scans: fixed patterns plus sliding entropy over candidate strings.

Fixed patterns give the kinds ``assign``, ``access`` and ``hex``; their spans
are whole matches.  Kind ``entropy`` adds candidate strings (runs of key
characters) in which a window reaches the Shannon entropy set for its character
class.  The window slides one character at a time with incremental counts.
Candidates that the allow-list knows, or that one fixed match covers whole, are
left out; the allow-list never removes a fixed match.

Null texts are empty; every text is scanned whole; rows of null or repeated ids
are kept row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteval.llm.common import map_texts, text_of

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no look
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18


@dataclass(frozen=True)
class EntropyRule:
    """A class of key characters: window length and bits per character that count."""
    name: str
    pattern: str
    window: int
    bits: float


ENTROPY_RULES = (
    EntropyRule("hex", r"[0-9A-Fa-f]{24,}", 24, 3.2),
    EntropyRule("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
# Known harmless strings: plain words and names, numbers, dotted or dashed words, paths, one character again and again.
ALLOWED = (
    r"[A-Za-z]+", r"\d+", r"[A-Za-z]+(?:[-_/+=][A-Za-z]+)*", r"(?:[A-Za-z]+[-_/])*[A-Za-z]*\d{1,4}", r"(.)\1*",
    r"[-_=+/]+", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
)


def window_entropy_reaches(s: str, window: int, bits: float) -> bool:
    """Some window of ``s`` has at least ``bits`` of entropy per character."""
    if len(s) < window:
        return False
    log = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log c over the window's counts
    least = window * (math.log2(window) - bits) + 1e-9
    for i, ch in enumerate(s):
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total += log[c - 1] - log[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += log[c + 1] - log[c]
        counts[ch] = c + 1
        if i >= window - 1 and total <= least:
            return True
    return False


def scan(text: str, rules=ENTROPY_RULES, allowed: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """Sorted (start, kind number, end) of all spans of a text."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    allowed = allowed or _allow(ALLOWED)
    seen: set[tuple[int, int]] = set()
    for rule in rules:
        # matches of one rule lie apart, so only spans found before can hold them
        held = sorted([(s, e) for s, _, e in spans] + list(seen))
        starts = [s for s, _ in held]
        reach = list(accumulate((e for _, e in held), max))
        for m in _compiled(rule.pattern).finditer(text):
            at, end = m.span()
            before = bisect_right(starts, at)
            if before and reach[before - 1] >= end:
                continue
            if allowed.fullmatch(m[0]) or not window_entropy_reaches(m[0], rule.window, rule.bits):
                continue
            seen.add((at, end))
    spans += [(s, 3, e) for s, e in seen]
    return sorted(spans)


_PATTERNS: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = re.compile(pattern)
    return _PATTERNS[pattern]


def _allow(patterns: tuple[str, ...]) -> re.Pattern:
    # each alternative's own group keeps its number out of the others
    joined = "|".join(f"(?:{p})" for p in patterns)
    return _compiled(joined)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=ENTROPY_RULES,
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Counts, digest and spans of every whole text."""
    docs = docs.select(F.col(id_col), text_of(text_col).alias("_text"))

    def start():
        skip = _allow(allowed)

        def find(texts):
            rows = [scan(t, rules, skip) for t in texts]
            base = [[x for x in r if x[1] < 3] for r in rows]
            return [*([sum(x[1] == i for x in r) for r in rows] for i in range(len(KINDS))),
                    [hashlib.sha256(spelled(r).encode()).hexdigest() for r in base], [spelled(r) for r in rows]]

        return find

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(docs, [id_col], f"{counts}, base_sha256 string, spans string", start)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each span, joined where they overlap, replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules=ENTROPY_RULES,
           allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All rows and columns, with secrets of the text replaced; null stays null."""
    def start():
        skip = _allow(allowed)
        return lambda texts: [[None if t is None else redacted(t, scan(t, rules, skip), mark) for t in texts]]

    rest = [c for c in docs.columns if c != text_col]
    return map_texts(docs, rest, f"`{text_col}` string", start, text_col).select(*docs.columns)
