r"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Base findings (kinds ``assign``, ``access``, ``hex``) are the leftmost
non-overlapping matches of fixed patterns. The method adds the kind
``entropy``: candidate strings are runs of token characters; a window slides
over a candidate, and the Shannon entropy of the characters in it is kept by
incremental counts (one character enters, one leaves). Each window is judged
by the character class of its own characters, since random hexadecimal text
holds 4 bits a character at most and base64 text 6, and a candidate may join a
name or a path to a secret. A candidate with a window that reaches its class's
threshold becomes one span, unless the allow-list suppresses the window: the
list is held against the whole candidate where it describes all of it, and
against the pieces between ``=`` and ``/`` that the window lies in; its words
count only there. The allow-list never touches base findings.

Defined results: a null text is an empty one; a document without findings has
zero counts and the digest of the empty string; a repeated row gets a row of
its own; spans that start together are ordered by kind as listed; other columns
are ignored; texts of any length are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from haulage.llm.common import slices

KINDS = ("assign", "access", "hex", "entropy")

# (?a) keeps (?i) to ASCII letters.
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs: dropping shorter ones changes no other match
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Window, in characters, and bits a character that a window must reach, by
#: the window's character class. A window of 20 holds log2(20) = 4.32 bits
#: at most, of 16 hexadecimal digits 4.
WINDOW = 20
THRESHOLDS = {"hex": 3.2, "alnum": 3.7, "base64": 3.9}

#: Where a candidate is cut into the pieces that allow-list words count for.
_CUT = re.compile(r"[=/]")

_LOWER_HEX, _UPPER_HEX = frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF")

#: Allow-list (fixed values): candidates that look random and are not secret.
_ANYWHERE = "(?i).*"  # begins a pattern of words that may stand anywhere
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?i).*(?:example|sample|placeholder|changeme|xxxx|abcdefgh|0123456789ab|1234567890).*"),
    re.compile(r"[0-9_=+/-]+"),  # numbers, rules, dates
    re.compile(r"[A-Za-z_=+/-]*"),  # words, identifiers and paths without a digit
)


def window_classes(text: str, width: int) -> Iterator[str]:
    """The character class of every window of ``width`` characters (of the
    whole text if it is shorter), from the last place that each class lacks."""
    width = min(width, len(text))
    lower = upper = alnum = -1
    for i, c in enumerate(text):
        if c not in _LOWER_HEX:
            lower = i
        if c not in _UPPER_HEX:
            upper = i
        if not c.isalnum():
            alnum = i
        start = i - width + 1
        if start >= 0:
            yield "hex" if lower < start or upper < start else "alnum" if alnum < start else "base64"


def window_entropies(text: str, width: int) -> Iterator[float]:
    """Shannon entropy, in bits a character, of every window of ``width``
    characters (of the whole text if it is shorter), by incremental counts:
    H = log2(n) - sum(c * log2(c)) / n over the counts c."""
    width = min(width, len(text))
    if not width:
        return
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts = Counter(text[:width])
    total = sum(weight[c] for c in counts.values())
    log_n = math.log2(width)
    yield log_n - total / width
    for out, new in zip(text, text[width:], strict=False):
        if out != new:
            c = counts[out]
            counts[out] = c - 1
            total += weight[c - 1] - weight[c]
            c = counts[new]
            counts[new] = c + 1
            total += weight[c + 1] - weight[c]
        yield log_n - total / width


def random_windows(candidate: str, width: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> Iterator[int]:
    """The starts of the windows that reach the threshold of their class."""
    judged = zip(window_entropies(candidate, width), window_classes(candidate, width), strict=True)
    return (i for i, (h, kind) in enumerate(judged) if h >= thresholds[kind])


def suppressed(candidate: str, allowed=ALLOWED) -> bool:
    return any(p.fullmatch(candidate) for p in allowed)


def is_secret(candidate: str, width: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allowed=ALLOWED) -> bool:
    """Whether a window is random that the allow-list does not suppress."""
    if suppressed(candidate, [p for p in allowed if not p.pattern.startswith(_ANYWHERE)]):
        return False
    cuts = [m.start() for m in _CUT.finditer(candidate)]
    last = None
    for i in random_windows(candidate, width, thresholds):
        before, after = bisect_right(cuts, i - 1), bisect_left(cuts, i + width)
        pieces = (cuts[before - 1] + 1 if before else 0, cuts[after] if after < len(cuts) else len(candidate))
        if pieces != last and not suppressed(candidate[pieces[0]:pieces[1]], allowed):
            return True
        last = pieces
    return False


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def entropy_spans(text: str, width: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS,
                  allowed=ALLOWED) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "entropy") for m in _CANDIDATE.finditer(text)
            if is_secret(m[0], width, thresholds, allowed)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


_SCHEMA = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, "
           "base_sha256 string, spans string")


def scan(docs: DataFrame, width: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Per document row the counts by kind, the digest of the base spans and
    all spans (kind:start:end in code points, by start, then kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = entropy_spans(text or "", width, thresholds)
                n = Counter(kind for _, _, kind in base)
                rows.append((n["assign"], n["access"], n["hex"], len(more),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            texts = [pa.array([r[i] for r in rows], pa.string()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, *texts],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
