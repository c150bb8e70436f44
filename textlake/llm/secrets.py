"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a run of at least ``WINDOW`` characters of one class (hexadecimal digits; base64 characters). A window
of ``WINDOW`` characters slides over it; the counts of its characters, and with them the sum of c log2 c, change by
one step in and one out, so entropy costs the same per place whatever the window. Windows at or above the class's
threshold are joined to spans. A candidate that the allow-list matches in full gives no span.

Defined results: a NULL text counts as empty and has no spans; spans are in code points, end exclusive; spans of the
patterns do not overlap within a kind, those of different kinds may; texts are read whole, and in pieces that cannot
change the outcome never; repeated rows give equal rows; other columns are kept by ``find``; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Patterns, least lengths and kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
#: class: characters, bits per character from which a window counts. A window of 20 random characters has about 3.5
#: bits (hexadecimal) or 4.1 (base64), ordinary words of that length about 3.2.
CLASSES = {"entropy_hex": ("0-9A-Fa-f", 3.0), "entropy_base64": ("A-Za-z0-9+/_=-", 3.7)}
#: Candidates that are no secrets: words (in one case or with a capital first) joined by separators, numbers, runs of the
#: alphabet or of digits, UUIDs. Case that changes within a word, as in random keys, is left to the threshold.
_WORD = r"(?:[A-Z]?[a-z]++|[A-Z]++)"
ALLOWED = (
    rf"[+/_=-]*+(?:{_WORD}[+/_=-]++)*+{_WORD}?",
    r"[0-9+/_=-]*",
    r"(?i:0123456789abcdef|abcdefghijklmnopqrstuvwxyz|1234567890|[+/_=-])+",
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
)


class Scanner:
    def __init__(self, window: int = WINDOW, classes: dict[str, tuple[str, float]] | None = None, allowed: tuple[str, ...] = ALLOWED):
        self.window, self.allowed = window, re.compile("|".join(f"(?:{a})" for a in allowed)) if allowed else None
        self.classes = {k: (re.compile(f"[{chars}]{{{window},}}"), bits) for k, (chars, bits) in (CLASSES if classes is None else classes).items()}
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        # a run of enough characters is found whole by a greedy match, so shorter runs need no match of their own
        self.access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
        self.hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
        self.log = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]  # a window holds one more while it moves

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "assign") for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in self.access.finditer(text)]
        return found + [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)]

    def entropy(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for kind, (candidate, bits) in self.classes.items():
            for m in candidate.finditer(text):
                if not (self.allowed and self.allowed.fullmatch(m.group())):
                    found += [(m.start() + a, m.start() + b, kind) for a, b in self.windows(m.group(), bits)]
        return found

    def windows(self, run: str, bits: float) -> list[tuple[int, int]]:
        """Unions of the windows whose entropy is at least ``bits``."""
        width, log = self.window, self.log
        most = (math.log2(width) - bits) * width + 1e-9  # of the sum of c log2 c
        counts: dict[str, int] = {}
        total, spans = 0.0, []
        for i, ch in enumerate(run):
            c = counts.get(ch, 0)
            total += log[c + 1] - log[c]
            counts[ch] = c + 1
            if i >= width:
                old = run[i - width]
                c = counts[old]
                total += log[c - 1] - log[c]
                counts[old] = c - 1
            if i >= width - 1 and total <= most:
                start = i - width + 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans]

    def scan(self, text: str | None) -> tuple[list, list]:
        """Spans of the patterns, and all spans: (start, end, kind), by start and then kind."""
        if not text:
            return [], []
        order = lambda s: (s[0], KINDS.index(s[2]) if s[2] in KINDS else len(KINDS), s[1])
        base = sorted(self.base(text), key=order)
        more = self.entropy(text)
        return base, sorted(base + more, key=order) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", scanner: Scanner | None = None) -> DataFrame:
    """Add ``out_col``: array of (kind, start, end) of all spans."""
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in scanner.scan(x.as_py())[1]] for x in texts], kind)

    return docs.withColumn(out_col, F.arrow_udf(run, "array<struct<kind:string,start:int,end:int>>")(F.col(text_col)))


def summary(text: Column, scanner: Scanner | None = None) -> Column:
    """n_assign, n_access, n_hex, base_sha256 and spans of a text, as a struct."""
    scanner = scanner or Scanner()
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: dict[str, list] = {n: [] for n in names}
            for x in texts:
                base, every = scanner.scan(x.as_py())
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.StructArray.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names)

    return F.arrow_udf(run, "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")(text)
