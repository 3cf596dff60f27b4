"""Secret scans: patterns, and sliding-window Shannon entropy with an allow-list."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from driftfield.llm.common import column, sliced

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What an assignment names; one search of the lower-cased bytes shows that a text has none.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Candidates for the entropy scan, and what is no secret however random it looks.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALLOWED = (
    r"[A-Za-z_/=+-]+",  # words, identifiers, paths and rulers; one class, so that matching is linear
    r"[0-9]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"(.)\1*",
    r".*(EXAMPLE|example|0123456789|abcdefgh|ABCDEFGH).*",
)
KINDS = ("assign", "access", "hex", "entropy")


def log_table(width: int) -> list[float]:
    """c * log2(c) for counts up to ``width``."""
    return [0.0] + [c * math.log2(c) for c in range(1, width + 1)]


def windows_entropy(text: str, width: int, table: Sequence[float]) -> Iterator[float]:
    """Shannon entropy (bits a character) of each run of ``width`` characters.

    The sum of c * log2(c) over the counts is kept as one character enters and
    one leaves, so a step costs the same at any width.
    """
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += table[n + 1] - table[n]
        if i >= width:
            old = text[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += table[n - 1] - table[n]
        if i >= width - 1:
            yield math.log2(width) - total / width


def char_class(text: str) -> str:
    return "hex" if re.fullmatch(r"[0-9a-fA-F-]+", text) else "base64"


class Scanner:
    """Finds spans (start, kind, end) of one text, in code points, end exclusive.

    ``limits`` hold the entropy from which a window of a class is a secret.
    """

    def __init__(self, width: int = 20, limits: dict[str, float] | None = None, allowed: Sequence[str] = ALLOWED):
        self.width, self.table = width, log_table(width + 1)  # one enters before one leaves
        self.limits = limits or {"hex": 3.0, "base64": 3.8}
        self.allowed = re.compile("|".join(f"(?:{x})" for x in allowed if r"\1" not in x)) if allowed else None
        self.repeated = any(r"\1" in x for x in allowed)

    def base(self, text: str, raw: bytes) -> list[tuple[int, int, int]]:
        spans = []
        low = raw.lower()
        if any(x in low for x in NAMES):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if b"AKIA" in raw:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return spans

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        """Maximal runs of windows over the limit, inside each candidate that no allow-list entry matches whole."""
        spans = []
        for m in CANDIDATE.finditer(text):
            word = m[0]
            if self.allowed and self.allowed.fullmatch(word) or self.repeated and len(set(word)) == 1:
                continue
            limit, start, end = self.limits[char_class(word)], None, 0
            for i, h in enumerate(windows_entropy(word, self.width, self.table)):
                if h >= limit:
                    if start is not None and i > end:
                        spans.append((m.start() + start, 3, m.start() + end))
                        start = None
                    start, end = (i if start is None else start), i + self.width
            if start is not None:
                spans.append((m.start() + start, 3, m.start() + end))
        return spans

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans."""
        if not text:
            return [], []
        base = sorted(self.base(text, text.encode("utf-8", "surrogatepass")))
        return base, sorted(base + self.entropy(text))


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, **scanner) -> DataFrame:
    """Find secrets in whole texts.

    Four kinds: assignments to names such as ``token``, access key ids, runs of
    24 or more hex digits, and stretches of high entropy in candidate strings
    that no allow-list entry explains. One pass over the rows, no shuffle; memory
    is bounded by a batch of texts.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (digest of the first
    three kinds' spans), spans (all, as kind:start:end by start, then kind). Null
    and empty texts have none; a long text is read whole, in time that grows as
    its length. Of kinds that match at one place each gives a span. A row per
    input row; null ids and repeated rows pass through; an empty table gives no
    rows; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Scanner(**scanner)
        for batch in sliced(batches):
            rows = [finder.scan(x.as_py()) for x in column(batch, "text")]
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in base) for base, _ in rows], pa.int64())
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]
            spans = [joined(every) for _, every in rows]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), count(0), count(1), count(2), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


_NAMES_SQL = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
#: The numbers of base spans.
ORACLE = rf"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '({_NAMES_SQL})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::bigint n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint n_hex
from documents
"""
