"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Base patterns find assignments, access keys and hexadecimal runs.  Besides, each
candidate (a long run of token characters) is classed by its characters, and a
window slides over it while counts, and so the sum of c*log2(c), are kept by adding
one character and taking one away.  Windows at or over their class's bits join to a
span of kind "entropy", unless the candidate is on the allow-list or at least half of
the window is placeholders.  Base spans are cut out of candidates first; what is left
is scanned.  Offsets are code points, ends exclusive.

Defined cases: null texts count as empty and have no spans; repeated rows give
repeated results; an empty table gives no rows; spans that start together come in the order
of their kinds; texts are scanned whole, in time linear in their length; extra columns are
never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.words import release

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Shortest candidate: a window of the class that needs fewest characters.
SHORTEST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Character classes from narrow to wide, the characters of their windows, and the bits a character from which a window is a secret.
#: Letters of one case alone are words: no window reaches theirs.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), 20, math.inf),
    ("hex", re.compile(r"[0-9A-F]+|[0-9a-f]+"), 16, 2.9),
    ("word", re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 20, math.inf),
    ("letters", re.compile(r"[A-Za-z]+"), 20, 4.1),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 16, 3.5),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.8),
)
#: Words that stand for a value.
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|x{4,}|0{7,}|1234567")
SEPARATORS = "+/_=-"
#: Candidates that are no secrets by one pattern: UUIDs, rulers, dates and counters.  No pattern can match a text in two ways, so all take linear time.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(.)\1*"),
    re.compile(r"[0-9]+([-_/=+][0-9]+)*"),
)
#: Parts of hyphenated words and paths of words.
PART = re.compile(r"[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4}")
#: Bits that a count of c adds: c*log2(c).
TERMS = [0.0] + [c * math.log2(c) for c in range(1, max(w for _, _, w, _ in CLASSES) + 1)]


def allowed(s: str) -> bool:
    """Whether a candidate is on the allow-list; words and numbers between separators, of which the first is a word, are."""
    if any(p.fullmatch(s) for p in ALLOWED):
        return True
    parts = re.split(r"[-_/=+]+", s.lstrip(SEPARATORS))
    return not parts[0].isdigit() and all(PART.fullmatch(x) for x in parts)


def entropy_windows(s: str, window: int, bits: float, marked: list[int] | None = None):
    """Merged (start, end) of the windows of ``s`` with at least ``bits`` a character; ``marked`` counts placeholders' characters before each place, and windows with half of them don't count."""
    counts: Counter[str] = Counter(s[:window])
    total, start, end = sum(TERMS[c] for c in counts.values()), -1, -1
    most = math.log2(window)
    for at in range(len(s) - window + 1):
        if at:
            out, new = s[at - 1], s[at + window - 1]
            if out != new:
                total += TERMS[counts[out] - 1] - TERMS[counts[out]] + TERMS[counts[new] + 1] - TERMS[counts[new]]
                counts[out] -= 1
                counts[new] += 1
        if most - total / window >= bits - 1e-9 and (marked is None or 2 * (marked[at + window] - marked[at]) < window):
            if at > end:
                if start >= 0:
                    yield start, end
                start = at
            end = at + window
    if start >= 0:
        yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if ":" in text or "=" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def pieces(s: str, start: int, base: list[tuple[int, int, int]]):
    """(start, text) of what base spans leave of a candidate that starts at ``start``; cut ends lose their separators."""
    end, at = start + len(s), start
    for a, kind, b in base:
        if a < end and at < b:
            # the value of an assignment has all characters of candidates, so nothing of the candidate is behind it
            if a > at:
                yield at, s[at - start : a - start]
            at = end if kind == 0 else b
    if at < end:
        yield at, s[at - start :]


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        whole = m.group()
        if allowed(whole):
            continue
        for start, s in pieces(whole, m.start(), base):
            if len(s) < len(whole):
                start += len(s) - len(s.lstrip(SEPARATORS))
                s = s.strip(SEPARATORS)
            if len(s) < SHORTEST:
                continue
            window, bits = next((w, b) for _, pattern, w, b in CLASSES if pattern.fullmatch(s))
            if len(s) < window or bits == math.inf or len(s) < len(whole) and allowed(s):
                continue
            marked = None
            for x in PLACEHOLDER.finditer(s):
                marked = marked or [0] * (len(s) + 1)
                for k in range(x.start(), x.end()):
                    marked[k + 1] = 1
            if marked:
                marked = list(accumulate(marked))
            found += [(start + a, 3, start + b) for a, b in entropy_windows(s, window, bits, marked)]
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + entropy_spans(text, base))
                n = Counter(k for _, k, _ in spans)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with each union of overlapping spans replaced."""
    base = base_spans(text)
    out, done = [], 0
    for a, _, b in sorted(base + entropy_spans(text, base)):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]]) if done else text


def redact(text: Column) -> Column:
    """Column of texts without their secrets; null stays null."""

    @F.arrow_udf("string")
    def without_secrets(texts: pa.Array) -> pa.Array:
        found = pa.array([None if (t := x.as_py()) is None else redacted(t) for x in texts], pa.string())
        release()
        return found

    return without_secrets(text)
