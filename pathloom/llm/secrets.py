"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs, so a bound in the pattern equals one on the match
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_DIGIT, _LOWER, _UPPER, _SIGN = range(4)
_CLASS = {**{c: _DIGIT for c in "0123456789"}, **{chr(97 + i): _LOWER for i in range(26)}, **{chr(65 + i): _UPPER for i in range(26)}, **{c: _SIGN for c in "+/-_"}}
# encodings by the characters they can hold, smallest alphabet first
ENCODINGS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_ALPHABETS = [(name, {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
SWITCH = (0.3, 0.12, 0.12, 0.12)  # by class, chance that the next character of ordinary text is of another: numbers are short
_STEP = [[math.log(1 - r if p == q else r / 3) for q in range(4)] for p, r in enumerate(SWITCH)]
# percentages of letters in ordinary text, the mean of English, German, French and Spanish
_SHARES = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.9, 1.5, 3.0, 4.4, 15.1, 1.2, 1.7, 3.2, 7.2, 0.4, 0.5, 4.5, 2.7, 7.8, 6.3, 2.1, 0.5, 6.6, 7.1, 6.8, 3.9, 1.0, 0.9, 0.2, 0.8, 0.6), strict=True))
_WHOLE = sum(_SHARES.values())
_TEXT = {c: math.log(1 / 10 if k == _DIGIT else 1 / 4 if k == _SIGN else _SHARES[c.lower()] / _WHOLE) for c, k in _CLASS.items()}  # a character within its class


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(token: str) -> tuple[str, float] | None:
    """(encoding, p): the least of three p-values under uniform draws from the inferred alphabet, times three.

    Chi-squared over the alphabet (normal approximation by cube root), a two-sided test of the runs above and
    below the alphabet's middle, and the lag-one serial correlation. None if no alphabet has all characters.
    """
    body = token.rstrip("=")
    for name, places in _ALPHABETS:
        if all(c in places for c in body):
            break
    else:
        return None
    x = [places[c] for c in body]
    n, k = len(x), len(places)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    spread = 2 / (9 * (k - 1))
    p_chi = _tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    high = [2 * v >= k for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
        p_runs = min(1.0, 2 * _tail(abs(runs - mean) / math.sqrt(var))) if var > 0 else 1.0
    else:
        p_runs = 2 * 0.5**n
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    p_serial = min(1.0, 2 * _tail(abs(sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False)) / var + 1 / n) * math.sqrt(n))) if var else 0.0
    return name, min(1.0, 3 * min(p_chi, p_runs, p_serial))


def ordinary(token: str) -> float:
    """p-value of a token as ordinary text, against uniform draws from the encodings that can hold it.

    Ordinary text draws characters by its letter counts and changes class at the rates of SWITCH. The value is the
    token's chance there over its mean chance under ENCODINGS: by Markov's inequality this ratio falls
    below p with chance p at most, at any length and for tokens of one class too.
    """
    body = token.rstrip("=")
    kinds = [_CLASS[c] for c in body]
    n = len(body)
    text = math.log(1 / 4) + sum(_STEP[p][q] for p, q in zip(kinds, kinds[1:], strict=False)) + sum(_TEXT[c] for c in body)
    held = set(body)
    sizes = [len(places) for _, places in _ALPHABETS if held <= places.keys()]
    if not sizes:
        return 1.0
    uniform = math.log(sum((min(sizes) / size) ** n for size in sizes) / len(_ALPHABETS)) - n * math.log(min(sizes))
    return math.exp(min(0.0, text - uniform))


def _fdr(tests: list[tuple[float, int]], rate: float) -> list[bool]:
    """Benjamini-Hochberg with weights in proportion to length: a longer token needs less."""
    total = sum(n for _, n in tests)
    weighted = sorted((p * total / (n * len(tests)), i) for i, (p, n) in enumerate(tests))
    last = max((k for k, (p, _) in enumerate(weighted, 1) if p <= rate * k / len(tests)), default=0)
    kept = {i for _, i in weighted[:last]}
    return [i in kept for i in range(len(tests))]


def spans(text: str, rate: float = 1e-4, alpha: float = 1e-3, doubt: float = 0.05) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a whole text, by start, then kind as in KINDS.

    The fixed patterns come first and always stay. A further token (20 characters or more of one of the
    alphabets, none of them in a fixed span) gets the battery's p-value under uniform draws and its p-value as
    ordinary text. Below `alpha` the battery rules it out; below `doubt` it takes evidence away in
    proportion. What is left is the value whose false-discovery rate is held at `rate` among the text's tokens.
    Time is linear in the text's length.
    """
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    fixed = sorted((a, b) for a, b, _ in out)
    at = reach = 0  # fixed spans that start before the token's end, and how far they go
    found = []
    for m in _TOKEN.finditer(text):
        while at < len(fixed) and fixed[at][0] < m.end():
            reach = max(reach, fixed[at][1])
            at += 1
        if reach <= m.start():
            tested = uniformity(m.group())
            q = tested[1] if tested else 0.0
            found.append((m, min(1.0, ordinary(m.group()) / min(1.0, q / doubt)) if q >= alpha else 1.0))
    for (m, _), hit in zip(found, _fdr([(p, m.end() - m.start()) for m, p in found], rate), strict=True):
        if hit:
            out.append((m.start(), m.end(), "random"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _join(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for each row of docs; see spans().

    Null and empty texts have no spans; rows that repeat a doc_id, or have none, each have a row; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    found = spans(text or "")
                    n = [sum(kind == k for _, _, kind in found) for k in KINDS]
                    base = _join([s for s in found if s[2] != "random"])
                    rows.append((*n[:3], sha256(base.encode()).hexdigest(), _join(found), n[3]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret of `text` replaced by the mark; overlapping secrets become one mark.

    Null and empty texts, rows without secrets, repeated rows and all other columns stay as they are."""
    schema = T.StructType(docs.schema.fields)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = []
                for text in part.column("text").to_pylist():
                    if text:
                        pieces, at = [], 0
                        for a, b, _ in spans(text):
                            if a >= at:
                                pieces += [text[at:a], mark]
                            at = max(at, b)
                        text = "".join([*pieces, text[at:]]) if pieces else text
                    texts.append(text)
                columns = list(part.columns)
                columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, schema)
