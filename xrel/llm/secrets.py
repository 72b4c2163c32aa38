"""Secret scans (operator 9): fixed patterns, and random strings found by a battery of randomness tests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored

# The base patterns and the least lengths of what they must match.
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

# Candidates of the method: runs of key characters with at least one digit and one letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_PART = 20
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
# A candidate passes a test if its p-value is above this; all three must be passed.
LEAST_P = 0.001
# Share of false finds allowed in each class of lengths.
FALSE_SHARE = 0.01
LENGTH_CLASSES = (32, 48, 80)
P_BINS = 64


def encoding(text: str) -> tuple[str, str] | None:
    """The smallest alphabet that holds all characters; None for what has no digit or no letter."""
    body = text.rstrip("=")
    if not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    own = set(body)
    return next(((name, alphabet) for name, alphabet in _ALPHABETS if own <= set(alphabet)), None)


def parts(text: str, start: int = 0, marks: tuple[str, ...] = ("/-", "+_")) -> Iterator[tuple[int, str, str]]:
    """(start, string, alphabet) of what is tested of a run of key characters.

    A run that mixes + or / with - or _ fits no alphabet: a path or a name may hold a key. It is split at / and -,
    and what still mixes + with _ is split there.
    """
    coded = encoding(text)
    if coded is not None:
        yield start, text, coded[1]
    elif marks and set(text) & set("+/") and set(text) & set("-_"):
        for m in re.finditer(f"[^{re.escape(marks[0])}]+", text):
            if len(m.group().rstrip("=")) >= LEAST_PART:
                yield from parts(m.group(), start + m.start(), marks[1:])


def _normal_tail(z: float) -> float:
    from math import erfc, sqrt

    return erfc(abs(z) / sqrt(2))


def _chi_tail(x: float, degrees: int) -> float:
    """Upper tail of the chi-squared distribution by the cube-root approximation."""
    from math import erfc, sqrt

    z = ((x / degrees) ** (1 / 3) - (1 - 2 / (9 * degrees))) / sqrt(2 / (9 * degrees))
    return erfc(z / sqrt(2)) / 2


def battery(text: str, alphabet: str) -> tuple[float, float, float]:
    """p-values of uniformity over the alphabet, of runs above and below its middle, and of serial correlation."""
    values = np.array([alphabet.index(c) for c in text.rstrip("=")], float)
    n, size = len(values), len(alphabet)
    # Few characters: the alphabet is folded into cells that expect at least four each.
    cells = max(2, min(size, n // 4))
    seen = np.bincount((values * cells / size).astype(int), minlength=cells)
    share = np.bincount((np.arange(size) * cells / size).astype(int), minlength=cells) / size
    uniform = _chi_tail(max(1e-9, float(((seen - n * share) ** 2 / (n * share)).sum())), cells - 1)
    above = values >= size / 2
    n1 = int(above.sum())
    n2 = n - n1
    if not n1 or not n2:
        return uniform, 0.0, 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * n1 * n2 / n
    spread = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    by_runs = _normal_tail((runs - mean) / max(spread, 1e-9) ** 0.5)
    centred = values - values.mean()
    total = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / total if total else 1.0
    return uniform, by_runs, _normal_tail((serial + 1 / n) * n**0.5)


def written_like(text: str) -> float:
    """How likely a text made of word pieces looks at least this mixed: the p-value that finds are controlled by.

    Written names change from small letters to capitals, or to and from digits and marks, at few places; random
    strings do at a fixed rate given by their alphabet. Under the null hypothesis one place in ten changes.
    """
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in text.rstrip("=")]
    changes = sum(a != b and (a, b) != (1, 0) for a, b in zip(kinds, kinds[1:], strict=False))
    return _binomial_tail(len(kinds) - 1, changes, 0.1)


def _binomial_tail(n: int, least: int, rate: float) -> float:
    """Chance of `least` or more hits in n draws. All terms are summed, as logarithms, so no length overflows."""
    from math import lgamma, log

    k = np.arange(least, n + 1, dtype=float)
    first = lgamma(n + 1) - lgamma(least + 1) - lgamma(n - least + 1) + least * log(rate) + (n - least) * log(1 - rate)
    # Each term from the one before it.
    steps = np.log((n - k[:-1]) / (k[:-1] + 1)) + log(rate / (1 - rate))
    terms = first + np.concatenate([[0.0], np.cumsum(steps)])
    top = float(terms.max())
    return min(1.0, float(np.exp(top + np.log(np.exp(terms - top).sum()))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order, of the base patterns; leftmost, non-overlapping within a kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Runs are as long as they can be, so those of 32 and more are the long matches of HEX.
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def random_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, end, length class, p) of strings that pass the battery and don't touch a base span."""
    out = []
    for m in CANDIDATE.finditer(text):
        for start, own, alphabet in parts(m.group(), m.start()):
            end = start + len(own)
            if any(s < end and start < e for s, _, e in base):
                continue
            if min(battery(own, alphabet)) < LEAST_P:
                continue
            length = sum(len(own) >= x for x in LENGTH_CLASSES)
            out.append((start, end, length, written_like(own)))
    return out


def p_bin(p: float) -> int:
    """Bins of halving width: bin k holds p in (2 ** -(k + 1), 2 ** -k]."""
    return P_BINS - 1 if p <= 0 else min(P_BINS - 1, int(-np.log2(min(p, 1.0))))


_SCANNED = "doc_id bigint, base array<struct<start:int,kind:int,end:int>>, random array<struct<start:int,end:int,length:int,bin:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    random_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "length", "bin")]))
    for batch in batches:
        base, random = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            own = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            random.append(
                [{"start": s, "end": e, "length": n, "bin": p_bin(p)} for s, e, n, p in random_candidates(text, own)]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, base_type), pa.array(random, random_type)], names=["doc_id", "base", "random"]
        )


def _least_bins(scanned: DataFrame) -> dict[int, int]:
    """Per class of lengths the first bin that is a find, by the step-up rule over all candidates of the class.

    With m candidates, of which c lie in bins from k on, bin k is accepted while its upper end m * 2 ** -k / c stays
    within FALSE_SHARE. At most classes x bins rows reach the driver.
    """
    cells = scanned.select(F.explode("random").alias("r")).groupBy("r.length", "r.bin").count().collect()
    out = {}
    for length in range(len(LENGTH_CLASSES) + 1):
        counts = {r["bin"]: r["count"] for r in cells if r["length"] == length}
        m, c = sum(counts.values()), 0
        out[length] = P_BINS
        for k in range(P_BINS - 1, -1, -1):
            c += counts.get(k, 0)
            if c and m * 2.0**-k / c <= FALSE_SHARE:
                out[length] = k
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base and random, the spans found as arrays of structs, in code points, end exclusive.

    base has kinds 0 assign, 1 access, 2 hex. random has further strings: their encoding is inferred, they pass a
    chi-squared test of uniformity, a runs test and a serial-correlation test at a fixed level each, and written words
    are ruled out by written_like(), the one test whose rate of false finds is controlled, per class of lengths over
    all documents. A run that fits no alphabet is split at its marks first. Null and empty texts have no spans;
    repeated rows and null ids are scanned row by row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scanned = stored(map_arrow(rows, _scan, _SCANNED), "secrets")
    least = _least_bins(scanned)
    table = F.array(*[F.lit(least[k]) for k in sorted(least)])
    return scanned.withColumn("random", F.filter("random", lambda r: r["bin"] >= F.get(table, r["length"])))


def joined_spans(*spans) -> F.Column:
    """kind:start:end by start, then kind, comma-joined, of arrays of (start, kind, end)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.array_sort(F.concat(*spans))
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
