"""Secret scan by sliding-window Shannon entropy (operator 5).

Base patterns (assignments, access keys, long hex) give spans; on top of them
every candidate string is scanned with a window whose character counts are
updated by one arrival and one departure a step, so that entropy costs O(1) a
character. A window counts when its entropy reaches the threshold of the
candidate's character class, and an allow-list takes out strings known to be
harmless. Offsets are code points, ends exclusive.

Nulls count as empty texts; empty texts have no spans; a repeated row gives its
result again; other columns of the input are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import slices, table, text_buffers

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Harmless strings: words and numbers, dotted or dashed identifiers made of them, runs of one separator.
ALLOW = (r"[A-Za-z]+", r"[0-9]+", r"[A-Za-z]+(?:[-_/+=][A-Za-z]+)*", r"[0-9]+(?:[-_/+=][0-9]+)*", r"(?:[A-Za-z]{2,}|[0-9]+)(?:[-_/+=](?:[A-Za-z]{2,}|[0-9]+))*[-_/+=]*", r"[-_/+=]+.{0,3}")


@dataclass(frozen=True)
class SecretRules:
    """window: characters a window; min_run: shortest candidate; bits: least entropy by class."""

    window: int = 20
    min_run: int = 20
    bits: dict = field(default_factory=lambda: {"entropy_hex": 2.7, "entropy_mixed": 3.7})
    allow: tuple[str, ...] = ALLOW


def entropy_windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of all windows of ``s`` with entropy >= bits, by incremental counts."""
    if len(s) < window:
        return []
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, base, found = 0.0, math.log2(window), []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += part[c + 1] - part[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += part[c - 1] - part[c]
        if i >= window - 1 and base - total / window >= bits - 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1][1] = i + 1
            else:
                found.append([start, i + 1])
    return [tuple(x) for x in found]


def scan_text(text: str, rules: SecretRules = SecretRules()) -> tuple[list, list]:
    """(base spans, entropy spans) of a text as (start, kind index, end)."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    extra, allowed = [], re.compile("|".join(f"(?:{a})" for a in rules.allow))
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % rules.min_run, text):
        if allowed.fullmatch(m[0]):
            continue
        kind = 3 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", m[0]) else 4
        if kind == 4 and not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
            continue
        for a, b in entropy_windows(m[0], rules.window, rules.bits[KINDS[kind]]):
            extra.append((m.start() + a, kind, m.start() + b))
    return sorted(base), sorted(extra)


def flagged(raw: np.ndarray, offs: np.ndarray, min_run: int) -> np.ndarray:
    """Rows that may hold a span: a long run of candidate bytes (base spans have 20 at least), or a keyword."""
    n = len(offs) - 1
    hit = np.zeros(n, bool)
    if not len(raw):
        return hit
    lut = np.zeros(256, bool)
    lut[np.frombuffer(CANDIDATE_BYTES, np.uint8)] = True
    breaks = np.flatnonzero(~lut[raw])
    edges = np.concatenate([[-1], breaks, [len(raw)]])
    long = np.flatnonzero(np.diff(edges) > min_run)
    at = edges[long] + 1
    first = np.searchsorted(offs, at, side="right") - 1
    last = np.searchsorted(offs, edges[long + 1] - 1, side="right") - 1
    for a, b in zip(first.tolist(), last.tolist()):  # a run over several rows flags them all
        hit[a : b + 1] = True
    low = raw.tobytes().lower()
    found: list[int] = []
    for word in KEYWORDS:
        i = low.find(word)
        while i >= 0:
            found.append(i)
            i = low.find(word, i + 1)
    if found:
        hit[np.searchsorted(offs, np.array(found), side="right") - 1] = True
    return hit


def _join(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: SecretRules = SecretRules()) -> DataFrame:
    """One row per input row: counts by kind, digest of the base spans, all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                n = batch.num_rows
                raw, offs = text_buffers(batch.column("text"))
                counts = np.zeros((4, n), np.int64)
                digests, spans = [empty] * n, [""] * n
                for i in np.flatnonzero(flagged(raw, offs, min(20, rules.min_run))).tolist():
                    base, extra = scan_text(raw[offs[i] : offs[i + 1]].tobytes().decode(), rules)
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                    counts[3, i] = len(extra)
                    digests[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                    spans[i] = _join(sorted(base + extra))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                    "n_entropy": counts[3], "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()),
                })

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(scan, SCHEMA)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
