"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are kept whenever their pattern and check
hold, whatever the score. The method adds kinds that need more than a pattern:
an IBAN by its mod-97 checksum; a key or password by words near it.
Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.textarrays import text_column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "key", "password", "ssn")
#: A proposed span of an added kind is kept at this score.
ACCEPT = 0.5
#: Code points before and after a span in which context words count.
NEAR = 40

#: Patterns of the base kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Patterns of the added kinds, with the score that the pattern alone gives.
ADDED = (
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), 0.2),
    ("key", re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), 0.6),
    ("key", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])"), 0.3),
    ("password", re.compile(r"(?i:(?:password|passwd|pwd)\x20?[=:]\x20?)[^\s\"',;]{6,64}"), 0.6),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.3),
)
CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank|banque|banco)"),
    "key": re.compile(r"(?i)(?:key|token|secret|credential|aws|api)"),
    "password": re.compile(r"(?i)(?:user|login|account)"),
    "ssn": re.compile(r"(?i)(?:ssn|social|security)"),
}
#: Words near a span that speak against it.
AGAINST = re.compile(r"(?i)(?:example|sample|dummy|checksum|commit|version|isbn)")

_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The Luhn checksum of a string of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 checksum of an IBAN (spaces allowed)."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, found from each @ outwards, so that long words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base kinds whose checks hold."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of added kinds whose score reaches ACCEPT."""
    out = []
    digits, small = _DIGITS.search(text) is not None, text.lower()
    for kind, pattern, score in ADDED:
        if not digits if kind != "password" else "pass" not in small and "pwd" not in small:
            continue  # no span of this kind can match
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "iban":
                end = b
                while end > a and not mod97(text[a:end]):  # a following word in capitals is not part of it
                    end = text.rfind(" ", a, end)
                if end <= a + 14:
                    continue
                b, score = end, 0.7
            around = text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]
            total = score + 0.3 * bool(CONTEXT[kind].search(around)) - 0.3 * bool(AGAINST.search(around))
            if total >= ACCEPT:
                out.append((a, b, kind))
    return out


def ordered(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of `docs`.

    Whole texts. Counts and base_sha256 are of base spans; spans has all. A
    null or empty text has no span: counts 0, the digest of the empty string,
    and an empty spans string. Rows repeat as they do in `docs`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, every = [], []
            for value in text_column(batch):
                text = value.as_py() or ""
                base = base_spans(text)
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[2] == kind for s in base))
                digests.append(sha256(ordered(base).encode()).hexdigest())
                every.append(ordered(base + added_spans(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """`text` with each span replaced by its kind in brackets (overlapping spans: the first wins)."""
    out, done = [], 0
    for part in spans.split(",") if spans else []:
        kind, a, b = part.split(":")
        if int(a) >= done:
            out += [text[done : int(a)], f"[{kind}]"]
            done = int(b)
    return "".join(out) + text[done:]
