"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a local parser expands to the boundaries of an e-mail, an
address (IP or URL), a card, a phone or an account number, and validates what it found. Text
without anchors costs no parsing. Parsers are deterministic; a match that fails validation is
dropped and its text not tried again from another start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_batches, text_of

#: The kinds, those of the base first, in the order of their spans.
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "url")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
CUES = ("account", "acct", "iban", "customer", "member", "passport", "user", "ssn", "konto", "compte", "cuenta")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?:[\x20_-]?(?:id|no|nr|number|num))?\.?[\x20]{0,2}[:=#]?[\x20]{0,2}([A-Za-z0-9](?:[A-Za-z0-9-]{4,32})[A-Za-z0-9])(?![A-Za-z0-9-])", re.I)
URL = re.compile(r"[^\s\"'<>]+")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("email", "@"), ("phone", "+"), ("digit", "0123456789"), ("url", SCHEMES), ("account", CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str, at: list[int]) -> list[tuple[int, int]]:
    found, done = [], 0
    for a in at:
        start = a
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if a >= done and start < a and (m := DOMAIN.match(text, a + 1)):
            found.append((start, done := m.end()))
    return found


def _from_digits(text: str, runs: list[int], pattern: re.Pattern, valid) -> list[tuple[int, int]]:
    """Matches that begin a digit run: whatever can match from within a run matches from its start."""
    found, done = [], 0
    for start in runs:
        if start >= done and (m := pattern.match(text, start)):
            done = m.end()
            if valid(m[0]):
                found.append((start, done))
    return found


def _is_ip(s: str) -> bool:
    # parts may be of any length: what is left without leading noughts is short, or too large
    parts = [x.lstrip("0") or "0" for x in s.split(".")]
    return all(len(x) <= 3 and int(x) <= 255 for x in parts)


def _is_card(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str, at: list[int]) -> list[tuple[int, int]]:
    found, done = [], 0
    for a in at:
        if a >= done and (m := PHONE.match(text, a)):
            done = m.end()
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((a, done))
    return found


def _accounts(text: str, ends: list[int]) -> list[tuple[int, int]]:
    found, done = [], 0
    for e in ends:
        m = ACCOUNT.match(text, e) if e >= done else None
        if m and sum(c.isdigit() for c in m[1]) >= 4:
            done = m.end(1)
            found.append((m.start(1), done))
    return found


def _urls(text: str, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found, done = [], 0
    for start, end in at:
        if start >= done and (m := URL.match(text, end)):
            done = end + len(m[0].rstrip(".,;:!?)"))
            if done > end:
                found.append((start, done))
    return found


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points by kind."""
    at, plus, digits, urls, cues = [], [], [], [], []
    last = -2
    # lower() may change the length of some letters; the anchors are ASCII, so only those are lowered
    lowered = text.lower() if text.isascii() else text.translate(_LOWER)
    for end, (kind, size) in automaton.iter(lowered):
        if kind == "digit":
            if end != last + 1:
                digits.append(end)
            last = end
        elif kind == "email":
            at.append(end)
        elif kind == "phone":
            plus.append(end)
        elif kind == "url":
            urls.append((end + 1 - size, end + 1))
        else:
            cues.append(end + 1)
    return {
        "email": _emails(text, at),
        "ip": _from_digits(text, digits, IP, _is_ip),
        "card": _from_digits(text, digits, CARD, _is_card),
        "phone": _phones(text, plus),
        "account": _accounts(text, cues),
        "url": _urls(text, urls),
    }


_LOWER = {i: i + 32 for i in range(65, 91)}


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = _automaton()
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            found = find(text, automaton)
            base = [f"{k}:{s}:{e}" for k in BASE for s, e in found[k]]
            every = base + [f"{k}:{s}:{e}" for k in ADDED for s, e in found[k]]
            out.append((doc_id, *[len(found[k]) for k in BASE + ADDED], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every)))
        yield pd.DataFrame(out, columns=["doc_id", *[f"n_{k}" for k in BASE + ADDED], "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id (as text), counts by kind, base_sha256 and spans (kind:start:end, by kind and start).

    Offsets are code points of the whole text, end exclusive. Null and empty texts have no
    spans; texts of any length are read whole, in time that grows with their length. Repeated
    rows repeat; an empty table gives no rows; other columns are not read.
    """
    counts = ", ".join(f"n_{k} long" for k in BASE + ADDED)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    return in_batches(rows).mapInPandas(_report, f"doc_id string, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span of text_col replaced by its kind in brackets; null stays null. All columns, repeated rows repeat."""

    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton()
        for texts in batches:
            yield texts.map(lambda t: t if t is None else masked(t, find(t, automaton)))

    return in_batches(docs).withColumn(text_col, F.pandas_udf(mask, "string")(F.col(text_col)))


def masked(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    out, done = [], 0
    for s, e, k in sorted((s, -e, k) for k, spans in found.items() for s, e in spans):
        if s >= done:
            out += [text[done:s], f"[{k}]"]
        done = max(done, -e)
    return "".join(out) + text[done:]
