"""Token ids in compact binary segments, written by an adaptive context-mixing range coder.

A segment holds whole documents in order: doc ids, token counts, the ids themselves, cut into
blocks that ``id_coder`` codes: each starts with a reset model, has its own checksum and can be
decoded alone (with the segment's header). Segments travel as a binary column, so any store
that Spark writes can hold them.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import in_batches, partitions, small, text_of, written
from quarry.llm.id_coder import BLOCK as BLOCK, decode, encode

MAGIC = b"QTS4"
#: About how many ids are in a segment. A document is never cut between segments.
SEGMENT = 1 << 22
#: Characters tokenized at once (a longer text alone), and pre-tokens whose ids are remembered.
CHARS, REMEMBERED = 200_000, 1_000_000
#: The letters and numbers among the characters whose pre-tokens are cut here; texts with others are left to the library whole.
LETTERS, NUMBERS = "A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", "0-9\u00B2\u00B3\u00B9\u00BC-\u00BE"
PLAIN = "\t\n\r\x20-\x7E\u00A1-\u024F\u2013\u2014\u2018-\u201D\u2026"
#: The pattern of byte-level pre-tokens that ``_starts`` follows, and what it cuts from an apostrophe on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Classes of characters: rare ones, letters, numbers, others, the space, other white space.
RARE, LETTER, NUMBER, OTHER, BLANK, WHITE = range(6)
CLASSES = np.full(0x2028, RARE, np.uint8)
for _c in range(len(CLASSES) - 1):
    if re.match(f"[{PLAIN}]", chr(_c)):
        CLASSES[_c] = LETTER if re.match(f"[{LETTERS}]", chr(_c)) else NUMBER if re.match(f"[{NUMBERS}]", chr(_c)) else BLANK if _c == 32 else WHITE if _c < 32 else OTHER
#: How a byte-level model spells bytes: visible ones as they are, the others, in order, from 256 on.
SPELT = np.arange(256, dtype="<u2")
_hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SPELT[_hidden] = 256 + np.arange(len(_hidden))
#: Slots for remembered pre-tokens at first; they double when half are taken.
SLOT_BITS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))
SEGMENT_SCHEMA = "part int, at long, n_tokens long, data binary"


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A segment. A null doc id is kept as such."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    body = b"".join([known.tobytes(), named.tobytes(), np.array(sizes, "<u8").tobytes(), encode(ids)])
    return MAGIC + struct.pack("<QQI", len(doc_ids), len(ids), zlib.crc32(body[: 17 * len(doc_ids)])) + body


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if raw[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, n_ids, crc = struct.unpack_from("<QQI", raw, 4)
    body = raw[24:]
    if zlib.crc32(body[: 17 * n]) != crc:
        raise ValueError("the document table does not match its checksum")
    known = np.frombuffer(body, np.uint8, n)
    named = np.frombuffer(body, "<i8", n, offset=n)
    sizes = np.frombuffer(body, "<u8", n, offset=9 * n).astype(np.int64)
    return [int(d) if k else None for d, k in zip(named, known, strict=True)], sizes, decode(body[17 * n :], n_ids)


def _starts(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts start; the texts lie one after the other and end at ``ends``."""
    n = len(code)
    kind = CLASSES.take(code)
    first = np.zeros(n + 1, bool)  # of a text
    first[0] = True
    first[ends] = True
    space = kind >= BLANK
    before = np.empty(n, np.uint8)
    before[0], before[1:] = RARE, kind[:-1]
    before[first[:n]] = RARE
    # the last white space before a word is cut off, and a blank there goes with the word
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start = np.where(space, (before < BLANK) | last, (before != kind) & (before != BLANK))
    marks = np.flatnonzero((code == 39) & start)
    if len(marks):
        text_end = ends[np.searchsorted(ends, marks, side="right")]
        padded = np.concatenate((code, np.zeros(2, code.dtype)))
        one, two = padded[marks + 1], padded[marks + 2]
        size = np.where(np.isin(one, [ord(c) for c in SHORT]), 2, 0)
        for a, b in LONG:
            size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
        size = np.where(marks + size <= text_end, size, 0)
        cut, size = marks[size > 0], size[size > 0]
        start[cut + 1] = False
        end = cut + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


class _Column:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            grown = np.empty(n + n // 4, self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : n] = values
        self.n = n


def _within(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    stops = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat(begins - stops + sizes, sizes)
    at += np.arange(len(at))
    return at


class Ids:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer cuts a text by its pattern and merges within each pre-token alone, so
    the library encodes each pre-token once and the ids are remembered, within bounds. Many
    texts are cut at once in numpy; pre-tokens are found by a hash and compared letter by letter
    with the one remembered. Texts with rare characters, with the name of an added
    token, or with a pre-token whose hash is another's go to the library whole.
    """

    def __init__(self, path: str):
        self.coder = Tokenizer.from_file(path)
        plan = json.loads(self.coder.to_str())
        first = plan["pre_tokenizer"] or {}
        same = public_tokenizers.PATTERN == PATTERN
        self.cuts = same and plan["normalizer"] is None and first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first.get("use_regex", True)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.up = self.down = np.empty(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        # of each pre-token its hash, its ids and letters and where they lie
        self.hashes, self.sizes, self.begins, self.lengths, self.spelt = map(_Column, (np.uint64, np.int32, np.uint32, np.int32, np.uint32))
        self.flat, self.letters = _Column(np.uint32), _Column(np.uint16)
        self._slots(SLOT_BITS)

    def _slots(self, bits: int) -> None:
        """Empty slots, into which all that is remembered is entered."""
        self.bits = bits
        self.slot_at = np.full(1 << bits, -1, np.int32)
        self._enter(self.hashes.data[: self.hashes.n], np.arange(self.hashes.n, dtype=np.int32))

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Give numbers a slot each: the one their hash names, or the next that is free."""
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slots):
            free = self.slot_at[slots] < 0
            self.slot_at[slots[free]] = numbers[free]
            won = self.slot_at[slots] == numbers
            slots, numbers = (slots[~won] + 1) & ((1 << self.bits) - 1), numbers[~won]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not remembered."""
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.slot_at.take(slots)
        other = np.flatnonzero((self.hashes.data.take(at, mode="clip") != hashes) & (at >= 0))
        slots = slots[other]
        while len(other):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            at[other] = self.slot_at.take(slots)
            on = (self.hashes.data.take(at[other], mode="clip") != hashes[other]) & (at[other] >= 0)
            other, slots = other[on], slots[on]
        return at

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Ids of words of letters, which are pre-tokens as they are: the library's model merges each."""
        lines = code.take(_within(begins, lengths + 1), mode="clip")
        lines[np.cumsum(lengths + 1) - 1] = 10
        spelt = SPELT.take(np.frombuffer(lines.tobytes().decode("utf-32-le").encode(), np.uint8)).tobytes().decode("utf-16-le")
        merged = self.coder.model.tokenize
        return [[t.id for t in merged(w)] for w in spelt.split(chr(SPELT[10]))[:-1]]

    def _learn(self, hashes: np.ndarray, code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the pre-tokens at these places of a text."""
        words = (CLASSES.take(code[begins + lengths - 1]) == LETTER) & (code[begins] != 39)
        order = np.argsort(~words, kind="stable")
        hashes, begins, lengths, n = hashes[order], begins[order], lengths[order], np.count_nonzero(words)
        read = self._alone(code, begins[:n], lengths[:n])
        read += self.whole([code[b:e].tobytes().decode("utf-32-le") for b, e in zip(begins[n:].tolist(), (begins + lengths)[n:].tolist(), strict=True)])
        sizes = np.fromiter(map(len, read), np.int64, len(read))
        numbers = np.arange(self.sizes.n, self.sizes.n + len(hashes), dtype=np.int32)
        self.begins.add(self.flat.n + np.cumsum(sizes) - sizes)
        self.spelt.add(self.letters.n + np.cumsum(lengths) - lengths)
        self.flat.add(np.fromiter(chain.from_iterable(read), np.uint32, int(sizes.sum())))
        self.letters.add(code[_within(begins, lengths)])
        self.hashes.add(hashes)
        self.sizes.add(sizes)
        self.lengths.add(lengths)
        if 2 * self.sizes.n > 1 << self.bits:
            self._slots((2 * self.sizes.n).bit_length())
        else:
            self._enter(hashes, numbers)

    def _numbers(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each pre-token; those met first are learned."""
        if len(self.up) <= len(code):
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(code), b, np.uint64)))) for b in (BASE, UNBASE))
        running = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * self.up[: len(code)], out=running[1:])
        hashes = (running[starts + lengths] - running[starts]) * self.down[starts]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        at = self._find(hashes)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            met, first = np.unique(hashes[missed], return_index=True)
            self._learn(met, code, starts[missed[first]], lengths[missed[first]])
            at[missed] = self._find(hashes[missed])
        return at

    def _of_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, where each text's end, and which texts met a foreign hash."""
        text = "".join(texts)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(code):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        if self.sizes.n > REMEMBERED:
            self._forget()
        starts = _starts(code, ends)
        lengths = np.diff(starts, append=len(code))
        at = self._numbers(code, starts, lengths)
        wrong = np.zeros(len(texts), bool)
        differs = self.lengths.data.take(at) != lengths
        spelt = np.repeat(self.spelt.data.take(at).astype(np.int64) - starts, lengths)
        spelt += np.arange(len(code))
        odd = np.flatnonzero(self.letters.data.take(spelt, mode="clip") != code)
        if len(odd) or differs.any():
            wrong[np.searchsorted(ends, np.concatenate((odd, starts[differs])), side="right")] = True
        sizes = self.sizes.data.take(at)
        place = _within(self.begins.data.take(at), sizes)
        bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))[np.searchsorted(starts, ends, side="left")]
        return self.flat.data.take(place), bounds, wrong

    def of(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0

        def settle() -> None:
            ids, bounds, wrong = self._of_plain([texts[i] for i in held])
            for i, begin, end, bad in zip(held, np.concatenate((np.zeros(1, np.int64), bounds))[:-1].tolist(), bounds.tolist(), wrong.tolist(), strict=True):
                if not bad:
                    out[i] = ids[begin:end]

        for i, t in enumerate(texts):
            if self.cuts and _plain(t) and not any(a in t for a in self.added):
                held.append(i)
                size += len(t)
                if size >= CHARS:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return out


_plain = re.compile(f"[{PLAIN}]*").fullmatch


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a few million characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 16 * CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


@functools.lru_cache(1)
def _ids(tokenizer: str) -> Ids:
    """Kept by a worker from task to task, with what it remembers."""
    return Ids(tokenizer)


def _write(tokenizer: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = _ids(tokenizer)
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        part, at, held = None, 0, 0
        end = np.array([end_id], np.uint32)

        def segment() -> pd.DataFrame:
            data = pack(docs, sizes, np.concatenate(parts).view(np.int32))
            return pd.DataFrame({"part": [part], "at": [at], "n_tokens": [held], "data": [data]})

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            texts, named = batch["text"].to_list(), batch["doc_id"].to_list()
            for i, j in _slices(texts):
                for doc_id, ids in zip(named[i:j], ids_of.of(texts[i:j]), strict=True):
                    docs.append(None if doc_id is None else int(doc_id))
                    parts += [ids, end]
                    sizes.append(len(ids) + 1)
                    held += sizes[-1]
                    if held >= SEGMENT:
                        yield segment()
                        docs, parts, sizes, at, held = [], [], [], at + held, 0
        if docs:
            yield segment()

    return run


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenize all rows in ascending order of id (nulls first) and write them as segments.

    Returns the written segments (part, at, n_tokens, data): parts follow one another in the
    order, ``at`` counts the ids before the segment in its part. Null text is empty text and
    gives the end id alone; repeated rows repeat; an empty table gives no segments; texts of any
    length are tokenized whole; rows of equal id follow one another in any order; other columns
    are not kept.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first())
    rows = rows.select(F.spark_partition_id().alias("part"), F.col("__id").cast("string").alias("doc_id"), "text")
    return written(in_batches(rows).mapInPandas(_write(tokenizer, end_id), SEGMENT_SCHEMA), "tokens")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, at, raw in zip(batch["part"], batch["at"], batch["data"], strict=True):
            doc_ids, sizes, ids = unpack(raw)
            ends = np.cumsum(sizes)
            plain = ids.astype("<u4")
            crc = [zlib.crc32(plain[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
            yield pd.DataFrame({"part": part, "doc_id": [None if d is None else str(d) for d in doc_ids], "begin": at + ends - sizes, "n_tokens": sizes, "ids_crc32": crc})


def read_index(segments: DataFrame) -> DataFrame:
    """Decode segments, checking every checksum: (doc_id, start, n_tokens, ids_crc32) per document.

    Null ids and repeated rows come back as they were written; no segments give no rows.
    """
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per part, not per document
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(totals.select("part", F.coalesce(before, F.lit(0)).alias("offset")), "token-offsets")
    docs = in_batches(segments).mapInPandas(_read, "part int, doc_id string, begin long, n_tokens long, ids_crc32 long")
    start = (F.col("begin") + F.col("offset")).alias("start")
    return docs.join(small(offsets), "part").select(F.col("doc_id").cast("long").alias("doc_id"), start, "n_tokens", "ids_crc32")


def read_ids(segments: DataFrame) -> DataFrame:
    """Decode segments: (doc_id, ids) per document, the end id included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["data"]:
                doc_ids, sizes, ids = unpack(raw)
                for i, (d, part) in enumerate(zip(doc_ids, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)):
                    yield pd.DataFrame({"doc_id": [None if d is None else str(d)], "ids": [part]}, index=[i])

    return segments.mapInPandas(run, "doc_id string, ids array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))
