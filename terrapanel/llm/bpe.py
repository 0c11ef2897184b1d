"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the text's bytes cuts each document into chunks at places that
depend on the bytes around them only, so that passages shared by documents give
equal chunks. Each chunk is encoded once and kept in a bounded table of the
Python worker. A cut may fall inside what the merges would join, so the ids at
each joint are repaired: the text between the last sure boundary before the cut
and the first after it is encoded again, and the region grows until its ends
fall on token boundaries of the chunks on both sides. A sure boundary is a place
between a character other than white space and a blank that another such
character follows, in any script: the vocabulary's pattern never joins these.

Ids are those of the tokenizers library for the same vocabulary file; strings of
special tokens in a text get the special id. Documents keep no state between
them but the table.

Defined cases: null and empty texts have no ids; long texts are cut like any,
and long runs of white space go to the merges by themselves, as the pattern's
search can't take them; repeated rows are each encoded (from the table); a null
doc_id stays null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy, worker_cache

VOCABULARY = "byte_bpe_50k"
#: A chunk ends where the rolling hash of the last WINDOW bytes has MASK's bits zero: 2 KB on average.
WINDOW, MASK = 16, 0x7FF
#: Runs of so much white space are parted from the text before the pattern sees it.
LONG_RUN = 1000
#: The pattern's white space: Unicode's property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{BLANKS}]{{{LONG_RUN},}}")
_BLANK = re.compile(f"[{BLANKS}]")
#: Chunks that a worker remembers; beyond, the oldest half goes.
REMEMBERED = 16_000


def vocabulary_file(suffix: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY + suffix)


class Coder:
    """Encodes whole texts for one vocabulary; one for each Python worker."""

    def __init__(self) -> None:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary_file(".tiktoken"), "rb"))}
        self.plain = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t["content"]: t["id"] for t in json.load(open(vocabulary_file(".json")))["added_tokens"]}
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for piece, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = piece
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.chunks: dict[bytes, np.ndarray] = {}
        self.asked = self.made = 0  # chunks looked up, and those not in the table

    def direct(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens, in one go.

        A long run of white space is one piece of the pattern, but for its last
        character where text follows, which may belong to the next piece.
        """
        out, at = [], 0
        for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            out += [self._short(text[at : run.start()]), np.array(self.plain._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32)]
            at = end
        out.append(self._short(text[at:]))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _short(self, text: str) -> np.ndarray:
        return np.frombuffer(self.plain._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32) if text else np.zeros(0, np.uint32)

    def chunk(self, data: bytes) -> np.ndarray:
        ids = self.chunks.get(data)
        self.asked += 1
        if ids is None:
            self.made += 1
            ids = self.direct(data.decode())
            if len(self.chunks) >= REMEMBERED:
                for k in list(self.chunks)[: REMEMBERED // 2]:
                    del self.chunks[k]
            self.chunks[data] = ids
        return ids

    def pieces(self, text: str):
        """(text, special id or -1) parts of a text."""
        found = [s for s in self.special if s in text]
        if not found:
            yield text, -1
            return
        s = found[0]
        for k, part in enumerate(text.split(s)):
            if k:
                yield "", self.special[s]
            yield from self.pieces(part)

    def encode(self, text: str | None, by_chunks: bool = True) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        parts = [np.array([i], np.uint32) if i >= 0 else self._by_chunks(part) if by_chunks else self.direct(part) for part, i in self.pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _by_chunks(self, text: str) -> np.ndarray:
        data = text.encode()
        cuts = chunk_cuts(data)
        if not cuts:
            return self.chunk(data) if data else np.zeros(0, np.uint32)
        edges = [0, *cuts, len(data)]
        # each id's end in bytes, over all chunks; joints are replaced below
        coded = [self.chunk(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        ids = np.concatenate(coded)
        ends = np.cumsum(self.length_of[ids])
        out, done = [], 0  # done: bytes of data whose ids are in out
        for cut in cuts:
            if cut < done:
                continue
            lo, hi = max(sure_before(data, cut), done), sure_after(data, cut)
            while lo > done and not _ends_at(ends, lo):
                lo = max(sure_before(data, lo), done)
            while hi < len(data) and not _ends_at(ends, hi):
                hi = sure_after(data, hi)
            if lo > done:
                out.append(ids[_first(ends, done) : _first(ends, lo)])
            out.append(self.direct(data[lo:hi].decode()))
            done = hi
        if done < len(data):
            out.append(ids[_first(ends, done) :])
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _ends_at(ends: np.ndarray, place: int) -> bool:
    """Whether an id ends at this byte."""
    i = int(np.searchsorted(ends, place, "left"))
    return i < len(ends) and ends[i] == place


def _first(ends: np.ndarray, place: int) -> int:
    """Index of the first id that begins at this byte or later."""
    return int(np.searchsorted(ends, place, "left")) + 1 if place else 0


def chunk_cuts(data: bytes) -> list[int]:
    """Byte places where chunks begin (but the first), at characters' first bytes only."""
    if len(data) <= WINDOW:
        return []
    b = np.frombuffer(data, np.uint8)
    h = b.astype(np.uint32)
    width = 1
    while width < WINDOW:  # the hash of 2 * width bytes from two of width bytes
        h = h[: len(h) - width] * np.uint32(pow(0x01000193, width, 1 << 32)) + h[width:]
        width *= 2
    h ^= h >> np.uint32(15)
    cuts = np.flatnonzero((h & np.uint32(MASK)) == 0) + WINDOW
    cuts = cuts[cuts < len(data)]
    return cuts[(b[cuts] & 0xC0) != 0x80].tolist()


def _sure(data: bytes, i: int) -> bool:
    """A blank at i between two characters other than white space."""
    if data[i] != 32:
        return False
    a, b = i - 1, i + 2
    while a > 0 and data[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(data) and data[b] & 0xC0 == 0x80:
        b += 1
    return not (_BLANK.match(data[a:i].decode()) or _BLANK.match(data[i + 1 : b].decode()))


def sure_before(data: bytes, cut: int) -> int:
    """The last sure boundary before cut, else 0."""
    i = data.rfind(b" ", 0, cut)
    while i > 0:
        if i + 1 < len(data) and _sure(data, i):
            return i
        run = len(data[max(0, i - LONG_RUN) : i + 1].rstrip(b" "))  # over a run of blanks in few steps
        i = data.rfind(b" ", 0, max(0, i - LONG_RUN) + run) if run else i - LONG_RUN
    return 0


def sure_after(data: bytes, cut: int) -> int:
    """The first sure boundary after cut, else the end."""
    i = data.find(b" ", cut + 1)
    while 0 <= i < len(data) - 1:
        if _sure(data, i):
            return i
        more = data[i : i + LONG_RUN]
        i = data.find(b" ", i + max(1, len(more) - len(more.lstrip(b" "))))
    return len(data)


def coder() -> Coder:
    cache = worker_cache()
    if "coder" not in cache:
        cache["coder"] = Coder()
    return cache["coder"]


def with_ids(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ids (array of int) and the decoded text: the operator's general form."""

    @tidy
    def run(batches):
        c = coder()
        for batch in batches:
            ids = [c.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, from the same encoder and decoder."""

    @tidy
    def run(batches):
        c = coder()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                ids = c.encode(t.as_py())
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
