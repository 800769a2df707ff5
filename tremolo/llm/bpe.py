"""Byte-level BPE over a contiguous rank array, and its decoder.

A short word is held as two flat lists: the boundaries of its parts, and for each pair of
neighbours the rank of their merge. The least rank is looked for again and again; its boundary
is deleted, and the ranks left and right of it are looked up anew. Words of over ``LONG_WORD``
bytes go through a heap with the same order of merges (least rank, then leftmost).

Defined results of odd inputs: a null text counts as empty; an empty text has no tokens; texts
of any length are encoded whole; strings of added tokens inside a text are those tokens, as in
the tokenizer file; null ids and repeated rows are returned like others; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, trimmed

LONG_WORD = 256
CACHE = 1 << 17  # words kept by a worker in a table, before it becomes the old one; a word kept is up to CACHE_CHARS long
CACHE_CHARS = 64
# Fixed value: the split pattern of the byte-level pre-tokenizer, white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60
_WIDE = re.compile(r" \s|\s ").search  # white space beside a space; \s holds all of White_Space


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: bytes that
    print stand for themselves, the others follow from code point 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes with a tokenizer file of the kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        raw = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: b"".join(raw[c] for c in s) for s, i in vocab.items()}
        self.byte_id = [vocab[s] for s in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.added_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(PATTERN).findall
        self.edge = regex.compile(r"\p{White_Space}").match
        self.kept: dict[str, bytes] = {}
        self.kept_words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the tables before these, for words that are met again
        self.old_words: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word, by the contiguous rank array."""
        if len(word) > LONG_WORD:
            return self.merge_long(word)
        ids = [self.byte_id[b] for b in word]
        merges = self.merges
        none = (NEVER, 0)
        pair = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while pair:
            best = min(pair)
            if best[0] == NEVER:
                break
            k = pair.index(best)
            ids[k] = best[1]
            del ids[k + 1], pair[k]
            if k:
                pair[k - 1] = merges.get((ids[k - 1], ids[k]), none)
            if k < len(pair):
                pair[k] = merges.get((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """As ``merge``, for words in which a scan for each merge would cost too much."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = right[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for i in (left[k], k):
                if i >= 0 and right[i] >= 0 and (m := self.merges.get((ids[i], ids[right[i]]))):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[right[i]], m[1]))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        out = self.kept_words.get(word)
        if out is None:
            out = self.old_words.get(word)
            if out is None:
                out = np.array(self.merge(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            if len(word) <= CACHE_CHARS:
                if len(self.kept_words) >= CACHE:
                    self.old_words, self.kept_words = self.kept_words, {}
                self.kept_words[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of a stretch that neither begins nor ends inside a pre-token."""
        out = self.kept.get(piece)
        if out is None:
            out = self.old.get(piece)
            if out is None:
                out = b"".join(map(self._word, self.split(piece)))
            if len(piece) <= CACHE_CHARS:
                if len(self.kept) >= CACHE:
                    self.old, self.kept = self.kept, {}
                self.kept[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        # A single space between two characters that aren't white space always begins a new
        # pre-token with the word behind it, so such words can be looked up one by one.
        parts = text.split(" ")
        if parts[0] and parts[-1] and not _WIDE(text):
            get, piece = self.kept.get, self._piece
            return piece(parts[0]) + b"".join([get(w) or piece(w) for w in [" " + p for p in parts[1:]]])
        get, white = self.kept.get, self.edge
        out: list[bytes] = []
        hold = parts[0]
        for k in range(1, len(parts)):
            part = parts[k]
            if part and hold:
                e, s = hold[-1], part[0]
                if (e > " " and s > " " and e < "\x80" and s < "\x80") or not (white(e) or white(s)):
                    out.append(get(hold) or self._piece(hold))
                    hold = " " + part
                    continue
            hold += " " + part
        out.append(self._piece(hold))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added_split is None or not any(s in text for s in self.added):
            return self._plain(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._plain(p) for p in self.added_split.split(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file; its word cache lasts as long as the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256): every whole text encoded
    and decoded again from its ids. ``path``: tokenizer file, present on every machine.
    ``ids=False`` leaves the arrays out."""
    ship(docs.sparkSession)
    where = path or default_path()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                coded = [c.encode(t) for t in texts[at : at + 256]]
                columns = [b.column(0)[at : at + 256]]
                if ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))))
                columns += [
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(c.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in coded]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", *["ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = f"doc_id {kind}, " + "ids array<int>, " * ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, ids=False)
