"""Line dedup: overlapping documents meet through shared rare line hashes, are aligned with
patience diff, and aligned common blocks are deleted from the later document.

Words are runs of bytes that are no ASCII white space; white space between them doesn't count. A line ends
at a line break, behind a sentence end, and behind words chosen by their hash (one of ``CUT``), so
that a passage pasted into a paragraph is cut in the same places wherever it stands.

A document is looked up by windows: from every line, the run of lines that reaches
``min_block_words`` words. A window that an earlier document has leads to the earliest such document
(one pair for each document and window, however common the window is). The lines of a pair are aligned,
and every run of lines that reaches ``min_block_words`` is a block; it is extended word by word into the
lines beside it, all words compared by 64-bit hashes, and deleted from the later document. So of a run
of whole lines that some earlier document has, every window of ``min_block_words`` words goes; what can
stay is less than a window at its end, where all holders of its windows go on differently. The
earliest holder of a window always keeps it.

Defined results of odd inputs: null and empty texts stay as they are; rows with a null id are
returned unchanged; rows that repeat an id count as versions of one document and aren't
compared with each other; an empty table gives an empty result; other columns pass through,
and only one named like ``cut_col`` is replaced by the operator's own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship, trimmed

CUT = 8  # a line ends behind a word whose hash is a multiple of CUT
FEW = 1_000_000  # ids at most that are broadcast as a filter
SALT = 2_000  # later documents that one group aligns with an earlier one
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?"))
_CLOSER = np.isin(np.arange(256), list(b"\"')]}"))


POWERS = 1 << 18  # powers kept; a part of a batch has fewer bytes, but where one text is larger
_powers = {int(x): np.ones(1, np.uint64) for x in (_MULT, _BACK)}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The first n of 1, base, base squared and so on, modulo 2**64; kept for the next call."""
    known = _powers[int(base)]
    if len(known) < n:
        known = np.full(max(n, POWERS), base)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[int(base)] = known[:POWERS].copy()
    return known[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values weighed by powers, and the inverse powers: the hash of positions
    a..b-1 is (sums[b] - sums[a]) * inverse[a], wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_MULT, len(values)), out=sums[1:])
    return sums, _power(_BACK, len(values) + 1)


@dataclass
class Lines:
    """Words and lines of several texts, one behind the other."""

    word: np.ndarray  # hash of each word
    begin: np.ndarray  # first byte of each word, from the beginning of its own text
    end: np.ndarray
    words_at: np.ndarray  # first word of each text, and the number of all words
    first: np.ndarray  # first word of each line, and the number of all words
    key: np.ndarray  # 64-bit hash of each line
    lines_at: np.ndarray  # first line of each text, and the number of all lines

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Lines:
        """``data``: bytes of the texts; ``offsets``: where each begins, and the end."""
        offsets = offsets.astype(np.int64) - int(offsets[0])
        white = _WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(~white & (np.r_[True, white[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(~white & (np.r_[white[1:], True] | edge[1:])) + 1 if len(data) else begins
        text = np.searchsorted(offsets, begins, "right") - 1
        sums, inverse = _sums(_BYTE[data])
        word = _mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
        n = len(word)
        cut = word % np.uint64(CUT) == 0
        last = data[ends - 1] if n else np.zeros(0, np.uint8)
        before = data[np.maximum(ends - 2, begins)] if n else last
        cut |= _STOP[last] | (_CLOSER[last] & _STOP[before])
        if n:
            breaks = np.flatnonzero(data == 10)
            behind = np.searchsorted(ends, breaks, "right") - 1  # the word before each line break
            cut[behind[behind >= 0]] = True
            cut[:-1] |= text[1:] != text[:-1]
            cut[-1] = True
        first = np.r_[0, np.flatnonzero(cut) + 1] if n else np.zeros(1, np.int64)
        sums, inverse = _sums(word)
        key = _mix((sums[first[1:]] - sums[first[:-1]]) * inverse[first[:-1]])
        each = np.arange(len(offsets))
        return Lines(word, begins - offsets[text], ends - offsets[text], np.searchsorted(text, each), first, key, np.searchsorted(text[first[:-1]], each))

    @staticmethod
    def of_texts(texts: pa.Array) -> Lines:
        texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        return Lines.of(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at)

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the shortest run of lines from each line that has ``min_words`` words."""
        stop = np.searchsorted(self.first, self.first[:-1] + min_words)
        text = np.repeat(np.arange(len(self.lines_at) - 1), np.diff(self.lines_at))
        fits = stop <= self.lines_at[1:][text]
        at, stop = np.flatnonzero(fits), stop[fits]
        sums, inverse = _sums(self.word)
        a, b = self.first[at], self.first[stop]
        return text[at], _mix((sums[b] - sums[a]) * inverse[a] + np.uint64(0x6C696E65)).view(np.int64)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose second members rise."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pos = bisect_left(tails, b)
        if pos == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[pos], at[pos] = b, k
        back[k] = at[pos - 1] if pos else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], both rising: common ends first, then lines
    unique in both parts, then (where there are none) the rarest common line."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        common = [x for x in in_a if x in in_b]
        if not common:
            continue
        once = {x for x in common if in_a[x] == 1 and in_b[x] == 1}
        if not once:
            once = {min(common, key=lambda x: (in_a[x] * in_b[x], x))}
        first_b: dict[int, int] = {}
        for j in range(b0, b1):
            if b[j] in once:
                first_b.setdefault(b[j], j)
        pairs, seen = [], set()
        for i in range(a0, a1):
            if a[i] in once and a[i] not in seen:
                seen.add(a[i])
                pairs.append((i, first_b[a[i]]))
        i0, j0 = a0, b0
        for i, j in _rising(pairs):
            out.append((i, j))
            stack.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        stack.append((i0, a1, j0, b1))
    return sorted(out)


def _longest_runs(a: list[int], b: list[int], words: list[int], at_a: list[int], at_b: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """Runs (first line in a, first in b, lines) that both have, of ``min_words`` words at least, by
    diagonals: no alignment is chosen, so none hides a run. ``at_a`` and ``at_b`` are the lines'
    places, ``words`` the sizes of b's."""
    at: dict[int, list[int]] = {}
    for x, place in zip(a, at_a, strict=True):
        at.setdefault(x, []).append(place)
    found: list[tuple[int, int, int]] = []
    before: dict[int, tuple[int, int]] = {}  # last line in a -> (first line in b, words) of the run so far
    last = -2
    for x, n, j in [*zip(b, words, at_b, strict=True), (None, 0, -1)]:
        now: dict[int, tuple[int, int]] = {}
        for i in at.get(x, ()):
            first, total = before.pop(i - 1, (j, 0)) if j == last + 1 else (j, 0)
            now[i] = (first, total + n)
        found += [(i - (last - first), first, last + 1 - first) for i, (first, total) in before.items() if total >= min_words]
        before, last = now, j
    return found


def common_blocks(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """Blocks (first line in a, first line in b, lines) of the lines ``b`` (``sizes``: words of
    each) that ``a`` has too. Aligns again without the lines found, until nothing is found: blocks
    in another order, and second copies of a block, are found too. What is left is searched by
    diagonals, as an alignment of many short lines can stand in the way of a longer block."""
    if len(a) == len(b) and (a == b).all():
        return [(0, 0, len(b))] if sizes.sum() >= min_words else []
    # Lines that only one side has are in no block: what is aligned are the others' places.
    a, b, size = a.tolist(), b.tolist(), sizes.tolist()
    there = set(a).intersection(b)
    at_a, at_b = [i for i, x in enumerate(a) if x in there], [j for j, x in enumerate(b) if x in there]
    a, b, words = [a[i] for i in at_a], [b[j] for j in at_b], [size[j] for j in at_b]
    out: list[tuple[int, int, int]] = []
    while sum([n for x, n in zip(b, words, strict=True) if x in there]) >= min_words:
        found: list[tuple[int, int, int]] = []
        first, last, total = (0, 0), (-2, -2), 0
        for i, j in [*patience(a, b), (-1, -1)]:
            x, y = (at_a[i], at_b[j]) if i >= 0 else (-1, -1)
            if (x, y) != (last[0] + 1, last[1] + 1):
                if total >= min_words:
                    found.append((*first, last[1] + 1 - first[1]))
                first, total = (x, y), 0
            last = (x, y)
            total += words[j] if j >= 0 else 0
        if not found:
            found = _longest_runs(a, b, words, at_a, at_b, min_words)
        if not found:
            break
        out += found
        gone = {y + k for _, y, n in found for k in range(n)}
        b = [-1 - k if at_b[k] in gone else x for k, x in enumerate(b)]  # no key is below zero
    return out


def shared_ranges(earlier: Lines, later: Lines, e: int, k: int, min_words: int) -> list[int]:
    """Ranges of words of text k of ``later`` (first, end, first, end ...) that lie in blocks shared
    with text e of ``earlier``, extended word by word."""
    a0, a1, b0, b1 = earlier.lines_at[e], earlier.lines_at[e + 1], later.lines_at[k], later.lines_at[k + 1]
    out: list[int] = []
    sizes = np.diff(later.first[b0 : b1 + 1])
    aw0, aw1, bw0, bw1 = earlier.words_at[e], earlier.words_at[e + 1], later.words_at[k], later.words_at[k + 1]
    for i, j, n in common_blocks(earlier.key[a0:a1], later.key[b0:b1], sizes, min_words):
        x, y, z = int(earlier.first[a0 + i]), int(later.first[b0 + j]), int(later.first[b0 + j + n])
        if not np.array_equal(earlier.word[x : x + z - y], later.word[y:z]):
            continue  # equal hashes of unequal lines
        end = x + z - y
        while x > aw0 and y > bw0 and earlier.word[x - 1] == later.word[y - 1]:
            x, y = x - 1, y - 1
        while end < aw1 and z < bw1 and earlier.word[end] == later.word[z]:
            end, z = end + 1, z + 1
        out += [y - int(bw0), z - int(bw0)]
    return out


def _parts(texts: pa.Array, most: int = 128, size: int = POWERS - 1) -> Iterator[tuple[int, int]]:
    """(first, rows) of parts of a column: ``most`` texts and ``size`` bytes, or one text."""
    n = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < len(texts):
        rows = max(1, min(most, int(np.searchsorted(n, n[at] + size, "right")) - 1 - at, len(texts) - at))
        yield at, rows
        at += rows


def _windows(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in _parts(b.column(1)):
                part = b.slice(at, rows)
                text, h = Lines.of_texts(part.column(1)).windows(min_words)
                by = np.lexsort((h, text))
                text, h = text[by], h[by]
                once = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
                ends = np.searchsorted(text[once], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[once]))], names=["doc_id", "w"])

    return run


def _aligner(min_words: int):  # noqa: ANN202
    """Rows (e_id, doc_id, tk, text) come by e_id: first the versions of the earlier document, without
    doc_id, then the later ones."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple[Lines, int]] = []
        fresh = False
        for b in batches:
            for at, size in _parts(b.column(3)):
                part = b.slice(at, size)
                head = part.column(1).is_null().to_numpy(zero_copy_only=False)
                lines = Lines.of_texts(part.column(3))
                rows, cuts = [], []
                for k in range(part.num_rows):
                    if head[k]:
                        heads = heads if fresh else []
                        heads.append((lines, k))
                        fresh = True
                        continue
                    fresh = False
                    cut = [x for h, e in heads for x in shared_ranges(h, lines, e, k, min_words)]
                    if cut:
                        rows.append(k)
                        cuts.append(cut)
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(rows, pa.int64())), part.column(2).take(pa.array(rows, pa.int64())), pa.array(cuts, pa.list_(pa.int32()))], names=["doc_id", "tk", "cut"])

    return align


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("lines", T.IntegerType()).add("chars", T.IntegerType()))
def _delete(texts, cuts):  # noqa: ANN001, ANN202
    import pandas as pd

    out: list[tuple] = [(None, 0, 0)] * len(texts)
    hits = [k for k, (text, cut) in enumerate(zip(texts, cuts, strict=True)) if text is not None and cut is not None]
    cut_texts = pa.array([texts.iloc[k] for k in hits], pa.large_string())
    for at, rows in _parts(cut_texts):
        lines = Lines.of_texts(cut_texts.slice(at, rows))
        for j, k in enumerate(hits[at : at + rows]):
            out[k] = _without(texts.iloc[k], cuts.iloc[k], lines, j)
    return pd.DataFrame(out, columns=["text", "lines", "chars"])


def _without(text: str, cut: np.ndarray, lines: Lines, j: int) -> tuple[str, int, int]:
    """Text j without the ranges of words ``cut``, whole lines and characters deleted."""
    w0, w1, l0, l1 = lines.words_at[j], lines.words_at[j + 1], lines.lines_at[j], lines.lines_at[j + 1]
    begin, first, n = lines.begin[w0:w1], lines.first[l0 : l1 + 1] - w0, int(w1 - w0)
    flips = np.zeros(n + 1, np.int64)
    np.add.at(flips, cut[0::2], 1)
    np.add.at(flips, cut[1::2], -1)
    gone = np.cumsum(flips)[:n] > 0
    raw, kept, start = text.encode(), [], 0
    ups = np.flatnonzero(gone & ~np.r_[False, gone[:-1]])
    downs = np.flatnonzero(gone & ~np.r_[gone[1:], False])
    for a, z in zip(ups.tolist(), downs.tolist(), strict=True):
        # With a block goes the white space behind it, up to the next word or the end.
        kept.append(raw[start : begin[a]])
        start = int(begin[z + 1]) if z + 1 < n else len(raw)
    rest = (b"".join(kept) + raw[start:]).decode()
    whole = np.add.reduceat(gone, first[:-1]) == np.diff(first) if n else np.zeros(0, bool)
    return rest, int(whole.sum()), len(text) - len(rest)


def _free(prefix: str, columns: list[str]) -> str:
    """A name that no column has, in any case."""
    return prefix + "_" * max([0, *map(len, columns)])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_block_words: int = 16, cut_col: str = "line_cut") -> DataFrame:
    """``docs`` with shared blocks deleted from the later document (by id), and the column
    ``cut_col`` struct(lines, chars): whole lines and characters deleted. All rows stay; texts may
    become empty."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    kind = dict(docs.dtypes)[id_col]
    text = F.col(f"`{text_col}`")
    keyed = docs.where(F.col(f"`{id_col}`").isNotNull() & text.isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    windows = scratch.keep(keyed.select("doc_id", "text").mapInArrow(trimmed(_windows(min_block_words)), f"doc_id {kind}, w array<bigint>"), "windows")
    anchors = windows.select("doc_id", F.explode("w").alias("x"))
    shared = anchors.groupBy("x").agg(F.min("doc_id").alias("e_id"), F.max("doc_id").alias("last_id")).where("e_id < last_id").select("x", "e_id")
    # The joins are merge joins at every size: both sides grow with the corpus, and AQE splits
    # the partitions of a hot window or a hot earlier document.
    pairs = anchors.join(scratch.keep(shared, "shared").hint("merge"), "x").where("doc_id > e_id").select("doc_id", "e_id").distinct()
    pairs = scratch.keep(pairs, "pairs")
    salts = scratch.keep(pairs.groupBy("e_id").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("s")), "salts")
    met = scratch.keep(pairs.select("doc_id").distinct(), "met")
    scratch.drop("windows")
    scratch.drop("shared")

    def of(ids: DataFrame, name: str) -> DataFrame:
        """Texts of the documents in ``ids``, a filter that is broadcast while it is small."""
        ids = ids.select(F.col(name).alias("doc_id"))
        return keyed.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), "doc_id", "left_semi")

    later = pairs.join(salts, "e_id").select("doc_id", "e_id", F.pmod(F.xxhash64("doc_id"), F.col("s")).cast("int").alias("salt"))
    later = later.hint("merge").join(of(met, "doc_id"), "doc_id").select("e_id", "salt", "doc_id", "tk", "text")
    heads = of(salts, "e_id").join(salts, F.col("doc_id") == F.col("e_id")).select("e_id", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.lit(None).cast(kind).alias("doc_id"), "tk", "text")
    dealt = heads.unionByName(later).repartition("e_id", "salt").sortWithinPartitions("e_id", "salt", F.col("doc_id").asc_nulls_first(), "tk")
    cuts = dealt.select("e_id", "doc_id", "tk", "text").mapInArrow(trimmed(_aligner(min_block_words)), f"doc_id {kind}, tk bigint, cut array<int>")
    cuts = cuts.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    i, k, c, d = (_free(x, [*docs.columns, cut_col]) for x in ("i", "k", "c", "d"))
    cuts = scratch.keep(cuts, "cuts").select(F.col("doc_id").alias(i), F.col("tk").alias(k), F.col("cut").alias(c))
    joined = docs.alias("d").join(cuts.hint("merge"), (F.col(f"d.`{id_col}`") == F.col(i)) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col(k)), "left")
    hit = F.col(c).isNotNull()
    joined = joined.withColumn(d, _delete(F.when(hit, F.col(f"d.`{text_col}`")), F.col(c)))
    keep = [F.when(hit, F.col(f"{d}.text")).otherwise(F.col(f"d.`{x}`")).alias(x) if x == text_col else F.col(f"d.`{x}`") for x in docs.columns if x != cut_col]
    cut = F.struct(F.coalesce(F.col(f"{d}.lines"), F.lit(0)).alias("lines"), F.coalesce(F.col(f"{d}.chars"), F.lit(0)).alias("chars"))
    return joined.select(*keep, cut.alias(cut_col))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", F.col("line_cut.lines").alias("lines_cut"), F.col("line_cut.chars").alias("chars_cut"))
