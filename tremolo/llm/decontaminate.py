"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names and units are replaced with typed placeholders,
other words are lower-cased without the punctuation around them. Windows of ``width`` template
tokens of the benchmark are hashed and joined with those of the documents; where windows of an
item meet a document, the values behind the placeholders must map consistently from item to
document (one value to one value), which catches re-parameterised copies and leaves texts that
only share a frame.

A window made of placeholders but for fewer than ``min_literals`` words is hashed with its values:
such a window counts where the values are the same. An item is found where the windows that meet
cover ``min_coverage`` of its tokens, or ``min_run`` tokens in one stretch, with slots that agree.

A name is a capitalised word that doesn't start a sentence; neighbours in one name are one
placeholder. (In languages that capitalise nouns, nouns are placeholders too.) Items shorter than a
window are looked up as a whole, with their first word as a word and as a name.

The join is a hash join of two tables. Before it, a document's windows are thinned by a bitmap of
the benchmark's hashes, which has ``BITS`` bits at any size of the benchmark: a fuller bitmap only
lets more windows into the join.

Defined results of odd inputs: null or empty texts match nothing; items without words match
nothing; repeated items are reported each; a null doc_id is reported as null; an empty table
on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, trimmed

NUM, NAME, UNIT, CAP, END, BOTH = 1, 2, 4, 8, 16, 32
_EDGE = "\"'`´‘’“”«»()[]{}<>.,;:!?…|*#&%$"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_QUANTITY = re.compile(r"([+-]?\d[\d.,:/]*)([a-zµ°]+)")
# Units that may follow a number.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros pound pounds cent cents percent kb mb gb tb hz khz mhz ghz v kv w kw mw kwh j kj cal kcal pa kpa bar n nm rpm mph kph kmh degree degrees metre metres meter meters "
    "mile miles inch inches foot feet litre litres liter liters gram grams kilogram kilograms kilometre kilometres kilometer kilometers".split()
)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PLACE = {NUM: 0x6E756D62, NAME: 0x6E616D65, UNIT: 0x756E6974}
_STOPS = frozenset(".!?…:")
VOCABULARY = 1 << 18
BITS = 1 << 24


class Vocabulary(dict):
    """Word -> position; each word's template key, value and kind are worked out once. It
    starts anew when full, between batches."""

    def __init__(self) -> None:
        super().__init__()
        self.key: list[int] = []  # of the words since arrays() was last asked for
        self.kind: list[int] = []
        self.unit: list[int] = []
        self._arrays = (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint64))

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGE)
        low = core.lower()
        kind, unit = 0, 0
        if low in UNITS:
            kind |= UNIT
        elif not low.isalpha():
            if _NUMBER.fullmatch(core):
                kind |= NUM
            elif (m := _QUANTITY.fullmatch(low)) and m[2] in UNITS:
                kind |= BOTH
                low, unit = m[1], xxhash.xxh64_intdigest(m[2])
        if core[:1].isupper():
            kind |= CAP
        if core != word and word.rstrip("\"')]}»”’")[-1:] in _STOPS:
            kind |= END
        self.key.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) if core else 0)
        self.kind.append(kind)
        self.unit.append(unit)
        self[word] = at = len(self)
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.key:
            new = (np.array(self.key, np.uint64), np.array(self.kind, np.uint8), np.array(self.unit, np.uint64))
            self._arrays = tuple(np.concatenate(x) for x in zip(self._arrays, new, strict=True))
            self.key, self.kind, self.unit = [], [], []
        return self._arrays


_vocabulary = Vocabulary()


@dataclass
class Template:
    """Template tokens of several texts: keys for windows, kinds, values and owning text."""

    key: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    text: np.ndarray


def canonicalise(texts: list[str | None], inside: bool = False) -> Template:
    """``inside``: as if a text stood inside a sentence, where its first word can be a name."""
    global _vocabulary
    if len(_vocabulary) > VOCABULARY:
        _vocabulary = Vocabulary()
    look = _vocabulary.__getitem__
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.split() if text else ()
        sizes[k] = len(words)
        ids.extend(map(look, words))
    at = np.array(ids, np.int64)
    key, kind, unit = (x[at] for x in _vocabulary.arrays())
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    ended = np.r_[True, (kind[:-1] & END) > 0] if len(owner) else first
    number = (kind & (NUM | BOTH)) > 0
    after = np.r_[False, number[:-1]] & ~first if len(owner) else first
    slot = np.zeros(len(at), np.uint8)
    slot[(kind & CAP > 0) & (~ended | first if inside else ~first & ~ended)] = NAME
    slot[(kind & UNIT > 0) & after] = UNIT
    slot[number] = NUM
    # A name's further words and lone punctuation leave; a number with its unit becomes two.
    again = np.r_[False, (slot[1:] == NAME) & (slot[:-1] == NAME)] & ~first if len(owner) else first
    times = np.where((key == 0) | again, 0, np.where(kind & BOTH > 0, 2, 1))
    rep = np.repeat(np.arange(len(at)), times)
    second = np.r_[False, rep[1:] == rep[:-1]] if len(rep) else np.zeros(0, bool)
    slot, value, owner = slot[rep].copy(), key[rep].copy(), owner[rep]
    slot[second], value[second] = UNIT, unit[rep][second]
    out = value.copy()
    for s, mark in _PLACE.items():
        out[slot == s] = mark
    return Template(out, slot, value, owner)


def window_hashes(key: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` tokens in a row, over the borders of texts too."""
    n = len(key) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Hashes of 1, 2, 4 ... tokens; those in the binary form of the width are joined.
    piece, size, h, done = (key ^ (key >> np.uint64(29))) * _MULT, 1, np.zeros(n, np.uint64), 0
    while True:
        power = np.uint64(pow(int(_MULT), size, 1 << 64))
        if width & size:
            h = h * power + piece[done : done + n]
            done += size
        if done == width:
            break
        piece = piece[:-size] * power + piece[size:]
        size *= 2
    h = (h ^ (h >> np.uint64(32))) * _MULT + np.uint64(width)
    return h ^ (h >> np.uint64(30))


def windows(t: Template, width: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every window of ``width`` tokens inside one text: of the template where
    it has words enough, of the values where it hasn't."""
    n = max(0, len(t.key) - width + 1)
    literal = np.r_[0, np.cumsum(t.kind == 0)]
    rich = literal[width:][:n] - literal[:n] >= min(min_literals, -(-width // 2))
    h = window_hashes(t.key, width)
    if not rich.all():
        h = np.where(rich, h, window_hashes(t.value, width) ^ _MULT)
    at = np.flatnonzero(t.text[:n] == t.text[width - 1 :][:n])
    return at, h[at]


_SLOTS = pa.list_(pa.int64())


def _slot_lists(t: Template, at: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
    """Kinds and values of the tokens of windows; a word has kind and value 0."""
    place = (at[:, None] + np.arange(width)[None, :]).ravel()
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
    kind = t.kind[place].astype(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(kind)), pa.ListArray.from_arrays(ends, pa.array(np.where(kind > 0, t.value[place], np.uint64(0)).view(np.int64)))


def _item_windows(width: int, min_literals: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for inside in (False, True):
                t = canonicalise(texts, inside)
                size = np.bincount(t.text, minlength=len(texts))
                start = np.cumsum(size) - size
                for w in sorted({width, *(int(s) for s in size if 0 < s < width)}):
                    at, h = windows(t, w, min_literals)
                    own = t.text[at]
                    if w < width:
                        at, h, own = at[size[own] == w], h[size[own] == w], own[size[own] == w]
                    elif inside:  # only the windows with the first word differ
                        at, h, own = at[at == start[own]], h[at == start[own]], own[at == start[own]]
                    kinds, values = _slot_lists(t, at, w)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array(size[own]), pa.array(at - start[own]), pa.array(np.full(len(at), w)), pa.array(h.view(np.int64)), kinds, values], names=["item", "size", "p", "w", "h", "kinds", "wanted"])

    return run


def _doc_windows(shared, widths: list[int], min_literals: int):  # noqa: ANN001, ANN202
    """The windows of texts whose hash is in the bitmap; equal ones of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            texts = b.column(2).to_pylist()
            at = 0
            while at < len(texts):  # a million characters at a time
                size, end = 0, at
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                t = canonicalise(texts[at:end])
                start = np.searchsorted(t.text, np.arange(end - at))
                for w in widths:
                    place, h = windows(t, w, min_literals)
                    slot = (h & np.uint64(BITS - 1)).astype(np.int64)
                    near = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    place, h = place[near], h[near]
                    values = window_hashes(t.value, w)[place] if len(place) else h
                    _, once = np.unique(np.column_stack([t.text[place].astype(np.uint64), h, values]), axis=0, return_index=True) if len(place) else (None, np.zeros(0, np.int64))
                    place, h = place[once], h[once]
                    own = t.text[place]
                    _, there = _slot_lists(t, place, w)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + own)), b.column(1).take(pa.array(at + own)), pa.array(h.view(np.int64)), pa.array(place - start[own]), there], names=["tk", "tl", "h", "d", "there"])
                at = end

    return run


def judge(hits: list[tuple], size: int, min_coverage: float, min_agreement: float, min_run: int) -> tuple[float, int, float] | None:
    """Whether the hits (p, d, kinds, wanted, there) of an item of ``size`` tokens in a text make a
    copy: (coverage, slots, agreement). Where windows of an item position meet several places,
    the place on the line (d - p) with most hits counts."""
    lines: dict[int, list[tuple]] = defaultdict(list)
    for hit in hits:
        lines[hit[1] - hit[0]].append(hit)
    aligned: dict[int, tuple] = {}
    run: dict[int, tuple] = {}
    for line in sorted(lines, key=lambda x: (-len(lines[x]), x)):
        own: dict[int, tuple] = {}
        for p, _, kinds, wanted, there in sorted(lines[line]):
            for j, slot in enumerate(zip(kinds, wanted, there, strict=True)):
                own.setdefault(p + j, slot)
        for p, slot in own.items():
            aligned.setdefault(p, slot)
        stretch: dict[int, tuple] = {}
        for p in sorted(own):
            if p - 1 not in stretch:
                stretch = {}
            stretch[p] = own[p]
            if len(stretch) > len(run):
                run = dict(stretch)
    for part, enough in ((aligned, len(aligned) >= min_coverage * size), (run, len(run) >= min_run)):
        if enough:
            slots, agreement = _agreement(part.values())
            if agreement >= min_agreement:
                return len(aligned) / size, slots, agreement
    return None


def _agreement(slots) -> tuple[int, float]:  # noqa: ANN001
    """Slots, and the share of them in which one value stands for one value, either way."""
    there: dict[tuple[int, int], Counter] = defaultdict(Counter)
    back: dict[tuple[int, int], Counter] = defaultdict(Counter)
    n = 0
    for kind, a, b in slots:
        if kind:
            there[(kind, a)][b] += 1
            back[(kind, b)][a] += 1
            n += 1
    return n, min(sum(max(c.values()) for c in m.values()) for m in (there, back)) / n if n else 1.0


def _judge(min_coverage: float, min_agreement: float, min_run: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        hits = list(zip(*(table.column(c).to_pylist() for c in ("p", "d", "kinds", "wanted", "there")), strict=True))
        found = judge(hits, size, min_coverage, min_agreement, min_run)
        one = table.slice(0, 1 if found else 0)
        coverage, slots, agreement = found or (0.0, 0, 0.0)
        n = len(one)
        return pa.table({"tk": one.column("tk"), "tl": one.column("tl"), "item": one.column("item"), "coverage": pa.array([coverage] * n, pa.float64()), "windows": pa.array([len(hits)] * n, pa.int32()), "slots": pa.array([slots] * n, pa.int32()), "agreement": pa.array([agreement] * n, pa.float64())})

    return run


def text_keys(text):  # noqa: ANN001, ANN201
    """Two hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 8, min_literals: int = 4, min_coverage: float = 0.5, min_agreement: float = 0.8, min_run: int = 20) -> DataFrame:
    """The benchmark items (item_id, text) found in texts of ``docs``: a row (tk, tl, item_id,
    coverage, windows, slots, agreement) for each different text, given by its ``text_keys``,
    and item."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "leaks")
    items = scratch.keep(benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = items.select("item", "text").mapInArrow(trimmed(_item_windows(width, min_literals)), "item bigint, size bigint, p bigint, w bigint, h bigint, kinds array<bigint>, wanted array<bigint>")
    wanted = scratch.keep(wanted, "windows")
    # BITS / 64 rows at most: a row for each word of the bitmap.
    slot = F.col("h").bitwiseAND(F.lit(BITS - 1).cast("bigint"))
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    widths = sorted(r["w"] for r in wanted.select("w").distinct().collect())  # 1 to width
    text = F.col(f"`{text_col}`").cast("string")
    tk, tl = text_keys(text)
    met = docs.where(text.isNotNull()).select(tk.alias("tk"), tl.alias("tl"), text.alias("text")).mapInArrow(trimmed(_doc_windows(shared, widths, min_literals)), "tk bigint, tl bigint, h bigint, d bigint, there array<bigint>")
    met = scratch.keep(met.dropDuplicates(["tk", "tl", "h", "d"]), "met")
    hits = met.join(wanted, "h")  # broadcast by Spark only below its threshold; else a merge join, which AQE splits
    found = hits.groupBy("tk", "tl", "item").applyInArrow(_judge(min_coverage, min_agreement, min_run), "tk bigint, tl bigint, item bigint, coverage double, windows int, slots int, agreement double")
    return scratch.keep(found.join(items.select("item", "item_id"), "item").select("tk", "tl", "item_id", "coverage", "windows", "slots", "agreement"), "found")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    tk, tl = text_keys(F.col("text"))
    rows = docs.where("text IS NOT NULL").select("doc_id", tk.alias("tk"), tl.alias("tl"))
    return rows.join(contamination(docs, items), ["tk", "tl"]).drop("tk", "tl")
