"""Line dedup: lines, alignment and blocks against brute force."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tremolo.llm.line_dedup import Lines, common_blocks, dedup_lines

DATA = "/root/testdata/sf0.001"


def _line(name, words):
    return " ".join(f"{name}{k}" for k in range(words)) + ".\n"


def _blocks(earlier, later, min_words):
    """Lines of ``later`` in a block, by position."""
    a, b = Lines.of_texts(pa.array([earlier])), Lines.of_texts(pa.array([later]))
    found = common_blocks(a.key, b.key, np.diff(b.first), min_words)
    return sorted({k for _, j, n in found for k in range(j, j + n)}), len(b.key)


def test_lines_of_texts():
    texts = ["One two. Three\nfour éè (five!) six", None, "", "  \n ", "\U0001f600", "One two."]
    lines = Lines.of_texts(pa.array(texts))
    assert np.diff(lines.words_at).tolist() == [7, 0, 0, 0, 1, 2]
    first = {texts[0].encode()[s:e].decode() for s, e in zip(lines.begin[lines.first[1:] - 1][:9], lines.end[lines.first[1:] - 1][:9], strict=True) if e <= len(texts[0].encode())}
    assert {"two.", "Three", "(five!)", "six"} <= first
    # Equal words have equal hashes wherever they stand, and so have equal lines.
    assert lines.word[0] == lines.word[-2] and lines.word[1] == lines.word[-1]
    assert lines.key[lines.lines_at[0]] == lines.key[lines.lines_at[5]]


def test_block_in_another_order_than_scattered_headings():
    h = [_line(f"head{k}", 5) for k in range(3)]
    u = [_line(f"own{k}", 9) for k in range(6)]
    passage = _line("p", 30) + _line("q", 30)
    earlier = passage + u[0] + h[0] + u[1] + h[1] + u[2] + h[2]
    later = h[0] + u[3] + h[1] + u[4] + h[2] + u[5]
    before = _blocks("", later, 25)[1]
    found, both = _blocks(earlier, later + passage, 25)
    assert found == list(range(before, both))
    assert _blocks(earlier, later, 25)[0] == []


def test_blocks_against_diagonals():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = rng.integers(4, 15, 12)
        a, b = rng.integers(0, 12, 25), rng.integers(0, 12, 25)
        a[5:9] = b[14:18]
        sizes = size[b]
        blocks = common_blocks(a, b, sizes, 25)
        assert all((a[i : i + n] == b[j : j + n]).all() and sizes[j : j + n].sum() >= 25 for i, j, n in blocks)
        found = {k for _, j, n in blocks for k in range(j, j + n)}
        left = [-1 - j if j in found else int(x) for j, x in enumerate(b)]
        for i in range(25):
            for j in range(25):
                n = 0
                while i + n < 25 and j + n < 25 and a[i + n] == left[j + n]:
                    n += 1
                assert sum(sizes[j : j + n]) < 25


def _check(spark, rows, least=16):
    """Every window of lines that an earlier document has is deleted, and every word deleted lies
    in a run of at least ``least`` words that some earlier document has. All pairs, no index."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    words = {d: (t or "").split() for d, t in rows}
    lines = {d: Lines.of_texts(pa.array([t])).first.tolist() for d, t in rows}
    cut = 0
    for d in words:
        must, may = set(), set()
        starts = {}
        for k in range(len(words[d]) - least + 1):
            starts.setdefault(tuple(words[d][k : k + least]), []).append(k)
        spans = set()
        for e in words:
            if e < d:
                for k in range(len(words[e]) - least + 1):
                    for at in starts.get(tuple(words[e][k : k + least]), ()):
                        may |= set(range(at, at + least))
                first = lines[e]
                for x in range(len(first) - 1):
                    z = next((z for z in range(x + 1, len(first)) if first[z] - first[x] >= least), None)
                    if z is not None:
                        spans.add(tuple(words[e][first[x] : first[z]]))
        first = lines[d]
        for x in range(len(first) - 1):
            z = next((z for z in range(x + 1, len(first)) if first[z] - first[x] >= least), None)
            if z is not None and tuple(words[d][first[x] : first[z]]) in spans:
                must |= set(range(first[x], first[z]))
        left = (result[d] or "").split()
        surely = [w for k, w in enumerate(words[d]) if k not in may]
        at = iter(left)
        assert all(any(w == x for x in at) for w in surely), d  # what no earlier document has stays, in order
        assert len(left) <= len(words[d]) - len(must), d
        cut += len(must) > 0
    return cut


def test_documents_against_all_pairs(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    assert _check(spark, rows) > 5


@pytest.mark.parametrize("shape", ["holders apart", "three-word lines", "one line again and again", "inside a sentence", "two of three lines"])
def test_shapes_that_one_holder_a_line_misses(spark, shape):
    long = [_line(f"l{k}x", 9) for k in range(3)]
    if shape == "holders apart":
        texts = [_line("a", 20) + long[0], _line("b", 20) + long[1], _line("c", 20) + long[2], _line("d", 20) + "".join(long), _line("e", 20) + "".join(long)]
    elif shape == "three-word lines":
        block = "".join(_line(f"v{k}y", 3) for k in range(15))
        texts = [_line("a", 20) + block, block + _line("b", 20)]
    elif shape == "one line again and again":
        texts = [_line("a", 20) + _line("r", 5) * 8, _line("b", 20) + _line("r", 5) * 8 + _line("c", 9)]
    elif shape == "inside a sentence":
        inside = " ".join(f"m{k}" for k in range(60))
        texts = [f"Our own words begin {inside} and go on here.", f"Other {inside} words."]
    else:
        texts = [long[0] + long[1] + _line("a", 20), _line("b", 20) + long[1] + long[2], _line("d", 20) + "".join(long), _line("e", 20) + "".join(long)]
    rows = list(enumerate(texts))
    assert _check(spark, rows) >= 1
    last = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()[-1]["text"]
    gone = {"holders apart": "l0x0", "three-word lines": "v7y1", "one line again and again": "r1", "inside a sentence": "m30", "two of three lines": "l1x3"}[shape]
    assert gone not in last.split() and len(last.split()) >= 2
    if shape == "inside a sentence":
        assert last.split() == ["Other", "words."]


def test_a_worker_gives_back_what_its_batches_took():
    """Python workers live on from task to task: of a large part little stays."""
    import os
    import random

    from tremolo.llm.common import trimmed
    from tremolo.llm.line_dedup import _parts

    def run(batches):
        for b in batches:
            held = [bytes(1000) for _ in range(200_000)]
            last = bytes(1000)  # stands behind the others on the heap
            del held
            yield b
        _ = last

    def rss():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20

    before = rss()
    assert len(list(trimmed(run)(iter([1])))) == 1
    assert rss() - before < 50
    rng = random.Random(3)
    texts = pa.array(["x" * rng.randrange(100_000) for _ in range(50)] + ["y" * 2_000_000])
    parts = list(_parts(texts))
    assert sum(n for _, n in parts) == len(texts)
    assert all(n == 1 or sum(len(x) for x in texts.slice(at, n).to_pylist()) < 1 << 18 for at, n in parts)
