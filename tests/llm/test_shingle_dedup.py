"""Near-duplicates of the pipeline against all pairs."""

import random

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tremolo.llm.shingle_dedup import shingles, similar_components  # noqa: E402


def _roots(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] == sets[b] or same * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _mutants():
    """Families of texts with more and more words replaced, and one passage in all."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, rows = [word() for _ in range(20)], [(0, ""), (1, None), (2, "two words"), (3, "Two  words")]
    for _ in range(25):
        base = [word() for _ in range(rng.choice((60, 200)))]
        for k in range(8):
            text = [word() if rng.random() < 0.006 * k else w for w in base]
            rows.append((len(rows), " ".join(passage + text)))
    return rows


def test_components_against_all_pairs(spark):
    rows = _mutants() + [(10_000 + d, t) for d, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    wanted = _roots({d: set(shingles(t, 5).tolist()) for d, t in rows})
    assert len(set(wanted.values())) < len(rows) - 50
    found = similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == wanted


def test_stage_drops_a_copy_that_simhash_at_four_bits_leaves(spark):
    from tremolo.llm.simhash import fingerprint

    rows = _mutants()
    sets = {d: set(shingles(t, 5).tolist()) for d, t in rows}
    text = dict(rows)
    far = [(a, b) for a in sets for b in sets if a < b and sets[a] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and (fingerprint(text[a]) ^ fingerprint(text[b])).bit_count() > 4]
    a, b = far[0]
    docs = spark.createDataFrame([(a, text[a], None, None, None), (b, text[b], None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [a]


def test_links_of_the_index_stand_below_the_similarity(spark):
    """A pair that only its fingerprints link: 4 bits or fewer apart, similarity under 0.8."""
    from tremolo.llm.shingle_dedup import majority

    rng = random.Random(11)
    found = None
    while found is None:
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        other = list(base)
        for k in rng.sample(range(200), 6):
            other[k] = f"v{rng.randrange(4000)}"
        x, y = (shingles(" ".join(t), 5) for t in (base, other))
        same = len(set(x.tolist()) & set(y.tolist()))
        if same * 18 < 8 * (len(x) + len(y)) and ((majority(x) ^ majority(y)) & (2**64 - 1)).bit_count() <= 4:
            found = base, other
    rows = [(k, " ".join(t), None, None, None) for k, t in enumerate(found, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_batches_of_lists_are_worked_in_parts():
    import pyarrow as pa
    from tremolo.llm.shingle_dedup import PART, _parts

    n = [3, PART, 5, 2 * PART, 1, 0]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([[0] * k for k in n], pa.list_(pa.int64()))], names=["node", "h"])
    parts = list(_parts(b, 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= PART for p in parts)
