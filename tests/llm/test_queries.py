"""Training-data queries against brute-force versions on the smallest tables."""

import hashlib
import json
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

pytest.importorskip("tremolo.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tremolo.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _table(name, order):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' ORDER BY {order}").df()


def _components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_bpe_against_the_tokenizers_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    docs = _table("documents", "doc_id")
    wanted = {}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        wanted[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), _sha(t.decode(ids, skip_special_tokens=False)))
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op8_bpe"](spark, DATA).collect()}
    assert found == wanted


def test_chat_digests(spark):
    rows = _table("conversations", "conv_id, turn")
    turns = {c: [(r.role, r.text if isinstance(r.text, str) else "") for r in g.itertuples()] for c, g in rows.groupby("conv_id")}
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in QUERIES["op2_chat_formatting"](spark, DATA).collect()}
    assert set(found) == set(turns)
    for c, ts in turns.items():
        loss = "".join(x for role, x in ts if role == "assistant")
        got = found[c]
        assert got["n_turns"] == len(ts)
        assert got["turns_sha256"] == _sha("".join(f"{r}\n{x}\n" for r, x in ts))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), _sha(loss))


def test_simhash_components_against_all_pairs(spark):
    docs = _table("documents", "doc_id")
    prints = {}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        words = [w for w in low.split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    roots = _components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash_near_dedup"](spark, DATA).collect()}
    assert found == {d: (f"{prints[d]:016x}", roots[d]) for d in ids}


def test_embedding_links_against_all_pairs(spark):
    rows = _table("embeddings", "vec_id")
    vec = np.array(rows.embedding.tolist(), dtype=float)
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    label, ids = rows.label.to_numpy(), rows.vec_id.tolist()
    near = (vec @ vec.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    roots = _components(ids, [(ids[i], ids[j]) for i, j in np.argwhere(np.triu(near))])
    found = {r["vec_id"]: r for r in QUERIES["op6_embedding_near_dedup"](spark, DATA).collect()}
    assert set(found) == set(ids)
    links = sum(r["n_links"] for r in found.values())
    assert 0.9 * near.sum() <= links <= near.sum()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] >= roots[r["vec_id"]] for r in found.values())


def test_quality_scores_on_held_out_rows(spark):
    rows = QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    truth = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.8


def test_url_filter_against_sql(spark):
    for name in ("pages", "labels", "documents"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    wanted = duckdb.sql(ORACLE_SQL["op4_url_filter"])
    found = QUERIES["op4_url_filter"](spark, DATA).select(*wanted.columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted.fetchall()))


def test_token_histogram_against_counts(spark):
    n = [r["n_tokens"] for r in QUERIES["op8_bpe"](spark, DATA).collect()]
    for r in QUERIES["op3_token_counts"](spark, DATA).collect():
        limit = r["context_limit"]
        assert r["docs"] == n.count(limit)
        assert r["docs_over"] == sum(x > limit for x in n)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))


def test_decontamination_finds_whole_items(spark):
    docs, items = _table("documents", "doc_id"), _table("benchmark", "item_id")
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_benchmark_decontamination"](spark, DATA).collect()}
    whole = {(d, i) for d, text in zip(docs.doc_id, docs.text, strict=True) for i, item in zip(items.item_id, items.text, strict=True) if len(item.split()) >= 13 and item in (text or "")}
    assert whole <= found
    # Nor is anything else found: each one found shares a run of words with the item, bare of
    # punctuation, as long as half of it or 20 words, numbers aside.
    bare = lambda text: [w.strip("\"'`.,;:!?()*#&%$").lower() for w in (text or "").split()]
    text_of, item_of = dict(zip(docs.doc_id, docs.text, strict=True)), dict(zip(items.item_id, items.text, strict=True))
    for d, i in found - whole:
        there = set(zip(*(bare(text_of[d])[k:] for k in range(4))))
        words = bare(item_of[i])
        covered = {k + j for k in range(len(words) - 3) if tuple(words[k : k + 4]) in there for j in range(4)}
        assert len(covered) >= 0.3 * len(words) or len(words) < 8, (d, i)


def test_pipeline_runs_and_keeps_a_copy_of_each(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, DATA).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op10_license_scan"])
def test_result_is_json_safe_and_stable(spark, name):
    def once():
        return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in QUERIES[name](spark, DATA).collect())

    assert once() == once()


def test_additive_model_against_lookups():
    """Scores by plain loops over the tables, and a model that finds a pair's interaction."""
    from tremolo.llm.gam import fit

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x, y)
    assert (0, 1) in model.pairs
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for value, cuts, table in zip(row, model.edges, model.tables, strict=True):
            total += table[sum(c <= value for c in cuts)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(c <= row[i] for c in model.pair_edges[i]), sum(c <= row[j] for c in model.pair_edges[j])]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9
