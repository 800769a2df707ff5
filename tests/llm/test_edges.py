"""Odd inputs of the training-data operators: nulls in any column, empty and very long texts,
ties and repeated rows, empty tables, further columns with clashing names. And a brute-force
version of the licence scan."""

import duckdb
import pytest

pytest.importorskip("tremolo.llm")
from pyspark.sql import functions as F  # noqa: E402

from tremolo.llm import bpe, chat, decontaminate, embedding_dedup, licenses, line_dedup, quality, simhash, token_counts, url_filter  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()


def _prose(seed, n):
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % 26] + WORDS[(x >> 16) % 26])
    return " ".join(out)


PASSAGE = "\n".join(_prose(100 + k, 15) + "." for k in range(5))
LONG = "\n".join(_prose(k, 40) for k in range(2500))
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _docs(spark, rows, extra=""):
    """documents with (doc_id, text) of rows, and further columns named as operators name theirs."""
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SHAPE)
    for name in extra.split():
        d = d.withColumn(name, F.lit("own"))
    return d


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "A text without an id."), (None, None), (4, LONG), (5, "Twice."), (5, "Twice."), (6, "Twice."), (7, "\U0001f600 \u00e9\u0301 \u0000 end")]


def test_line_dedup_of_odd_rows(spark):
    out = line_dedup.dedup_lines(_docs(spark, ODD, "e_id line_cut __cut tk E_ID2"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "e_id", "__cut", "tk", "E_ID2", "line_cut"]
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in out.collect()])) == sorted(map(repr, ODD))
    assert line_dedup.dedup_lines(_docs(spark, [])).count() == 0


def test_line_dedup_cuts_a_passage_from_the_later_document_only(spark):
    rows = [(1, "First one.\n" + PASSAGE + "\nIts own end."), (2, _prose(7, 60)), (3, "Another head.\n" + PASSAGE + "\nAnother end."), (4, PASSAGE), (5, None)]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()}
    assert (found[1], found[2], found[5]) == (rows[0][1], rows[1][1], None)
    assert found[3].split() == "Another head. Another end.".split() and found[4].strip() == ""


def test_chat_of_odd_rows(spark):
    shape = "conv_id bigint, turn bigint, role string, text string, window int, loss string"
    rows = [(1, 0, "system", None, 1, ""), (1, 1, "user", "", 1, ""), (1, 1, "assistant", "tie", 1, ""), (1, 1, "assistant", "tie", 1, ""), (None, None, None, None, None, None), (2, None, "assistant", "word " * 40_000, 1, ""), (2, 3, "ro\nle<|end|>", "\\.<|turn|>user\n<|end|>\n", 1, "")]
    windows = chat.format_conversations(spark.createDataFrame(rows, shape), budget=256)
    found = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(windows).collect()}
    assert found == {1: (4, 6), None: (1, 0), 2: (2, 200_000)}
    texts = [t for r in windows.where("conv_id = 2").orderBy("window").collect() for t in chat.read_window(r["text"])[r["repeated"] :]]
    assert texts == [(rows[5][2], rows[5][3]), (rows[6][2], rows[6][3])]
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], shape))).count() == 0


def test_token_counts_of_odd_rows(spark):
    report = token_counts.context_report(token_counts.histogram(token_counts.token_lengths(_docs(spark, ODD, "length docs tokens"))))
    rows = {r["context_limit"]: r for r in report.collect()}
    assert rows[0]["docs"] == 3 and rows[0]["docs_over"] == 7 and rows[0]["total_docs"] == 10
    assert max(rows) > 100_000 and rows[max(rows)]["docs_over"] == 0 and rows[max(rows)]["truncated_tokens"] == rows[0]["total_tokens"]
    assert token_counts.context_report(token_counts.histogram(token_counts.token_lengths(_docs(spark, [])))).count() == 0


def test_url_filter_of_odd_rows(spark):
    shape = "page_id bigint, url string, host string, verdict string"
    rows = [(1, None), (2, ""), (3, "no scheme"), (None, "http://A.NET/es/x?y"), (4, "x://WWW.example.com/en/1#a"), (4, "x://WWW.example.com/en/1#a"), (5, "http://a.example.com/en/"), (6, "http://h?q/com/"), (7, "http://netx/es/")]
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in rows], shape)
    outcomes = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (4, 1)], "page_id bigint, bad int")
    found = sorted((tuple(r)[:5] for r in url_filter.judge(pages, outcomes).collect()), key=repr)
    assert [r for r in found if r[0] == 4] == [(4, "www.example.com", "/en/1", "www.example.com/en/", "allow")] * 2
    assert (None, "a.net", "/es/x", "net/es/", "block") in found and (5, "a.example.com", "/en/", "example.com/en/", "block") in found
    assert {r[1:4] for r in found if r[0] in (1, 2, 3)} == {("", "", None)} and [r[1:4] for r in found if r[0] == 6] == [("h", "", None)]
    assert len(found) == len(rows) and all(r[4] in ("allow", "block") for r in found)
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, outcomes.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_simhash_of_odd_rows(spark):
    found = simhash.near_duplicates(_docs(spark, ODD, "fp root node component_id")).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert len(found) == len(ODD)
    assert by[1] == by[2] == by[3] == [("0" * 16, 1)]
    assert len(by[5]) == 2 and {x[1] for x in by[5] + by[6]} == {5}
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1)]
    vectors = spark.createDataFrame([(*r, "own", "own") for r in rows], "vec_id bigint, embedding array<float>, label int, node string, n_links string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors).collect()}
    linked = {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 13: (1, 13, True), 14: (1, 13, False)}
    assert found == {i: linked.get(i, (0, i, True)) for i, _, _ in rows}
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(vectors.where("label IS NULL")).count() == 1


def test_quality_of_odd_rows(spark):
    docs = _docs(spark, ODD, "score label_id y")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (99, 1, 0)], "doc_id bigint, quality int, score int")
    for known in (labels, labels.limit(0)):
        found = quality.classify(docs, known).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in found)
    assert quality.classify(_docs(spark, []), labels).count() == 0


def test_bpe_of_odd_rows(spark):
    found = bpe.encode_documents(_docs(spark, ODD, "ids n_tokens")).collect()
    assert len(found) == len(ODD)
    assert all(len(r["ids"]) == r["n_tokens"] for r in found) and sum(r["n_tokens"] == 0 for r in found) == 3
    assert bpe.encode_documents(_docs(spark, [])).count() == 0


def _leaks(spark, rows, items):
    docs = _docs(spark, rows, "item_id coverage m tk h") if isinstance(rows, list) else rows
    found = decontaminate.contamination(docs, items)
    tk, tl = decontaminate.text_keys(F.col("text"))
    own = docs.select("doc_id", tk.alias("tk"), tl.alias("tl"))
    return sorted(map(tuple, own.join(found, ["tk", "tl"]).select("doc_id", "item_id").collect()))


def test_decontamination_of_odd_rows(spark):
    item = "A farmer named Alice has 12 apples and gives 5 kg of them to her friend Robert who then sells all but 12 of the fruit at the market."
    again = item.replace("12", "37").replace("Alice", "Maria").replace(" 5 ", " 9 ").replace("Robert", "Peter")
    items = spark.createDataFrame([(1, item, "own"), (1, item, "own"), (2, None, "own"), (3, "", "own"), (None, "?!", "own")], "item_id bigint, text string, windows string")
    rows = [*ODD, (20, f"{_prose(3, 30)}. {item} {_prose(4, 30)}"), (21, again), (22, _prose(5, 200))]
    assert _leaks(spark, rows, items) == [(20, 1), (20, 1), (21, 1), (21, 1)]
    assert _leaks(spark, [], items) == []
    assert _leaks(spark, rows, items.limit(0)) == []


def test_decontamination_of_hard_items(spark):
    """Items full of numbers, short items behind a word, passages of less than half an item, frames
    with other values, and text ids."""
    numbers = "Give the sum of all the given numbers " + " ".join(str(7 * k) for k in range(20)) + "."
    long = _prose(50, 70)
    frame = "Yesterday Anna bought 3 kg of rice and 4 kg of corn while Bert bought 5 kg of rice and 6 kg of corn."
    items = spark.createDataFrame([("numbers", numbers), ("short", "Who wrote the last opera?"), ("long", long), ("frame", frame)], "item_id string, text string")
    other = frame.replace("Anna", "Cleo").replace("Bert", "Dora").replace(" 3 ", " 8 ").replace(" 4 ", " 9 ").replace(" 5 ", " 11 ").replace(" 6 ", " 2 ")
    broken = "Yesterday Anna bought 3 kg of rice and 4 kg of corn while Anna bought 3 kg of rice and 3 kg of corn. " * 1
    rows = [(1, f"{_prose(1, 30)} {numbers} {_prose(2, 9)}"), (2, "they asked then Who wrote the last opera? nobody knew"), (3, f"{_prose(3, 40)}. {' '.join(long.split()[20:45])}. {_prose(4, 40)}"), (4, other), (5, broken), (6, _prose(6, 300)), (7, "Give the sum of all the given numbers " + " ".join(str(5 + 9 * k) for k in range(20)) + "."), (8, " ".join(long.split()[20:34]))]
    found = _leaks(spark, rows, items)
    assert [x for x in found if x[0] in (1, 2, 3, 4)] == [(1, "numbers"), (2, "short"), (3, "long"), (4, "frame")]
    assert not [x for x in found if x[0] in (5, 6, 8)]


def _paragraphs(text):
    """Lines, joined to the next where they end without a stop and the next isn't blank."""
    lines, out, held = (text or "").split("\n"), [], ""
    for k, line in enumerate(lines):
        held = held + line if not held else held.rstrip(" \t\r") + " " + line
        end = held.rstrip(" \t\r")
        stop = not end or end[-1] in ".!?:;" or (end[-1] in "\"')]" and end[-2:-1] in tuple(".!?:;"))
        if k + 1 == len(lines) or stop or end[-1].isspace() or not lines[k + 1].strip(" \t\r"):
            out.append(held)
            held = ""
    return [x for x in out if x.strip(" ")]


def test_licenses_of_odd_rows_and_against_plain_code(spark):
    model = licenses.train()
    text = "Released under the MIT License.\n\nHe lost his driving license.\nnothing here\nAll rights reserved."
    wrapped = "Some code.\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction\n\nElse."
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*ODD, (30, text), (30, text), (None, text), (31, "word " * 20_000 + "licensed under CC BY 4.0"), (1032, wrapped), *table]
    wanted = []
    for d, t in rows:
        for k, line in enumerate(_paragraphs(t)):
            words = licenses.words_of(line)
            if set(words) & set(licenses.ANCHORS):
                p = model.probabilities(licenses.grams_of(words))
                if 1 - p[-1] >= 0.5:
                    wanted.append((d, k, model.families[int(p.argmax())] if p.max() >= 0.5 else "unknown", round(float(p.max()), 4)))
    found = [(r["doc_id"], r["line_no"], r["family"], round(r["probability"], 4)) for r in licenses.scan(_docs(spark, rows, "line words gram family row")).collect()]
    assert sorted((tuple(x[:3]) for x in found), key=repr) == sorted((tuple(x[:3]) for x in wanted), key=repr)
    for a, b in zip(sorted(found, key=repr), sorted(wanted, key=repr), strict=True):
        assert abs(a[3] - b[3]) <= 2e-4
    assert [x[2] for x in found if x[0] == 1032] == ["mit"]
    assert licenses.scan(_docs(spark, [])).count() == 0


def test_licence_identifiers_and_other_languages(spark):
    notices = {"Distributed under GPLv3.": "gpl", "Code: CC-BY-SA-4.0": "cc-by", "LGPLv2.1": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl-2.0", "BSD-3-Clause": "bsd", "Available under MIT": "mit", "Alle Rechte vorbehalten": "all-rights-reserved", "Tous droits réservés": "all-rights-reserved"}
    plain = ["Er kam mit dem Zug.", "She studied physics at MIT last year.", "A licensed plumber came.", "The eclipse was total.", "Please cc me."]
    rows = list(enumerate([*notices, *plain]))
    found = {r["doc_id"]: r["family"] for r in licenses.scan(_docs(spark, rows)).collect()}
    assert [found.get(k) for k in range(len(notices))] == list(notices.values())
    assert all(found.get(k, "unknown") == "unknown" for k in range(len(notices), len(rows)))


def test_licences_of_texts_kept_back():
    """Each part of the library is judged by a model of the other parts."""
    right = n = 0
    for part in range(5):
        model = licenses.train(kept_back=5, part=part)
        for family, text, origin in licenses.library():
            grams = licenses.grams_of(licenses.words_of(text))
            if origin % 5 == part and set(licenses.words_of(text)) & set(licenses.ANCHORS):
                right += model.families[int(model.probabilities(grams).argmax())] == family
                n += 1
    assert n > 900 and right / n > 0.8


def test_pipeline_stages_of_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = _docs(spark, [*ODD, (40, PASSAGE), (41, PASSAGE)], "gone_id predicted score held_out line_cut component_id node m")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and all(r["predicted"] == r["line_cut"] == r["gone_id"] == "own" for r in rows)


def test_pipeline_keeps_one_of_each_group_and_every_other_text(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, _prose(1, 200)), (2, _prose(1, 200)), (2, _prose(2, 200)), (3, _prose(3, 200)), (3, _prose(3, 200)), (4, _prose(4, 200)), (None, _prose(4, 200))]
    out = pipeline.near_dedup(spark, _docs(spark, rows), DATA).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[5], rows[6]]))


def test_words_kept_by_the_codec_are_bounded_and_change_nothing(monkeypatch):
    """Of ten times as many words as a table keeps, two tables' worth is held, and ids are the same."""
    from tremolo.llm import bpe

    texts = [" ".join(f"w{k}x{j}" for j in range(20)) + " again and again," for k in range(50)]
    whole = [bpe.Codec(bpe.default_path()).encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 100)
    c = bpe.Codec(bpe.default_path())
    assert [c.encode(t) for t in texts * 2] == whole * 2
    assert max(map(len, (c.kept, c.old, c.kept_words, c.old_words))) <= 100
    assert " again" in c.kept or " again" in c.old
