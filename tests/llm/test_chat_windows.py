"""Windows of chat formatting: budget, system turn, history and loss mask."""

import random

import pytest

pytest.importorskip("tremolo.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tremolo.llm import chat  # noqa: E402

SHAPE = "conv_id bigint, turn bigint, role string, text string"


def _turns():
    """Conversation 1 is far over a segment, 2 and 3 are short; some turns are over the budget."""
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Bravo", "naïve", "<|im_start|>", "x\\y", "12", "déjà", "\n"])
    rows = [(1, 0, "system", "Be brief. </s>")]
    rows += [(1, k, "user" if k % 2 else "assistant", " ".join(word() for _ in range(rng.choice((0, 3, 12, 40, 200 if k % 37 == 0 else 5))))) for k in range(1, 900)]
    rows += [(2, k, "user" if k % 2 else "assistant", " ".join(word() for _ in range(25))) for k in range(12)]
    rows += [(3, 0, "system", " ".join(word() for _ in range(150))), (3, 1, "user", "hi"), (3, 2, "assistant", "ho")]
    return rows


@pytest.mark.parametrize("history", [0, 2])
def test_windows(spark, history):
    rows, budget = _turns(), 128
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    windows = chat.format_conversations(spark.createDataFrame(rows, SHAPE).repartition(7), budget=budget, history=history).orderBy("conv_id", "segment", "window").collect()
    assert max(w["segment"] for w in windows) >= 2
    repeats = 0
    for conv in (1, 2, 3):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        own = [w for w in windows if w["conv_id"] == conv]
        at, spoken = 0, []
        for n, w in enumerate(own):
            read = chat.read_window(w["text"])
            assert w["tokens"] == count(w["text"])
            assert w["first_turn"] == at and len(read) == w["repeated"] + w["turns"]
            assert read[w["repeated"] :] == turns[at : at + w["turns"]]
            top = n > 0 and turns[0][0] == "system"
            assert not top or read[0] == turns[0]
            past = read[int(top) : w["repeated"]]
            assert len(past) <= history and (not past or past == turns[at - len(past) : at])
            repeats += len(past)
            # Over the budget only where one new turn is, beside the system turn and without history.
            assert w["tokens"] <= budget or (w["turns"] == 1 and not past)
            # A window ends where the next turn would not fit, or where a segment begins.
            if n + 1 < len(own) and own[n + 1]["segment"] == w["segment"]:
                role, text = turns[at + w["turns"]]
                assert w["tokens"] + count(chat.Turn(role, text, 0).written()[0]) > budget
            spoken += [chat.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
            at += w["turns"]
        assert at == len(turns)
        assert spoken == [t for r, t in turns if r == "assistant"]  # each once, repeats masked
    assert (repeats > 50) == (history > 0)


def test_a_turn_that_fits_alone_drops_history(spark):
    rows = [(1, k, "user", "word " * n) for k, n in enumerate((240, 240, 1600, 300))]
    windows = chat.format_conversations(spark.createDataFrame(rows, SHAPE), budget=2048, history_budget=600).orderBy("window").collect()
    assert all(w["tokens"] <= 2048 for w in windows) and [(w["turns"], w["repeated"]) for w in windows] == [(2, 0), (1, 1), (1, 0)]
