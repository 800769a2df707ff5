"""Chat formatting in budgeted windows.

A conversation is written as windows of whole turns. Prefix sums of turn tokens choose the spans: a
window takes new turns while they fit the budget beside the system turn, which is kept at the top of
every window, and beside the last few turns of the window before, which are repeated as history;
history gives way, oldest first, where the next turn would not fit beside it. A turn that is over the
budget beside the system turn alone gets a window of its own. The loss mask covers assistant texts the
first time they stand in a window; repeated ones are masked out.

Tokens are those of the turn as written, marks and escapes included, by the byte-level BPE of a
tokenizer file; turns begin and end where no token can reach across, so a window's tokens are
the sum of its turns'.

Template: ``<|turn|>role`` newline text ``<|end|>`` newline. Control strings of this and other
templates are broken up inside roles and texts by an escape, which reading undoes.

A long conversation is dealt out: turns are ranged by conversation and turn, sums of whole ranges are
carried over, and where the prefix sum passes a multiple of ``SEGMENT`` budgets a new segment, and a
new window, begins. Segments are written independently of each other, the last turns before a segment
going with it as history.

Defined results of odd inputs: a null text is empty, a null role is the empty role; turns of the
same number are ordered by role, then text, and all are kept; rows with a null conv_id are one
conversation, and so are those with NaN; a null turn number comes first; an empty table gives no windows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_path
from .common import Scratch, ship

TURN, STOP = "<|turn|>", "<|end|>"
# Control strings of chat templates in use.
CONTROLS = (TURN, STOP, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")
_START = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_BACK = {"\\": "\\", ".": "", "n": "\n"}
_READ = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(STOP) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """Backslashes are doubled; behind the first character of every control string stands ``\\.``."""
    text = text.replace("\\", "\\\\")
    return _START.sub(r"\1\\.", text) if "<" in text or "[" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _BACK[m[1]], text) if "\\" in text else text


def read_window(window: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _READ.finditer(window)]


@dataclass
class Turn:
    role: str
    text: str
    tokens: int

    def written(self) -> tuple[str, int, int]:
        """The turn as written and the span of its text inside."""
        head = f"{TURN}{escape_role(self.role)}\n"
        body = escape(self.text)
        return f"{head}{body}{STOP}\n", len(head), len(head) + len(body)


class Windows:
    """Budgeted windows of one segment of a conversation, fed turn by turn."""

    def __init__(self, budget: int, history: int, history_budget: int, before: int = 0):
        self.budget, self.keep, self.history_budget = budget, history, history_budget
        self.system: Turn | None = None
        self.past: deque[Turn] = deque(maxlen=max(history, 1))
        self.new: list[Turn] = []
        self.prefix = 0  # tokens of all turns so far
        self.start = 0  # prefix sum where the window's new turns begin
        self.base = 0  # tokens of system turn and history in the window
        self.repeated: list[Turn] = []
        self.seen = before  # turns of the conversation so far
        self.number = 0

    def head(self, turn: Turn, kind: int) -> None:
        """The system turn (kind 0), or a turn before the segment (1)."""
        if kind == 0:
            self.system = turn
        elif self.keep and turn is not self.system:
            self.past.append(turn)

    def feed(self, turn: Turn) -> Iterator[dict]:
        if self.new and self.base + self.prefix + turn.tokens - self.start > self.budget:
            yield self.flush()
        if not self.new:
            self.repeat(turn)
        if not self.seen and turn.role == "system":
            self.system = turn
        self.seen += 1
        self.prefix += turn.tokens
        self.new.append(turn)

    def flush(self) -> dict:
        out, at, spans, tokens = [], 0, [], 0
        for k, turn in enumerate([*self.repeated, *self.new]):
            text, a, b = turn.written()
            if k >= len(self.repeated) and turn.role == "assistant":
                spans.append({"start": at + a, "end": at + b})
            out.append(text)
            at += len(text)
            tokens += turn.tokens
        row = {"window": self.number, "first_turn": self.seen - len(self.new), "repeated": len(self.repeated), "turns": len(self.new), "tokens": tokens, "text": "".join(out), "loss": spans}
        self.number += 1
        for turn in self.new:
            self.head(turn, 1)
        self.new, self.start = [], self.prefix
        return row

    def repeat(self, turn: Turn) -> None:
        """What a new window has at its top, so that ``turn`` fits beside it."""
        top = [] if self.system is None or not self.seen else [self.system]
        self.base = sum(t.tokens for t in top)
        self.repeated, left = [], min(self.history_budget, self.budget - self.base - turn.tokens)
        for past in reversed(self.past):
            if past.tokens > left:
                break
            left -= past.tokens
            self.repeated.insert(0, past)
        self.base += sum(t.tokens for t in self.repeated)
        self.repeated = top + self.repeated


_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_NAMES = ("conv_id", "segment", "window", "first_turn", "repeated", "turns", "tokens", "text", "loss")
SYSTEM, CONTEXT, NEW = 0, 1, 2
SEGMENT = 64  # budgets of tokens in a segment


def _counter(path: str):  # noqa: ANN202
    """Adds the tokens of each turn as written to (role, text) at the end of a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            tokens = [len(bpe.encode(Turn(r or "", t or "", 0).written()[0])) // 4 for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.int64())], names=[*b.schema.names, "tokens"])

    return count


def _writer(kind: pa.DataType, budget: int, history: int, history_budget: int):  # noqa: ANN202
    types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), _LOSS)

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, types, strict=True)], names=list(_NAMES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, own, rows, size = None, None, {}, [], 0
        for b in batches:
            for key, segment, part, ordinal, conv, role, text, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made = []
                if (key, segment) != now:
                    if state is not None and state.new:
                        made.append({**own, **state.flush()})
                    state, now, own = None, (key, segment), {"conv_id": conv, "segment": segment}
                turn = Turn(role or "", text or "", tokens)
                if state is None:
                    state = Windows(budget, history, history_budget)
                if part == NEW:
                    if not state.new and not state.number:
                        state.seen = ordinal
                    made += [{**own, **w} for w in state.feed(turn)]
                else:
                    state.head(turn, part)
                rows += made
                size += sum(len(r["text"]) for r in made)
                if size > 4_000_000:
                    yield pack(rows)
                    rows, size = [], 0
        if state is not None and state.new:
            rows.append({**own, **state.flush()})
        if rows:
            yield pack(rows)

    return write


def format_conversations(turns: DataFrame, budget: int = 2048, history: int = 2, history_budget: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> one row for each window: conv_id, segment, window (its
    number in the segment), first_turn (ordinal of its first new turn), repeated (turns that it
    repeats at the top), turns (new ones), tokens, text, loss (spans of code points under the
    loss mask). ``tokenizer``: a byte-level BPE file; history_budget: a quarter of the budget
    where none is given."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = turns.sparkSession
    ship(spark)
    scratch = Scratch(spark, "chat")
    kind = turns.schema["conv_id"].dataType
    order = turns.schema["turn"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    read = turns.select(key.alias("key"), "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    counted = read.mapInArrow(_counter(tokenizer or default_path()), f"key string, conv_id {kind.simpleString()}, turn {order}, role string, text string, tokens bigint")
    ranged = counted.repartitionByRange("key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text")
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()), "ranged")
    # Tokens and turns of a conversation before each range: a row for each range that it reaches into.
    whole = ranged.groupBy("key", "part").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"))
    so_far = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("key", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("k").over(so_far), F.lit(0)).alias("turns_before"))
    carried = scratch.keep(carried, "carried")
    inside = Window.partitionBy("key", "part").orderBy("pos")
    placed = ranged.join(carried, ["key", "part"]).select(
        "key", F.floor((F.col("tokens_before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")) / F.lit(SEGMENT * budget)).alias("segment"), F.lit(NEW).alias("kind"),
        (F.col("turns_before") + F.row_number().over(inside) - 1).alias("ordinal"), "conv_id", "role", "text", "tokens")
    placed = scratch.keep(placed, "placed")
    # Later segments begin with the system turn and the last turns before them.
    begins = placed.where("segment > 0").groupBy(F.col("key").alias("b_key"), F.col("segment").alias("b_segment")).agg(F.min("ordinal").alias("begin"))
    wanted = F.concat(F.array(F.struct(F.lit(SYSTEM).alias("b_kind"), F.lit(0).cast("bigint").alias("at"))), F.transform(F.sequence(F.lit(1), F.lit(history)) if history else F.array().cast("array<int>"), lambda h: F.struct(F.lit(CONTEXT).alias("b_kind"), (F.col("begin") - h).alias("at"))))
    begins = scratch.keep(begins.select("b_key", "b_segment", F.explode(wanted).alias("w")).select("b_key", "b_segment", "w.*"), "begins")
    opening = placed.join(begins, (F.col("key") == F.col("b_key")) & (F.col("ordinal") == F.col("at")) & (F.col("ordinal") >= 0))
    is_system = (F.col("ordinal") == 0) & F.coalesce(F.col("role") == "system", F.lit(False))
    opening = opening.where(F.when(F.col("b_kind") == SYSTEM, is_system).otherwise(~is_system)).select("key", F.col("b_segment").alias("segment"), F.col("b_kind").alias("kind"), "ordinal", "conv_id", "role", "text", "tokens")
    dealt = placed.unionByName(opening).repartition("key", "segment").sortWithinPartitions("key", "segment", "kind", "ordinal")
    write = _writer(to_arrow_type(kind), budget, history, budget // 4 if history_budget is None else history_budget)
    schema = f"conv_id {kind.simpleString()}, segment bigint, window bigint, first_turn bigint, repeated int, turns int, tokens bigint, text string, loss array<struct<start:int,end:int>>"
    return dealt.mapInArrow(write, schema)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation as read from its windows: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_windows, most_tokens (of a window). A digest is
    taken of the turns in order, so a conversation is read by one task, window after window."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = windows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows", "most_tokens"]
    types = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, state, rows = None, None, None, []

        def done() -> tuple:
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6])

        for b in batches:
            for key, own, repeated, tokens, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or key != now:
                    if state is not None:
                        rows.append(done())
                    now, conv, state = key, own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in read_window(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
                state[6] = max(state[6], tokens)
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if state is not None:
            rows.append(done())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    placed = windows.select(key.alias("key"), "conv_id", "segment", "window", "repeated", "tokens", "text", "loss").repartition("key").sortWithinPartitions("key", "segment", "window")
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint, most_tokens bigint"
    return placed.select("key", "conv_id", "repeated", "tokens", "text", "loss").mapInArrow(read, schema)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_conversations(turns.unionByName(probe)))
