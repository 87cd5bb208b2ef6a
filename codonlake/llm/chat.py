"""Chat formatting in budgeted windows of whole turns.

A turn is written as ``<turn>role\\ntext</turn>\\n``. Backslashes and the two
control strings inside roles and texts (and line ends in roles) get a backslash
in front, so that any text reads back exactly.

Prefix sums of turn tokens place every turn in a conversation; they are built
in two levels (ranges of turns, then turns), so that a conversation with any
number of turns is spread over many tasks. Each stretch of BLOCK_WINDOWS budgets
is cut into windows on its own: a window takes new turns while they fit beside
the system turn and a limited, repeated history; a turn over the budget stands
alone. A system turn is repeated if it takes at most half of the budget; a longer
one stands in its first window only, so that windows hold new turns for at least
half of what they cost. The loss mask covers assistant texts that are new in the window.

Cases: null role or text: empty; turns with equal number go by role and text; a
null turn comes first, a null conv_id is a conversation of its own; repeated
rows are repeated turns; no rows give no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS_PER_RANGE = 256
BLOCK_WINDOWS = 64
WINDOWS = "conv_id long, block long, no int, n_repeated int, n_turns int, tokens long, formatted string, loss array<struct<start:int,end:int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

_TURN = re.compile(r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    for what in ("\\", "<turn>", "</turn>"):
        text = F.replace(text, F.lit(what), F.lit("\\" + what))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def count_tokens(text: Column) -> Column:
    """Words, single digits and other marks: close to what a subword vocabulary gives."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]{1,8}|\p{N}|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def placed_turns(conversations: DataFrame, tokens=count_tokens) -> DataFrame:
    """Every turn with its number ``idx`` and the tokens before it in its conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    body = escaped(F.col("text"))
    rows = rows.withColumn("seg", F.concat(F.lit("<turn>"), role, F.lit("\n"), body, F.lit("</turn>\n")))
    rows = rows.withColumn("loss_from", F.length(role) + 7).withColumn("loss_len", F.length(body))
    rows = rows.withColumn("tokens", tokens(F.col("seg"))).withColumn("range", F.coalesce(F.floor(F.col("turn") / TURNS_PER_RANGE), F.lit(-(1 << 62))))

    first = F.min(F.struct("turn", "role", "text", "seg", "tokens"))
    sums = rows.groupBy("conv_id", "range").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), first.alias("first"))
    ahead = W.partitionBy("conv_id").orderBy("range")
    before = ahead.rowsBetween(W.unboundedPreceding, -1)
    head = F.first("first").over(ahead.rowsBetween(W.unboundedPreceding, 0))
    starts = sums.select(
        F.col("conv_id").alias("_conv"),
        F.col("range").alias("_range"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.when(head["role"] == "system", F.struct(head["seg"].alias("seg"), head["tokens"].alias("tokens"))).alias("system"),
    )
    rows = rows.join(starts, rows["conv_id"].eqNullSafe(starts["_conv"]) & (rows["range"] == starts["_range"]))
    order = W.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
    rows = rows.withColumn("idx", F.col("n0") + F.row_number().over(order) - 1)
    rows = rows.withColumn("before", F.col("t0") + F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("conv_id", "range", "idx", "role", "seg", "loss_from", "loss_len", "tokens", "before", "system")


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens=count_tokens) -> DataFrame:
    """(conv_id, block, no, n_repeated, n_turns, tokens, formatted, loss).

    Windows of a conversation go by (block, no). Their first ``n_repeated``
    turns, the system turn among them, stood in an earlier window; ``loss`` has
    the spans of ``formatted`` (code points) to learn from.
    """
    size = BLOCK_WINDOWS * budget
    rows = placed_turns(conversations, tokens).withColumn("own", F.floor(F.col("before") / size).cast("long"))
    last = F.lag("own").over(W.partitionBy("conv_id", "range").orderBy("idx"))
    rows = rows.withColumn("system", F.when(last.isNull() | (last != F.col("own")), F.col("system")))  # once a block is enough
    late = F.col("before") >= (F.col("own") + 1) * size - history
    rows = rows.withColumn("block", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "idx").drop("range", "before")

    def cut(batches):
        return _cut(batches, budget, history)

    return rows.mapInArrow(cut, WINDOWS)


_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WINDOW_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), _LOSS]


def _batch(rows, spec, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in spec.split(", ")[: len(types)]])


class _Block:
    """The windows of one block, from its turns in order; holds one window and its history."""

    def __init__(self, key, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.system, self.past, self.new, self.no = None, [], [], 0

    def room(self) -> int:
        return self.budget - (self.system["tokens"] if self.repeats_system() else 0)

    def repeats_system(self) -> bool:
        return bool(self.system) and self.new[0]["idx"] > 0 and 2 * self.system["tokens"] <= self.budget

    def add(self, row):
        self.system = self.system or row["system"]
        if row["own"] != self.key[1]:
            self.remember(row)
            return None
        done = None
        if self.new and self.used + row["tokens"] > self.room():
            done = self.close()
        if not self.new:
            self.new = [row]
            self.used = row["tokens"]
            while self.past and self.used + sum(x["tokens"] for x in self.past) > self.room():
                self.past.pop(0)
            self.repeated = list(self.past)
            self.used += sum(x["tokens"] for x in self.repeated)
        else:
            self.new.append(row)
            self.used += row["tokens"]
        return done

    def remember(self, row) -> None:
        if row["idx"] == 0 and row["role"] == "system":
            return
        self.past.append(row)
        while self.past and sum(x["tokens"] for x in self.past) > self.history:
            self.past.pop(0)

    def close(self):
        kept = [self.system["seg"]] if self.repeats_system() else []
        kept += [x["seg"] for x in self.repeated]
        used = self.used + self.budget - self.room()
        at, loss = sum(map(len, kept)), []
        for x in self.new:
            if x["role"] == "assistant":
                loss.append({"start": at + x["loss_from"], "end": at + x["loss_from"] + x["loss_len"]})
            at += len(x["seg"])
            self.remember(x)
        out = (*self.key, self.no, len(kept), len(self.new), used, "".join(kept + [x["seg"] for x in self.new]), loss)
        self.new, self.no = [], self.no + 1
        return out


def _cut(batches, budget, history):
    block, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv_id"], row["block"])
            if block is None or block.key != key:
                if block and block.new:
                    out.append(block.close())
                block = _Block(key, budget, history)
            if done := block.add(row):
                out.append(done)
            if len(out) >= 500:
                yield _batch(out, WINDOWS, _WINDOW_TYPES)
                out = []
    if block and block.new:
        out.append(block.close())
    if out:
        yield _batch(out, WINDOWS, _WINDOW_TYPES)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window; anything else is an error."""
    at, turns = 0, []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


_READ_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _read(batches):
    conv, state, out = object(), None, []

    def row():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    for batch in batches:
        for w in batch.to_pylist():
            if w["conv_id"] != conv or state is None:
                if state:
                    out.append(row())
                conv, state = w["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            turns = parse(w["formatted"])[w["n_repeated"] :]
            for role, text in turns:
                state[1].update(f"{role}\n{text}\n".encode())
            for span in w["loss"]:
                text = unescape(w["formatted"][span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[0] += len(turns)
            state[4] += len(w["formatted"])
            state[5] += 1
        if len(out) >= 500:
            yield _batch(out, READ, _READ_TYPES)
            out = []
    if state:
        out.append(row())
    if out:
        yield _batch(out, READ, _READ_TYPES)


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and learned text of each conversation, as digests, from its windows alone.

    A digest of a conversation runs over it in order; its windows are streamed
    from a sorted partition and only the running state is held.
    """
    kept = windows.select("conv_id", "block", "no", "n_repeated", "formatted", "loss")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "block", "no").mapInArrow(_read, READ)
