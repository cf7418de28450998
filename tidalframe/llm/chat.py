"""Chat formatting: conversations as windows of a token budget.

A turn is written as `<turn role>`, a line break, its text, a line break, `</turn>` and a line break.
Tokens are counted a turn at a time.  Prefix sums of these counts choose the windows: each takes
as many whole turns as the budget leaves after the system turn, which every window repeats, and a limited
history, the turns just before it, repeated as well.  A turn that fills most of a window alone is written in parts,
`<turn+ role>` for all but the first.  Only assistant texts outside of what is repeated are under the loss mask, so each is
there once.

A control string inside a text gets a backslash, and backslashes just before it are doubled,
so that real marks are those with no backslash before them; reading back undoes it.  In a role, `%`, `<`, `>`
and line breaks are written as `%25` and so on.

A conversation is cut into blocks of BLOCK turn numbers, and a turn number with more than TIED
rows into shares, so no conversation meets in one task: windows do not reach over a block's end, but
the first window of a block has its system turn and history all the same.  Only the digests of whole conversations,
which SHA-256 makes sequential, are streams through one task each, in bounded memory.

Defined cases: null texts and roles are empty; a null turn comes first; rows of one turn number are turns of their own, in the
order of a hash of role and text; a null conversation is a conversation; a system turn is the first row if its role is
`system`, and is repeated if it has at most a quarter of the budget; a very long text is written in
parts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .packing import _encoder, default_tokenizer

BUDGET = 2048
#: Turns and share of the budget that a window's history may have.
HISTORY, HISTORY_SHARE = 4, 0.25
SYSTEM_SHARE = 0.25
#: Turn numbers in a block; rows of one turn number that stay together.
BLOCK, TIED = 512, 2_048

# Fixed values of the template.
OPEN, MORE, CLOSE = "<turn", "<turn+", "</turn>"

_CONTROL = re.compile(r"(\\*)(</?turn)")
_HEAD = re.compile(r"<turn(\+?) ([^<>\n]*)>\n")
_END = f"\n{CLOSE}\n"
_ROLE = {c: f"%{ord(c):02X}" for c in "%<>\n\r"}


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def written(role: str, text: str, more: bool = False) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text begins and ends."""
    head = f"{MORE if more else OPEN} {role.translate(str.maketrans(_ROLE))}>\n"
    body = escaped(text)
    return f"{head}{body}\n{CLOSE}\n", len(head), len(head) + len(body)


def parsed(window: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, whether it goes on with the turn before) for each turn or part of a window."""
    at = 0
    while at < len(window):
        head = _HEAD.match(window, at)
        end = window.index(_END, head.end())
        role = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), head[2])
        yield role, unescaped(window[head.end() : end]), head[1] == "+"
        at = end + len(_END)


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[str], int]:
    encode = _encoder(path)
    return lambda text: len(encode(text))


def parts(role: str, text: str, count: Callable[[str], int], most: int) -> Iterator[tuple[str, int]]:
    """Texts, and their tokens when written, that together are text: itself, or halves of halves of at most so many tokens."""
    todo, more = [text], False
    while todo:
        x = todo.pop()
        n = count(written(role, x, more)[0])
        if n > most and len(x) > 1:
            todo += [x[len(x) // 2 :], x[: len(x) // 2]]
        else:
            yield x, n
            more = True


def windows_of(tokens: np.ndarray, first: int, system: int, budget: int, history: int, history_tokens: int) -> list[tuple[int, int, int]]:
    """(history from, start, end) of each window of turns first..; those before are history only.

    system: tokens to be repeated in windows that do not begin with the first turn of all (0: none).
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    out, s, n = [], first, len(tokens)
    while s < n:
        room = budget - system
        h = s
        least = max(total[s] - min(history_tokens, room - tokens[s]), 0)
        while h > 0 and s - h < history and total[h - 1] >= least:
            h -= 1
        e = int(np.searchsorted(total, total[h] + room, side="right")) - 1
        e = max(e, s + 1)
        out.append((h, s, e))
        s = e
    return out


TURN = "turn long, role string, text string, hash long, tie long, n_tokens int, part int"


def _counted(turns: DataFrame, tokenizer: str, most: int, key: str) -> DataFrame:
    """A row for each turn (part 0) or part (from 1), with its tokens; `hash` is the turn's, `tie` numbers the rows of the table."""
    kind = dict(turns.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for b in batches:
            place, out = [], []
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
                found = list(parts(role, text, count, most))
                place += [i] * len(found)
                out += [(x, n, j if len(found) > 1 else 0) for j, (x, n) in enumerate(found, 1)]
            rows = b.take(pa.array(place, pa.int64()))
            x, n, j = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(x, pa.string()), *rows.columns[4:], pa.array(n, pa.int32()), pa.array(j, pa.int32())], names=[*rows.schema.names, "n_tokens", "part"])

    empty = F.lit("")
    plain = turns.select(key, F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    plain = plain.withColumns({"hash": F.xxhash64("role", "text"), "tie": F.monotonically_increasing_id()})
    return plain.mapInArrow(run, f"{key} {kind}, {TURN}")


def _shared(rows: DataFrame, key: str, tied: int, block: int) -> DataFrame:
    """rows with share: 0, but in a block with a turn number of more than `tied` rows each number has shares of its own, as many as bring it below."""
    many = rows.where("part <= 1").groupBy(key, "block", "turn").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tied)
    many = common.stored(many.select(F.col(key).alias("_key"), F.col("block").alias("_b"), F.col("turn").alias("_turn"), "_n"), "tied-turns", narrow=True)
    if many.isEmpty():
        return rows.withColumn("share", F.lit(0).cast("long"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_b"))
    full = many.select("_key", "_b").distinct().withColumn("_full", F.lit(True))
    rows = rows.join(common.small(common.stored(full, "tied-blocks", narrow=True)), same, "left").drop("_key", "_b")
    rows = rows.join(common.small(many), same & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    slice_ = F.coalesce(F.pmod(F.xxhash64("tie"), F.ceil(F.col("_n") * 2 / tied).cast("long")), F.lit(0))
    share = F.shiftleft(F.coalesce(F.pmod("turn", F.lit(block)), F.lit(0)), 40) + slice_
    return rows.withColumn("share", F.when(F.col("_full"), share).otherwise(0).cast("long")).drop("_key", "_b", "_turn", "_n", "_full")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, key: str = "conv_id", block: int = BLOCK, tied: int = TIED) -> DataFrame:
    """Windows of every conversation of turns (key, turn, role, text).

    key, block, share, window (their order), text, loss (array of start and end in code points), repeated (turns and parts at the
    beginning that other windows have as their own), n_tokens.
    """
    path = tokenizer or default_tokenizer()
    kind = dict(turns.dtypes)[key]
    system_most, history_most = int(budget * SYSTEM_SHARE), int(budget * HISTORY_SHARE)
    # Beside the repeated system turn there is room for any part.
    rows = common.stored(_counted(turns, path, budget - system_most, key), "turns")
    number = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    rows = _shared(rows.withColumn("block", number), key, tied, block)
    own = rows.withColumn("own", F.lit(True))
    # What later blocks repeat: the first turn if it is a system turn, and the turns just before.
    edge = rows.groupBy(key).agg(F.min(F.struct("block", "share")).alias("_lo"), F.max(F.struct("block", "share")).alias("_hi"))
    edge = common.stored(edge.where("_lo < _hi").select(F.col(key).alias("_key"), F.col("_lo.block").alias("_b"), F.col("_lo.share").alias("_s")), "long-conversations", narrow=True)
    if not edge.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_key"))
        begins = (F.col("block") == F.col("_b")) & (F.col("share") == F.col("_s"))
        there = rows.select(key, "block", "share").distinct().join(common.small(edge), same & ~begins, "left_semi")
        there = common.stored(there.select(F.col(key).alias("_key"), F.col("block").alias("_b"), F.col("share").alias("_s")), "later-blocks", narrow=True)
        order = F.struct("turn", "hash", "tie", "part")
        first = rows.join(common.small(edge), same & begins, "left_semi").groupBy(key).agg(F.min_by(F.struct("role", "text", "n_tokens", "part"), order).alias("_t"))
        first = first.where((F.col("_t.role") == "system") & (F.col("_t.n_tokens") <= system_most) & (F.col("_t.part") == 0))
        # Each later block has a head: the system turn, or a row without a role.
        heads = there.join(first, same, "left").select(F.col("_key").alias(key), F.lit(None).cast("long").alias("turn"), "_t.role", "_t.text", F.lit(0).cast("long").alias("hash"), F.lit(-1).cast("long").alias("tie"), F.coalesce("_t.n_tokens", F.lit(0)).alias("n_tokens"), F.lit(0).alias("part"), F.col("_b").alias("block"), F.col("_s").alias("share"))
        before = rows.where((F.col("share") == 0) & (F.pmod("turn", F.lit(block)) >= block - history)).withColumn("block", F.col("block") + 1)
        before = before.join(common.small(there), same & begins, "left_semi").select(*heads.columns)
        own = own.unionByName(heads.unionByName(before).withColumn("own", F.lit(False)))
    group = [key, "block", "share"]
    cols = [*group, "own", "turn", "role", "text", "tie", "n_tokens", "part"]
    by = [*group, "own", F.col("tie") >= 0, "turn", "hash", "tie", "part"]
    ordered = own.repartition(*group).sortWithinPartitions(*by).select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for at, rows_ in groupby(_each(batches), key=lambda r: r[:3]):
            made += [(*at, *w) for w in _windows_of_block([r[3:] for r in rows_], budget, history, history_most, system_most)]
            if len(made) >= 256:
                yield _batch(made, out)
                made = []
        if made:
            yield _batch(made, out)

    schema = f"{key} {kind}, block long, share long, window int, text string, loss array<struct<start:int,end:int>>, repeated int, n_tokens int"
    out = to_arrow_schema(turns.sparkSession.createDataFrame([], schema).schema)
    return ordered.mapInArrow(run, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in b.slice(lo, 1024).columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _windows_of_block(rows: list[tuple], budget: int, history: int, history_most: int, system_most: int) -> Iterator[tuple]:
    """(window, text, loss, repeated, n_tokens); rows: own, turn, role, text, tie, n_tokens, part in order."""
    head = rows[0] if not rows[0][0] and rows[0][4] == -1 else None
    turns = rows[1:] if head else rows
    first = sum(not r[0] for r in turns)
    tokens = np.array([r[5] for r in turns], dtype=np.int64)
    # A conversation's first block has its system turn as a row of its own; later ones have a head, with or without a role.
    lead = head is None and turns[0][2] == "system" and turns[0][5] <= system_most and turns[0][6] == 0
    system = turns[0] if lead else head if head and head[2] is not None else None
    if lead:
        # The first window begins with the system turn itself; later ones repeat it and never as history.
        spans = windows_of(tokens[1:], 0, int(tokens[0]), budget, history, history_most) or [(0, 0, 0)]
        whole = [(h + 1, s + 1, e + 1) for h, s, e in spans]
    else:
        whole = windows_of(tokens, first, system[5] if system else 0, budget, history, history_most)
    for w, (h, s, e) in enumerate(whole):
        text, loss, at, n = [], [], 0, 0
        again = [system] if system and not (lead and w == 0) else []
        begin = [turns[0]] if lead and w == 0 else []
        for own, r in [*((False, r) for r in again), *((True, r) for r in begin), *((False, r) for r in turns[h:s]), *((True, r) for r in turns[s:e])]:
            x, lo, hi = written(r[2], r[3], r[6] > 1)
            if own and r[2] == "assistant" and hi > lo:
                loss.append({"start": at + lo, "end": at + hi})
            text.append(x)
            at, n = at + len(x), n + r[5]
        yield w, "".join(text), loss, len(again) + s - h, n


def read_back(found: DataFrame, key: str = "conv_id") -> DataFrame:
    """For each conversation what its windows hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows are parsed in order; what they repeat is left out, parts are joined, and texts are unescaped.
    """
    kind = dict(found.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv, rows in groupby(_each(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = whole = 0
            for _, text, spans, repeated in rows:
                whole += len(text)
                for i, (role, said, more) in enumerate(parsed(text)):
                    if i < repeated:
                        continue
                    if not more:
                        turns.update(f"{'' if n == 0 else chr(10)}{role}\n".encode())
                        n += 1
                    turns.update(said.encode())
                for span in spans:
                    said = unescaped(text[span["start"] : span["end"]])
                    chars += len(said)
                    loss.update(said.encode())
            turns.update(b"\n")
            made.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole))
            if len(made) >= 4096:
                yield _batch(made, out)
                made = []
        if made:
            yield _batch(made, out)

    schema = f"{key} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)
    ordered = found.select(key, "text", "loss", "repeated", "block", "share", "window").repartition(key).sortWithinPartitions(key, "block", "share", "window")
    return ordered.select(key, "text", "loss", "repeated").mapInArrow(run, schema)


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"  # fixed value of the contract
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], turns.schema)
    return read_back(windows(turns.unionByName(more)))


QUERIES = {"op13_chat_windows": op13_chat_windows}
ORACLES: dict[str, str] = {}
