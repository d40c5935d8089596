"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate.

Roles, by their initials, have to read `(s?(ua)+)?`: nothing, or an optional system message and then
user and assistant in turn. A row that is blank, or repeats the role and text of an earlier one, has
to be deleted (2); others are kept (0), get the role that the grammar asks for (1), or are deleted
(2); an empty message can be put anywhere (5); a truncated row that stays costs 5 more.

The method is that of Wu and Manber's bit-parallel matching with errors, read from the end: for each
cost, one after the other, a bitset of the grammar states is kept for each turn, from which the rest
can be accepted at exactly that cost. A layer follows from the layers one, two, five and six below
it, and the first one that holds the start state gives the cost. The edits are traced through the
same bits from the front, with the least initial that a bit allows, which gives the least audit.

Rows are sorted by range, not gathered by conversation, and cut into segments of at most 64 rows and
1 MiB. Nearly all conversations are one segment. For the others, layers that start with all four
states at once give each segment's cost from state to state; these are multiplied backwards, first
over the segments of a partition and then over partitions, so that each segment learns what the rest
costs from each state; traces from all four states give its end state for each, which lead forwards
to the state it starts with. Only the digest of a repaired text is taken in one piece, since
SHA-256 has no other form; it streams, with segments as its rows.

Null roles and texts are taken as one space; rows go by turn with nulls first, then by role and by the
hash of the text; a null conversation is one of its own; turns can repeat; extra columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SEGMENT_ROWS, SEGMENT_BYTES = 64, 1 << 20

#: Grammar states: 0 nothing yet, 1 behind a system message, 2 behind a user's, 3 behind an assistant's. The state behind the message that each asks for.
_NEXT = (2, 2, 3, 2)
#: Cost of the end of a conversation from each state, and of a state that can't be reached.
_END, _FAR = (0, 10, 5, 0), 1 << 40
_LEGAL = {"su", "ua", "au"}

# --- cost layers ---
# A word holds a block of four bits for each state; the bits of a block stand for up to four goals.


def _asked(word: int) -> int:
    """States from which the message that the grammar asks for leads into the word."""
    return (word >> 8 & 15) * 0x1011 | (word >> 12 & 15) << 8


#: States from which a kept message of each initial leads into the word.
_KEPT = {"s": lambda w: w >> 4 & 15, "u": lambda w: (w >> 8 & 15) * 0x1011, "a": lambda w: (w >> 12 & 15) << 8, "x": lambda w: 0}


def layers(kinds: str, ends: dict[int, int], wanted: int) -> list[list[int]]:
    """Words of each cost and turn; the last layer is the one in which all wanted bits have been seen at the first turn, or the last that can be.

    `kinds` has a letter for each row: the initial s, u, a, or x for another, as a capital if the
    row is truncated, or D if it has to go. `ends` has the word behind the last row for each cost.
    """
    n, out, seen = len(kinds), [], 0
    none = [0] * (n + 1)
    most = 2 * n + 20 + max(ends)
    while len(out) <= most:
        cost = len(out)
        layer = none[:]
        out.append(layer)
        layer[n] = ends.get(cost, 0)
        two, five = out[cost - 2] if cost > 1 else none, out[cost - 5] if cost > 4 else none
        one, six = out[cost - 1] if cost else none, out[cost - 6] if cost > 5 else none
        for i in range(n - 1, -1, -1):
            kind = kinds[i]
            word = two[i + 1]
            if five[i]:
                word |= _asked(five[i])
            if kind != "D":
                cut = kind.isupper()
                kept, named = (five, six) if cut else (layer, one)
                if kept[i + 1]:
                    word |= _KEPT[kind.lower()](kept[i + 1])
                if named[i + 1]:
                    word |= _asked(named[i + 1])
            layer[i] = word
        seen |= layer[0]
        if seen & wanted == wanted:
            break
    return out


def costs(kinds: str) -> list[int]:
    """Least cost of the rows from state s to state t, at 4 * s + t."""
    out = [_FAR] * 16
    for cost, layer in enumerate(layers(kinds, {0: 0x8421}, 0xFFFF)):
        for bit in range(16):
            if layer[0] >> bit & 1 and out[bit] == _FAR:
                out[bit] = cost
    return out


def _ends(ahead: list[int] | tuple[int, ...]) -> dict[int, int]:
    least, out = min(ahead), {}
    for state, cost in enumerate(ahead):
        if cost < _FAR:
            out[cost - least] = out.get(cost - least, 0) | 1 << 4 * state
    return out


def traces(kinds: str, ahead: list[int] | tuple[int, ...], starts: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """(cost with what is ahead, edits, end state) from each of these states: the cheapest edits, of these the least."""
    wanted = sum(1 << 4 * s for s in starts)
    found = layers(kinds, _ends(ahead), wanted)
    least, n, out = min(ahead), len(kinds), []
    for start in starts:
        cost = left = next((k for k, layer in enumerate(found) if layer[0] >> 4 * start & 1), None)
        if cost is None:
            out.append((_FAR, "", start))
            continue
        state, i, edits = start, 0, []
        while i < n:
            kind = kinds[i]
            extra = 5 if kind.isupper() and kind != "D" else 0
            kept = {"s": 1, "u": 2, "a": 3}.get(kind.lower(), -1) if kind != "D" else -1
            if kept == 1 and state != 0 or kept > 1 and kept != _NEXT[state]:
                kept = -1
            if left >= 2 and found[left - 2][i + 1] >> 4 * state & 1:
                edit, left, i = "D", left - 2, i + 1
            elif left >= 5 and found[left - 5][i] >> 4 * _NEXT[state] & 1:
                edit, left, state = "I", left - 5, _NEXT[state]
            elif kept >= 0 and left >= extra and found[left - extra][i + 1] >> 4 * kept & 1:
                edit, left, state, i = "K", left - extra, kept, i + 1
            else:
                edit, left, state, i = "R", left - 1 - extra, _NEXT[state], i + 1
            edits.append(edit)
        out.append((cost + least, "".join(edits), state))
    return out


def tail(state: int) -> str:
    """The messages to be put behind the last row."""
    return "I" * (_END[state] // 5)


_WORDS = {2: "user", 3: "assistant"}


def applied(edits: str, start: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The edited rows: edit, role and text of each; deleted rows stay as they were."""
    out, state, i = [], start, 0
    for edit in edits:
        if edit == "D":
            out.append({"edit": edit, "role": roles[i], "text": texts[i]})
            i += 1
            continue
        state = 1 if edit == "K" and roles[i][:1] == "s" else _NEXT[state]
        role = roles[i] if edit == "K" else _WORDS[state]
        out.append({"edit": edit, "role": role, "text": "" if edit == "I" else texts[i]})
        i += edit != "I"
    return out


# --- rows and segments ---

_KEY = ["missing", "conv"]


def _rows(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    own = messages.select(
        F.col(conv).isNull().alias("missing"), F.coalesce(F.col(conv).cast("bigint"), F.lit(0)).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    return own.withColumn("h", F.md5(F.col("text").cast("binary"))).withColumn("uid", F.monotonically_increasing_id())


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("uid"))


def faults(rows: DataFrame) -> DataFrame:
    """`rows` with a column kind. A row repeats an earlier one if it isn't the first of its conversation, role and text."""
    groups = rows.groupBy(*_KEY, "role", "h").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    again = c.materialise(groups.filter("n > 1").select(*_KEY, "role", "h", "first"))
    joined = c.join_small(rows, again, [*_KEY, "role", "h"], "left", again.count() * 4)  # keys with a text take about four numbers' room
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    repeated = F.coalesce(F.col("first") < _place(), F.lit(False))
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    fault = F.when(blank, "b").when(repeated, "d").when(~whole, "t").otherwise("")
    return joined.withColumn("fault", fault).withColumn("initial", initial).drop("first")


_SEGMENT = (
    "missing boolean, conv bigint, part int, segment int, whole boolean, kinds string, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first_role string, last_role string, costs array<bigint>"
)


def segments(rows: DataFrame) -> DataFrame:
    """Rows in order, as segments; a segment that isn't whole has its costs from state to state."""
    ordered = rows.repartitionByRange(*_KEY, F.asc_nulls_first("turn"), "role", "h", "uid").sortWithinPartitions(*_KEY, F.asc_nulls_first("turn"), "role", "h", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([
            ("missing", pa.bool_()), ("conv", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("whole", pa.bool_()), ("kinds", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
            *[(x, pa.int64()) for x in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn")], ("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())),
        ])
        done: list[dict] = []
        # The segment that is being filled, the last row's key, turn and role, and the number of conversations begun.
        now, last, begun, held = None, None, 0, 0

        def close(ends_conversation: bool) -> None:
            now["whole"] = ends_conversation and now["segment"] == 0 and begun > 1
            now["costs"] = None if now["whole"] else costs(now["kinds"])
            done.append(now)

        for batch in batches:
            for missing, conv, turn, role, text, fault, initial in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                key = (missing, conv)
                fresh = last is None or last[0] != key
                size = len(text) * 4
                if fresh or len(now["kinds"]) >= SEGMENT_ROWS or held + size > SEGMENT_BYTES:
                    number = 0 if fresh else now["segment"] + 1
                    if now is not None:
                        close(fresh)
                    begun += fresh
                    held = 0
                    now = {"missing": missing, "conv": conv, "part": part, "segment": number, "kinds": "", "roles": [], "texts": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "first_turn": turn, "first_role": role[:1]}
                held += size
                now["kinds"] += "D" if fault in ("b", "d") else initial.upper() if fault else initial
                now["roles"].append(role)
                now["texts"].append(text)
                for letter, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated")):
                    now[name] += fault == letter
                if not fresh:
                    now["illegal"] += last[2] + role[:1] not in _LEGAL
                if turn is not None:
                    now["turns"] += fresh or last[1] != turn
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                now["last_turn"], now["last_role"] = turn, role[:1]
                last = (key, turn, role[:1])
                if len(done) >= 256:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done.clear()
        if now is not None:
            close(False)
            yield pa.RecordBatch.from_pylist(done, schema)

    return c.small_batches(ordered.select(*_KEY, "turn", "role", "text", "fault", "initial")).mapInArrow(run, _SEGMENT)


# --- conversations of several segments ---


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _matrix(flat) -> np.ndarray:
    return np.array(flat, np.int64).reshape(4, 4)


def _part_costs(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("segment")
    total = _matrix(frame["costs"].iloc[0])
    for flat in frame["costs"].iloc[1:]:
        total = _product(total, _matrix(flat))
    return pd.DataFrame({"missing": frame["missing"].iloc[:1], "conv": frame["conv"].iloc[:1], "part": frame["part"].iloc[:1], "costs": [total.ravel().tolist()]})


def _ahead(frame: pd.DataFrame) -> pd.DataFrame:
    """What is ahead behind each part of a conversation, and the cost of all of it."""
    frame = frame.sort_values("part", ascending=False)
    ahead, out = np.array(_END, np.int64), []
    for flat in frame["costs"]:
        out.append(ahead.tolist())
        ahead = np.minimum((_matrix(flat) + ahead[None, :]).min(axis=1), _FAR)
    last = [True] + [False] * (len(frame) - 1)
    return pd.DataFrame({"missing": frame["missing"].to_numpy(), "conv": frame["conv"].to_numpy(), "part": frame["part"].to_numpy(), "ahead": out, "last_part": last, "cost": int(ahead[0])})


def _within(frame: pd.DataFrame) -> pd.DataFrame:
    """What is ahead behind each segment of a part, and its start state for each start state of the part."""
    frame = frame.sort_values("segment", ascending=False)
    ahead, aheads, exits = np.array(frame["ahead"].iloc[0], np.int64), [], []
    for flat, kinds in zip(frame["costs"], frame["kinds"], strict=True):
        aheads.append(ahead.tolist())
        exits.append([end for _, _, end in traces(kinds, ahead.tolist(), (0, 1, 2, 3))])
        ahead = np.minimum((_matrix(flat) + ahead[None, :]).min(axis=1), _FAR)
    state, starts = [0, 1, 2, 3], []
    for leads in reversed(exits):
        starts.append(state)
        state = [leads[s] for s in state]
    frame = frame[["missing", "conv", "part", "segment", "last_part"]].iloc[::-1].reset_index(drop=True)
    frame["ahead"], frame["starts"] = aheads[::-1], starts
    frame["leads"] = [None] * (len(frame) - 1) + [state]
    return frame


def _starts(frame: pd.DataFrame) -> pd.DataFrame:
    """Start state of each part, and what its ends add to the counts of the conversation."""
    frame = frame.sort_values("part")
    state, out, illegal, same, before = 0, [], 0, 0, None
    for row in frame.itertuples():
        out.append(state)
        state = row.leads[state]
        if before is not None:
            illegal += before.last_role + row.first_role not in _LEGAL
            same += not pd.isna(row.first_turn) and not pd.isna(before.last_turn) and before.last_turn == row.first_turn
        before = row
    return pd.DataFrame({"missing": frame["missing"].to_numpy(), "conv": frame["conv"].to_numpy(), "part": frame["part"].to_numpy(), "begins": out, "more_illegal": [illegal] + [0] * (len(out) - 1), "same_turns": [same] + [0] * (len(out) - 1)})


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Repaired messages and conversations.

    The first has a row for each segment, in order of part and segment within a conversation: its
    edits, and edit, role and text of each message (deleted ones included). The second has gaps
    between turns, the number of rows by fault and of illegal neighbours, and the cost of the edits.
    """
    rows = faults(_rows(messages, conv_col, turn_col, role_col, text_col))
    found = c.materialise(segments(rows))
    keys, at = _KEY, [*_KEY, "part"]
    named = "missing boolean, conv bigint, part int, "
    opened = found.filter("not whole")
    parts = c.materialise(opened.select(*at, "segment", "costs").groupBy(*at).applyInPandas(_part_costs, named + "costs array<bigint>"))
    ahead = c.materialise(parts.groupBy(*keys).applyInPandas(_ahead, named + "ahead array<bigint>, last_part boolean, cost bigint"))
    ways = c.materialise(
        opened.select(*at, "segment", "costs", "kinds").join(ahead.select(*at, "ahead", "last_part"), at).groupBy(*at)
        .applyInPandas(_within, named + "segment int, last_part boolean, ahead array<bigint>, starts array<int>, leads array<int>")
    )
    ends = opened.groupBy(*at).agg(
        *[F.sum(x).alias(x) for x in (*_COUNTS, "turns")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.min(F.struct("segment", "first_turn", "first_role")).alias("f"), F.max(F.struct("segment", "last_turn", "last_role")).alias("l"),
    )
    chunks = c.materialise(ends.select(*at, *_COUNTS, "turns", "low", "high", "f.first_turn", "f.first_role", "l.last_turn", "l.last_role").join(ways.filter("leads is not null").select(*at, "leads"), at))
    begins = c.materialise(
        chunks.select(*at, "leads", "first_turn", "first_role", "last_turn", "last_role").groupBy(*keys).applyInPandas(_starts, named + "begins int, more_illegal bigint, same_turns bigint")
    )
    steps = ways.join(begins.select(*at, "begins"), at).select(*at, "segment", "ahead", F.element_at("starts", F.col("begins") + 1).alias("start"), (F.col("last_part") & F.col("leads").isNotNull()).alias("last"))
    edited = c.materialise(_edited(found, steps))
    counts = [F.sum(x).alias(x) for x in (*_COUNTS, "turns")]
    whole = found.filter("whole").select(*keys, *_COUNTS, "turns", "low", "high").join(edited.filter("whole").select(*keys, "cost"), keys)
    split = chunks.join(begins.drop("begins"), at).withColumn("illegal", F.col("illegal") + F.col("more_illegal")).withColumn("turns", F.col("turns") - F.col("same_turns"))
    split = split.groupBy(*keys).agg(*counts, F.min("low").alias("low"), F.max("high").alias("high")).join(ahead.groupBy(*keys).agg(F.max("cost").alias("cost")), keys)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return edited, whole.unionByName(split).select(*keys, gaps, *_COUNTS, "cost")


_MESSAGES = "array<struct<edit:string,role:string,text:string>>"


def _edited(found: DataFrame, steps: DataFrame) -> DataFrame:
    """Segments with their edits and messages; those of `steps` begin and go on as it says."""
    own = ["missing", "conv", "part", "segment", "whole", "kinds", "roles", "texts"]
    single = found.filter("whole").select(*own, F.array(*map(F.lit, _END)).cast("array<bigint>").alias("ahead"), F.lit(0).alias("start"), F.lit(True).alias("last"))
    several = found.filter("not whole").select(*own).join(steps, ["missing", "conv", "part", "segment"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        audits, messages, totals = [], [], []
        for kinds, roles, texts, ahead, start, last in zip(*(batch.column(i).to_pylist() for i in range(5, 11)), strict=True):
            [(cost, edits, end)] = traces(kinds, ahead, (start,))
            edits += tail(end) if last else ""
            audits.append(edits)
            messages.append(applied(edits, start, roles, texts))
            totals.append(cost)
        kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(audits, pa.string()), pa.array(totals, pa.int64()), pa.array(messages, kind)], ["missing", "conv", "part", "segment", "whole", "audit", "cost", "messages"])

    return c.map_rows(single.unionByName(several), run, f"missing boolean, conv bigint, part int, segment int, whole boolean, audit string, cost bigint, messages {_MESSAGES}")


def digests(edited: DataFrame) -> DataFrame:
    """(missing, conv, audit, repaired_sha256): edits of each conversation, and the hash of its `role:text` lines."""
    lines = F.array_join(F.transform(F.filter("messages", lambda m: m["edit"] != "D"), lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    single = edited.filter("whole").select(*_KEY, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    kept = F.exists("messages", lambda m: m["edit"] != "D")
    several = edited.filter("not whole").select(*_KEY, "part", "segment", "audit", F.when(kept, lines.cast("binary")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, begun = None, None, False
        names = ["missing", "conv", "repaired_sha256"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.bool_()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names)

        for batch in batches:
            for missing, conv, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != (missing, conv):
                    if key is not None:
                        yield row()
                    key, digest, begun = (missing, conv), hashlib.sha256(), False
                if chunk.is_valid:
                    if begun:
                        digest.update(b"\n")
                    digest.update(chunk.as_buffer())
                    begun = True
        if key is not None:
            yield row()

    streams = several.select(*_KEY, "lines", "part", "segment").repartition(*_KEY).sortWithinPartitions(*_KEY, "part", "segment").select(*_KEY, "lines")
    hashes = c.small_batches(streams).mapInArrow(run, "missing boolean, conv bigint, repaired_sha256 string")
    audits = several.groupBy(*_KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "segment", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    return single.unionByName(audits.join(hashes, _KEY))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user, by a hash of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    what = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    out = conversations.select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), what.alias("what"),
    ).filter("what <> 0")
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost and edits of every conversation, after damage."""
    given = c.table(spark, sf_dir, "conversations")
    edited, counts = repair(damaged(given))
    ids = given.select(F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0)).alias("conv")).distinct()
    out = ids.join(counts, _KEY, "left").join(digests(edited), _KEY, "left")
    zero = [F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("gaps", *_COUNTS, "cost")]
    return out.select(F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _step() -> str:
    """SQL for the best (cost, audit, text) of each state behind one more row, from the best p0 to p3 before it."""

    def add(p: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN {p}.c < 99999999 THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{letter}', 't': {line}}} ELSE far END"

    def line(p: str, role: str) -> str:
        return f"{p}.t || {role} || ':' || text || chr(10)"

    out = []
    for state in range(4):
        ways = [add(f"q{state}", "2", "D", f"q{state}.t")]
        for before in range(4):
            q = f"q{before}"
            if _NEXT[before] == state:
                ways.append(f"CASE WHEN must THEN far ELSE {add(q, '1 + extra', 'R', line(q, chr(39) + _WORDS[state] + chr(39)))} END")
                ways.append(f"CASE WHEN must OR r <> '{'?sua'[state]}' THEN far ELSE {add(q, 'extra', 'K', line(q, 'role'))} END")
        if state == 1:
            ways.append(f"CASE WHEN must OR r <> 's' THEN far ELSE {add('q0', 'extra', 'K', line('q0', 'role'))} END")
        out.append(f"{_least(*ways)} AS p{state}")
    return ", ".join(out)


def _put(names: str, give: str) -> str:
    """SQL for the best of each state with a message put in: from 0, 1 and 3 to 2, and from 2 to 3; two rounds are enough."""

    def add(p: str, role: str) -> str:
        return f"CASE WHEN {p}.c < 99999999 THEN {{'c': {p}.c + 5, 'a': {p}.a || 'I', 't': {p}.t || '{role}:' || chr(10)}} ELSE far END"

    n = names
    return f"{n}0 AS {give}0, {n}1 AS {give}1, {_least(f'{n}2', *(add(f'{n}{s}', 'user') for s in (0, 1, 3)))} AS {give}2, {_least(f'{n}3', add(f'{n}2', 'assistant'))} AS {give}3"


_CRC = "list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint), lambda x, y: xor(x >> 8, t.t[(xor(x, y) & 255) + 1]), 4294967295)"
_SQL = rf"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) AS v FROM range(256) r(b))),
w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")}, 4294967295) % 20 AS k FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM w WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
g AS (SELECT conv_id, i, role, text, r, blank OR again AS must, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM f),
z AS (SELECT {{'c': 99999999, 'a': '', 't': ''}} AS far),
s AS (SELECT conv_id, 0::bigint AS i, {{'c': 0, 'a': '', 't': ''}} AS p0, far AS p1, far AS p2, far AS p3 FROM n, z
    UNION ALL SELECT conv_id, i, {_step()} FROM (
        SELECT g.conv_id, g.i, role, text, r, must, extra, far, {_put('e', 'q')} FROM (
            SELECT s.conv_id, s.i AS j, far, {_put('p', 'e')} FROM s, z) e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.j + 1)),
l AS (SELECT conv_id, {_put('e', 'q')}, gaps, blank, duplicate, truncated, illegal FROM (SELECT n.conv_id, far, {_put('p', 'e')}, gaps, blank, duplicate, truncated, illegal FROM z, s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n = s.i)),
a AS (SELECT *, least(q0, q3) AS best FROM l)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::bigint AS cost, coalesce(best.a, '') AS audit,
    sha256(coalesce(best.t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op12_turn_repair": op12_turn_repair}
ORACLES = {"op12_turn_repair": _SQL}
