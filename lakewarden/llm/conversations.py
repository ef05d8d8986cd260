"""Repair of conversation structure with the fewest edits.

A sound conversation is empty or reads: a system message or none, then pairs of user and
assistant.  Messages may be kept, given another role, deleted, or empty ones inserted, at
a cost each.  Four states (nothing yet, after system, after user, after assistant) carry
the cheapest costs.

The edits are found by divide and conquer in linear space: cost vectors of the four
states run forward over the first half of a conversation and backward over the second,
the states where their sum is least are the optimal crossings, and the one whose first
half has the least audit (the string of edits' initials) is taken; then each half is
solved alike.  Inserted messages go with the message behind them, so that no audit of a
half is the beginning of another and the least halves make the least whole.

What the search needs of a message is one letter.  Letters are gathered in ranges of the
ordered conversation first, so a very long one is not gathered row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import SPACES
from lakewarden.session import work_folder

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
# Where a message with each initial leads from each state; an insert or a new role leads the same way.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60
# Cost from each state to the end: nothing and after assistant are sound, the others need messages.
END = (0, 2 * INSERT, INSERT, 0)
# A letter for each initial (system, user, assistant, another) and fault (none, truncated, blank, duplicate).
LETTERS = "abcdefghijklmnop"
NONE, CUT, BLANK, SAME = range(4)
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
SCHEMA = ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n in NAMES)


@lru_cache(maxsize=None)
def edits(letter: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state, what may be done with a message: cost, audit (inserts first), state behind it.

    More than two inserts in a row only return to a state at a cost.
    """
    initial, fault = divmod(LETTERS.index(letter), 4)
    out = []
    for state in range(4):
        some, at = [], state
        for inserts in range(3):
            cost, audit = inserts * INSERT, "I" * inserts
            some.append((cost + DELETE, audit + "D", at))
            if fault in (NONE, CUT):
                more = TRUNCATED if fault == CUT else 0
                kept = STEPS.get((at, "sua?"[initial]))
                if kept is not None:
                    some.append((cost + more, audit + "K", kept))
                some.append((cost + more + REROLE, audit + "R", NEXT[at]))
            at = NEXT[at]
        out.append(tuple(some))
    return tuple(out)


def forward(letters: str, low: int, high: int, start: int) -> list[int]:
    """Least cost from a state in front of the messages to each state behind them."""
    costs = [FAR] * 4
    costs[start] = 0
    for k in range(low, high):
        after = [FAR] * 4
        for state, options in enumerate(edits(letters[k])):
            if costs[state] < FAR:
                for cost, _, to in options:
                    after[to] = min(after[to], costs[state] + cost)
        costs = after
    return costs


def backward(letters: str, low: int, high: int, ends: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each state in front of the messages to the end, given that from each state behind them."""
    for k in range(high - 1, low - 1, -1):
        ends = tuple(min(cost + ends[to] for cost, _, to in options) for options in edits(letters[k]))
    return ends


def solve(letters: str, low: int, high: int, start: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """The least audit among the cheapest ways over some messages, and the state it leads to.

    ``ends`` is the cost from each state behind them to the end; states it rules out cost ``FAR``.
    """
    if high - low == 1:
        options = edits(letters[low])[start]
        least = min(cost + ends[to] for cost, _, to in options)
        return min((audit, to) for cost, audit, to in options if cost + ends[to] == least)
    middle = (low + high) // 2
    before, behind = forward(letters, low, middle, start), backward(letters, middle, high, ends)
    least = min(map(sum, zip(before, behind)))
    # Only optimal crossings stay open to the first half, which takes the one of the least audit.
    crossings = tuple(b if a + b == least else FAR for a, b in zip(before, behind))
    first, state = solve(letters, low, middle, start, crossings)
    second, state = solve(letters, middle, high, state, ends)
    return first + second, state


def repair(letters: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation; ties go to the least audit."""
    if not letters:
        return 0, ""
    audit, state = solve(letters, 0, len(letters), START, END)
    return backward(letters, 0, len(letters), END)[START], audit + "I" * (END[state] // INSERT)


def _fault(text: Column) -> Column:
    """The fault that a message's text shows by itself."""
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), NONE).otherwise(CUT)


def _messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls, and a digest that stands for both."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.concat(
                           F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))


def plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` has conv_id, turn, role and text; ``ids``, if given, has the conv_id of
    conversations that may have no rows.  Messages stand in order of their turn, nulls
    first; ties by a digest of role and text, so equal messages are neighbours.  A null
    role or text is one space; a null conv_id is a conversation like another.  Only
    turns, digests and letters move; texts do not.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "conversations")
    messages = _messages(rows)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    counted = messages.groupBy("conv_id", "turn", "digest", initial.alias("initial"), _fault(F.col("text")).alias("fault")
                               ).agg(F.count(F.lit(1)).alias("n"))
    counted.write.parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted")
    # The first turn of messages that stand in several; this side is stored, so that a common message is split.
    again = counted.filter(F.col("fault") != BLANK).groupBy("conv_id", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first").write.parquet(f"{folder}/again")
    again = spark.read.parquet(f"{folder}/again")
    joined = counted.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    own = F.when(F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn")), 1).otherwise(0)
    more = F.col("n") - F.when(F.col("fault") == BLANK, F.col("n")).otherwise(own)

    def letter(fault: Column) -> Column:
        return F.substring(F.lit(LETTERS), (F.col("initial") * 4 + fault + 1).cast("int"), F.lit(1))

    piece = F.concat(F.repeat(letter(F.col("fault")), (F.col("n") - more).cast("int")),
                     F.repeat(letter(F.lit(SAME)), more.cast("int")))
    pieces = joined.select("conv_id", "turn", "digest", piece.alias("piece"))
    pieces.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()).write.parquet(
        f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")

    def gathered(order: list[str], value: str) -> Column:
        items = F.array_sort(F.collect_list(F.struct(*[x.alias(f"o{k}{y}") for k, c in enumerate(order) for y, x in (
            ("", F.col(c).isNotNull()), ("v", F.col(c)))], F.col(value).alias("value"))))
        return F.array_join(F.transform(items, lambda x: x["value"]), "").alias("letters")

    parts = pieces.groupBy("conv_id", "part").agg(gathered(["turn", "digest"], "piece"))
    letters = parts.groupBy("conv_id").agg(gathered(["part"], "letters"))
    spread = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    turns = pieces.select(F.col("conv_id").alias("c"), "turn").distinct().groupBy("c").agg(spread)
    found = letters.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "letters", "gaps")
    if ids is not None:
        every = ids.select(F.col("`conv_id`").cast("long").alias("i")).distinct()
        found = every.join(found, F.col("i").eqNullSafe(F.col("conv_id")), "left").select(
            F.col("i").alias("conv_id"), F.coalesce("letters", F.lit("")).alias("letters"),
            F.coalesce("gaps", F.lit(0)).alias("gaps"))

    def planned(batches):
        for batch in batches:
            ids, letters, gaps = (c.to_pylist() for c in batch.columns)
            ends = [repair(x) for x in letters]
            faults = [[LETTERS.index(c) % 4 for c in x] for x in letters]
            firsts = [["suao"[LETTERS.index(c) // 4] for c in x] for x in letters]
            counts = [[f.count(kind) for f in faults] for kind in (BLANK, SAME, CUT)]
            illegal = [sum(a + b not in ("su", "ua", "au") for a, b in pairwise(x)) for x in firsts]
            columns = [ids, gaps, *counts, illegal, [c for c, _ in ends]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(
                [a for _, a in ends], pa.string())], names=NAMES)

    found.mapInArrow(planned, SCHEMA).write.parquet(f"{folder}/plans")
    return spark.read.parquet(f"{folder}/plans")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The edits of every conversation as messages: conv_id, position, edit, role, text.

    ``plan`` is the result of ``plans``.  Deleted messages have no position.  The rows of
    a conversation stand in one partition, in order, and pass one by one, so that its
    length costs time but no memory.
    """
    texts = _messages(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    heads = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long"), F.lit(None).cast("binary"),
                        F.lit(""), "audit")
    ordered = heads.toDF(*texts.columns).unionByName(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "digest").select("conv_id", "kind", "role", "text")

    def edited(batches):
        rest, conv, state, position = iter(()), None, START, 0
        out: list[tuple] = []

        def inserts(upcoming: Iterator[str]) -> str | None:
            nonlocal state, position
            for edit in upcoming:
                if edit != "I":
                    return edit
                state = NEXT[state]
                out.append((conv, position, edit, ROLES[state], ""))
                position += 1
            return None

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*some)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["conv_id", "position", "edit", "role", "text"])

        for batch in batches:
            for next_conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    inserts(rest)
                    rest, conv, state, position = iter(text), next_conv, START, 0
                    continue
                edit = inserts(rest)
                if edit == "D":
                    out.append((conv, None, edit, role, text))
                    continue
                if edit == "R":
                    state = NEXT[state]
                    role = ROLES[state]
                else:
                    state = STEPS[state, role[:1]]
                out.append((conv, position, edit, role, text))
                position += 1
            yield batch_of(out)
            out.clear()
        inserts(rest)
        yield batch_of(out)

    return ordered.mapInArrow(edited, "conv_id long, position long, edit string, role string, text string")


def digests(messages: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the ``role:text`` of each conversation's messages, joined by line ends.

    ``messages`` is the result of ``repaired``, read as it comes, a conversation's rows in order.
    """
    def hashed(batches):
        conv, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for next_conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
                if edit == "D":
                    continue
                if state is None or next_conv != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = next_conv, sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array(
                [d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())],
                                             names=["conv_id", "repaired_sha256"])

    return messages.mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the message, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3
    repeats it with the same turn, 4 makes its role user.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text"))
    blank = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(role.cast("string"), blank), F.coalesce(text.cast("string"), blank)
    told = rows.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("kind")).filter("kind <> 0")
    return told.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(
        F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its plan's figures and the digest of the repaired messages."""
    plan = plans(rows, ids)
    hashes = digests(repaired(rows, plan)).select(F.col("conv_id").alias("c"), "repaired_sha256")
    empty = F.lit(sha256().hexdigest())
    return plan.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *NAMES, F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
