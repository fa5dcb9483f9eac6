"""Repair of the role structure of conversations: the cheapest edits, found by an integer shortest path over a DAG.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4, forced for blank rows and duplicates); anywhere an empty
user or assistant row can be put in: Insert (3). A truncated row that stays adds 3. The roles left must read `(s?(ua)+)?`, by their initials.

The weight of a path is one integer. Its high digits are the cost; its low digits, base 8 and of a fixed number, spell the letters
of the edits from the first on and end in zeros, so that the least integer is the cheapest path and, among those, the one of the
ASCII-least letters. Rows stand for the layers of the DAG, the four states of the pattern for its nodes.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds a third of all rows is spread over many tasks. Each task
turns every run of up to RUN rows into a 4 by 4 table of such integers, from each state to each; only these meet in one place. Two
paths of one run with the same cost never spell a word and its beginning (a letter more would be an insert, which costs), so the best of a
concatenation is made of best parts and the runs can be joined. The hash of a repaired conversation needs its texts in order: there
a conversation's rows stream through one task, one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shielded

#: Rows that one table of integers stands for, at most.
RUN = 1024

#: Letters as digits in ASCII order; 0 ends a word.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. Where u or a leads from each, and the role that stands there.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
FINAL = (0, 3)

BLANK_TEXT = r"^[\x20\x09-\x0D]*\z"
TRUNCATED_TEXT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def _kept(state: int, initial: str) -> int | None:
    """Where a kept row of this role leads."""
    if initial == "s":
        return 1 if state == 0 else None
    if (initial == "u" and state != 2) or (initial == "a" and state == 2):
        return NEXT[state]
    return None


def solve(rows: list[tuple[str, bool, bool]]) -> list[list[tuple[int, int] | None]]:
    """rows: initial of the role, whether it must go, whether it is truncated. For each pair of states the least (cost, word), the word
    as an integer of base-8 digits without end padding; None where no edits lead from one to the other."""
    width = 2 * len(rows) + 1
    top, unit = 3 * (width - 1), 1 << 3 * width
    mask = unit - 1

    def before(weight: int | None, cost: int, letter: int) -> int | None:
        """The weight of a path with one more edit before it."""
        if weight is None:
            return None
        low = weight & mask
        return weight - low + cost * unit + (letter << top) + (low >> 3)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    table: list[list[tuple[int, int] | None]] = [[None] * 4 for _ in range(4)]
    for end in range(4):
        own = [0 if s == end else None for s in range(4)]
        # Two inserts in one gap lead back to where they began or to less than where they began, so one is enough.
        own = [least(own[s], before(own[NEXT[s]], 3, INSERT)) for s in range(4)]
        for initial, goes, cut in reversed(rows):
            after, own = own, [before(own[s], 4, DELETE) for s in range(4)]
            if not goes:
                extra = 3 * cut
                for s in range(4):
                    to = _kept(s, initial)
                    own[s] = least(own[s], before(after[NEXT[s]], 3 + extra, REROLE), None if to is None else before(after[to], extra, KEEP))
            own = [least(own[s], before(own[NEXT[s]], 3, INSERT)) for s in range(4)]
        for s in range(4):
            if own[s] is not None:
                low = own[s] & mask
                padding = ((low & -low).bit_length() - 1) // 3 if low else width
                table[s][end] = (own[s] // unit, low >> 3 * padding)
    return table


def _size(word: int) -> int:
    return (word.bit_length() + 2) // 3


def cheapest(paths: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The path of the least weight, words padded to one width."""
    width = 3 * max((_size(w) for _, w in paths), default=0)
    return min(paths, key=lambda p: (p[0] << width) | (p[1] << width - 3 * _size(p[1])), default=None)


def join(left: list[list], right: list[list]) -> list[list]:
    """The table of two runs, one after the other."""

    def through(s: int, e: int) -> list[tuple[int, int]]:
        both = [(left[s][m], right[m][e]) for m in range(4) if left[s][m] is not None and right[m][e] is not None]
        return [(a[0] + b[0], a[1] << 3 * _size(b[1]) | b[1]) for a, b in both]

    return [[cheapest(through(s, e)) for e in range(4)] for s in range(4)]


def spell(word: int) -> str:
    """The letters of a word."""
    digits = oct(word)[2:] if word else ""
    return digits.translate({ord(str(i)): LETTERS[i] for i in range(1, 5)})


def _dump(table: list[list]) -> list[bytes]:
    return [b"" if x is None else x[0].to_bytes(8, "big") + x[1].to_bytes((x[1].bit_length() + 7) // 8, "big") for line in table for x in line]


def _load(cells: list[bytes]) -> list[list]:
    flat = [(int.from_bytes(x[:8], "big"), int.from_bytes(x[8:], "big")) if x else None for x in cells]
    return [flat[4 * s : 4 * s + 4] for s in range(4)]


_RUNS = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("run", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cells", pa.list_(pa.binary()))])
_LEGAL = {"su", "ua", "au"}


def _runs(most: int):
    """Sorted rows (conv, initial, blank, truncated, copies, seen) to runs of `most` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own: dict = {}
        out: list[dict] = []

        def close() -> None:
            rows = own["rows"]
            out.append({"conv": own["conv"], "part": part, "run": own["run"], "first": rows[0][0], "last": rows[-1][0], "blank": own["blank"], "duplicate": own["duplicate"], "truncated": sum(r[2] for r in rows), "illegal": sum(a[0] + b[0] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False)), "cells": _dump(solve(rows))})

        for batch in batches:
            for conv, initial, blank, cut, copies, seen in zip(*(batch.column(c).to_pylist() for c in ("conv", "initial", "blank", "cut", "copies", "seen")), strict=True):
                for i in range(copies):
                    if own and (own["conv"] != conv or len(own["rows"]) == most):
                        close()
                        own = {"conv": conv, "run": own["run"] + 1, "rows": [], "blank": 0, "duplicate": 0}
                    elif not own:
                        own = {"conv": conv, "run": 0, "rows": [], "blank": 0, "duplicate": 0}
                    again = not blank and (seen or i > 0)
                    own["blank"] += blank
                    own["duplicate"] += again
                    own["rows"].append((initial, blank or again, cut and not blank and not again))
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=_RUNS)
                out = []
        if own:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RUNS)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs to one row a conversation."""
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = pa.schema([(n, pa.string() if n in ("conv", "audit") else pa.int64()) for n in names])
    out: list[dict] = []
    own: dict = {}

    def close() -> None:
        best = cheapest([x for x in (own["table"][0][e] for e in FINAL) if x is not None])
        out.append({k: own[k] for k in names[:5]} | {"cost": best[0], "audit": spell(best[1])})

    for batch in batches:
        for r in batch.to_pylist():
            if own and own["conv"] == r["conv"]:
                own["illegal"] += r["illegal"] + (own["last"] + r["first"] not in _LEGAL)
                for k in ("blank", "duplicate", "truncated"):
                    own[k] += r[k]
                own["table"], own["last"] = join(own["table"], _load(r["cells"])), r["last"]
            else:
                if own:
                    close()
                own = {k: r[k] for k in ("conv", "blank", "duplicate", "truncated", "illegal", "last")} | {"table": _load(r["cells"])}
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
            out = []
    if own:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


def replay(audit: Iterator[str], initial: str | None, role: str, text: str, state: int) -> tuple[list[str], int]:
    """The lines that a row gives under the next letters, and the state after it; without a row (initial None) all letters left are inserts."""
    lines: list[str] = []
    for letter in audit:
        if letter == "I":
            lines.append(f"{ROLE[state]}:")
            state = NEXT[state]
            continue
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = _kept(state, initial or "")
        elif letter == "R":
            lines.append(f"{ROLE[state]}:{text}")
            state = NEXT[state]
        break
    return lines, state


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, a conversation's audit before its texts, to the hash of each repaired conversation."""
    out: list[tuple[str, str]] = []
    own: dict = {}

    def add(lines: list[str]) -> None:
        for line in lines:
            own["hash"].update((("\n" if own["any"] else "") + line).encode())
            own["any"] = True

    def close() -> None:
        add(replay(own["audit"], None, "", "", own["state"])[0])
        out.append((own["conv"], own["hash"].hexdigest()))

    for batch in batches:
        for conv, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies")), strict=True):
            if audit is not None:
                if own:
                    close()
                own = {"conv": conv, "audit": iter(audit), "hash": hashlib.sha256(), "any": False, "state": 0}
                continue
            for _ in range(copies):
                lines, own["state"] = replay(own["audit"], role[:1], role, text, own["state"])
                add(lines)
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out, strict=True)], names=["conv", "repaired"])
            out = []
    if own:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out, strict=True)], names=["conv", "repaired"])


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations after damage by crc32("conv_id:turn") modulo 20, nulls read as one space: how often each stands there is in copies.

    0 drops the row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    code = F.col("code")
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def repair_conversations(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text): its faults, the cheapest repair and the hash of what it gives.

    Rows stand in the order of turn (nulls first); rows of one turn in that of role, then of their text's hash, so that equal rows are
    neighbours. `copies` names a column that says how often a row stands there (else once). A role that is null or begins unlike
    those of the pattern is kept nowhere: its row is reroled or deleted; a null text is blank. Null conversation ids make one
    conversation. A conversation whose rows all have 0 copies gets zeros, an empty audit and the hash of the empty text; an empty table
    gives no rows. Other columns are ignored.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows.
    """
    frame, at = shielded(rows)
    role, text = (F.coalesce(F.col(at[c]).cast("string"), F.lit("")) for c in ("role", "text"))
    # A name that no null shares, for joins and orders.
    conv = F.coalesce(F.concat(F.lit("="), F.col(at["conv_id"]).cast("string")), F.lit("-"))
    full = frame.select(F.col(at["conv_id"]).alias("conv_id"), conv.alias("conv"), F.col(at["turn"]).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col(at[copies]) if copies else F.lit(1)).cast("long").alias("copies"))
    full = full.withColumn("told", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    there, order = full.where("copies > 0"), ["conv", "turn", "role", "told"]
    # Texts stay behind: a hash stands for each, and one row for equal ones.
    light = there.groupBy(*order).agg(F.sum("copies").alias("copies"), F.first(F.col("text").rlike(BLANK_TEXT)).alias("blank"), F.first(F.col("text").rlike(TRUNCATED_TEXT)).alias("cut"))
    light = cut(light)
    here = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    earliest = light.groupBy("conv", "told").agg(F.min(here).alias("least"))
    # The key of the join is made anew, so that both sides are shuffled for it and a hot one can be split.
    earliest = earliest.select(F.xxhash64("conv", "told").alias("key"), F.col("conv").alias("_conv"), F.col("told").alias("_told"), "least")
    known = light.withColumn("key", F.xxhash64("conv", "told")).join(earliest, "key").where("conv = _conv AND told = _told")
    known = known.select(*order, F.substring("role", 1, 1).alias("initial"), "blank", "cut", "copies", (here != F.col("least")).alias("seen"))
    runs = known.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs(RUN), "conv string, part int, run int, first string, last string, blank long, duplicate long, truncated long, illegal long, cells array<binary>")
    joined = runs.repartition("conv").sortWithinPartitions("conv", "part", "run")
    repaired = cut(joined.mapInArrow(_joined, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    turns = light.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    none = F.lit(None)
    texts = there.select(*order, F.lit(1).alias("after"), none.cast("string").alias("audit"), "text", "copies")
    words = repaired.select("conv", none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("told"), F.lit(0).alias("after"), "audit", F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    streams = texts.unionByName(words).repartition("conv").sortWithinPartitions("conv", "after", "turn", "role", "told")
    hashes = streams.select("conv", "audit", "role", "text", "copies").mapInArrow(_hashed, "conv string, repaired string")
    zero = F.lit(0).cast("long")
    found = full.groupBy("conv", "conv_id").agg(F.sum("copies").alias("n_rows")).join(repaired, "conv", "left").join(turns, "conv", "left").join(hashes, "conv", "left")
    return found.select("conv_id", *[F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.sha2(F.lit(""), 256)).alias("repaired_sha256"), F.coalesce("n_rows", zero).alias("n_rows"))
