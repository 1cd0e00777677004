"""Chat formatting: minimum-cost repair of roles over a legal-turn automaton, then rendering.

A legal conversation is an optional system turn, then user and assistant in turn, from a user turn on. Each turn of the
input is kept, relabelled, or merged into the turn before it, and empty turns may be inserted before any; every choice
has a cost, and dynamic programming over the automaton's four states (nothing yet, system, user, assistant) finds the
cheapest legal conversation. Ties go to the earlier state and the earlier choice, so results repeat.

Only a turn's role matters to the costs, so a stretch of turns is one (min, +) matrix of 4 x 4. The turns are dealt by
range of (conversation, turn) and sorted; a conversation that runs over several partitions is met first as one matrix
for each, of which at most two a partition come to the driver, and then each partition repairs its own stretch between
the states chosen. So a conversation with a third of all rows is as many tasks as it fills partitions.

The rendered text is returned in parts of at most PART input turns; joined in order they are the conversation. A
text may not forge a marker: every ``<``, backslashes and ``|`` in it gets one backslash more, which ``unescaped``
takes back.

Cases: a very long text is one piece, rendered whole; a null or unknown role must be relabelled; a null text is empty; a null conversation id is a conversation of
its own; turns of one number are ordered by role and text, nulls first; repeated turns are merged as any two turns of
one role; a conversation of a system turn alone is given an empty user turn; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

ROLES = ("", "system", "user", "assistant")
#: Legal next states; a conversation may end after user or assistant.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (2, 3)
MERGE, INSERT, RELABEL = 1, 2, 3
#: Input turns in one part of a rendered conversation.
PART = 512
#: Turns in one batch handed back.
BATCH = 4096
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
MARK, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FAR = 1 << 40


def escaped(text: str) -> str:
    return MARK.sub(r"<\1\\|", text) if "<" in text else text


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def way(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest turns to insert after state a so that b is legal."""
    paths = [()]
    for _ in range(4):
        for p in paths:
            if b in NEXT[p[-1] if p else a]:
                return p
        paths = [(*p, q) for p in paths for q in NEXT[p[-1] if p else a]]
    return None


def moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state, state after) to the cheapest (cost, kind, inserted) for a turn of a role; 0 is an unknown role."""
    out = {}
    for a in range(4):
        for b in range(1, 4):
            found = []
            change = 0 if b == role else RELABEL
            inserted = way(a, b)
            if inserted is not None:
                found.append((INSERT * len(inserted) + change, "relabel" if change else "keep", inserted))
            if a == b:
                found.append((MERGE + change, "merge", ()))
            if found:
                out[a, b] = min(found, key=lambda x: x[0])
    return out


MOVES = [moves(r) for r in range(4)]
COSTS = [np.array([[m.get((a, b), (FAR,))[0] for b in range(4)] for a in range(4)]) for m in MOVES]


def last_way(a: int) -> tuple[int, ...]:
    """The turns to add after state a so that a conversation may end."""
    if a in ENDS:
        return ()
    return min(((*way(a, b), b) for b in ENDS if way(a, b) is not None), key=len)


END_COST = np.array([INSERT * len(last_way(a)) for a in range(4)])


def role_number(role: object) -> int:
    return ROLES.index(role) if role in ROLES[1:] else 0


def matrix(roles: list[int]) -> np.ndarray:
    """The least cost from each state to each over a stretch of turns."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        total = np.minimum((total[:, :, None] + COSTS[r][None]).min(axis=1), FAR)
    return total


def path(roles: list[int], first: int, last: int | None) -> tuple[int, list[int]]:
    """The least cost and the states after each turn, from state first to last, or to the cheapest end."""
    cost, back = np.where(np.arange(4) == first, 0, FAR), []
    for r in roles:
        each = cost[:, None] + COSTS[r]
        back.append(each.argmin(axis=0))
        cost = np.minimum(each.min(axis=0), FAR)
    if last is None:
        last = int((cost + END_COST).argmin())
    states = [last]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return int(cost[last]), states[::-1]


class Stretches:
    """For stretches of conversations over several partitions: entry and exit state, turns before, whole cost."""

    def __init__(self, rows: list[tuple[int, bool, object, int, np.ndarray]]) -> None:
        self.of: dict[tuple[int, object], tuple[int, int, int, bool, int]] = {}
        rows = sorted({(p, not head, conv is not None, conv or ""): (p, conv, n, m) for p, head, conv, n, m in rows}.items())
        run: list[tuple[int, object, int, np.ndarray]] = []
        for _, row in rows:
            if run and run[-1][1] != row[1]:
                self._close(run)
                run = []
            if not run or run[-1][0] != row[0]:
                run.append(row)
        self._close(run)

    def _close(self, run: list[tuple[int, object, int, np.ndarray]]) -> None:
        if len(run) < 2:
            return
        cost, back = np.where(np.arange(4) == 0, 0, FAR), []
        for *_, m in run:
            each = cost[:, None] + m
            back.append(each.argmin(axis=0))
            cost = np.minimum(each.min(axis=0), FAR)
        state = int((cost + END_COST).argmin())
        whole = int((cost + END_COST)[state])
        before = sum(n for _, _, n, _ in run)
        for k in range(len(run) - 1, -1, -1):
            part, conv, n, _ = run[k]
            first = int(back[k][state])
            before -= n
            self.of[part, conv] = (first, state, before, k == len(run) - 1, whole)
            state = first


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[tuple]]]:
    """(conversation, turns) of a sorted partition, each complete as far as the partition goes."""
    rows = (r for pdf in batches for r in zip(*(pdf[c] for c in pdf.columns)))
    return ((conv, list(run)) for conv, run in groupby(rows, key=lambda r: r[0] if isinstance(r[0], str) else None))


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the first and the last run of a partition, the only ones that others may go on with."""
    from pyspark import TaskContext

    part, ends = TaskContext.get().partitionId(), []
    for conv, run in _runs(batches):
        row = (part, not ends, conv, len(run), [role_number(r[1]) for r in run])
        ends = [*ends[:1], row]
    rows = [(p, head, conv, n, matrix(roles).ravel().tolist()) for p, head, conv, n, roles in ends]
    yield pd.DataFrame(rows, columns=["part", "head", "conv", "n", "m"])


#: Conversation ids travel as text through pandas, which would turn whole numbers beside a null into doubles.
PIECES = "conv_id string, position long, cost long, merged long, relabelled long, inserted long, out_turns long, piece string"


def _pieces(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def _repairing(stretches: Stretches):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), []
        for conv, turns in _runs(batches):
            roles = [role_number(t[1]) for t in turns]
            first, last, before, ends, whole = stretches.of.get((part, conv), (0, None, 0, True, None))
            cost, states = path(roles, first, last)
            if whole is None:
                whole = cost + int(END_COST[states[-1]])
            state = first
            for k, (role, text, after) in enumerate(zip(roles, (t[2] for t in turns), states)):
                _, kind, inserted = MOVES[role][state, after]
                change = after != role
                text = escaped(text) if isinstance(text, str) else ""
                if kind == "merge":
                    piece = "\n" + text
                else:
                    closed = CLOSE if state else ""
                    piece = closed + "".join(OPEN.format(ROLES[q]) + CLOSE for q in inserted) + OPEN.format(ROLES[after]) + text
                n_in, out = len(inserted), len(inserted) + (kind != "merge")
                if ends and k == len(turns) - 1:
                    tail = last_way(after)
                    piece += CLOSE + "".join(OPEN.format(ROLES[q]) + CLOSE for q in tail)
                    n_in, out = n_in + len(tail), out + len(tail)
                rows.append((conv, before + k, whole, int(kind == "merge"), int(change), n_in, out, piece))
                state = after
            if len(rows) >= BATCH:
                yield _pieces(rows)
                rows = []
        yield _pieces(rows)

    return run


def repaired_turns(turns: DataFrame) -> DataFrame:
    """One row per input turn, with the piece of the rendered conversation that comes from it."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = turns.select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    # checkpointed as it lies: both passes see the same partitions in the same order
    dealt = cut(slim.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions(*order).select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text"))
    ends = dealt.select("conv_id", "role").mapInPandas(_matrices, "part int, head boolean, conv string, n long, m array<long>").collect()
    stretches = Stretches([(r["part"], r["head"], r["conv"], r["n"], np.array(r["m"]).reshape(4, 4)) for r in ends])
    return dealt.mapInPandas(_repairing(stretches), PIECES).withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per part of a conversation: conv_id, part, turns in and out, repairs, the conversation's cost, rendered."""
    pieces = repaired_turns(turns).withColumn("part", F.floor(F.col("position") / PART))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("conv_id", "part").agg(
        F.count("*").alias("turns"),
        F.sum("out_turns").alias("out_turns"),
        F.sum("merged").alias("merged"),
        F.sum("relabelled").alias("relabelled"),
        F.sum("inserted").alias("inserted"),
        F.max("cost").alias("cost"),
        text.alias("rendered"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))
