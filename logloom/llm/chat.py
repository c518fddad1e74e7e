"""Chat formatting with minimum-cost repair of roles.

A legal conversation is at most one system turn, then user and assistant turns in alternation, from user on. A turn may
keep its role, be merged into the one before it (MERGE), be relabelled (RELABEL; UNKNOWN for a role that is none), or have
an empty turn of the other role put before it (INSERT). Costs add up; dynamic programming over the automaton's four
states finds the least, ties by the order of choices below.

A conversation may be of any length. Rows are sorted by range over (conversation, turn, role, text), so that a long one
spans partitions, and are cut into blocks of at most BLOCK rows. A block is summed up in a matrix of least costs from each
state to each; matrices of up to BLOCK blocks are multiplied (minimum for sum, sum for product) level by level, and the way
back hands each block its first and last state, with which it chooses its turns' actions. The rendering is one piece for
each row, and a conversation is its pieces in order.

Null or unknown roles are relabelled, null texts are empty, rows with a null turn come last, repeated rows each are a turn, and
a null conversation is one like any other. A text of any length is one piece. Other columns of the table are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MERGE, INSERT, RELABEL, UNKNOWN = 1.0, 2.0, 3.0, 1.5
BLOCK = 512
ROLES = ["system", "user", "assistant"]
#: States: nothing yet, after system, after user, after assistant. A state but the first is its role's number plus one.
STATES, ACTIONS = 4, ["keep", "merge", "insert"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@lru_cache(maxsize=None)
def choices(state: int, role: int) -> tuple[tuple[int, float, int], ...]:
    """(next state, cost, action) of a turn of that role (3: unknown); action numbers are ACTIONS'."""
    out = []
    for new in (0, 1, 2):
        relabel = 0.0 if new == role else UNKNOWN if role == 3 else RELABEL
        after = new + 1
        if after == state:
            out.append((after, relabel + MERGE, 1))
        if new == 0:
            legal, insert = state == 0, False
        else:
            legal = state in ((0, 1, 3) if new == 1 else (2,))
            insert = not legal  # an empty user turn before an assistant's, or the other way round
        if legal or insert:
            out.append((after, relabel + INSERT * insert, 2 if insert else 0))
    return tuple(sorted(out, key=lambda c: (c[1], c[2], c[0])))


def forward(roles: list[int], start: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Least costs of the states after the turns, from start's, and each turn's best (state before, action) by state after."""
    cost, back = start.tolist(), []
    for role in roles:
        new, how = [np.inf] * STATES, [(-1, -1)] * STATES
        for state in range(STATES):
            if cost[state] < np.inf:
                for after, c, action in choices(state, role):
                    if cost[state] + c < new[after]:
                        new[after], how[after] = cost[state] + c, (state, action)
        cost = new
        back.append(how)
    return np.array(cost), back


def only(state: int) -> np.ndarray:
    out = np.full(STATES, np.inf)
    out[state] = 0
    return out


def matrix(roles: list[int]) -> list[float]:
    return np.concatenate([forward(roles, only(s))[0] for s in range(STATES)]).tolist()


def product(parts: list[list[float]]) -> list[float]:
    out = np.array(parts[0]).reshape(STATES, STATES)
    for p in parts[1:]:
        out = (out[:, :, None] + np.array(p).reshape(1, STATES, STATES)).min(axis=1)
    return out.ravel().tolist()


def through(parts: list[list[float]], first: int, last: int) -> list[int]:
    """The states between the parts of a least-cost way from first to last, both included."""
    cost, back = only(first), []
    for p in parts:
        total = cost[:, None] + np.array(p).reshape(STATES, STATES)
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    way = [last]
    for b in reversed(back):
        way.append(int(b[way[-1]]))
    return way[::-1]


def decide(roles: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """(role, action) of every turn of a least-cost way from first to last."""
    _, back = forward(roles, only(first))
    out, state = [], last
    for how in reversed(back):
        before, action = how[state]
        out.append((state - 1, action))
        state = before
    return out[::-1]


def matrix_series(parts: pd.Series) -> pd.Series:
    return pd.Series([matrix([int(r["role"]) for r in rows]) for rows in parts])


def product_series(parts: pd.Series) -> pd.Series:
    return pd.Series([product([r["m"] for r in rows]) for rows in parts])


def through_series(parts: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    out = []
    for rows, a, b in zip(parts, first, last, strict=True):
        way = through([r["m"] for r in rows], int(a), int(b))
        out.append([{"block": int(r["block"]), "first": x, "last": y} for r, x, y in zip(rows, way, way[1:], strict=False)])
    return pd.Series(out)


def decide_series(parts: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[{"id": int(r["id"]), "role_out": x, "action": y} for r, (x, y) in zip(rows, decide([int(r["role"]) for r in rows], int(a), int(b)), strict=True)] for rows, a, b in zip(parts, first, last, strict=True)])


def in_blocks(df: DataFrame, size: int) -> DataFrame:
    """df sorted by (conv, turn, role, text) with ids that rise in that order, and blocks of at most `size` ids."""
    turns = df.withColumn("h", F.xxhash64("text"))
    sort = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("h"), F.col("text")]
    # h is in the range key, so that even rows of one turn can be dealt to several partitions
    ranged = turns.repartitionByRange(*sort[:-1]).sortWithinPartitions(*sort).drop("h")
    rows = common.table(ranged.withColumn("id", F.monotonically_increasing_id()), "chat-turns")
    return rows.withColumn("block", F.floor(F.col("id") / size).cast("long"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, turn, role, text, id, role_out, action, last): a row for each turn; id orders them, last marks a conversation's end."""
    rows = in_blocks(df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text")), block)
    number = F.coalesce(*(F.when(F.lower(F.trim("role")) == r, F.lit(i)) for i, r in enumerate(ROLES)), F.lit(3))
    own = rows.select("conv", "block", "id", number.alias("role")).groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("id", "role"))).alias("rows"))
    own = own.withColumn("m", F.pandas_udf(matrix_series, "array<double>")("rows"))
    levels = [common.table(own, "chat-level")]
    while not levels[-1].groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        below = levels[-1].select("conv", F.floor(F.col("block") / block).cast("long").alias("above"), "block", "m")
        up = below.groupBy("conv", F.col("above").alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("rows"))
        levels.append(common.table(up.withColumn("m", F.pandas_udf(product_series, "array<double>")("rows")), "chat-level"))
    ends = F.slice("m", 1, STATES)  # from nothing to each state
    cheapest = (F.array_position(ends, F.array_min(ends)) - 1).cast("int")
    now = levels[-1].select("conv", "block", "rows", F.lit(0).alias("first"), cheapest.alias("last"))
    for below in reversed(levels[:-1]):
        ways = now.select("conv", F.explode(F.pandas_udf(through_series, "array<struct<block: long, first: int, last: int>>")("rows", "first", "last")).alias("w")).select("conv", "w.*")
        now = below.select("conv", "block", "rows").join(ways.withColumnRenamed("conv", "c"), (F.col("c").eqNullSafe(F.col("conv"))) & (below["block"] == ways["block"])).select("conv", below["block"], "rows", "first", "last")
    chosen = now.select(F.explode(F.pandas_udf(decide_series, "array<struct<id: long, role_out: int, action: int>>")("rows", "first", "last")).alias("d")).select("d.*")
    final = rows.groupBy("conv").agg(F.max("id").alias("id")).select("id", F.lit(True).alias("last"))
    return rows.drop("block").join(chosen, "id").join(final, "id", "left").withColumn("last", F.coalesce("last", F.lit(False)))


def render(repaired: DataFrame) -> DataFrame:
    """With `piece`: a conversation's pieces, in the order of id, make its rendering. Marks inside a text are broken up."""
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role_out") + 1)
    other = F.when(F.col("role_out") == 1, "assistant").otherwise("user")
    clean = F.replace("text", F.lit("<|"), F.lit("< |"))
    empty = F.concat(F.lit(OPEN), other, F.lit("\n"), F.lit(CLOSE))
    # a turn is closed by whatever opens the next, as only that knows that nothing more is merged into it
    opens = F.concat(F.when(F.col("start"), "").otherwise(CLOSE), F.when(F.col("action") == 2, empty).otherwise(""), F.lit(OPEN), name, F.lit("\n"), clean)
    piece = F.concat(F.when(F.col("action") == 1, F.concat(F.lit("\n"), clean)).otherwise(opens), F.when(F.col("last"), CLOSE).otherwise(""))
    first = repaired.groupBy("conv").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("start"))
    out = repaired.join(first, "id", "left").withColumn("start", F.coalesce("start", F.lit(False)))
    return out.withColumns({"role_out": name, "action": F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("action") + 1), "piece": piece}).drop("start")


def op5(conversations: DataFrame) -> DataFrame:
    out = render(common.table(repair(conversations), "chat-repaired"))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "role_out", "action", "last", "piece")
