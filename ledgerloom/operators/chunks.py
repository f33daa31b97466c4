"""Statements that come in chunks of lines: each chunk goes on from what the one before it left.

The state of a statement is its open lines, those from its last transaction on (which the next chunk may continue), the last
balance, and whether it is overdrawn. With it a chunk is parsed without the lines before it, and all chunks together give
what the whole gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.operators.rounds import written
from ledgerloom.operators.statements import opening_balances

Parser = Callable[[DataFrame], DataFrame]
Signs = Callable[[DataFrame, str, str], DataFrame]


@dataclass
class State:
    """lines: open ones (statement_id, line_no, line); balances: (statement_id, opening, overdrawn), opening being the balance before the open lines."""

    lines: DataFrame
    balances: DataFrame


def first_state(lines: DataFrame) -> State:
    """The state before any chunk, of the shape of lines."""
    none = lines.limit(0).select("statement_id", "line_no", "line")
    return State(none, none.select("statement_id", F.lit(None).cast(MONEY).alias("opening"), F.lit(None).cast("boolean").alias("overdrawn")))


def _signed(rows: DataFrame, balances: DataFrame, signs: Signs) -> DataFrame:
    known = rows.join(balances, "statement_id", "left").withColumn("overdrawn", F.coalesce("overdrawn", F.lit(False)))
    return signs(known.withColumnRenamed("statement_id", "account"), "opening", "overdrawn").withColumnRenamed("account", "statement_id")


def parse_chunk(lines: DataFrame, state: State, parser: Parser, signs: Signs, last: bool = False) -> tuple[DataFrame, State]:
    """(transactions with type and balance_used, the state after them). The last transaction waits for lines that may follow, unless the chunk is the last.

    signs: by_delta or its like, called with the columns of the opening and of the overdrawn mark.
    """
    known = state.balances.where("overdrawn IS NOT NULL")
    fresh = opening_balances(lines).join(known, "statement_id", "left_anti").select("statement_id", "opening", (F.col("opening") < 0).alias("overdrawn"))
    balances = written(known.unionByName(fresh), "chunk-balances")
    every = written(state.lines.unionByName(lines.select("statement_id", "line_no", "line")), "chunk-lines")
    rows = written(_signed(parser(every), balances, signs), "chunk-rows")
    ends = rows.groupBy("statement_id").agg(F.max("seq").alias("_open"))
    if last:
        return rows.drop("opening", "overdrawn", "delta"), State(every.limit(0), balances)
    done = rows.join(ends, "statement_id").where(F.col("seq") < F.col("_open")).drop("_open")
    left = every.join(ends, "statement_id", "left").where(F.col("_open").isNull() | (F.col("line_no") >= F.col("_open"))).drop("_open")
    after = done.groupBy("statement_id").agg(F.max_by("balance_used", "seq").alias("_last"))
    moved = balances.join(after, "statement_id", "full_outer").select("statement_id", F.coalesce("_last", "opening").cast(MONEY).alias("opening"), F.coalesce("overdrawn", F.lit(False)).alias("overdrawn"))
    return done.drop("opening", "overdrawn", "delta"), State(written(left, "chunk-state"), written(moved, "chunk-state"))
