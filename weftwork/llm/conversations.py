"""Rebuilding conversations from message rows.

Messages are partitioned by conversation key, ordered by time within it, and judged by a finite-state automaton over their
speakers. No task ever holds a whole channel or conversation: time is cut into buckets, each bucket is worked on alone, and
the automaton's state after every piece carries the judgement across its borders. A state is the number of turns so far (up
to what is asked for), whether somebody else than the opener has replied, and whether the named message is there; states
of pieces combine by Automaton.then, in any order, which the tests prove from the transition table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import materialised

PLACE = ["workspace_id", "channel"]
#: Stands for a null workspace or channel inside.
NONE = "\x00"
MICRO = 1_000_000
#: Messages of a run are at most this many seconds apart.
GAP_S = 600
#: A bucket of time. Only the work per task depends on it, never the result.
BUCKET_S = 6 * 3600
#: Turns that a thread and a run must have.
THREAD_TURNS, RUN_TURNS = 2, 3
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$"


def micros(text: Column) -> Column:
    """Decimal epoch seconds as whole microseconds; null if the text is no number."""
    return F.when(
        text.rlike(NUMBER), F.round(F.trim(text).cast("decimal(38,12)") * MICRO).cast("long")
    )


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(r"(?U)[^\s​﻿]")


def newest_messages(messages: DataFrame) -> DataFrame:
    """One row per workspace, channel and moment: the row received last; of equal times, the one with the larger row id.

    Columns: workspace_id, channel, ts_us, thread_us, user, left. left: the message has a text and a user. Rows without a
    numeric ts are ignored. Null workspaces and channels become NONE, so that they join like any others.
    """
    m = messages.select(
        *[F.coalesce(c, F.lit(NONE)).alias(c) for c in PLACE], micros(F.col("ts")).alias("ts_us"), micros(F.col("thread_ts")).alias("thread_us"),
        F.when(~blank(F.col("text")), F.col("user")).alias("user"), "received_at", "row_id",
    ).filter("ts_us IS NOT NULL")
    w = Window.partitionBy(*PLACE, "ts_us").orderBy(F.col("received_at").desc_nulls_last(), F.col("row_id").desc_nulls_last())
    return m.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "received_at", "row_id")


def bucketed(rows: DataFrame, order: str, bucket_s: int) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col(order) / (bucket_s * MICRO)))


def runs(loose: DataFrame, gap_s: int = GAP_S, bucket_s: int = BUCKET_S) -> DataFrame:
    """loose with run_us, the first moment of the run that each message belongs to."""
    key, gap = [*PLACE, "bucket"], gap_s * MICRO
    w = Window.partitionBy(*key).orderBy("ts_us")
    m = bucketed(loose, "ts_us", bucket_s).withColumn("before", F.lag("ts_us").over(w))
    m = m.withColumn("own", F.last(F.when(F.col("ts_us") - F.col("before") > gap, F.col("ts_us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = m.groupBy(*key).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max("own").alias("last_own"))
    c = Window.partitionBy(*PLACE).orderBy("bucket")
    heads = heads.withColumn("gone", F.lag("last_us").over(c))
    heads = heads.withColumn("opens", F.col("gone").isNull() | (F.col("first_us") - F.col("gone") > gap))
    heads = heads.withColumn("tail", F.coalesce("last_own", F.when(F.col("opens"), F.col("first_us"))))
    heads = heads.withColumn("carried", F.last("tail", ignorenulls=True).over(c.rowsBetween(Window.unboundedPreceding, -1)))
    heads = heads.select(*key, F.when(F.col("opens"), F.col("first_us")).otherwise(F.col("carried")).alias("head"))
    return m.join(heads, key).select(*loose.columns, F.coalesce("own", "head").alias("run_us"))


class Automaton:
    """What a conversation must be: `most` turns at least are counted; a thread needs its named message, a reply by somebody
    else than the opener is never missing. Symbols are the turns that are left (empty ones are no symbol)."""

    OPENER, REPLIER, NAMED_OPENER, NAMED_REPLIER = range(4)

    def __init__(self, thread_turns: int = THREAD_TURNS, run_turns: int = RUN_TURNS):
        self.most = max(thread_turns, run_turns)
        states = [(t, replied, named) for t in range(self.most + 1) for replied in (0, 1) for named in (0, 1)]
        self.number = {s: i for i, s in enumerate(states)}
        #: state and symbol to state: every turn counts, a replier's turn is a reply, the named message is there once seen
        self.transitions = [[self.number[min(t + 1, self.most), replied | (x in (1, 3)), named | (x in (2, 3))] for x in range(4)] for t, replied, named in states]
        self.thread_accepts = [bool(t >= thread_turns and replied and named) for t, replied, named in states]
        self.run_accepts = [bool(t >= run_turns and replied) for t, replied, named in states]

    def after(self, symbols: list[int], state: int = 0) -> int:
        for x in symbols:
            state = self.transitions[state][x]
        return state

    def then(self, first: int, second: int) -> int:
        """The state after a piece that alone leads to `second`, from `first`: turns add up, marks stay."""
        t, replied, named = self.states[first]
        u, also, too = self.states[second]
        return self.number[min(t + u, self.most), replied | also, named | too]

    @property
    def states(self) -> list[tuple[int, int, int]]:
        return list(self.number)

    def state(self, turns: Column, replied: Column, named: Column) -> Column:
        """The number of a state, from what `then` adds up over pieces."""
        return F.least(turns, F.lit(self.most)).cast("int") * 4 + replied.cast("int") * 2 + named.cast("int")

    def accepted(self, threaded: Column, state: Column) -> Column:
        tables = [F.element_at(F.array(*map(F.lit, t)), state + 1) for t in (self.thread_accepts, self.run_accepts)]
        return F.when(threaded, tables[0]).otherwise(tables[1])


def judged(said: DataFrame, keys: list[str], thread_turns: int, run_turns: int, bucket_s: int) -> DataFrame:
    """said with root_us, turn and role, in the conversations that the automaton accepts.

    Every piece (keys, bucket) of a conversation is reduced to the automaton's state after it; states are combined over the
    few pieces of a conversation, which also tells how many turns come before each piece.
    """
    machine = Automaton(thread_turns, run_turns)
    piece = [*keys, "bucket"]
    m = bucketed(said, "ts_us", bucket_s)
    state = m.groupBy(*piece).agg(
        F.count(F.lit(1)).alias("n"), F.min("user").alias("low"), F.max("user").alias("high"), F.min("ts_us").alias("first_us"),
        F.min_by("user", "ts_us").alias("first_user"), F.max(F.col("ts_us") == F.col("conv_us")).alias("named"),
    )
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("bucket")
    state = state.withColumn("opener", F.first("first_user").over(ordered))
    replied = (F.col("low") != F.col("opener")) | (F.col("high") != F.col("opener"))
    end = machine.state(F.sum("n").over(whole), F.max(replied).over(whole), F.max("named").over(whole))
    state = state.select(
        *piece, machine.accepted(F.col("threaded"), end).alias("accepted"), F.min("first_us").over(whole).alias("root_us"), "opener",
        F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
    ).filter("accepted").drop("accepted")
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy("ts_us"))
    return m.join(state, piece).withColumn("turn", (rank - 1 + F.col("shift")).cast("int")).withColumn("role", F.when(F.col("user") == F.col("opener"), "opener").otherwise("replier"))


def conversations(messages: DataFrame, *, gap_s: int = GAP_S, bucket_s: int = BUCKET_S, thread_turns: int = THREAD_TURNS, run_turns: int = RUN_TURNS) -> DataFrame:
    """workspace_id, channel, root_us, turn, ts_us, role: one row per message of each kept conversation.

    A message with a thread_ts belongs to that thread, and so does the message it names, unless that one belongs to
    another thread itself. All others form runs. Messages without text or user take their place and are left out then.
    A conversation is kept if the automaton accepts it: it has enough turns, more than one speaker, and, for a thread,
    its named message. A null workspace or channel is a place like any other. Empty tables give no rows; other columns
    are ignored.
    """
    m = materialised(newest_messages(messages))
    named = m.filter("thread_us IS NOT NULL").select(*PLACE, F.col("thread_us").alias("ts_us")).distinct().withColumn("named", F.lit(True))
    single = m.filter("thread_us IS NULL").drop("thread_us").join(named, [*PLACE, "ts_us"], "left")
    conv = [*PLACE, "threaded", "conv_us", "ts_us", "user"]
    replies = m.filter("thread_us IS NOT NULL AND user IS NOT NULL").select(*PLACE, F.lit(True).alias("threaded"), F.col("thread_us").alias("conv_us"), "ts_us", "user")
    roots = single.filter("named AND user IS NOT NULL").select(*PLACE, F.lit(True).alias("threaded"), F.col("ts_us").alias("conv_us"), "ts_us", "user")
    loose = runs(single.filter("named IS NULL").drop("named"), gap_s, bucket_s).filter("user IS NOT NULL")
    said = replies.unionByName(roots).unionByName(loose.select(*PLACE, F.lit(False).alias("threaded"), F.col("run_us").alias("conv_us"), "ts_us", "user"))
    rows = judged(said.select(*conv), [*PLACE, "threaded", "conv_us"], thread_turns, run_turns, bucket_s)
    return rows.select(*[F.when(F.col(c) != NONE, F.col(c)).alias(c) for c in PLACE], "root_us", "turn", "ts_us", "role")
