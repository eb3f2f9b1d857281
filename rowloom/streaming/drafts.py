"""The life of drafts: created, edited, confirmed, discarded or expired, over a table of commands or a stream of them.

A command is refused if its draft is not there, has been discarded, or expired before it. Confirming twice changes nothing, and
preferences are replaced as a whole. The first creation counts. A table is answered by windows over each draft's commands; a stream
by state under the draft's key, whose timer expires it, and from which a restarted stream goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "draft_id string, at timestamp, seq long, command string, expires timestamp, payload string"
OUTCOMES = "draft_id string, at timestamp, seq long, command string, outcome string, status string, payload string, preferences string, confirmed_at timestamp"
#: Stream: how much later than others a command may come.
LATE = "1 hour"
_STATE = "status string, payload string, preferences string, expires timestamp, confirmed_at timestamp"


def outcomes(commands: DataFrame) -> DataFrame:
    """OUTCOMES of every command (COMMANDS; CREATE, EDIT, READ, CONFIRM, DISCARD, PREFER) of a table.

    outcome: OK, DRAFT_EXISTS, DRAFT_NOT_FOUND, DRAFT_DISCARDED or DRAFT_EXPIRED; status and the rest: the draft's after the command.
    Commands of a draft follow each other by at and seq, which must differ. A draft without an expiry doesn't expire; a null key is
    a draft as others; other commands are like READ. Rows are a draft's commands: their number is bounded by what a person does.
    """
    order = Window.partitionBy("draft_id").orderBy("at", "seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    is_, last = lambda c: F.col("command") == c, lambda c: F.last(c, ignorenulls=True)
    creates = F.coalesce(F.max(is_("CREATE")).over(before), F.lit(False))
    rows = commands.select("draft_id", "at", "seq", "command", "expires", "payload").withColumn("exists", creates)
    rows = rows.withColumn("until", F.first(F.when(is_("CREATE"), F.struct("expires")), ignorenulls=True).over(upto)["expires"])
    rows = rows.withColumn("expired", F.coalesce(F.col("exists") & (F.col("until") < F.col("at")), F.lit(False)))
    discards = is_("DISCARD") & F.col("exists") & ~F.col("expired")
    rows = rows.withColumn("gone", F.coalesce(F.max(discards).over(before), F.lit(False)))
    outcome = (
        F.when(is_("CREATE"), F.when(F.col("exists"), "DRAFT_EXISTS").otherwise("OK"))
        .when(~F.col("exists"), "DRAFT_NOT_FOUND")
        .when(F.col("gone"), "DRAFT_DISCARDED")
        .when(F.col("expired"), "DRAFT_EXPIRED")
        .otherwise("OK")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("ok", F.col("outcome") == "OK")
    becomes = F.when(F.col("ok"), F.when(is_("CREATE"), "NEW").when(is_("EDIT"), "EDITING").when(is_("CONFIRM"), "CONFIRMED").when(is_("DISCARD"), "DISCARDED"))
    rows = rows.withColumn("was", last(becomes).over(before)).withColumn("status", last(becomes).over(upto))
    first_confirm = F.when(F.col("ok") & is_("CONFIRM") & ~F.col("was").eqNullSafe(F.lit("CONFIRMED")), F.col("at"))
    return rows.select(
        "draft_id", "at", "seq", "command", "outcome",
        F.when((F.col("outcome") == "DRAFT_EXPIRED"), "EXPIRED").otherwise(F.col("status")).alias("status"),
        last(F.when(F.col("ok") & (is_("CREATE") | is_("EDIT")), F.struct("payload"))).over(upto)["payload"].alias("payload"),
        last(F.when(F.col("ok") & is_("PREFER"), F.struct("payload"))).over(upto)["payload"].alias("preferences"),
        last(first_confirm).over(upto).alias("confirmed_at"),
    )


class _Lifecycle(StatefulProcessor):
    """One draft: its state, and a timer for its expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.draft.get()) if self.draft.exists() else None
        out, commands = [], pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, seq, command, expires, payload in commands[["at", "seq", "command", "expires", "payload"]].itertuples(index=False):
            state, outcome = _step(state, at, command, None if pd.isna(expires) else expires, payload)
            if command == "CREATE" and outcome == "OK" and state[3] is not None:
                self.handle.registerTimer(int(pd.Timestamp(state[3]).timestamp() * 1000) + 1)
            status, held, preferences, _, confirmed = state or [None] * 5
            out.append((key[0], at, seq, command, outcome, "EXPIRED" if outcome == "DRAFT_EXPIRED" else status, held, preferences, confirmed))
        if state is not None:
            self.draft.update(tuple(state))
        yield pd.DataFrame(out, columns=["draft_id", "at", "seq", "command", "outcome", "status", "payload", "preferences", "confirmed_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What an expired draft held is let go; that it expired, or was confirmed or discarded, stays."""
        if self.draft.exists():
            status, _, _, expires, confirmed = self.draft.get()
            self.draft.update((status, None, None, expires, confirmed))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _step(state: list | None, at, command: str, expires, payload: str | None) -> tuple[list | None, str]:
    """The draft after a command, and the command's outcome. state: status, payload, preferences, expires, confirmed_at."""
    if command == "CREATE":
        return (state, "DRAFT_EXISTS") if state else (["NEW", payload, None, expires, None], "OK")
    if state is None:
        return None, "DRAFT_NOT_FOUND"
    if state[0] == "DISCARDED":
        return state, "DRAFT_DISCARDED"
    if state[3] is not None and pd.Timestamp(state[3]) < at:
        return state, "DRAFT_EXPIRED"
    new = list(state)
    if command == "EDIT":
        new[0], new[1] = "EDITING", payload
    elif command == "CONFIRM" and state[0] != "CONFIRMED":
        new[0], new[4] = "CONFIRMED", at
    elif command == "DISCARD":
        new[0] = "DISCARDED"
    elif command == "PREFER":
        new[2] = payload
    return new, "OK"


def stream_outcomes(commands: DataFrame, late: str = LATE) -> DataFrame:
    """The same over a stream of commands, by state under each draft's key; needs the RocksDB state store.

    Commands of one micro-batch are put in order; of different ones, those that come later count as later.
    """
    timed = commands.withWatermark("at", late)
    return timed.groupBy("draft_id").transformWithStateInPandas(_Lifecycle(), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
