"""Streams that remember by key: entries that expire, a capped cache of responses, and repeats within conversations.

State lies in RocksDB and is saved with the stream's checkpoint, so a lost executor's keys are picked up elsewhere. All decisions are by
event time: a replay gives what the first run gave. Rows later than the watermark are dropped, as in any event-time stream. A task
sorts one key's rows of one micro-batch in memory: bound a batch by the source's options (maxFilesPerTrigger, maxBytesPerTrigger).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import text_of
from ..operators.dedup import THRESHOLD, similarity
from ..plans.conversations import REPEAT_LENGTH
from ..sources.scratch import shared_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Entries(StatefulProcessor):
    """Bodies by key, in the order in which keys came; ts in microseconds. A slot holds at most `most` of them (None: any number)."""

    def __init__(self, ttl: int, most: int | None) -> None:
        self.life, self.most = ttl * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("entries", "key string", "number long, body string, at long")

    def _expired(self, at: int, now: int) -> bool:
        return 0 < self.life < now - at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = sorted((number, k, body, at) for (k,), (number, body, at) in self.state.iterator())
        held = {k: (number, body, at) for number, k, body, at in stored}
        before, following = dict(held), stored[-1][0] + 1 if stored else 0
        batch = pd.concat(list(rows))
        # what is put at an instant is there for who asks at the same instant
        batch = batch.assign(asks=batch["body"].isna()).sort_values(["at", "asks", "id"], kind="stable")
        out = []
        for row in batch.itertuples(index=False):
            if row.asks:
                found = held.get(row.key)
                if found and self._expired(found[2], row.at):
                    del held[row.key]
                    found = None
                out.append((row.id, row.key, row.at, found[1] if found else None))
                continue
            if self.most is not None and len(held) >= self.most:
                del held[next(iter(held))]
            if row.key in held:
                number = held[row.key][0]
            else:
                number, following = following, following + 1
            held[row.key] = (number, row.body, row.at)
        for k in before.keys() - held.keys():
            self.state.removeKey((k,))
        for k, entry in held.items():
            if before.get(k) != entry:
                self.state.updateValue((k,), entry)
                if self.life > 0:
                    self.handle.registerTimer((entry[2] + self.life) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["id", "key", "at", "found"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for k in [k for (k,), (_, _, at) in self.state.iterator() if self._expired(at, now)]:
            self.state.removeKey((k,))
        return iter(())

    def close(self) -> None:
        pass


def _remembering(df: DataFrame) -> DataFrame:
    if df.sparkSession.conf.get(_PROVIDER, "") != _ROCKSDB:
        df.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return df


def _looked_up(rows: DataFrame, slot, ttl: int, most: int | None, late: str) -> DataFrame:
    keyed = rows.select("id", "key", "ts", F.unix_micros("ts").alias("at"), "body").withWatermark("ts", late).withColumn("slot", slot)
    found = _remembering(keyed).groupBy("slot").transformWithStateInPandas(
        _Entries(ttl, most), "id long, key string, at long, found string", outputMode="append", timeMode="eventTime"
    )
    return found.select("id", "key", F.timestamp_micros("at").alias("ts"), "found", F.col("found").isNotNull().alias("hit"))


def stored_entries(rows: DataFrame, ttl: int = 86_400, late: str = "1 hour") -> DataFrame:
    """(id, key, ts, found, hit) for each row that asks.

    rows: (id long, key string, ts timestamp, body string): a row with a body puts it, again from its ts on; a row without one asks for
    what was put last and no more than `ttl` seconds ago (0: whenever). A null key is a key like any other.
    """
    return _looked_up(rows.withColumn("key", F.coalesce("key", F.lit(""))), F.col("key"), ttl, None, late)


def cached_responses(rows: DataFrame, ttl: int = 3600, most: int = 1024, slots: int = 1, late: str = "1 hour") -> DataFrame:
    """As stored_entries, for a cache of at most `most` keys, of which those that came first go first.

    One slot keeps to that order exactly, in one task; more slots, to which keys are dealt by hash, keep most / slots keys each.
    """
    key = F.coalesce("key", F.lit(""))
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    return _looked_up(rows.withColumn("key", key), slot, ttl, -(-most // slots), late)


class _History(StatefulProcessor):
    """Distinct texts of a conversation with the position of each one's first occurrence."""

    def __init__(self, silence: int, threshold: float) -> None:
        self.silence, self.threshold = silence * 1000, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getListState("texts", "pos long, text string")
        self.last = handle.getValueState("last", "following long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {text: pos for pos, text in self.texts.get()}
        following, last = self.last.get() if self.last.exists() else (0, 0)
        known, out = len(seen), []
        for row in pd.concat(list(rows)).sort_values("turn", kind="stable").itertuples(index=False):
            pos, last = following, max(last, int(row.at) // 1000)
            following += 1
            dup = None
            if row.open:
                if len(row.text) > REPEAT_LENGTH:
                    dup = next((p for t, p in seen.items() if t == row.text or similarity(row.text, t) >= self.threshold), None)
                seen.setdefault(row.text, pos)
            out.append((*key, row.turn, pos, dup))
        new = [(p, t) for t, p in list(seen.items())[known:]]
        if new:
            self.texts.appendList(new)
        self.last.update((following, last))
        self.handle.registerTimer(last + self.silence)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "pos", "dup"]).astype({"dup": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1] + self.silence <= expiredTimerInfo.getExpiryTimeInMs():
            self.texts.clear()
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def repeats_so_far(turns: DataFrame, silence: int = 86_400, threshold: float = THRESHOLD, late: str = "1 hour") -> DataFrame:
    """(conv_id, turn, pos, dup) of every message: its position, and that of the earliest message before it that a long one nearly repeats.

    turns: (conv_id long, turn long, role string, text string, ts timestamp). Messages of the system role and empty ones repeat nothing
    and aren't repeated. The protected tail of the batch form can't be known while a conversation goes on; whoever elides messages
    leaves the last ones. A conversation that is silent for `silence` seconds is forgotten.
    """
    text = F.coalesce(text_of(F.col("text")), F.lit(""))
    rows = turns.withWatermark("ts", late).select(
        "conv_id", "turn", text.alias("text"), "ts", F.unix_micros("ts").alias("at"),
        (~F.coalesce(F.col("role") == "system", F.lit(False)) & (F.length(text) > 0)).alias("open"),
    )
    return _remembering(rows).groupBy("conv_id").transformWithStateInPandas(
        _History(silence, threshold), "conv_id long, turn long, pos long, dup long", outputMode="append", timeMode="eventTime"
    )


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that its source holds now, and reads what it wrote to the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
