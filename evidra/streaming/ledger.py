"""The screening ledger as a stream, and other running accounts.

The state of a record at a stage is what its reviewers last said and the last
adjudication; the order of appending (``seq``) decides, so events that arrive
late by the clock are not put in front, and an event that arrives behind a
later one of its reviewer changes nothing.  State is kept a key, bounded by
the number of reviewers, and every batch emits the keys that it touched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidra.operators.screening import NOT_SCREENED
from evidra.plans.scratch import scratch_path

FINAL = "record_id string, stage string, seq long, decision string, reason string, conflict boolean, reviewers int"


def settle(state: dict, rows: list[tuple]) -> dict:
    """The state after events (seq, reviewer, decision, reason, adjudication), in any order."""
    for seq, reviewer, decision, reason, ruling in rows:
        slot = state.setdefault("ruled" if ruling else "said", {})
        who = "" if ruling else reviewer
        if who not in slot or slot[who][0] < seq:
            slot[who] = [seq, decision, reason]
    return state


def outcome(state: dict) -> tuple[int, str, str | None, bool, int]:
    """(last seq, decision, reason, conflict, reviewers): a ruling stands until a reviewer decides again."""
    said, ruled = state.get("said", {}), state.get("ruled", {}).get("")
    last = max((s for s, *_ in said.values()), default=-1)
    if ruled and ruled[0] > last:
        return ruled[0], ruled[1], ruled[2], False, len(said)
    if len({d for _, d, _ in said.values()}) == 1:
        seq, decision, reason = max(said.values())
        return seq, decision, reason, False, len(said)
    return max(last, ruled[0] if ruled else -1), NOT_SCREENED, None, bool(said), len(said)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = json.loads(state.get[0]) if state.exists else {}
    for batch in batches:
        columns = [batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("seq", "reviewer", "decision", "reason", "adjudication")]
        now = settle(now, [(int(s), r, d, why, bool(a)) for s, r, d, why, a in zip(*columns, strict=True)])
    state.update((json.dumps(now),))
    seq, decision, reason, conflict, n = outcome(now)
    yield pd.DataFrame({"record_id": [key[0]], "stage": [key[1]], "seq": [seq], "decision": [decision], "reason": [reason], "conflict": [conflict], "reviewers": [n]})


def final_decisions(events: DataFrame) -> DataFrame:
    """A stream of the keys' current decisions, one row for each key that a batch touched (update mode)."""
    reason = F.coalesce(F.col("reason_code"), F.nullif(F.trim("reason_text"), F.lit("")))
    rows = events.where("record_id IS NOT NULL AND stage IS NOT NULL AND seq IS NOT NULL").select("record_id", "stage", "seq", F.coalesce("reviewer", F.lit("")).alias("reviewer"), "decision", reason.alias("reason"), F.coalesce("adjudication", F.lit(False)).alias("adjudication"))
    return rows.groupBy("record_id", "stage").applyInPandasWithState(_update, FINAL, "state string", "update", GroupStateTimeout.NoTimeout)


def arriving_once(hits: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Hits by their identifiers, each once within the time that events may be late."""
    return hits.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def activity(events: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts a window and key; a window is emitted when no event of it can come any more."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there now; its output rows, with the batch that made each.

    A batch that is run again overwrites its own folder, so no row counts twice.
    """
    spark = stream.sparkSession
    out, schema = scratch_path(spark, "stream"), stream.schema

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "offsets")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return _batches(spark, out, T.StructType([*schema, T.StructField("batch", T.IntegerType())]))


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def newest(rows: DataFrame) -> DataFrame:
    """Of what batches emitted, the last row of each record and stage."""
    columns = [c for c in rows.columns if c not in ("record_id", "stage", "batch")]
    return rows.groupBy("record_id", "stage").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("record_id", "stage", "r.*")
