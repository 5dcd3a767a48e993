"""Structured Streaming: index upkeep by batches, stop strings and JSON ends across pieces of a stream, bounded streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.jsonx import value_end

# Bounds of one stream's buffer.
MAX_EVENTS, MAX_CHARACTERS = 64, 1 << 20


def file_stream(spark, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream; the rate is bounded by files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles all that is there now, batch by batch, and ends; a restart goes on after the last batch."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def index_upsert(path: str, key: str = "doc_id") -> Callable[[DataFrame, int], None]:
    """A handler that keeps versions of a document table in the folder path: each batch is written under its own number, so a
    batch that is handled twice writes the same. current_documents() reads the newest row of each id."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("revision", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/revision={number:012d}")

    return handle


def current_documents(spark, path: str, key: str = "doc_id") -> DataFrame:
    """The newest row of each id over all revisions."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    newest = rows.groupBy(key).agg(F.max("revision").alias("revision"))
    return rows.join(newest, [key, "revision"], "left_semi")


def _pieces(pdfs: Iterator[pd.DataFrame]) -> list[tuple[int, str]]:
    return sorted((int(s), t or "") for pdf in pdfs for s, t in zip(pdf["seq"], pdf["text"], strict=True))


def stop_buffer(pieces: DataFrame, stops: list[str]) -> DataFrame:
    """pieces (stream_id, seq, text) -> (stream_id, seq, text, stopped): what may be shown so far. Text that could be the
    start of a stop string is held back until the next piece; after a stop nothing more is given out."""
    longest = max(map(len, stops)) - 1

    def run(key, pdfs, state: GroupState):
        held, stopped = state.get if state.exists else ("", False)
        for seq, text in _pieces(pdfs):
            out = ""
            if not stopped:
                held += text
                cut = min((held.find(s) for s in stops if s in held), default=-1)
                if cut >= 0:
                    out, held, stopped = held[:cut], "", True
                else:
                    keep = next((n for n in range(min(longest, len(held)), 0, -1) if any(s.startswith(held[-n:]) for s in stops)), 0)
                    out, held = held[: len(held) - keep], held[len(held) - keep :]
            yield pd.DataFrame({"stream_id": [key[0]], "seq": [seq], "text": [out], "stopped": [stopped]})
        state.update((held, stopped))

    out = "stream_id long, seq long, text string, stopped boolean"
    return pieces.groupBy("stream_id").applyInPandasWithState(run, out, "held string, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def json_stream(pieces: DataFrame) -> DataFrame:
    """pieces (stream_id, seq, text) -> (stream_id, seq, state): whether the JSON value that the stream starts with is partial,
    complete or invalid after each piece; a decided stream keeps its state."""

    def run(key, pdfs, state: GroupState):
        text, verdict = state.get if state.exists else ("", "partial")
        for seq, piece in _pieces(pdfs):
            if verdict == "partial":
                text += piece
                verdict, _ = value_end(text)
            yield pd.DataFrame({"stream_id": [key[0]], "seq": [seq], "state": [verdict]})
        state.update((text if verdict == "partial" else "", verdict))

    return pieces.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq long, state string", "text string, verdict string", "append", GroupStateTimeout.NoTimeout)


def bounded(events: DataFrame, max_events: int = MAX_EVENTS, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """(stream_id, events, characters) of a batch of events (stream_id, text); a stream beyond its bounds fails the query."""
    per = events.groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.length("text")).alias("characters"))
    over = (F.col("events") > max_events) | (F.col("characters") > max_characters)
    return per.withColumn("events", F.when(over, F.raise_error(F.concat(F.lit("stream over its bounds: "), F.col("stream_id"))).cast("long")).otherwise(F.col("events")))
