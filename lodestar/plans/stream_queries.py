"""Queries that run streams to their end and return what they made."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from ..storage import fresh_dir
from .registry import query, table


def _folder(spark) -> str:
    """A fresh folder that driver and executors share."""
    return fresh_dir(spark, "stream")


def _collected(spark, stream, where: str):
    """Appends a stream's rows to a table and reads it."""
    query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out")


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS version FROM documents")
def stream_index_upsert(spark, sf_dir):
    """Documents arrive as they are, then every seventh again, changed."""
    where = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.parquet(f"{where}/in")
    handle = S.index_upsert(f"{where}/index")
    S.run_available(S.file_stream(spark, f"{where}/in", docs.schema, 1000), f"{where}/state", handle)
    docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit("!"))).write.mode("append").parquet(f"{where}/in")
    S.run_available(S.file_stream(spark, f"{where}/in", docs.schema, 1000), f"{where}/state", handle)
    return S.current_documents(spark, f"{where}/index").select("doc_id", F.sha2("text", 256).alias("version"))


@query("SELECT conv_id AS stream_id, sum(CASE WHEN instr(a, ' of') > 0 THEN instr(a, ' of') - 1 ELSE length(a) END)::BIGINT AS shown FROM (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn, role, text) AS a FROM conversations GROUP BY conv_id) GROUP BY conv_id")
def stream_stop_buffer(spark, sf_dir):
    """Each conversation as a stream of pieces, stopped at the first ' of'."""
    where = _folder(spark)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat("text", F.lit("\n")).alias("text"))
    turns.write.parquet(f"{where}/in")
    out = _collected(spark, S.stop_buffer(S.file_stream(spark, f"{where}/in", turns.schema, 1000), [" of"]), where)
    return out.groupBy("stream_id").agg(F.sum(F.length("text")).alias("shown"))


@query("SELECT user_id AS stream_id, 'complete' AS state, count(*) AS pieces FROM events GROUP BY user_id")
def stream_json_boundary(spark, sf_dir):
    """Events of a user as pieces of one JSON array."""
    from pyspark.sql import Window

    where = _folder(spark)
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(by)).withColumn("last", F.lead("event_id").over(by).isNull())
    text = F.concat(F.when(F.col("n") == 1, "[").otherwise(","), F.col("props"), F.when(F.col("last"), "]").otherwise(""))
    pieces = e.select(F.col("user_id").alias("stream_id"), F.col("n").cast("long").alias("seq"), text.alias("text"))
    pieces.write.parquet(f"{where}/in")
    out = _collected(spark, S.json_stream(S.file_stream(spark, f"{where}/in", pieces.schema, 1000)), where)
    return out.groupBy("stream_id").agg(F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("pieces"))


@query("SELECT conv_id AS stream_id, count(*) AS events, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id")
def stream_bounded(spark, sf_dir):
    return S.bounded(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), "text"))
