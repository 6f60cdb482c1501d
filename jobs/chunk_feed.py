"""Keeps a chunk table current while documents arrive.

Who answers questions over documents needs their chunks, and needs those of new documents soon after they come. This job reads what is
new in a folder of documents (a file stream whose checkpoint knows the files already taken), cuts the texts with the library's recursive
splitter, gives each chunk its content-addressed id, and writes

    output/chunks   partitioned by (part, batch): the chunks of each version of a document
    output/ledger   partitioned by batch: a row for each version, with its number of chunks

documents is a folder or a pattern (a single file needs one, as file streams have it). It ends when all that lay there at its start is taken, so it can run by the clock. A document that comes again replaces its earlier
version, and one that comes again without text (null or blank) is withdrawn: ``current`` reads the chunks of the last versions. Of
rows of one id in the same batch the one with the greatest hash of its text counts; rows without an id are rejected and counted.

A batch overwrites its own partitions only, so one that was cut off is written again as it was, and a run that finds nothing new
changes nothing. Batches are numbered by the checkpoint: an output folder goes with one checkpoint, and both are started anew together.

    spark-submit jobs/chunk_feed.py --documents s3://.../documents --output s3://.../feed --checkpoint s3://.../feed-checkpoint
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import main, say
from tessera.functions import scores
from tessera.functions import text as tx
from tessera.operators import chunking

LEDGER = "batch long, status string, n_chunks long"


def _one_an_id(batch: DataFrame) -> DataFrame:
    """One row for each id. Only rows whose id comes more than once are shuffled with their texts."""
    again = batch.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    marked = batch.join(again, "doc_id", "left")
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.xxhash64("text")), "text", "part")
    repeated = marked.where("times > 1").withColumn("place", F.row_number().over(best)).where("place = 1")
    return marked.where("times is null").drop("times").unionByName(repeated.drop("times", "place"))


def _chunks(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    cut = chunking.recursive(rows, size, overlap, id_col="doc_id", text_col="text", keep=("part",))
    uri = F.col("doc_id").cast("string")
    return cut.select(
        "doc_id", F.col("position").cast("long").alias("position"), scores.stable_id(uri, "position", "content").alias("chunk_id"), "content",
        F.length("content").cast("long").alias("n_chars"), tx.estimate_tokens("content").cast("long").alias("n_tokens"), "part",
    )


def run(
    spark: SparkSession, documents: str, output: str, checkpoint: str, format: str = "parquet", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    size: int = 600, overlap: int = 72, max_files: int = 1000,
) -> dict[str, Any]:
    """Takes all new files, max_files a batch; returns how many batches, documents and chunks there were."""
    schema = spark.read.format(format).load(documents).schema
    done = {"batches": 0, "documents": 0, "chunks": 0, "withdrawn": 0, "rejected": 0}
    id_type = schema[id_col].dataType.simpleString()

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(part_col).cast("string").alias("part"))
        known = _one_an_id(rows.where("doc_id is not null"))
        here = F.lit(number).cast("long").alias("batch")
        _chunks(known, size, overlap).select("*", here).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{output}/chunks")
        written = batch.sparkSession.read.schema(f"doc_id {id_type}, batch long").parquet(f"{output}/chunks").where(F.col("batch") == number)
        counts = written.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        versions = known.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("n_chunks") > 0, "live").otherwise("withdrawn").alias("status"), here)
        versions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/ledger")
        ledger = batch.sparkSession.read.schema(f"doc_id {id_type}, {LEDGER}").parquet(f"{output}/ledger").where(F.col("batch") == number)
        n, chunks, gone = ledger.agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0)), F.count_if(F.col("status") == "withdrawn")).first()
        rejected = rows.where("doc_id is null").count()
        say("batch", number=number, documents=n, chunks=chunks, withdrawn=gone, rejected=rejected, files=len(batch.inputFiles()), output=output)
        for k, v in (("batches", 1), ("documents", n), ("chunks", chunks), ("withdrawn", gone), ("rejected", rejected)):
            done[k] += v

    say("reads", documents=documents, checkpoint=checkpoint)
    stream = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", max_files).load(documents)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    say("wrote", output=output, **done)
    return done


def current(spark: SparkSession, output: str, id_type: str = "long") -> DataFrame:
    """(doc_id, position, chunk_id, content, n_chars, n_tokens, part, batch) of each document's last version."""
    ledger = spark.read.schema(f"doc_id {id_type}, {LEDGER}").parquet(f"{output}/ledger")
    last = ledger.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    chunks = spark.read.schema(f"doc_id {id_type}, position long, chunk_id string, content string, n_chars long, n_tokens long, part string, batch long").parquet(f"{output}/chunks")
    return chunks.join(last, ["doc_id", "batch"], "left_semi")


if __name__ == "__main__":
    main(run, __file__, __doc__)
