"""Texts from a remote model, in a job that can be stopped and started again.

Answers go to a log of Parquet files, each keyed by a hash of its prompt. A task writes its answers every ``every`` prompts, in a file whose name is that
of the run, its partition and its place there; so a task that is tried again after a lost executor finds what it has written and
goes on behind it, and a new run asks only what no file of the log answers. Equal prompts are asked once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from io import BytesIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.remote import exists, write_bytes
from paperloom.workspace import stored

LOG = pa.schema([("key", pa.string()), ("output", pa.string()), ("error", pa.string())])
LOG_SQL = "key string, output string, error string"


def key_of(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


class Pace:
    """Waits so that calls come no faster than rate a second; a rate of 0 is none."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.step, self.clock, self.sleep, self.next = 1 / rate if rate else 0.0, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.step


def asked(call: Callable[[str], str], prompt: str, tries: int, pace: Pace, wait: float) -> tuple[str | None, str | None]:
    """The text and no error, or the last error of so many tries; waits double from try to try."""
    error = None
    for k in range(tries):
        pace.wait()
        try:
            return call(prompt), None
        except Exception as e:  # noqa: BLE001  a remote service may raise anything; the row carries it
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return None, error


def log_of(spark, log: str) -> DataFrame:
    """key, output and error of all answers in the log; of a prompt asked in several runs one that has an output."""
    try:
        found = spark.read.schema(LOG_SQL).parquet(f"{log}/answers")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], LOG_SQL)
    return found.groupBy("key").agg(F.max("output").alias("output"), F.max("error").alias("error")).withColumn("error", F.when(F.col("output").isNull(), F.col("error")))


def generated_with_log(
    rows: DataFrame, client: Callable[[], Callable[[str], str]], log: str, prompt: str = "prompt", every: int = 20, tries: int = 3, wait: float = 2.0, rate: float = 0.0, slots: int | None = None
) -> DataFrame:
    """rows with output and error. client() gives a function from prompts to texts, made once a task.

    log is a folder that executors and driver share. rate: calls a second that an executor may make; each of its slots, the tasks it runs at a time
    (as configured, or given), keeps to its part. Prompts that failed in an earlier run are asked again; a null prompt has neither output nor error.
    """
    spark = rows.sparkSession
    done = log_of(spark, log).filter("output is not null")
    todo = rows.select(F.col(prompt).cast("string").alias("prompt")).filter("prompt is not null").distinct().withColumn("key", key_of(F.col("prompt")))
    run = time.strftime("%Y%m%d%H%M%S", time.gmtime()) + f"-{time.time_ns() % 10**9:09d}"
    # stored, so that a task that is tried again gets the same prompts in the same order
    todo = stored(todo.join(done.select("key"), "key", "left_anti"), f"{log}/runs/{run}")
    conf = spark.sparkContext.getConf()
    cores = int(conf.get("spark.executor.cores", "0")) or spark.sparkContext.defaultParallelism
    share = rate / (slots or max(1, cores // int(conf.get("spark.task.cpus", "1"))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pace, call, part = Pace(share), None, TaskContext.get().partitionId()
        chunks = chunked((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), every)
        for k, chunk in enumerate(chunks):
            name = f"{log}/answers/{run}-{part}-{k}.parquet"
            if exists(name):
                continue
            call = call or client()
            held = [(key, *asked(call, text, tries, pace, wait)) for key, text in chunk]
            out = BytesIO()
            pq.write_table(pa.table([list(c) for c in zip(*held, strict=True)], schema=LOG), out)
            write_bytes(name, out.getvalue())
        yield from ()

    todo.select("key", "prompt").mapInArrow(ask, "key string").write.format("noop").mode("overwrite").save()
    answers = log_of(spark, log).select(F.col("key").alias("_key"), "output", "error")
    return rows.join(answers, key_of(F.col(prompt).cast("string")) == F.col("_key"), "left").drop("_key")


def chunked(items: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    chunk: list[tuple] = []
    for item in items:
        chunk.append(item)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
