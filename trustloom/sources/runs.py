"""Runs: several tables at work at once, each for itself, and the log of what started and finished.

A run is a piece of work with a name. Runs share the cluster as jobs of one session from a few threads; each run's jobs carry a tag, so that a run
which exceeds its deadline is cancelled without the others. An error ends its own run only, and is kept in the run's row.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

LOG = "name string, status string, error string, row_count long, began timestamp, ended timestamp"


def run_all(spark: SparkSession, works: dict[str, Callable[[], DataFrame]], at_once: int = 4, deadline: float | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(results by name, one row per run): each work gives a DataFrame, which its run writes to the shared folder.

    status: ok, failed, or cancelled for a run that was still at work `deadline` seconds after its start.
    """
    from datetime import datetime, timezone

    sc, inherit = spark.sparkContext, inheritable_thread_target(spark)
    done: dict[str, DataFrame] = {}
    now = lambda: datetime.fromtimestamp(time.time(), timezone.utc)

    def run(name: str, work: Callable[[], DataFrame]) -> tuple:
        tag, began, late, over = f"run-{uuid.uuid4().hex}", now(), threading.Event(), threading.Event()

        def watch():
            if not over.wait(deadline):
                late.set()
                while not over.wait(0.2):  # also what the run starts after its time
                    sc.cancelJobsWithTag(tag)

        watcher = threading.Thread(target=inherit(watch), daemon=True)
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        try:
            if deadline is not None:
                watcher.start()
            out = scratch.stored(work(), "run")
            n = out.count()
            if late.is_set():
                raise TimeoutError
            done[name] = out
            return name, "ok", None, n, began, now()
        except Exception as e:  # noqa: BLE001  whatever a run does wrong is its own row
            state = "cancelled" if late.is_set() else "failed"
            return name, state, f"after {deadline} s" if late.is_set() else f"{type(e).__name__}: {e}"[:500], None, began, now()
        finally:
            over.set()
            sc.removeJobTag(tag)
            sc.setInterruptOnCancel(False)

    with ThreadPoolExecutor(at_once) as pool:
        log = list(pool.map(inherit(lambda nw: run(*nw)), works.items()))
    return done, spark.createDataFrame(log, LOG)


def intervals(events: DataFrame, keys: list[str], at: str, order: list[str], starts: Column, finishes: Column, status: Column) -> DataFrame:
    """keys, run_no, started, finished, status, seconds, finish_count: the runs that an append-only log of events tells of.

    A start opens a run of its key. The finishes up to the next start are the run's, late ones folded into it: the last one tells when it finished and how. A run without one is
    open: its end and seconds are null and its status is running, or abandoned if its key has started again. Finishes before any start and other events are left out.
    """
    said = events.select(*keys, F.col(at).alias("_at"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], starts.alias("_s"), finishes.alias("_f"), status.alias("_status")).filter("_s or _f")
    ordered = Window.partitionBy(*keys).orderBy(*[f"_o{i}" for i in range(len(order))])
    numbered = said.withColumn("run_no", F.sum(F.col("_s").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).filter("run_no > 0")
    place = F.struct(*[f"_o{i}" for i in range(len(order))])
    runs = numbered.groupBy(*keys, "run_no").agg(
        F.min(F.when(F.col("_s"), F.col("_at"))).alias("started"), F.max_by(F.when(F.col("_f"), F.col("_at")), F.when(F.col("_f"), place)).alias("finished"),
        F.max_by(F.when(F.col("_f"), F.col("_status")), F.when(F.col("_f"), place)).alias("_last"), F.count_if(F.col("_f")).alias("finish_count"), F.max("run_no").alias("_n"),
    )
    newest = F.max("run_no").over(Window.partitionBy(*keys))
    state = F.when(F.col("finish_count") > 0, F.col("_last")).when(F.col("run_no") < newest, "abandoned").otherwise("running")
    seconds = (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000
    return runs.withColumn("status", state).select(*keys, F.col("run_no").cast("long").alias("run_no"), "started", "finished", "status", seconds.alias("seconds"), F.col("finish_count").cast("long").alias("finish_count"))
