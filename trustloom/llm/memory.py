"""Hand memory back between pieces of work: Python workers live on from task to task and stage to stage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of whole texts in one Arrow batch; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim  # the GNU allocator keeps what it freed unless it is told
except (AttributeError, OSError):
    _trim = None


def release() -> None:
    """Free garbage, Arrow's unused pool and the allocator's free pages."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # modules that stay: each later collection would walk all of them
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes as well as by rows: it is held on both sides of the pipe, and ten thousand texts are much.

    The session keeps the bound, since results are lazy. A smaller one stays, and so does one written with a unit.
    """
    now = spark.conf.get(_BATCH).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
