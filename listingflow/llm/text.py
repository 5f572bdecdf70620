"""Small helpers shared by the text operators."""

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_blocks(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about a megabyte of text each.

    bytes.split() cuts at exactly the six ASCII spaces (x20, x09 to x0D), so a
    very long text never exists as one list of words.
    """
    at = 0
    while at < len(data):
        cut = len(data)
        if at + block < len(data) and (m := _SPACE.search(data, at + block)):
            cut = m.start()
        if words := data[at:cut].split():
            yield words
        at = cut


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of at most some bytes of text.

    A longer text is a slice of its own. So what Python makes of a slice has a
    size that depends neither on the batch nor on how long its rows are.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return the memory that Arrow and the allocator keep to the system, at the
    end of a task: the worker may wait for its next one beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
