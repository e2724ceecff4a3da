"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.sources.shared import cut, shared_folder  # noqa: F401 (the pipeline takes both from here)
from quillspark.sources.tables import read_table, spread

#: Bytes of text that one vectorised step holds at a time; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Entries that a worker's memo of words may hold before it starts anew.
MEMO_WORDS = 400_000


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """A worker's state of one operator, kept from task to task; what another operator left is given back first."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; texts and pages over all cores, also where the file is one split."""
    df = read_table(spark, sf_dir, table)
    return spread(df) if table in ("documents", "pages") else df


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def distinct_ids(docs: DataFrame, id_column: str = "doc_id") -> bool:
    """Whether no id repeats or is null."""
    ids = docs.groupBy(id_column).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.coalesce(F.bool_or(F.col(id_column).isNull()), F.lit(False)).alias("missing")).first()
    return (ids.most or 1) == 1 and not ids.missing


def numbered(docs: DataFrame, name: str = "own", id_column: str = "doc_id", distinct: bool | None = None) -> DataFrame:
    """docs with a number of each row's own that orders as the id does (null last).

    Distinct ids are their own numbers. Where ids repeat or are null the rows are sorted by
    id and text and written with their places, so that rows alike in both have an order too.
    """
    if distinct_ids(docs, id_column) if distinct is None else distinct:
        return docs.withColumn(name, F.col(id_column).cast("long"))
    # the last key deals rows alike in id and text, of which there may be many, over several tasks
    order = docs.orderBy(F.col(id_column).asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    return cut(order.withColumn(name, F.monotonically_increasing_id()))


#: Ids that may be broadcast to the documents (at most 24 MB); more are shuffled.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows of docs whose id isn't in ids (one column); a null id stays. The counted side is broadcast only below a bound."""
    name = free_name(docs, "left_out")
    ids = cut(ids.toDF(name).where(F.col(name).isNotNull()).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_column] == ids[name], "left_anti")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches of about STEP_BYTES of text each, with the texts' UTF-8 bytes (null: empty)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, n = 0, batch.num_rows
        while start < n:
            room, end = STEP_BYTES, start
            while end < n and (end == start or room >= lengths[end]):
                room -= int(lengths[end])
                end += 1
            part = batch.slice(start, end - start)
            yield part, part.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
            start = end


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in one list, and the bounds of each text in it.

    bytes.split() splits on exactly the six ASCII white-space bytes.
    """
    words: list[bytes] = []
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        words += t.split()
        bounds[i + 1] = len(words)
    return words, bounds


def word_ids(words: list) -> np.ndarray:
    """Exact ids of words, valid within this call only."""
    ids: defaultdict = defaultdict(count().__next__)
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_of(df: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns of the input can't clash."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


class Forest:
    """Union-find whose root is the least member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x], x = root, p
        return root

    def union(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True
