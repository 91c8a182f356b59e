"""Arrow batches as flat byte arrays, word positions and hashes, and steps written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.settings import ship, work_folder

# Bytes of text that a Python function works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)  # fixed values of the splitmix64 finaliser


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Steps:
    """Tables written below spark.checkpoint.dir on the way to a result.

    A written step is computed once and survives lost executors. ``drop`` and ``drop_all_but`` remove
    steps that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[int, tuple[str, DataFrame]] = {}  # with the table, so that its id stays its own

    def keep(self, df: DataFrame) -> DataFrame:
        path = work_folder(self.spark, self.name)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (path, found)
        # What the step shuffled is not needed any more; Spark deletes it once its own objects are collected.
        self.spark._jvm.System.gc()
        return found

    def drop(self, *steps: DataFrame) -> None:
        for step in steps:
            self._delete(id(step))

    def drop_all_but(self, *steps: DataFrame) -> None:
        """Remove what the result does not read: it depends on these steps only."""
        for key in self.paths.keys() - {id(s) for s in steps}:
            self._delete(key)

    def _delete(self, key: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[0])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def own_ids(rows: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``rows`` (id, text) with an id per row and, if ids had to be given, the names (id, name) to go back by and the step of both.

    Ids that are present and unique stay. Else rows are numbered and written once, so that a row keeps its number.
    """
    most, absent = rows.groupBy("id").count().agg(F.max("count"), F.count_if(F.col("id").isNull())).first()
    if (most or 0) <= 1 and not absent:
        return rows, None, None
    numbered = steps.keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    return numbered.select(F.col("row").alias("id"), "text"), numbered.select(F.col("row").alias("id"), F.col("id").alias("name")), numbered


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text; a text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def columns_of(df: DataFrame) -> str:
    """The columns of a table as a schema string."""
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in df.dtypes)


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = SLICE_BYTES
) -> DataFrame:
    """Apply a function to slices of Arrow batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


@dataclass
class Texts:
    """The texts of a slice as one byte array; a null text is empty."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.fill_null("")
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(whole[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0])

    @property
    def sizes(self) -> np.ndarray:
        return self.ends - self.starts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) in place of weak low bits."""
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a slice in order: byte range, the text each belongs to, and a 64-bit hash of its bytes."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text: its first word
    last: np.ndarray  # per text: one past its last word

    @property
    def counts(self) -> np.ndarray:
        return self.last - self.first


# Powers of an odd multiplier and of its inverse modulo 2^64, grown as needed.
_POWER = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_POWER), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_POWER, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]), dtype=U64)
    return _powers[0], _powers[1]


def find_words(texts: Texts, data: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes. ``data`` holds the normalised bytes, ``is_word`` is a table of 256 flags."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    starting = inside.copy()
    starting[1:] &= ~inside[:-1]
    heads = texts.starts[texts.sizes > 0]
    starting[heads] = inside[heads]  # a text may begin right after a word of the text before it
    ending = np.zeros(n + 1, bool)
    ending[1:] = inside[:-1] & ~(inside[1:] & ~starting[1:])
    start, end = np.flatnonzero(starting[:n]), np.flatnonzero(ending)
    power, inverse = powers_upto(max(n, 1))
    upto = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=upto[1:])
    code = (upto[end] - upto[start]) * inverse[start] if len(start) else np.zeros(0, U64)
    first, last = np.searchsorted(start, texts.starts), np.searchsorted(start, texts.ends)
    text = np.repeat(np.arange(len(first)), last - first)
    return Words(start, end, text, mix(code ^ ((end - start).astype(U64) << U64(48))), first, last)


def byte_table(*, lower: bool = True) -> np.ndarray:
    """Identity on bytes, with A-Z lower-cased."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    return out


def flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


def batch(**columns: pa.Array | np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def join_unique(rows: DataFrame, table: DataFrame, key: str, hot: Column, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, of which any may stand for a third of the rows.

    ``hot`` tells the table's keys that hold more than a thousandth of the rows. They are fewer than a thousand,
    which bounds their broadcast; no key of the shuffled rest holds more. The table should be a written step.
    """
    large, small = table.where(hot), table.where(~hot)
    known = rows.join(F.broadcast(large), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key, how)
    return known.unionByName(rest)
