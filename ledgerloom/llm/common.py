"""What the operators of this subpackage share: tables, the shared folder, and vectorised words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.shared import shared_folder

#: Bytes of text, and texts, that one vectorised step takes at a time at most; a longer text is a step of its own.
STEP_BYTES, STEP_TEXTS = 1 << 20, 1024

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
# Every byte that is no word byte becomes a space; A-Z become a-z. Word bytes are 0-9, a-z and all of 0x80-0xFF.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, see ``shared_folder``."""
    return shared_folder(spark, f"ledgerloom-{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors and is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """Session settings for the jobs that are run inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fold(text: str | None) -> bytes:
    """Words of a text, lower-cased (A-Z) and joined by spaces; runs of spaces may remain."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for key, base in (("up", _PRIME), ("down", _INVERSE)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """Words of several texts at once: byte ranges in ``data``, and per text the range of its words."""

    def __init__(self, texts: list[str | None]):
        folded = [fold(t) for t in texts]
        self.data = np.frombuffer(b" " + b" ".join(folded) + b" ", dtype=np.uint8)
        is_word = self.data != 32
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        text_ends = np.cumsum([len(f) + 1 for f in folded], dtype=np.int64)
        #: words first[i]..first[i + 1] are those of text i
        self.first = np.concatenate([[0], np.searchsorted(self.starts, text_ends, side="right")]).astype(np.int64)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def prefix_sums(self) -> np.ndarray:
        up, _ = _power_table(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], dtype=np.uint64)
        return np.concatenate([np.zeros(1, dtype=np.uint64), sums])

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the byte ranges (by default the words): equal bytes give equal hashes in every process."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        sums = self.prefix_sums() if sums is None else sums
        _, down = _power_table(len(self.data) + 1)
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def give_back() -> None:
    """At the end of a task: memory that is free goes back to the machine. Workers live on, and the next stage has its own peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def steps(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts, given by their lengths, of at most STEP_BYTES and STEP_TEXTS together or of one text."""
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + STEP_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + STEP_TEXTS)
        yield start, stop
        start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def map_texts(df: DataFrame, fn: Callable[[list[str | None]], dict], schema: str, text: str = "text", keep: bool = False, after: Callable[[], None] | None = None) -> DataFrame:
    """Columns of ``df``, without ``text`` unless ``keep``, and those of ``schema``, which ``fn`` gives for a list of texts.

    ``fn`` gets neighbouring texts of about STEP_BYTES, never a whole batch; other columns pass through as Arrow.
    ``after`` is called at the end of every task and drops what ``fn`` has cached: workers live on into other stages.
    """
    new = StructType.fromDDL(schema)
    kept = [c for c in df.columns if keep or c != text]
    out = StructType(df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields + new.fields)
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in steps(byte_lengths(texts)):
                made = fn(texts.slice(a, b - a).to_pylist())
                here = batch.slice(a, b - a)
                arrays = [here.column(here.schema.get_field_index(c)) for c in kept]
                arrays += [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new.names])
        if after:
            after()
        give_back()

    return df.mapInArrow(run, out)


def apart(docs: DataFrame) -> tuple[DataFrame, list[Column], str]:
    """``docs`` with its columns named by place, so that no name of theirs can clash; the columns that give the names
    back; and the name by which the text, as a string, is found."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rows, text = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names["text"]
    if docs.schema["text"].dataType.simpleString() != "string":
        rows, text = rows.withColumn("_text", F.col(text).cast("string")), "_text"
    return rows, [F.col(n).alias(c) for c, n in names.items()], text


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string: all that an operator on texts reads."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``width`` words; a text of fewer words, but one at least, has one run of all its words."""
    h = words.hashes()
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = np.where(words.counts == 0, 0, np.maximum(words.counts - width + 1, 1))
    text = np.repeat(np.arange(len(n)), n)
    at = np.repeat(words.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros(len(at), dtype=np.uint64)
    last = words.first[1:][text]
    with np.errstate(over="ignore"):
        for j in range(width):
            here = at + j
            inside = here < last
            out = out * np.uint64(0x100000001B3) + np.where(inside, h[np.minimum(here, len(h) - 1)], np.uint64(7))
    return text, mix(out)
