"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts are handed to the per-batch code in slices of about this many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local folder only where that setting is absent (tests, one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


class Shared:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about SLICE_BYTES at most in each; a longer text is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        lengths = pa.compute.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        start = filled = 0
        for i, n in enumerate(lengths):
            if i > start and filled + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, filled = i, 0
            filled += n
        yield batch.slice(start)


def pieces(text: str, most: int = 1 << 18) -> Iterator[str]:
    """The text in parts of at most ``most`` characters, cut at blanks where there are any."""
    at = 0
    while len(text) - at > most:
        window = text[at : at + most]
        cut = max(window.rfind(" "), window.rfind("\n"), window.rfind("\t"))
        at += cut if cut > 0 else most
        yield window[:cut] if cut > 0 else window
    yield text[at:]


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, capitals aside."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sampled(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """At most ``size`` distinct rows, for each value of ``by`` if given, those with the smallest hash: a row that repeats counts
    once.

    Only rows whose hash lies below a share, estimated from the number of distinct hashes, are made distinct and ranked, so
    little is shuffled whatever the input, and a repeated row is one row before the shuffle. The shares come to the driver, one
    for each value of ``by``: it is for columns of few values.
    """
    h, rank = fresh(rows.columns, "h", "rank")
    hashed = rows.withColumn(h, F.xxhash64(*rows.columns))
    # Half as many again, and a hundred, so that neither the estimate nor chance leaves too few.
    share = lambda n: F.lit(min(1.0, (1.5 * size + 100) / max(1, n)) * float(1 << 40))
    place, n = F.pmod(F.col(h), F.lit(1 << 40)), F.approx_count_distinct(h)
    if by is None:
        few = hashed.where(place < share(hashed.agg(n).first()[0]))
        return few.dropDuplicates([h]).orderBy(h).limit(size).select(*rows.columns)
    counts = hashed.where(F.col(by).isNotNull()).groupBy(by).agg(n).collect()
    if not counts:
        return rows.limit(0)
    few = hashed.where(place < F.create_map(*[x for v, k in counts for x in (F.lit(v), share(k))])[F.col(by)]).dropDuplicates([h])
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(h))).where(F.col(rank) <= size).select(*rows.columns)


def held_out(doc_id, mod: int, remainder: int):
    """True where crc32 of doc_id's decimal text leaves that remainder; a null doc_id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(spare)}
