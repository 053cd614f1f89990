"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str | None) -> list[str]:
    """Words of a text as ``WORD`` finds them; a null text has none."""
    if not text:
        return []
    return [w for w in text.translate(_SPACES).split(" ") if w]


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, and those of them that are Python objects at once. Texts can be long: both bound memory.
BATCH, ROWS = 1000, 200


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Arrow batches of at most ``BATCH`` rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, BATCH)
    return df


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``ROWS`` rows, without copies."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to columns of a few hundred rows (as Python lists), Arrow in and out, with no shuffle."""
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return bounded(df).mapInArrow(run, out)


def held_out(doc_id: Column, folds: int) -> Column:
    """True for rows whose crc32 of the id as text is divisible by ``folds``; a null id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % F.lit(folds) == 0


def ensure_checkpoints(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the session says, else, in a local session only, one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="kindred-checkpoints-")
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, salt_by: Iterable[str], how: str = "left", salts: int = 32) -> DataFrame:
    """Join a left side with hot keys to a right side with unique keys: each right row is repeated once a salt."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    return a.join(b, [key, "__salt"], how).drop("__salt")


def keep_rows(df: DataFrame, keep: Callable[[list], list[bool]], column: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, for which ``keep`` of the column's values is true; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(batch.column(column).to_pylist()), pa.bool_()))

    return bounded(df).mapInArrow(run, df.schema)


#: Most ids that are broadcast to be dropped (8 bytes each, some 20 in a hash table).
MAX_BROADCAST_IDS = 300_000


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` isn't in ``ids(doc_id)``; null ids stay. Broadcast only if few, else shuffled."""
    gone = materialise(ids.where("doc_id is not null").distinct(), "gone")
    few = gone.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
