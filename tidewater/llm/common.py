"""What several corpus operators share: the shared folder, skew-safe joins, ASCII case folding."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The white space that the contracts name, as characters.
WHITE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one if driver and
    executors are one process, as in tests; an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Deletes the folders of staged tables, or named ones, that nothing reads any more."""
    for table in tables:
        path = table if isinstance(table, str) else table._staged_at
        jvm, conf = SparkSession.active()._jvm, SparkSession.active()._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def free_names(columns: list[str], *stems: str) -> list[str]:
    """The stems, each with as many underscores as make it differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def others(columns: list[str], *names: str) -> list[str]:
    """The columns that bear none of these names, whatever their case, as Spark tells names apart by letters only."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def fresh(key: Column | str) -> Column:
    """The same key as a new expression. An aggregate's output is already dealt by its key, and Spark can split
    a hot key of a join only if it deals both sides itself; a derived key makes it do so."""
    return F.concat(F.col(key) if isinstance(key, str) else key, F.lit(""))


def fresh_long(key: Column | str) -> Column:
    """fresh() for whole numbers."""
    return F.bitwise_not(F.bitwise_not(F.col(key) if isinstance(key, str) else key) + F.lit(0).cast("long"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def bounded_sample(df: DataFrame, group: str, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each group, picked by a hash of the id: the same rows however the table is dealt."""
    counts = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    if not counts:
        return df
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, bound / n))])
    place = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(place < F.try_element_at(share, F.col(group)))


def with_columns(df: DataFrame, text_col: str, make, added: str, keep_text: bool = False) -> DataFrame:
    """df with columns computed from one text column in Arrow batches; all others pass through as they are.

    make() is called once a task and gives a function from some texts (a list of str or None) to rows of the added
    columns. added: their DDL; columns of these names are replaced. Batches are taken 128 rows at a time.
    """
    new = T._parse_datatype_string(added)
    kept = others(df.columns, *new.names)
    fields = [f for f in df.schema.fields if f.name in kept and (keep_text or f.name != text_col)]
    names = [f.name for f in fields]
    kinds = to_arrow_schema(new)

    def run(batches):
        found = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                rows = found(part.column(part.num_columns - 1).to_pylist())
                columns = [pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *columns], names=[*names, *new.names])

    return df.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, T.StructType([*fields, *new.fields]))
