"""Small helpers for sessions and tables."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that a lost executor costs no recomputation. The folder
    is the session's spark.checkpoint.dir; only where none is set and all runs on one machine, a local folder is used."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("On a cluster spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of results that nothing refers to any more. Its cleaner acts
    when the driver's garbage is collected, which a loop of small jobs doesn't bring about by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pick(df: DataFrame, **named: str) -> DataFrame:
    """The columns of df that are called named.values(), as named.keys(). Names are compared exactly, and the first of
    equal names counts, so that other columns whose names clash (in case, or entirely) do no harm."""
    names = df.columns
    held = df.toDF(*[f"_{i}" for i in range(len(names))])
    return held.select(*[held[f"_{names.index(have)}"].alias(new) for new, have in named.items()])


def held(df: DataFrame) -> DataFrame:
    """df with its columns called _0, _1 and so on, which no name can clash with; toDF(*names) gives the names back."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def rows_to(out, schema):
    """A RecordBatch of lists by name, in the types of an Arrow schema."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(schema, out)], schema=schema)
