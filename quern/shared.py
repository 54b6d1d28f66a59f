"""The folder that all executors reach, and cuts of the lineage in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and Spark runs on one machine."""
    sc = spark.sparkContext
    got = sc._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read back: it then has the size of its files.

    A checkpoint keeps the planner's estimate, which loops of several joins multiply until it has more digits
    than can be handled; it keeps its partitioning, too, which is better for loops that join by one key.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(rows: DataFrame, key: str, order: list[str], columns: list[str], step, result, schema: str) -> DataFrame:
    """(key, result): rows of each key in order through step(state, values), beginning with None, one at a time.

    Rows are sorted within partitions and stream by, so one state is held however many rows a key has; what is
    sequential by its nature then takes one task for a key, but no memory.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    kind = T.StructType([rows.schema[key], *T._parse_datatype_string(schema).fields])
    names = [f.name for f in kind.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        now, state, out, any_row = None, None, [], False
        for batch in batches:
            for k, *values in zip(batch.column(key).to_pylist(), *[batch.column(c).to_pylist() for c in columns]):
                if any_row and k != now:
                    out.append({names[0]: now, names[1]: result(state)})
                    state = None
                now, any_row = k, True
                state = step(state, tuple(values))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if any_row:
            out.append({names[0]: now, names[1]: result(state)})
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)
