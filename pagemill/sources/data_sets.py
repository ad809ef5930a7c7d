"""A data set of several configurations and splits as one frame, of splits whose columns differ too.

Every folder path/[snapshots/revision/][config/]split is a scan of its own with its names as literal columns, so a filter on config or
split leaves only the scans it asks for. Columns of one name and differing types get a type that holds both: the wider number,
structs with the fields of both, arrays of such elements, else a string (JSON where one side is nested).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


def joined_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys(a.names + b.names))
        return T.StructType([T.StructField(n, joined_type(a[n].dataType, b[n].dataType) if n in a.names and n in b.names else (a if n in a.names else b)[n].dataType) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(joined_type(a.elementType, b.elementType))
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: next(k for k, w in enumerate(_WHOLE) if isinstance(t, w)))
    if isinstance(a, _WHOLE + _REAL) and isinstance(b, _WHOLE + _REAL):
        return T.DoubleType()
    return T.StringType()


def as_type(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column of the one type as the other, which joined_type made of it and others; fields that it lacks are null."""
    if have == want:
        return column
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        fields = [(as_type(column.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(column, lambda x: as_type(x, have.elementType, want.elementType))
    if isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast(want)


def split_folders(spark: SparkSession, path: str) -> list[tuple[str | None, str, str, str]]:
    """(revision, config, split, folder) of every folder that holds Parquet files, in order; config is `default` where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[tuple[str | None, str, str, str]] = []

    def look(folder, names: tuple[str, ...]) -> None:
        inside = list(store.listStatus(folder))
        below = [f.getPath() for f in inside if f.isDirectory() and not f.getPath().getName().startswith(("_", "."))]
        if any(f.isFile() and f.getPath().getName().endswith(".parquet") for f in inside) or any("=" in p.getName() for p in below):
            revision, rest = (names[1], names[2:]) if names[:1] == ("snapshots",) and len(names) > 2 else (None, names)
            if rest:
                found.append((revision, "/".join(rest[:-1]) or "default", rest[-1], folder.toString()))
            return
        for p in below:
            look(p, (*names, p.getName()))

    if store.exists(root):
        look(root, ())
    return sorted(found, key=lambda f: (f[0] or "", *f[1:]))


def read_data_set(spark: SparkSession, path: str, config: str | None = None, split: str | None = None, revision: str | None = None, limit: int | None = None, streaming: bool = False) -> DataFrame:
    """All splits asked for, with columns config, split and revision; a column of the data that has one of these names gives way.

    A limit keeps any so many rows and no scan reads more than these. Several revisions and none named, or nothing found, raise.
    With streaming=True new files of the splits that are there when the stream is made come as a stream, which takes no limit.
    """
    folders = [f for f in split_folders(spark, path) if (config or f[1]) == f[1] and (split or f[2]) == f[2] and (revision or f[0]) == f[0]]
    if not folders:
        raise ValueError(f"no Parquet files in {path} for config {config}, split {split}, revision {revision}")
    if len({f[0] for f in folders}) > 1:
        raise ValueError(f"several revisions in {path}: name one")
    if streaming and limit is not None:
        raise ValueError("a stream takes no limit")
    marks = ("revision", "config", "split")
    frames = [spark.read.option("mergeSchema", True).parquet(f[3]).drop(*marks) for f in folders]
    if streaming:
        frames = [spark.readStream.schema(f.schema).parquet(where[3]) for f, where in zip(frames, folders, strict=True)]
    want = reduce(joined_type, (f.schema for f in frames))

    def shaped(frame: DataFrame, where: tuple) -> DataFrame:
        have = frame.schema
        columns = [as_type(F.col(f"`{w.name}`"), have[w.name].dataType, w.dataType) if w.name in have.names else F.lit(None).cast(w.dataType) for w in want]
        return frame.select(*(c.alias(w.name) for c, w in zip(columns, want, strict=True)), *(F.lit(x).cast("string").alias(n) for n, x in zip(marks, where, strict=False)))

    out = reduce(DataFrame.unionByName, (shaped(f, w) for f, w in zip(frames, folders, strict=True)))
    return out if limit is None else out.limit(limit)
