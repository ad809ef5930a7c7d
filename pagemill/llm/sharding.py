"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Law `bytes`: shard sizes (UTF-8 bytes of the text plus 16 a row) come out near equal; tokens and rows do as well, as far as
groups allow. A group is all rows of one text. It is placed whole, unless it is larger than a shard in bytes, tokens or rows:
then it is cut into pieces that are placed like groups.

Packing is sequential, so it runs over parcels whose number has a bound that does not grow with the data. The unit is
1 / (shards * grain) of all bytes, tokens or rows, whichever is the largest share. A group of a unit or more is a parcel of
its own (at most 3 * shards * grain). Smaller groups are hashed into parcels of about a unit, each class of texts, by bytes
and by tokens a byte, into its own, so that a parcel's vector is as narrow or wide as its groups. Each parcel, largest
first, goes to the shard where the dot product of its vector with the shard's residual capacity is highest, among the shards
that it fits into; where it fits into none, to the one that it overloads least. Then parcels of unlike shards are exchanged
while that evens out the loads.

Slots number the rows of a shard from 0 without gaps. Parcels over a unit are numbered in parts of about a unit, whose
offsets the driver's table holds, so no task ever sorts a whole shard or a whole group.

Nulls: a null text has no bytes and no tokens, its size is 16, its crc32 is 0; all null texts are one group, apart from
the empty text. Null ids are allowed; rows without an id are spread like others where their group is cut. Repeated rows each
take a slot; which of two equal rows comes first is immaterial. Ties of vectors are placed by the parcel's name. A very long
text is a group like any other. Columns beside id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import cleared, keyed, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of bytes, tokens and rows while parcels are exchanged.
EVEN = np.array([2.0, 1.0, 1.0])


def pack(vectors: np.ndarray, shards: int, rounds: int = 4000) -> np.ndarray:
    """Shard of each vector (bytes, tokens, rows): largest first, highest dot product with the residual capacity; then exchanges."""
    scale = vectors.sum(0) / shards
    v = vectors / np.where(scale > 0, scale, 1)
    left = np.ones((shards, v.shape[1])) * (scale > 0)
    out = np.zeros(len(v), np.int64)
    for k in np.lexsort((np.arange(len(v)), -v[:, 0], -v.max(1))):
        fits = (left >= v[k] - 1e-12).all(1)
        score = np.where(fits, left @ v[k], -np.inf) if fits.any() else -(v[k] - left).max(1)
        out[k] = s = int(score.argmax())
        left[s] -= v[k]
    return exchanged(v * EVEN, out, shards, rounds)


def exchanged(v: np.ndarray, out: np.ndarray, shards: int, rounds: int, most: int = 400) -> np.ndarray:
    """Moves and swaps between the shard that is furthest off the mean and those that are off most the other way.

    Of a shard with more than `most` vectors the smallest are tried.
    """
    load = np.stack([np.bincount(out, v[:, c], shards) for c in range(v.shape[1])], 1)
    off, largest = load - load.mean(0), v.max(1)
    tired = np.zeros(shards, bool)  # shards that no exchange evens out as things are

    def inside(s: int) -> np.ndarray:
        at = np.flatnonzero(out == s)
        return at if len(at) <= most else at[np.argsort(largest[at], kind="stable")[:most]]

    for _ in range(rounds):
        far = np.where(tired, -1, (off**2).sum(1))
        s = int(far.argmax())
        if far[s] < 1e-9:
            break
        own = inside(s)
        for t in np.argsort(off @ off[s], kind="stable")[:4].tolist():
            its = inside(t)
            given = np.vstack([np.zeros(v.shape[1]), v[its]])  # the first is nothing: a move
            d = v[own][:, None] - given[None]
            gain = 2 * (d * (off[s] - off[t] - d)).sum(2)
            if gain.size and gain.max() > 1e-9:
                i, j = divmod(int(gain.argmax()), len(given))
                out[own[i]] = t
                if j:
                    out[its[j - 1]] = s
                off[s] -= d[i, j]
                off[t] += d[i, j]
                tired[:] = False
                break
        else:
            tired[s] = True
    return out


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", grain: int = 256) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null under this law), tokens."""
    docs, spark = keyed(df, id_col, text_col), df.sparkSession
    raw, scratch = F.col("text").cast("binary"), []
    rows = stored(
        docs.select(
            "id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).alias("crc"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("g"),
            F.xxhash64("id", F.monotonically_increasing_id()).alias("spread"),  # ids may repeat
        ),
        "rows",
        scratch,
    )
    all_bytes, all_tokens, all_rows = (x or 0 for x in rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first())
    share = F.greatest(*(F.col(c) / float(max(1, n)) for c, n in (("size", all_bytes), ("tokens", all_tokens), ("n", all_rows))))
    # classes are of a text, not of a group, so a row knows its own: powers of two of bytes, steps of tokens a byte
    kind = F.concat_ws(".", F.floor(F.log2("size")).cast("string"), F.floor(F.least(F.col("tokens") / F.col("size"), F.lit(1.0)) * 8).cast("string"))
    groups = rows.groupBy("g", "size", "tokens").agg(F.count("*").alias("n")).select("g", kind.alias("kind"), "n", (F.col("size") * F.col("n")).alias("size"), (F.col("tokens") * F.col("n")).alias("tokens"))
    groups = stored(groups.withColumn("units", share * (shards * grain)), "groups", scratch)
    large = groups.where("units >= 1").select(F.col("g").alias("g_"), F.ceil("units").cast("int").alias("parts"), (F.col("units") > grain).alias("cut"))
    small = groups.where("units < 1").groupBy("kind").agg(F.greatest(F.lit(1), F.ceil(F.sum("units"))).cast("int").alias("parcels")).withColumnRenamed("kind", "kind_")
    # rows of `large` are at most 3 * shards * grain, of `small` one for each class
    dealt = rows.withColumn("kind", kind).join(F.broadcast(large), F.col("g") == F.col("g_"), "left").join(F.broadcast(small), F.col("kind") == F.col("kind_"), "left")
    part = F.pmod("spread", "parts").cast("string")
    name = F.when(F.col("g_").isNull(), F.concat_ws("/", F.col("kind"), F.pmod("g", "parcels"))).when(F.col("cut"), F.concat_ws("/", F.col("g"), part)).otherwise(F.col("g").cast("string"))
    dealt = dealt.select("id", "size", "crc", "tokens", "g", name.alias("parcel"), F.when(F.col("g_").isNotNull() & ~F.col("cut"), F.pmod("spread", "parts")).otherwise(0).cast("int").alias("part"))
    dealt = stored(dealt, "parcels")
    cleared(spark, scratch)
    found = sorted(map(tuple, dealt.groupBy("parcel", "part").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()))
    names = sorted({p[0] for p in found})
    number = {p: k for k, p in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    for p in found:
        vectors[number[p[0]]] += p[2:]
    placed = pack(vectors, shards) if names else []
    offset, table = [0] * shards, []
    for p, part_, _, _, n in found:
        s = int(placed[number[p]])
        table.append((p, part_, s, offset[s]))
        offset[s] += n
    where = spark.createDataFrame(table, T.StructType([T.StructField("parcel", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("start", T.LongType())]))
    place = Window.partitionBy("parcel", "part").orderBy("g", "id", "size")
    return (
        dealt.withColumn("row", F.row_number().over(place) - 1)
        .join(F.broadcast(where), ["parcel", "part"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "tokens",
        )
    )
