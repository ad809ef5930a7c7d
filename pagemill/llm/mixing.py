"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its share of all words by weight, but never over `most` times its size; the excess goes to the other
sources by weight until none is above. The level that all uncapped sources share is found in closed form: in order of
cap / weight the capped sources are a prefix.

Inside a source documents have unequal expected copies: `most` at most, else in proportion to a factor, by which the expected
words add up to the target (again in closed form, over the levels of the factor). The factor is a column that `odds` names, in
sixteenths from 1/16 to 16, or by default 1 + k / 8 for a text of k binary digits of words beyond the first, a mild preference
for long texts. Every document takes its whole expected copies for certain. What is left of each, p, is its inclusion
probability in a Pareto order sample: its rank is the odds of a uniform number (from a digest of id and text) divided by
its inclusion odds p / (1 - p). Documents are taken in order of rank until the words reach what the certain copies leave of
the target, the last one only if that comes nearer. Documents of over 1 / BIG of these words are drawn first, among
themselves, for the words expected of them, and the others fill up the rest, so one giant text cannot end the filling; what
is then still missing goes to documents not drawn that fit into it, again by rank.
Running sums go over cells of ranks first and then inside a cell; the number of cells grows with the rows, so no task ever
sees a whole source. No document gets more than `most` copies.

Nulls: a null text has size 0; the null source is a source of its own, last in order; a null id is sampled by its text; a null
factor is 1. Reruns agree. Ties of rank are taken by digest; repeated rows have equal ranks and are told apart arbitrarily.
Texts are counted whole, however long. mix_sources reads no column beside id, text, source and factor; mixed_rows hands all
columns through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
CELLS, CELL_ROWS, BIG = 4096, 50_000, 64
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def filled_up(parts: DataFrame, by: list[str], order: list[Column], total: Column) -> DataFrame:
    """For parts with a cap and a weight w, per group: `level`, so that min(cap, level * w) adds up to total. Few rows a group."""
    group, before = Window.partitionBy(*by).rowsBetween(*_ALL), Window.partitionBy(*by).orderBy((F.col("cap") / F.col("w")).asc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    s = parts.withColumn("t", total).withColumn("ws", F.sum("w").over(group))
    s = s.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", F.col("cap") * (F.col("ws") - F.col("w0")) <= F.col("w") * (F.col("t") - F.col("c0")))
    s = s.withColumn("cc", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(group), F.lit(0)))
    return s.withColumn("cw", F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(group), F.lit(0)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From (source, source_size), one row per source: adds target. One row per source is all these windows see."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    s = filled_up(s, [], [F.col("source").asc_nulls_last()], F.sum("source_size").over(Window.rowsBetween(*_ALL)))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("w") * (F.col("t") - F.col("cc"))).cast("double") / (F.col("ws") - F.col("cw")))
    return s.select("source", "source_size", target.alias("target"))


def _key(id_: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", id_.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, odds: str | None = None, label: str = "rows") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken, p (its inclusion probability), and key."""
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    rows = df.select(
        id_.alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.coalesce(F.col(odds).cast("double"), F.lit(1.0)) if odds else F.lit(None).cast("double")).alias("given"),
        _key(id_, text).alias("key"),
        F.monotonically_increasing_id().alias("rid"),  # tells repeated rows apart once it is stored
    )
    by_length = 1 + (F.length(F.bin("size")) - 1) / F.lit(8.0)
    rows = rows.withColumn("factor", F.greatest(F.lit(0.0625), F.least(F.lit(16.0), F.round(F.col("given") * 16) / 16)) if odds else by_length).drop("given")
    rows = stored(rows, label)
    levels = rows.groupBy("source", "factor").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    levels = stored(levels, f"{label}-levels")  # at most 256 a source
    targets = source_targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = stored(targets.withColumnRenamed("source", "s"), "targets")
    own = levels.join(F.broadcast(targets), levels.source.eqNullSafe(targets.s)).drop("s")
    # expected copies of a level: most, or its factor times the level k at which the words add up to the target
    own = own.withColumn("cap", (F.col("words") * most).cast("double")).withColumn("w", F.col("factor") * F.col("words"))
    own = filled_up(own.where("words > 0"), ["source"], [F.col("factor").desc()], F.col("target"))
    copies = F.when(F.col("capped"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("factor") * ((F.col("t") - F.col("cc")) / (F.col("ws") - F.col("cw")))))
    own = own.withColumn("expected", copies).withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    own = own.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source").rowsBetween(*_ALL)))
    own = stored(own.select(F.col("source").alias("s"), F.col("factor").alias("f"), "whole", "p", "rest"), f"{label}-expected")
    total = levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells_ = max(CELLS, total // CELL_ROWS)
    r = rows.join(F.broadcast(targets), rows.source.eqNullSafe(targets.s), "left").drop("s")
    r = r.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s")) & (F.col("factor") == F.col("f")), "left").drop("s", "f")
    u = (F.conv(F.substring("key", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    r = r.withColumn("rank", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))).withColumn("big", F.col("size") * BIG > F.col("rest"))
    r = stored(r, f"{label}-ranked")
    drawn, kept = r.where("rank IS NOT NULL"), r.where("rank IS NULL").withColumn("extra", F.lit(0))
    words = lambda of: of.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("extra") * F.col("size")).alias("got"))
    # the big ones: as many words as are expected of them; the others: what is then left; last, whatever still fits in
    hoped = drawn.where("big").groupBy("source", "p").agg(F.sum("size").alias("words")).groupBy(F.col("source").alias("s")).agg(F.sum(F.col("p") * F.col("words")).alias("room"))
    big = _drawn(drawn.where("big"), stored(hoped, f"{label}-hoped"), cells_, f"{label}-big")
    room = targets.select("s").join(own.select(F.col("s").alias("s_"), "rest").distinct(), F.col("s").eqNullSafe(F.col("s_"))).drop("s_")
    left = lambda of: stored(_left(room, words(of)), f"{label}-left")
    small = _drawn(drawn.where("NOT big"), left(big), cells_, f"{label}-small")
    both = big.unionByName(small)
    gaps = left(both)
    late = both.where("extra = 0").join(F.broadcast(gaps.withColumnRenamed("room", "gap")), F.col("source").eqNullSafe(F.col("s"))).where("size <= gap").drop("s", "gap", "extra")
    late = _drawn(late, gaps, cells_, f"{label}-late").where("extra > 0")
    rest = both.join(late.select(F.col("source").alias("s"), F.col("key").alias("k"), F.col("rid").alias("r_")), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")) & (F.col("rid") == F.col("r_")), "left_anti")
    out = rest.unionByName(late).unionByName(kept).drop("rid")
    copies = F.coalesce("whole", F.lit(0)) + F.col("extra")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.coalesce("p", F.lit(0.0)).alias("p"), "key")


def _left(room: DataFrame, got: DataFrame) -> DataFrame:
    """(s, room): what the words that each source has got leave of its rest."""
    return room.join(got.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")), "left").select("s", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("room"))


def _drawn(rows: DataFrame, rooms: DataFrame, cells_: int, label: str) -> DataFrame:
    """Rows with extra, 1 for those that in order of rank come before the middle of a document passes their source's room."""
    # a cell is a range of rank, not a count: x / (1 + x) lies in 0..1 and keeps the order
    rows = rows.withColumn("cell", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * cells_), F.lit(cells_ - 1)))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    cells = cells.join(F.broadcast(rooms), F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("cell").alias("c"), "start", "room")
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    inside = Window.partitionBy("source", "cell").orderBy("rank", "key", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("start") + F.sum("size").over(inside)
    return stored(rows.withColumn("extra", F.when(2 * before - F.col("size") <= 2 * F.col("room"), 1).otherwise(0)).drop("cell", "start", "room"), label)


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, each row as often as it is taken.

    Copies are joined back by the digest of id and text and the source. Rows that repeat in all three have one or two numbers
    of copies; two only where the end of a sample falls between them, and only such rows are numbered to tell them apart.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    taken = mix_sources(df, **options).groupBy("key", F.col("source").alias("s")).agg(F.min("copies").alias("low"), F.max("copies").alias("high"), F.sum("copies").alias("all"), F.count("*").alias("n"))
    packed = df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), _key(df[f"`{id_col}`"].cast("long"), df[f"`{text_col}`"].cast("string")).alias("key_"), df[f"`{source_col}`"].cast("string").alias("source_"))
    both = packed.join(taken, (F.col("key_") == F.col("key")) & F.col("source_").eqNullSafe(F.col("s")))
    even = both.where("low = high").select("row", F.col("low").alias("copies"))
    parted = both.where("low < high").withColumn("place", F.row_number().over(Window.partitionBy("key_", "source_").orderBy("low")))
    parted = parted.select("row", F.when(F.col("place") <= F.col("all") - F.col("low") * F.col("n"), F.col("high")).otherwise(F.col("low")).alias("copies"))
    out = even.unionByName(parted).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
