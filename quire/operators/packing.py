"""Order-dependent operators as windows and folds inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T


#: Starts of parts are held in arrays of so many, as appending copies an array.
_CHUNK = 512


def pack(pieces: Column, limit: int, heading: str = r"(?s)^\s*<h[12][\s>].*") -> Column:
    """Part number (from 1) of each piece of an ordered array.

    A part takes pieces while its estimate stays within the limit; a heading begins a new one.  The estimate is
    of the part's characters, as rounded estimates don't add up, so the fold carries weights that do.
    """
    count = lambda p: 6 * F.length(p) - 5 * T.ascii_count(p)
    return pack_weights(F.transform(pieces, lambda p: F.struct(count(p).cast("bigint").alias("w"), p.rlike(heading).alias("heading"))), limit)


def pack_weights(pieces: Column, limit: int) -> Column:
    """``pack`` of an array of struct<w, heading>, where the estimate is a third of the weights, rounded up.

    The fold carries a sum and the starts of parts; part numbers come from these at the end.  Starts are held in
    two levels, so that time is linear in the pieces up to millions of parts.
    """
    longs = F.expr("cast(array() as array<bigint>)")
    start = F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).cast("bigint").alias("i"), longs.alias("now"), F.expr("cast(array() as array<array<bigint>>)").alias("done"))

    def step(s: Column, p: Column) -> Column:
        new = (s["i"] == 0) | ((s["w"] > 0) & ((s["w"] + p["w"] > 3 * limit) | p["heading"]))
        full = new & (F.size(s["now"]) >= _CHUNK)
        now = F.when(full, F.array(s["i"])).when(new, F.array_append(s["now"], s["i"])).otherwise(s["now"])
        return F.struct(F.when(new, p["w"]).otherwise(s["w"] + p["w"]).alias("w"), (s["i"] + 1).alias("i"), now.alias("now"), F.when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"))

    def numbered(state: Column) -> Column:
        return F.transform(F.array(F.struct(F.flatten(F.array_append(state["done"], state["now"])).alias("starts"), state["i"].alias("n"))), lambda x: F.flatten(
            F.transform(x["starts"], lambda s, k: F.array_repeat((k + 1).cast("int"), (F.coalesce(F.get(x["starts"], k + 1), x["n"]) - s).cast("int")))))[0]

    return F.aggregate(pieces, start, step, numbered)


def ranged(rows: DataFrame, order: str, many: int | None = None) -> DataFrame:
    """``_range``: the number of an order column's quantiles below a row's, so that what is ordered within books can be
    split, however large a book is.  A range holds whole values of the column; the number of ranges follows the
    session's partitions.  The column must be a number.  A row is compared with the square root of the bounds twice:
    with every last one of a group of bounds, then with those of its group."""
    many = many or 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.agg(F.percentile_approx(order, [i / many for i in range(1, many)] or [1.0], 10 * many).alias("q")).first()["q"]
    if not cut:
        return rows.withColumn("_range", F.lit(0))
    bounds = sorted(set(cut))
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda some: F.size(F.filter(some, lambda b: b < F.col(order)))
    group = below(F.lit([g[-1] for g in groups]))
    inside = below(F.coalesce(F.get(F.lit([g + [g[-1]] * (step - len(g)) for g in groups]), group), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>")))
    return rows.withColumn("_range", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(group * step + inside))


def carry_previous(rows: DataFrame, book: str, order: str, value: str, ok: str, limit: int = 12_000) -> DataFrame:
    """``previous``: the value of the last successful row before, cut to its first characters.

    Found within ranges of the order first; what each range ends with is then carried over the ranges, a row a book
    and range."""
    cut = F.when(F.col(ok), F.substring(F.col(value), 1, limit))
    parts = ranged(rows, order).withColumn("_value", cut)
    before = Window.partitionBy(book, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.where(F.col("_value").isNotNull()).groupBy(book, "_range").agg(F.max_by("_value", order).alias("_end"))
    every = parts.select(book, "_range").distinct().join(ends, [book, "_range"], "left")
    over = Window.partitionBy(book).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(book, "_range", F.last("_end", ignorenulls=True).over(over).alias("_carried"))
    own = parts.withColumn("_own", F.last("_value", ignorenulls=True).over(before))
    return own.join(carried, [book, "_range"], "left").withColumn("previous", F.coalesce("_own", "_carried", F.lit(""))).drop("_range", "_value", "_own", "_carried")


def previous_parts(rows: DataFrame, group: str, order: str, value: str, limit: int = 6_000) -> DataFrame:
    """``tail``: the last characters of all earlier parts, without placeholders.

    What a part ends with comes from the parts that reach back ``limit`` characters: a window over running lengths,
    which holds at most as many parts, as empty ones are left out of it and take over the tail before them.
    """
    text = F.coalesce(F.regexp_replace(value, T.TOKEN, ""), F.lit(""))
    right = lambda x: F.right(x, F.lit(limit))
    over = Window.partitionBy(group).orderBy(order)
    parts = rows.withColumn("_length", F.length(text).cast("bigint")).withColumn("_text", right(text)).withColumn("_end", F.sum("_length").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(group, F.col("_length") > 0).orderBy("_end").rangeBetween(1 - limit, 0)
    after = F.when(F.col("_length") > 0, right(F.array_join(F.collect_list("_text").over(near), "")))
    told = parts.withColumn("_after", F.when(F.col("_length") > 0, after))
    tail = F.last("_after", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return told.withColumn("tail", F.coalesce(tail, F.lit(""))).drop("_length", "_text", "_end", "_after")


def relabel(found: Column, expected: Column) -> Column:
    """The k-th placeholder found becomes the k-th expected; surplus goes, and what lacks comes at the end."""
    taken = F.slice(expected, F.lit(1), F.least(F.size(found), F.size(expected)))
    return F.concat(taken, F.slice(expected, F.size(taken) + 1, F.size(expected)))


def play_order(entries: DataFrame) -> DataFrame:
    """Numbers entries and their children (book_id, entry, child; child 0 is the entry itself) in reading order."""
    return _numbered(entries, "book_id", ("entry", "child"), "play_order")


def dense_index(rows: DataFrame, book: str, position: str) -> DataFrame:
    """``idx``: 1, 2, ... in order of position within a book."""
    return _numbered(rows, book, (position,), "idx")


def _numbered(rows: DataFrame, book: str, order: tuple[str, ...], name: str) -> DataFrame:
    """Numbers from 1 within a book, counted within ranges of the first order column, whose sizes are then added up."""
    parts = ranged(rows, order[0])
    over = Window.partitionBy(book).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(book, "_range").count().select(F.col(book).alias("_book"), F.col("_range").alias("_part"), F.coalesce(F.sum("count").over(over), F.lit(0)).alias("_before"))
    own = Window.partitionBy(book, "_range").orderBy(*order)
    found = parts.withColumn(name, F.row_number().over(own)).join(before, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_range") == F.col("_part")))
    return found.withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_range", "_before", "_book", "_part")
