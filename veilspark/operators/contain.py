"""Joins that stay even: which texts contain which needles, and lookups by keys that most rows lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A net has so many longs, whatever the number of needles: a start of a text goes on if its bit is set.
NET_LONGS = 1024
#: Rows without a key are dealt to so many keys of their own.
SALTS = 4096


def net(needles: DataFrame, needle: str, classes: tuple[int, ...]) -> DataFrame:
    """One row (bits, lengths) over needles of classes[-1] characters at least: bits of their first characters and, by class, their lengths.

    A needle is of the first class that it is as long as; classes are given in falling order.
    """
    n = F.lit(None).cast("int")
    for c in reversed(classes):
        n = F.when(F.length(needle) >= c, F.lit(c)).otherwise(n)
    rows = needles.select(F.col(needle).alias("v"), n.alias("n")).where("n is not null").withColumn("h", _start_hash(F.expr("substring(v, 1, n)"), F.col("n")))
    words = rows.groupBy(_word(F.col("h")).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))")).alias("bits"))
    table = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))  # NET_LONGS entries at most
    dense = table.select(F.transform(F.sequence(F.lit(0), F.lit(NET_LONGS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))
    lengths = rows.agg(F.array(*[F.array_sort(F.collect_set(F.when(F.col("n") == c, F.length("v")))) for c in classes]).alias("lengths"))
    return dense.crossJoin(F.broadcast(lengths))  # one row each


def _start_hash(start: Column, n: Column) -> Column:
    return F.xxhash64(start, n.cast("int"))


def _word(h: Column) -> Column:
    return F.pmod(h, F.lit(NET_LONGS)).cast("int")


def met(df: DataFrame, key: str, text: Column, needles: DataFrame, needle: str, classes: tuple[int, ...], known: DataFrame) -> DataFrame:
    """(key, columns of needles, __t) of the texts that contain a needle, met through a hash of the whole needle; known: net() of them.

    Only the starts of a text that the net lets through are shuffled, once for each length of its class. Equal hashes of
    different strings may add a pair, so whoever needs certainty compares the texts.
    """
    texts = df.select(key, text.alias("__t"))
    rows = texts.crossJoin(F.broadcast(known))  # a row of fixed size
    t, size = F.col("__t"), F.length("__t")

    def hashes(k: int, n: int) -> Column:
        """Of the substrings that begin where the net has a bit for their first n characters, as long as a needle of class k."""
        fit = F.filter(F.get(F.col("lengths"), F.lit(k)), lambda m: m <= size)
        starts = F.when(F.size(fit) > 0, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(starts, lambda s: F.struct(s.alias("s"), _start_hash(F.substring(t, s, F.lit(n)), F.lit(n)).alias("h")))
        let = F.filter(hashed, lambda x: F.getbit(F.get(F.col("bits"), _word(x["h"])), F.shiftright(x["h"], 32).bitwiseAND(F.lit(63)).cast("int")) == 1)
        return F.flatten(F.transform(let, lambda x: F.transform(F.filter(fit, lambda m: x["s"] + m - 1 <= size), lambda m: F.xxhash64(F.substring(t, x["s"], m)))))

    parts = [hashes(k, n) for k, n in enumerate(classes)]
    found = rows.select(key, F.explode(F.array_distinct(F.concat(*parts))).alias("__h"))
    return found.join(needles.withColumn("__h", F.xxhash64(needle)), "__h").drop("__h").join(texts, key)


def lookup(df: DataFrame, on: str, key: str, *tables: DataFrame) -> DataFrame:
    """df left joined with tables by `on`; tables hold no empty `on`, nor one that begins with a blank.

    Rows whose `on` is empty or null match nothing: they are dealt out by their key, where one task would get them all.
    """
    salt = F.concat(F.lit(" "), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("string"))
    rows = df.withColumn("__on", F.when(F.coalesce(F.col(on), F.lit("")) == "", salt).otherwise(F.col(on)))
    return reduce(lambda a, b: a.join(b.withColumnRenamed(on, "__on"), "__on", "left"), tables, rows).drop("__on")
