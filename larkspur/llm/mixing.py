"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. All sizes
together are shared out by weight, a target stops at ``most`` times its
source's size, and the excess is reshared until none is above (water filling,
in closed form over the sources sorted by how soon they fill up). Every
document of a source then expects target / source size copies; their running
sum, plus one offset drawn from the seed and the source's name, is cut at the
integers, and a document is taken once for each integer it crosses.

The running order within a source is by band of sizes, then by a salt of the
id's digest, so that large and small documents are taken evenly. Its prefix
sums are made in two levels: a window within (source, band, salt) and a window
over the few totals of these groups, so a source of any share is spread over
tasks. Rows that are alike count as one with a number before anything is
shuffled, so no repeated row or id makes a group large.

A null text has size 0. A null source is a source of its own, the last. Where
all sizes of a source are 0, its target is 0 and nothing is taken. Rows of a
repeated id are documents of their own. :func:`mix` ranks by id and size and
:func:`mixed` by a hash of the whole row too, so they may take different rows
of one band, as many of each source. An empty table gives an empty result; :func:`mix` ignores
further columns, :func:`mixed` keeps them, whatever their names. The number of
sources is taken to be small (one row each is ranked in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cols, prefix_for, row_hash, store

_HEX = "0123456789abcdef"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digits(digest: Column, n: int) -> Column:
    """The first n hex digits of a digest as a number."""
    total = F.lit(0)
    for i in range(1, n + 1):
        total = total * 16 + (F.instr(F.lit(_HEX), F.substring(digest, i, 1)) - 1)
    return total


def _offset(source: Column, seed: int) -> Column:
    """A multiple of 2**-20 in [0, 1) from the digits of an md5 sum."""
    return _digits(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))), 5) / F.lit(1048576.0)


def _targets(sized: DataFrame, most: int, seed: int) -> DataFrame:
    """One row a source: target, expected copies a document, offset."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    ahead, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))) / F.sum("weight").over(rest)
    # A source is full if the level, had all before it been full, is at or above its own; the first that isn't sets the level of the rest.
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    open_level = leveled.withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("weight"), "level"))).over(whole).getField("level"))
    target = F.when(F.col("full"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("water") * F.col("weight"))
    return open_level.select(
        F.col("source").alias("of"), "source_size", target.cast("double").alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"), _offset(F.col("source"), seed).alias("offset"),
    )


def _placed(rows: DataFrame, most: int, seed: int, salts: int) -> DataFrame:
    """For rows (doc_id, source, size, tie) one row each kind: how many there are (n), the ranks before them, and their source's plan."""
    bits = F.length(F.bin("size"))
    band = bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")
    salt = _digits(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("|"), F.col("tie").cast("string")), F.lit("")))), 3) % salts
    kinds = rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n"))
    kinds = store(kinds.select("*", band.cast("int").alias("band"), salt.cast("int").alias("salt")))
    group = ["source", "band", "salt"]
    before = Window.partitionBy("source").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = kinds.groupBy(*group).agg(F.sum("n").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    sized = kinds.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"))
    targets = _targets(sized, most, seed)
    plan = starts.join(targets, starts.source.eqNullSafe(targets.of)).select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("salt").alias("t"), "before", "source_size", "target", "expected", "offset")
    within = Window.partitionBy(*group).orderBy("size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(plan, placed.source.eqNullSafe(plan.s) & (placed.band == plan.b) & (placed.salt == plan.t))
    return placed.withColumn("ahead", F.col("before") + F.col("ahead"))


def _crossed(first: Column, last: Column) -> Column:
    """How many integers the ranks from first to last cross."""
    upto = lambda rank: F.floor(rank * F.col("expected") + F.col("offset"))
    return (upto(last) - upto(first - 1)).cast("long")


def _numbered(rows: DataFrame, times: Column, name: str, block: int = 4096) -> DataFrame:
    """Each row ``times`` times with the numbers from 1 on; long runs are dealt out in blocks, so that no array is long."""
    first = F.explode(F.sequence(F.lit(1).cast("long"), times, F.lit(block).cast("long")))
    out = rows.where(times > 0).withColumn(name, first)
    return out.withColumn(name, F.explode(F.sequence(F.col(name), F.least(F.col(name) + (block - 1), times))))


def mix(docs: DataFrame, *, most: int = 3, seed: int = 1, salts: int = 64) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one for each row of docs."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(None).cast("long").alias("tie"))
    placed = _numbered(_placed(rows, most, seed, salts), F.col("n"), "i")
    rank = F.col("ahead") + F.col("i")
    return placed.withColumn("copies", _crossed(rank, rank)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, *, most: int = 3, seed: int = 1, salts: int = 64) -> DataFrame:
    """The mix itself: the rows of docs, each as many times as it is taken.

    Rows meet their copies by id, source and a hash of the whole row. Rows that
    are wholly alike are taken from one of them, as often as all together.
    """
    p = prefix_for(docs.columns)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(docs).alias("tie"))
    copies = _placed(rows, most, seed, salts).withColumn("copies", _crossed(F.col("ahead") + 1, F.col("ahead") + F.col("n"))).where("copies > 0")
    copies = store(copies.select(*(F.col(c).alias(p + c) for c in ("doc_id", "source", "tie", "n", "copies"))))
    keys = {c: F.col(p + "own_" + c) for c in ("doc_id", "source", "tie")}
    own = docs.select(*cols(docs), F.col("doc_id").alias(p + "own_doc_id"), F.col("source").alias(p + "own_source"), row_hash(docs).alias(p + "own_tie"))
    meet = lambda some: own.join(some, (keys["tie"] == F.col(p + "tie")) & keys["doc_id"].eqNullSafe(F.col(p + "doc_id")) & keys["source"].eqNullSafe(F.col(p + "source")))
    out = meet(copies.where(F.col(p + "n") == 1))
    if not copies.where(F.col(p + "n") > 1).isEmpty():
        out = out.union(meet(copies.where(F.col(p + "n") > 1)).dropDuplicates([p + "doc_id", p + "source", p + "tie"]))
    return _numbered(out, F.col(p + "copies"), p + "i").select(*cols(docs))
