"""Mixing sources to target weights by weighted fair queueing (operator 3, native).

Each document of a source is shuffled to a place by a keyed hash and offered
up to `epochs` times.  Its virtual finish time is the running total of its
source's words through it, divided by the source's target.  The mix is the
queue in order of virtual finish time (a global range sort), cut at the total
budget: at virtual time 1 every source has had exactly its target, so the copy
in service then is taken in part.

Targets: sources in code-point order (null last) weigh `weights` in turn and
share `budget` times all words; a target stops at `epochs` times its source's
words, and the excess is shared out anew by weight until none is above.  That
fixed point is found in closed form: sources sorted by words per weight, the
first of them are full.

Running totals of a source do not pass through one task: the hash range is cut
into equal blocks, `blocks_a_partition` for each shuffle partition at least and no
more than `block_rows` documents of the whole table each on average, and documents
are shuffled by (source, block).  Block totals are summed up first, then
each block by itself; a source's target joins its blocks, not its documents, so no
shuffle of documents goes by source alone.

Cases: null text, empty text: size 0, taken 0.  Null source: a source of its
own, last.  Null doc_id: placed by the hash of its text.  Repeated rows: each
is a document.  Very long texts: whole; one is in service as any other.  No words
at all: targets 0.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import WORD, fresh, materialize


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    epochs: int = 2
    seed: str = "mix"
    block_rows: int = 100_000
    blocks_a_partition: int = 4


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, p: Params = Params()) -> DataFrame:
    """sizes (source, source_size, ...), a row for each source -> with weight and target.

    Windows over sources alone, a row each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(p.weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * p.epochs)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(p.budget)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before, gone = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    # the level if just the sources before this one are full; it rises while a next one is too, and falls after
    s = s.withColumn("level", (F.col("budget") - before) / (F.sum("weight").over(everything) - gone))
    s = s.withColumn("open_level", F.max("level").over(everything))
    full = F.col("cap") <= F.col("open_level") * F.col("weight")
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight"))
    return s.withColumn("target", target).drop("cap", "budget", "level", "open_level")


def sized(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Narrow rows of docs (doc_id, source, text), written once: doc_id, skey, size, place (the shuffle's key)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    place = F.md5(F.concat(F.lit(p.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text))).cast("binary"))
    source = F.col("source").cast("string")
    skey = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))  # a key that is never null
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), skey.alias("skey"), n_words(F.col("text").cast("string")).alias("size"), place.alias("place")), "mix-sizes")


def placed(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """sized() rows -> doc_id, skey, size, source_size, target, first (words of its source before it)."""
    n_blocks = max(p.blocks_a_partition * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // p.block_rows))
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    keyed = rows.withColumn("block", F.shiftright(share * F.lit(n_blocks), 32))
    blocks = materialize(keyed.groupBy("skey", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    sizes = blocks.groupBy("skey").agg(F.sum("block_size").alias("source_size"))
    t = targets(sizes.withColumn("source", F.when(F.col("skey") != "", F.substring("skey", 2, 1 << 30))), p).select("skey", "source_size", "target")
    upto = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("skey", "block", F.coalesce(F.sum("block_size").over(upto), F.lit(0)).alias("block_start")).join(t, "skey")
    inside = Window.partitionBy("skey", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("block_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return keyed.join(starts, ["skey", "block"]).withColumn("first", first).select("doc_id", "skey", "size", "source_size", "target", "first")


def served_words(copy: int | Column) -> Column:
    """Words taken of a copy (0-based) of a placed() row when the queue stops at virtual time 1."""
    start = F.col("first") + copy * F.col("source_size")
    return F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.floor("target") - start))


def finish_time(copy: int | Column) -> Column:
    """Virtual finish time of a copy of a placed() row; null where the target is 0."""
    return F.when(F.col("target") > 0, (F.col("first") + copy * F.col("source_size") + F.col("size")) / F.col("target"))


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """For each document, in order of virtual finish time: doc_id, size, source_size, target, taken
    (words the mix takes, repeats counted), vft (of its first copy)."""
    taken = served_words(0)
    for copy in range(1, p.epochs):
        taken = taken + served_words(copy)
    out = placed(sized(docs, p), p).select("doc_id", "size", "source_size", "target", taken.alias("taken"), finish_time(0).alias("vft"))
    return out.orderBy("vft", "doc_id")


def mixed_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The mix itself, in queue order: rows of docs with the columns of docs, a row for each copy taken.

    A copy taken in part keeps its first words; n_chars, if there, counts what is kept.
    Documents are told apart by (doc_id, source, hash of the text)."""
    rows = placed(sized(docs, p), p)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(p.epochs - 1))))
    copies = copies.select("doc_id", "skey", "size", served_words(F.col("copy")).alias("words"), finish_time(F.col("copy")).alias("vft"), "copy").filter("words > 0")
    # rows that repeat (doc_id, source, size) are numbered on both sides, so each copy meets one row
    source = F.col("source").cast("string")
    mark = {c: fresh(docs, c) for c in ("k_id", "k_src", "k_size", "k_nr")}
    same = Window.partitionBy(mark["k_id"], mark["k_src"], mark["k_size"]).orderBy(F.xxhash64("text"))
    left = docs.withColumns({
        mark["k_id"]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        mark["k_src"]: F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)),
        mark["k_size"]: n_words(F.col("text").cast("string"))}).withColumn(mark["k_nr"], F.row_number().over(same))
    again = Window.partitionBy("doc_id", "skey", "size", "copy").orderBy("vft")
    right = copies.withColumn("nr", F.row_number().over(again)).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("r_id"), F.col("skey").alias("r_src"), F.col("size").alias("r_size"), F.col("nr").alias("r_nr"),
        F.col("words").alias("r_words"), F.col("vft").alias("r_vft"), F.col("copy").alias("r_copy"))
    x, r = left.alias("x"), right.alias("r")
    on = [F.col(f"x.{mark[a]}") == F.col(f"r.{b}") for a, b in (("k_id", "r_id"), ("k_src", "r_src"), ("k_size", "r_size"))]
    # written as a difference the number is no join key: the window's shuffle of the texts then serves the join too
    on.append(F.col(f"x.{mark['k_nr']}") - F.col("r.r_nr") == 0)
    both = x.join(r, on).orderBy("r.r_vft", f"x.{mark['k_src']}", f"x.{mark['k_id']}", "r.r_copy")
    whole = F.col("r.r_words") == F.col("r.r_size")
    text = F.when(whole, F.col("x.text")).otherwise(first_words(F.col("x.text"), F.col("r.r_words")))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias(c))
        elif c == "n_chars":
            cols.append(F.when(whole, F.col("x.n_chars")).otherwise(F.char_length(text)).alias(c))
        else:
            cols.append(F.col(f"x.`{c}`"))
    return both.select(*cols)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.concat_ws("", F.slice(words, F.lit(1), n.cast("int")))
