"""Mixing sources to target weights, with DataFrame functions only.

Sources in code-point order (null last) weigh ``weights`` in turn and share
``share`` times all words; a target stops at ``most`` times its source's words and
the excess is shared again by weight (water filling, solved in one pass over the
sources ordered by capacity per weight).

* Pack: each source's documents follow one another in a fixed order, as one row
  of words cut into blocks of ``block`` words (sources with less than ``block``
  squared words: of fewer, so that the last block is a small share of any).
  Places come from two-level prefix sums: within chunks of a source's documents,
  then over the chunks' totals, so a source of any size is spread over many tasks.
* Draw: output shards of ``slots`` block slots draw their source for each slot
  from the target shares with hashed uniforms: multinomial counts per shard.
  Draws beyond a source's quota are passed on to sources short of theirs, so
  that each source gets its target to the block.
* Map: the k-th slot of a source takes block perm(k mod blocks), where perm is a
  swap-or-not permutation of the source's block numbers.
* Join: slots and blocks meet by source and block number.

Every draw is a hash of numbers, and a document's place follows from its id and
text, so reruns agree.  A null or empty text has size zero and is taken zero
times; rows that repeat an id, or have none, are handled each by itself; texts of
any length are cut in time that grows with their length; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch, bounded, numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 64
#: Block slots of an output shard.
SLOTS = 4096
#: Documents in a chunk of a source, on average.
CHUNK = 2048
ROUNDS = 12
SEED = 20


def permuted(k: Column, n: Column, key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by the number ``key``, sends k (swap-or-not).

    Each round pairs x with (r - x) mod n and swaps by a hash of the greater one.
    """

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, i, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(SEED + i) for i in range(ROUNDS)]), k.cast("long"), swap)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, key, source_size, target of every source in ``sizes`` (source, source_size)."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("key", F.row_number().over(order).cast("long"))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    below = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", (total - below) / above).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # Full sources come first; the first source that is not full sets the level of all after it.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(Window.partitionBy())["level"]
    return levelled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select("source", "key", "source_size", F.col("target").cast("double").alias("target"))


def documents_in_order(docs: DataFrame, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every document of ``docs`` (uid, id, text, source) with its place in its source, and the sources with their targets and block sizes."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = docs.select("uid", "id", F.xxhash64("text").alias("mark"), "source", size.alias("size"))
    docs = scratch.table(docs.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))), "sizes")
    by_source = docs.groupBy("source", "named").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_source = scratch.table(by_source, "by_source")
    width = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / block))).cast("long")
    sources = scratch.table(targets(by_source.select("source", "source_size")).join(by_source.select("named", F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("width", width), "sources")

    chunk = F.pmod(F.xxhash64(F.lit(SEED + 2), "id", "mark"), F.ceil(F.col("n_docs") / CHUNK))
    docs = docs.join(sources.select("named", "key", "n_docs", "width"), "named").withColumn("chunk", chunk)
    inside = Window.partitionBy("key", "chunk").orderBy("id", "mark", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    chunks = docs.groupBy("key", "chunk").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.select("key", "chunk", (F.sum("words").over(ahead) - F.col("words")).alias("base"))
    placed = docs.join(chunks, ["key", "chunk"]).select("uid", "id", "key", "size", "width", (F.col("base") + F.col("inside")).alias("start"))
    placed = scratch.table(placed, "placed")
    scratch.drop("sizes", "by_source")
    return placed, sources


def drawn_blocks(sources: DataFrame, scratch: Scratch, slots: int = SLOTS) -> DataFrame:
    """(key, block, times, first_shard): how often the mix takes each block of a source."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / F.col("width"))
    quota = sources.filter("source_size > 0").select("key", blocks.alias("blocks"), F.least(F.round(F.col("target") / F.col("width")), 2 * blocks).cast("long").alias("quota"))
    up = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    quota = scratch.table(quota.withColumn("upto", F.sum("quota").over(up)), "quota")
    with bounded(spark):
        total = quota.agg(F.max("upto")).first()[0] or 0

    # Draw: a hashed uniform for each slot, looked up among the cumulative quotas.  Slots
    # are first grouped by the stretch of a fixed grid that the uniform falls in, and a
    # source is joined to the stretches it touches.
    step = max(1, -(-total // 4096))
    shard_slot = spark.range(total).select((F.col("id") / slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 3), "id"), F.lit(max(1, total))).alias("u"))
    touched = quota.filter("quota > 0").select("key", "blocks", "quota", (F.col("upto") - F.col("quota")).alias("low"), F.col("upto").alias("high")).withColumn("cell", F.explode(F.sequence((F.col("low") / step).cast("long"), ((F.col("high") - 1) / step).cast("long"))))
    draws = shard_slot.withColumn("cell", (F.col("u") / step).cast("long")).join(touched, "cell").filter("u >= low and u < high").select("shard", "key", "quota")

    counts = scratch.table(draws.groupBy("shard", "key", "quota").agg(F.count("*").alias("count")), "shard_counts")

    # A source's slots are numbered shard after shard; draws beyond its quota, the last
    # ones, are given up, and their shards pass them on to the sources that are short.
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("count").over(before)).withColumn("base", F.col("upto") - F.col("count"))
    kept = F.greatest(F.least("upto", "quota") - F.col("base"), F.lit(0))
    counts = scratch.table(counts.withColumn("kept", kept), "kept")
    held = counts.filter("kept > 0").select("shard", "key", F.col("base").alias("k"), F.col("kept").alias("n"))
    given = counts.filter("kept < count").select("shard", "key", (F.col("count") - F.col("kept")).alias("n"))
    by_key = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    got = counts.groupBy("key").agg(F.sum("count").alias("got"))
    balance = quota.join(got, "key", "left").select("key", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    balance = balance.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    balance = scratch.table(balance.withColumn("over_base", F.sum("over").over(up) - F.col("over")).withColumn("short_base", F.sum("short").over(up) - F.col("short")), "balance")
    number = F.col("over_base") + F.sum("n").over(by_key) - F.col("n")
    spare = given.join(balance.select("key", "over_base"), "key").select("shard", number.alias("from"), "n").select("shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("number"))
    missing = balance.filter("short > 0").select("key", "got", "short_base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("i")).select("key", (F.col("got") + F.col("i")).alias("k"), (F.col("short_base") + F.col("i")).alias("number"))
    passed = spare.join(missing, "number").select("shard", "key", "k", F.lit(1).cast("long").alias("n"))

    # Few short rows become many: deal them out first, in a number that is kept.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = held.unionByName(passed).repartition(parts, "shard", "key").select("shard", "key", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("n") - 1)).alias("k"))
    placed = placed.join(quota.select("key", "blocks"), "key").withColumn("round", F.floor(F.col("k") / F.col("blocks")))
    placed = placed.select("shard", "key", permuted(F.pmod("k", "blocks"), F.col("blocks"), F.xxhash64("key", "round")).alias("block"))
    drawn = scratch.table(placed.groupBy("key", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard")), "drawn")
    scratch.drop("quota", "shard_counts", "kept", "balance")
    return drawn


def taken_pieces(placed: DataFrame, drawn: DataFrame) -> DataFrame:
    """(uid, size, first, words, times): the stretch of each document in each taken block; ``first`` counts words of the document."""
    end = F.col("start") + F.col("size")
    pieces = placed.filter("size > 0").select("uid", "key", "start", "size", "width", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((end - 1) / F.col("width")))).alias("block"))
    low = F.greatest("start", F.col("block") * F.col("width"))
    high = F.least(end, (F.col("block") + 1) * F.col("width"))
    pieces = pieces.select("uid", "key", "size", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))
    return pieces.join(drawn, ["key", "block"]).select("uid", "size", "first", "words", "times")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """For every document: ``id_col``, size, source_size, target, taken.

    The result is a table of the scratch folder; the tables it was made from are removed.
    """
    scratch = scratch or Scratch(df.sparkSession)
    docs = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    placed, sources = documents_in_order(docs, block, scratch)
    taken = taken_pieces(placed, drawn_blocks(sources, scratch)).groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = placed.join(taken, "uid", "left").join(sources.select("key", "source_size", "target"), "key")
    rows = scratch.table(rows.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), "mixed")
    scratch.keep_only("mixed")
    return rows.withColumnRenamed("id", id_col)


def mixed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """The mix as documents: rows of ``df`` whose text holds the words taken, with the white space after them.

    A document taken in part keeps the taken stretches in order; one of which
    stretches are taken twice comes in two rows.  Documents not taken are absent.
    ``n_chars`` follows the text where ``df`` has it; other columns, of any name,
    stay as they are.  Rows are found by a row number, so null and repeated ids lose or multiply nothing.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = numbered(df, scratch)
    docs = rows.select("uid", F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text"), F.col(f"doc.{source_col}").alias("source"))
    placed, sources = documents_in_order(docs, block, scratch)
    pieces = taken_pieces(placed, drawn_blocks(sources, scratch))
    copies = pieces.select("uid", "size", "first", "words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    wanted = copies.groupBy("uid", "copy", "size").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("stretches"), F.sum("words").alias("n"))
    wanted = scratch.table(wanted.select("uid", F.when(F.col("n") < F.col("size"), F.col("stretches")).alias("stretches")), "wanted")
    scratch.drop("placed", "drawn", "sources")
    # The words are an element of an array of one, so that they are listed once a row and not once a stretch.
    words = F.regexp_extract_all(f"doc.{text_col}", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("stretches", lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["words"].cast("int")))), ""))
    text = F.when(F.col("stretches").isNull(), F.col(f"doc.{text_col}")).otherwise(F.get(cut, F.lit(0)))
    joined = rows.join(wanted, "uid").select("doc", text.alias("text"))
    value = {c: F.col(f"doc.{c}") for c in df.columns} | {text_col: F.col("text")}
    if "n_chars" in df.columns:
        value["n_chars"] = F.length("text").cast(df.schema["n_chars"].dataType)
    return joined.select(*(v.alias(c) for c, v in value.items()))
