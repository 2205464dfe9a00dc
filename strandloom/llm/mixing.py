"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of the identifier. Each
source gets a target in words: its weight's share of the total, at most CAP
times its size, the excess shared anew by weight. A target is met by whole
passes over the source and a last, partial pass over its blocks in a permuted
order; the block in which that pass ends is cut between documents.

Every (source, block, pass) is a draw. The tree halves the list of draws level
by level, each node by its own permutation and by exact counts, so the sources'
quotas in a node's halves are a multivariate-hypergeometric sample and all
output shards get the same number of draws, within one. Documents of a shard
are shuffled locally. Everything is DataFrame operations; only counts of words
meet per source, and a source's rows are spread over its blocks throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.llm.common import checkpointed

WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
CAP = 3
#: Hexadecimal digits of a hash that name a source's blocks, 256 to 65,536, by the words of a block if sources were equal.
BLOCK_DIGITS, BLOCK_WORDS = (2, 4), 20_000_000
#: Levels of the tree, twice as many shards for each, by the words of a shard.
LEVELS, SHARD_WORDS = (4, 17), 200_000_000
_WORD = r"[^\x20\x09-\x0D]+"


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.col(p) for p in parts)))


def sized(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size (words) and key, the document's place among the source's; rows without an identifier are placed by their text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.md5(text)), F.lit(seed)))
    size = F.regexp_count(text, F.lit(_WORD)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"))


def scale(words: int, sources: int) -> tuple[int, int]:
    """Block digits and tree levels for a corpus: blocks and shards of about the same words whatever its size, within limits."""
    digits, levels = BLOCK_DIGITS[0], LEVELS[0]
    while digits < BLOCK_DIGITS[1] and words > sources * 16**digits * BLOCK_WORDS:
        digits += 1
    while levels < LEVELS[1] and words > 2**levels * SHARD_WORDS:
        levels += 1
    return digits, levels


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) with target: the total shared by weight, none above cap times its size.

    Sources take the weights in turn, by code point, null last. Sources are
    ordered by how soon they are full; a source is full if the level that the
    rest would share is above its cap, and all after the first that is not
    share one level. One row per source meets in one task, nothing more.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = sources.withColumn("rank", F.row_number().over(everything)).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    full = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before, after = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(whole))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("is_full", F.col("level") * F.col("weight") > F.col("most"))
    level = F.max(F.when(~F.col("is_full"), F.col("level"))).over(whole)
    return rows.withColumn("target", F.when(F.col("is_full"), F.col("most")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def _draws(blocks: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    """source, block, pass, is_last and left: what the last pass still takes when it comes to the block."""
    goal = goals.where("source_size > 0").withColumn("passes", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP)).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumnRenamed("source", "s")
    rows = blocks.join(goal, F.col("source").eqNullSafe(F.col("s")))
    order = W.partitionBy("source").orderBy(_key("source", "block", F.lit(seed)), "block")
    rows = rows.withColumn("before", F.sum("block_size").over(order) - F.col("block_size"))
    rows = rows.withColumn("left", F.col("rest") - F.col("before")).withColumn("last", F.col("left") > 0)
    passes = F.filter(F.sequence(F.lit(0), F.col("passes")), lambda p: (p < F.col("passes")) | F.col("last"))
    return rows.select("source", "block", "block_size", "left", "passes", F.explode(passes).alias("pass")).withColumn("is_last", F.col("pass") == F.col("passes"))


def split(draws: DataFrame, levels: int = LEVELS[0], seed: str = "mix") -> DataFrame:
    """draws with shard, 0 to 2**levels - 1: each node's list permuted and halved by exact count.

    The root's list meets in one task: a row of a few numbers for each block and pass, no documents.
    """
    now = draws.withColumn("shard", F.lit(0))
    for level in range(levels):
        order = W.partitionBy("shard").orderBy(_key("source", "block", "pass", F.lit(str(level)), F.lit(seed)), F.col("source").asc_nulls_last(), "block", "pass")
        now = now.withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("shard")))
        now = now.withColumn("shard", F.col("shard") * 2 + (F.col("at") * 2 > F.col("n") + 1).cast("int")).drop("at", "n")
    return now


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, levels: int | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, copies, shards.

    copies is how often the mix holds the document, shards to which outputs the
    copies go (numbers joined by commas), taken their words. A null text has no
    words; null is a source of its own, the last one; a document without words
    is taken with its block and adds none. Rows that repeat are weighed and
    returned each. No rows give no rows. The result depends on the rows and the
    seed alone.
    """
    rows = checkpointed(sized(docs, seed, id_col, text_col, source_col))
    words, sources = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.countDistinct(F.coalesce("source", F.lit("")))).first()
    digits, fitting = scale(words, max(1, sources))
    levels = fitting if levels is None else levels
    rows = rows.withColumn("block", F.substring("key", 1, digits))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    goals = checkpointed(targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights))
    shards = split(_draws(blocks, goals, seed), levels, seed)
    last = F.max(F.when(F.col("is_last"), F.col("shard")))
    whole = F.sort_array(F.collect_list(F.when(~F.col("is_last"), F.col("shard"))))
    taken = shards.groupBy("source", "block").agg(whole.alias("whole"), last.alias("last_shard"), F.max(F.when(F.col("is_last"), F.col("left"))).alias("left"), F.first("block_size").alias("block_size"))
    taken = checkpointed(taken).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    each = rows.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    cut = (F.col("last_shard").isNotNull()) & (F.col("left") < F.col("block_size"))
    order = W.partitionBy("source", "block").orderBy("key", "id", "size")
    ending = each.where(cut).withColumn("within", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2 <= F.col("left"))
    rest = each.where(~F.coalesce(cut, F.lit(False))).withColumn("within", F.col("last_shard").isNotNull())
    every = ending.unionByName(rest)
    to = F.sort_array(F.concat(F.coalesce("whole", F.array().cast("array<int>")), F.when(F.col("within"), F.array("last_shard")).otherwise(F.array().cast("array<int>"))))
    goals = goals.withColumnRenamed("source", "g")
    out = every.withColumn("to", to).join(goals, F.col("source").eqNullSafe(F.col("g")))
    copies = F.size("to").cast("long")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.array_join(F.col("to").cast("array<string>"), ",").alias("shards")
    )


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Names that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mixture takes it; all columns as they were, whatever their names.

    Rows that share identifier and number of words share the number of copies.
    """
    key, n, size, copies, copy = _named(docs, "__key", "__n", "__size", "__copies", "__copy")
    plan = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = plan.groupBy(F.col(id_col).alias(key), F.col("size").alias(size)).agg(F.max("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    count = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(_WORD)).cast("long")
    rows = docs.withColumn(n, count).join(plan, docs[id_col].eqNullSafe(F.col(key)) & (F.col(n) == F.col(size)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def sharded(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: str = "mix", shard_col: str = "shard") -> DataFrame:
    """docs with a row per copy and its shard, one shard's rows together and shuffled locally, ready to be written.

    A column of docs with shard_col's name gets underscores added to that of the shard.
    """
    key, shard = _named(docs, "__key", shard_col)
    where = plan.select(F.col(id_col).alias(key), F.explode(F.split(F.col("shards"), ",")).alias(shard)).where(F.col(shard) != "")
    rows = docs.join(where, docs[id_col].eqNullSafe(F.col(key))).drop(key).withColumn(shard, F.col(shard).cast("int"))
    place = _key(F.col(id_col).cast("string"), F.col(shard).cast("string"), F.lit(seed))
    return rows.repartition(shard, F.substring(place, 1, 1)).sortWithinPartitions(shard, place)
