"""Mixing sources to target weights, block by block, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Words of a block, blocks of an output shard, runs that a source's token stream is laid out in.
BLOCK_WORDS, SHARD_BLOCKS, RUNS = 64, 4096, 1024
#: A source has so many blocks at least, or as many as words; the blocks of a small source are shorter.
LEAST_BLOCKS = 64
#: Sources up to which their table is broadcast; beyond, Spark joins it by shuffle.
BROADCAST_SOURCES = 50_000
_PIECE, _RANGE = 1 << 16, 1 << 12
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, number, source_size, target) for each source of ``sizes`` (source, size).

    Sources in code-point order, null last, take the weights in turn and divide ``share`` of all words. A target
    stops at ``most`` times its source; what is left over goes to the others by weight. In the order of cap per
    weight, a source is capped exactly when the level of those not yet capped reaches it, so running sums over
    the table of sources solve this at once.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = by.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1).cast("double")
    named = named.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(most)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every) * share - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    named = named.withColumn("level", level)
    open_ = F.max(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    target = F.when(F.col("level") < F.col("cap") / F.col("weight"), open_ * F.col("weight")).otherwise(F.col("cap"))
    return named.withColumn("target", target).select("source", "number", "source_size", "target")


def source_blocks(sources: DataFrame, most: float = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds ``width`` (words of a block), ``blocks`` and ``quota`` (blocks that the mix takes, repeats counted): the target by the mean words of a block."""
    width = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    sized = sources.withColumn("width", width).withColumn("blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
    quota = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    return sized.withColumn("quota", F.when(F.col("source_size") > 0, F.least(quota, F.floor(F.lit(most) * F.col("blocks")).cast("long"))).otherwise(F.lit(0).cast("long")))


def _ranked(rows: DataFrame, group: list[str], key: Column, ranges: Column) -> DataFrame:
    """Adds ``rank``, from 0, in the pseudorandom order of ``key`` within ``group``: rows fall into ranges of the key, whose counts say where each begins, so that no task sees a whole group."""
    high = F.shiftrightunsigned("key", 32)
    keyed = rows.withColumn("key", key).withColumn("range", F.floor(high * ranges / float(1 << 32)))
    sums = keyed.groupBy(*group, "range").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*group) if group else Window
    begun = sums.select(*group, "range", (F.sum("n").over(own.orderBy("range")) - F.col("n")).alias("begun"))
    rest = [c for c in rows.columns if c not in group]
    order = Window.partitionBy(*group, "range").orderBy("key", *rest)
    return keyed.join(begun.hint("merge"), [*group, "range"]).withColumn("rank", F.col("begun") + F.row_number().over(order) - 1).drop("begun", "range", "key")


def shard_slots(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, number, block): which block of which source stands at which slot of which output shard, from ``source_blocks``.

    Each shard draws its source counts from the urn of all quotas without replacement: all draws are ranked by
    pseudorandom keys and every ``shard_blocks`` of them make a shard. So a shard's counts are multinomial but for
    meeting the quotas exactly over all shards. A source's draws go through its blocks by one pseudorandom
    permutation after another (the order of keyed hashes), so a block is used as often as any other, or once more.
    """
    total, blocks, epochs = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max(F.ceil(F.col("quota") / F.greatest("blocks", F.lit(1)))), F.lit(0))).first()
    tasks = max(1, min(20_000, 2 * -(-blocks // _PIECE)))
    pieces = sources.where("quota > 0").select("number", "blocks", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / _PIECE))).alias("piece"))
    last = F.least((F.col("piece") + 1) * _PIECE, F.col("blocks")) - 1
    every = pieces.repartition(tasks, "number", "piece").select("number", "blocks", "quota", F.explode(F.sequence(F.col("piece") * _PIECE, last)).alias("block"))
    # the permutation of each epoch: all of its ranks below what the quota leaves for it are taken
    dealt = None
    for epoch in range(int(epochs)):
        left = F.col("quota") - epoch * F.col("blocks")
        some = every.where(left > 0)
        own = _ranked(some, ["number"], F.xxhash64("number", "block", F.lit(f"order {epoch}")), F.ceil(F.col("blocks") / _RANGE)).where(F.col("rank") < left)
        own = own.select("number", "block", F.lit(epoch).alias("epoch"))
        dealt = own if dealt is None else dealt.unionByName(own)
    if dealt is None:
        return sources.sparkSession.createDataFrame([], "shard long, slot long, number int, block long")
    drawn = _ranked(dealt, [], F.xxhash64("number", "block", "epoch", F.lit("shard")), F.lit(-(-total // shard_blocks)))
    return drawn.select(F.floor(F.col("rank") / shard_blocks).alias("shard"), (F.col("rank") % shard_blocks).cast("long").alias("slot"), "number", "block")


def packed(sized: DataFrame, runs: int = RUNS) -> DataFrame:
    """Adds ``start``: where the row's words begin in the token stream of its source (number).

    The stream is laid out in ``runs`` runs by the hash of the row, in the order of doc_id within a run; sums per
    run come first, so that no task sees a whole source.
    """
    rows = sized.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(runs)))
    sums = rows.groupBy("number", "run").agg(F.sum("size").alias("n"))
    begun = sums.select("number", "run", (F.sum("n").over(Window.partitionBy("number").orderBy("run")) - F.col("n")).alias("begun"))
    order = Window.partitionBy("number", "run").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(begun, ["number", "run"]).withColumn("start", F.col("begun") + F.sum("size").over(order) - F.col("size")).drop("run", "begun")


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, block_words: int) -> tuple[DataFrame, DataFrame]:
    """The table of sources with their targets, and the rows with the place of their words in their source's stream."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), size.alias("size")), "sizes")
    sources = stored(source_blocks(source_targets(sized, weights, share, most), most, block_words), "targets")
    small = sources.count() <= BROADCAST_SOURCES
    known = sources.select(F.col("source").alias("of"), "number", "source_size", "target", "width")
    known = F.broadcast(known) if small else known
    return sources, stored(packed(sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")), "placed")


def _blocks(sources: DataFrame, placed: DataFrame, shard_blocks: int) -> DataFrame:
    end, width = F.col("start") + F.col("size"), F.col("width")
    blocks = F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))
    pieces = placed.where("size > 0").select("number", "source", "doc_id", "text_hash", "start", "width", end.alias("end"), F.explode(blocks).alias("block"))
    begin = F.greatest("start", F.col("block") * width)
    words = F.least("end", (F.col("block") + 1) * width) - begin
    segment = F.struct("start", "doc_id", "text_hash", (begin - F.col("start")).alias("first"), words.alias("words"))
    filled = pieces.groupBy("number", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(segment)).alias("segments"))
    # the plan can't tell how many slots a source's row explodes into, so the join must not be left to its estimate
    dealt = filled.join(shard_slots(sources, shard_blocks).hint("merge"), ["number", "block"])
    return stored(dealt.select("shard", "slot", "number", "source", "block", "segments"), "mixed")


def mixed_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, number, source, block, segments): the mix, a row for each slot of each output shard.

    ``segments`` are the pieces of documents in the block, in order: where the document starts in its source's
    stream, doc_id, text_hash, the first word taken and the number of words. ``block_texts`` adds the words.
    """
    return _blocks(*_placed(docs, weights, share, most, block_words), shard_blocks)


def block_texts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(shard, slot, source, text): the words of ``mixed_blocks(docs)``, single spaces between them."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("all")).dropDuplicates(["doc_id", "text_hash"])
    pieces = blocks.select("shard", "slot", "source", F.explode("segments").alias("s")).select("shard", "slot", "source", "s.*").withColumnsRenamed({"doc_id": "of", "text_hash": "hash"})
    words = pieces.join(texts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")))
    words = words.select("shard", "slot", "source", "start", F.array_join(F.slice("all", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ").alias("text"))
    joined = words.groupBy("shard", "slot").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("s"))
    return joined.select("shard", "slot", "source", F.array_join(F.col("s.text"), " ").alias("text"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source; other columns are ignored).

    Each source's words are packed into blocks of ``block_words`` (shorter ones for small sources, so that each comes
    near its target; the last may be shorter), the slots of the output
    shards are drawn and dealt to blocks, and the mixed blocks are written by shard and slot (``mixed_blocks``).
    ``taken`` counts the words of the document in the written blocks, repeats included. Pseudorandom choices hash
    fixed numbers, so reruns agree.

    A null text has size 0 and is never taken; a null source is a source, the last one; repeated rows are packed
    one after another. Sources without words have target 0, and an empty table gives an empty result.
    """
    sources, placed = _placed(docs, weights, share, most, block_words)
    used = _blocks(sources, placed, shard_blocks).select("number", F.explode("segments").alias("s"))
    taken = used.groupBy("number", F.col("s.start").alias("start")).agg(F.sum("s.words").alias("taken"))
    out = placed.join(taken.hint("merge"), ["number", "start"], "left")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
