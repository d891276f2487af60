"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in order of id, form one stream of words that is cut into blocks of
fixed length. A source gets a target: its weight's share of the mix, at most `repeat` times its
size, the excess reshared by weight (water filling). The target in blocks is the source's number of slots.
Output shards have `per_shard` places each. The draw deals all slots to all places by one pseudorandom
permutation: a shard's counts of the sources are a multinomial draw under fixed totals of sources and shards
(a free draw would miss the targets by its own variance and could show a document more than `repeat` times).
Slot i of a source with n blocks shows block
p(i mod n), p a pseudorandom permutation that differs by source and by epoch i div n
(swap-or-not: any n, no tables). Slots join the blocks by index.

`mixed_blocks` gives the mix itself, a row for each place of each output shard; `mix` the words taken of each
document and the output shards that show it; `mixed_documents` whole documents in the same shares.

The draw depends on ids, texts and the seed only, so reruns agree.

Defined results. Null or blank text: size 0, taken 0. A null source is a source of its own and
comes last. Sources that have no words: target 0. Repeated rows are documents of their own. A null
id sorts first. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import SPACE, running, text_tag, word_count
from braidwork.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
BLOCK = 64
ROUNDS = 12
#: Slots that one row unfolds to, and places of an output shard.
CHUNK, PER_SHARD = 16_384, 16_384
#: One whole copy of a document, in parts that sum exactly.
UNIT_BITS = 20
UNIT = 1 << UNIT_BITS


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0, scratch: Scratch | None = None) -> DataFrame:
    """(source, sid, source_size, target): one row per source.

    Sources are numbered in order of code points without a task that sees them all. The water level L solves
    sum(min(cap, weight * L)) = mix: each step is one aggregation, caps the sources that are under water and raises
    the level for the rest, and ends when none is added.
    """
    scratch = scratch or Scratch(sized.sparkSession, "targets")
    totals = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull()))
    named = running(scratch, totals, [], ["_null", "source"], by_value="_before")
    picked = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_before") % len(weights)).cast("int"))
    rows = scratch.keep(named.select("source", (F.col("_before") + 1).cast("long").alias("sid"), "source_size", picked.alias("_w"), (F.col("source_size") * F.lit(float(repeat))).alias("_cap")))
    words, weight = rows.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped = (words or 0) * share / (weight or 1), -1
    while True:
        under = F.col("_cap") <= F.col("_w") * F.lit(level)
        full, rest, n = rows.agg(F.sum(F.when(under, F.col("_cap"))), F.sum(F.when(~under, F.col("_w"))), F.count_if(under)).first()
        if n == capped or not rest:
            break
        level, capped = (words * share - (full or 0.0)) / rest, n
    return rows.select("source", "sid", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 named by `key`, by swap-or-not rounds."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        coin = F.pmod(F.xxhash64(*key, r, F.lit("coin"), F.greatest(at, other)), F.lit(2))
        return F.when(coin == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, turn)


def slots(scratch: Scratch, sources: DataFrame, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 17) -> DataFrame:
    """(sid, epoch, slot, block, shard, place): what every slot of the mix shows, and where it stands.

    Chunk numbers are few and small but unfold to many slots, so they are dealt to a stated number
    of tasks, which adaptive execution leaves alone.
    """
    spread = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.round(F.col("target") * n / F.col("source_size")).cast("long")
    counted = scratch.keep(sources.where("source_size > 0").select("sid", n.alias("n"), wanted.alias("slots")).where("slots > 0"))
    every = F.lit(counted.agg(F.sum("slots")).first()[0] or 1).cast("long")
    first = running(scratch, counted, [], ["sid"], F.col("slots"), by_value="_first")
    chunks = first.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}")))).repartition(spread, "sid", "_c")
    last = F.least(F.col("slots"), (F.col("_c") + 1) * CHUNK) - 1
    rows = chunks.withColumn("slot", F.explode(F.sequence(F.col("_c") * CHUNK, last))).withColumn("epoch", F.expr("slot div n"))
    index = permuted(F.expr("slot % n"), F.col("n"), F.lit(seed), F.col("sid"), F.col("epoch"))
    dealt = rows.select("sid", "epoch", "slot", index.alias("block"), permuted(F.col("_first") + F.col("slot"), every, F.lit(seed), F.lit("deal")).alias("_to"))
    return dealt.select("sid", "epoch", "slot", "block", F.expr(f"_to div {per_shard}").alias("shard"), (F.col("_to") % per_shard).alias("place"))


def _placed(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, repeat: float) -> tuple[DataFrame, DataFrame]:
    """(sid, _id, _tag, size, source_size, target, _at), a row per document with its place in its source's stream, and the sources."""
    sized = scratch.keep(docs.select(F.col(id_col).alias("_id"), text_tag(text_col).alias("_tag"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    sources = scratch.keep(targets(sized, weights, share, repeat, scratch))
    named = sized.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    return scratch.keep(running(scratch, named, ["sid"], ["_id", "_tag"], F.col("size"), by_value="_at")), sources


def _spans(placed: DataFrame, block: int) -> DataFrame:
    """(sid, block, _at, _from, _words, ...): the blocks of every document, the first of its words in each, and how many."""
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))))
    first = F.greatest(F.col("_at"), F.col("block") * block)
    words = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block) - first
    return spans.withColumn("_from", first - F.col("_at")).withColumn("_words", words)


def _mixed(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, repeat: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sid, _id, _tag, size, source_size, target, taken, first_shard, last_shard), a row per document, and the sources."""
    scratch = Scratch(spark, "mix")
    placed, sources = _placed(scratch, docs, id_col, text_col, source_col, weights, share, repeat)
    spans = _spans(placed, block).select("sid", "_at", "block", "_words")
    shown = slots(scratch, sources, block, seed=seed).groupBy("sid", "block").agg(F.count("*").alias("_times"), F.min("shard").alias("_a"), F.max("shard").alias("_b")).hint("merge")  # its size is guessed from the few sources
    taken = spans.join(shown, ["sid", "block"]).groupBy("sid", "_at").agg(F.sum(F.col("_words") * F.col("_times")).alias("_taken"), F.min("_a").alias("first_shard"), F.max("_b").alias("last_shard"))
    full = placed.withColumn("_key", F.when(F.col("size") > 0, F.col("_at")))
    joined = full.join(taken.withColumnsRenamed({"sid": "_sid", "_at": "_k"}), (F.col("sid") == F.col("_sid")) & (F.col("_key") == F.col("_k")), "left")
    return joined.select("sid", "_id", "_tag", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard"), sources


def mix(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0, block: int = BLOCK, seed: int = 17,
) -> DataFrame:
    """One row per document: id, tag, size, source_size, target, the words that the mix takes of it, and the first and
    last output shard that shows some of them (null if none does)."""
    rows, _ = _mixed(spark, docs, id_col, text_col, source_col, weights, share, repeat, block, seed)
    return rows.select(F.col("_id").alias(id_col), F.col("_tag").alias("text_tag"), "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mixed_blocks(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 17,
) -> DataFrame:
    """The mix: (shard, place, source, epoch, block, n_words, text), a row for each place of each output shard.

    A block's words are joined by single spaces; the last block of a source may be shorter. A block holds words of at most `block`
    documents, so no group is larger.
    """
    scratch = Scratch(spark, "blocks")
    placed, sources = _placed(scratch, docs, id_col, text_col, source_col, weights, share, repeat)
    # documents that share id, tag and source are alike: any of the texts serves all of them
    alike = docs.select(F.col(id_col).alias("_i"), text_tag(text_col).alias("_t"), F.col(source_col).alias("_s"), F.col(text_col).alias("_text")).where("_text is not null").dropDuplicates(["_i", "_t", "_s"])
    named = alike.join(sources.select(F.col("source").alias("_n"), F.col("sid").alias("_sid")), F.col("_s").eqNullSafe(F.col("_n"))).drop("_s", "_n")
    met = placed.where("size > 0").join(named, (F.col("sid") == F.col("_sid")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t")))
    words = met.withColumn("_all", F.array_remove(F.split("_text", SPACE), "")).withColumn("_all", F.slice("_all", 1, F.col("size").cast("int")))
    cut = _spans(words.select("sid", "_at", "size", "_all"), block).select("sid", "block", "_at", F.slice("_all", (F.col("_from") + 1).cast("int"), F.col("_words").cast("int")).alias("_part"))
    parts = cut.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("_at", "_part"))).alias("_parts"))
    texts = parts.withColumn("_all", F.flatten(F.transform("_parts", lambda p: p["_part"]))).select("sid", "block", F.size("_all").alias("n_words"), F.array_join("_all", " ").alias("text"))
    dealt = slots(scratch, sources, block, per_shard, seed).hint("merge")
    joined = dealt.join(texts, ["sid", "block"]).join(sources.select("sid", "source"), "sid")
    return joined.select("shard", "place", "source", "epoch", "block", "n_words", "text")


def mixed_documents(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: float = 2.0, block: int = BLOCK, seed: int = 17,
) -> DataFrame:
    """The documents as the mix shows them: each as often as its taken share, rounded down or up (0, 1, 2, ...).

    Shares are summed within a source in order of size, equal sizes in a seeded order, from a seeded
    start; a document gets the whole copies by which its sum passes integers. What one is rounded down,
    the next of about its size makes up, so the words shown of a source, and of its documents below any size,
    differ from the words taken by less than the largest of these documents.

    A document without words isn't shown. Repeated rows of a source share the mean of what they got, count as
    one document of their joint size in that bound, and are all shown equally often.
    """
    scratch = Scratch(spark, "mixed")
    rows, sources = _mixed(spark, docs, id_col, text_col, source_col, weights, share, repeat, block, seed)
    units = F.round(F.sum("taken") * UNIT / F.sum("size")).cast("long")
    shares = rows.where("size > 0").groupBy("sid", "_id", "_tag").agg(F.sum("size").alias("_words"), units.alias("_units")).withColumn("_turn", F.xxhash64(F.lit(seed), F.lit("turn"), "_id", "_tag"))
    summed = running(scratch, shares, ["sid"], ["_words", "_turn", "_id", "_tag"], F.col("_units"), by_value="_sum")
    start = F.col("_sum") + F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "sid"), F.lit(UNIT))
    passed = F.shiftright(start + F.col("_units"), UNIT_BITS) - F.shiftright(start, UNIT_BITS)
    shown = summed.join(sources.select(F.col("sid").alias("_n"), F.col("source").alias("__bw_s")), F.col("sid") == F.col("_n"))
    shown = shown.select("__bw_s", F.col("_id").alias("__bw_i"), F.col("_tag").alias("__bw_t"), passed.cast("int").alias("__bw_times")).where("__bw_times > 0")
    own = docs.withColumn("__bw_tag", text_tag(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__bw_i")) & (F.col("__bw_tag") == F.col("__bw_t")) & F.col(source_col).eqNullSafe(F.col("__bw_s"))
    return own.join(shown, same).withColumn("__bw_copy", F.explode(F.sequence(F.lit(1), F.col("__bw_times")))).select(*docs.columns)
