"""Mixing sources to target weights: a golden-ratio schedule over sources, joined to shuffled equal-token blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut, map_arrow, running_totals, slices, table

#: Points live in [0, 2^48); the step is 2^48 divided by the golden ratio, made odd.
GRID = 1 << 48
STEP = 173961102589771
WEIGHTS = (5, 2, 1)
#: Cells of a source that one row is cut into.
CHUNK = 1 << 14
_WORD = re.compile(WORD)


def golden_point(i):
    """i * STEP mod GRID in exact 64-bit integers, i up to 2^45, by 15-bit limbs."""
    point = F.lit(0)
    for k in range(3):
        limb = F.shiftrightunsigned(i, 15 * k).bitwiseAND(F.lit(0x7FFF)) if k else i.bitwiseAND(F.lit(0x7FFF))
        point = point + F.pmod(limb * F.lit((STEP << (15 * k)) % GRID), F.lit(GRID))
    return F.pmod(point, F.lit(GRID))


def source_key():
    """The source as a key that sorts by code point, nulls last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source key, size in words and the shuffle key of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", source_key().alias("skey"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ratio: float, epochs: int) -> DataFrame:
    """Per source key: source_size, rank by code point, weight and target; a target stops at epochs * size, the excess goes to the others by weight."""
    totals = cut(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = running_totals(totals, ["skey"], ["source_size"], "mix-ranks")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("idx", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("skey", "source_size", F.col("idx").alias("rank"), w.alias("weight"), F.col("source_size_before").alias("source_start")), "mix-weights")
    cap = F.col("source_size") * F.lit(float(epochs))
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    goal, level, held = ratio * whole[0], ratio * whole[0] / whole[1] if whole[1] else 0.0, -1
    while True:  # the level only rises, so those at their cap stay there; each round is one small aggregate
        full = F.col("weight") * level > cap
        n, used, rest = ranked.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == held or not rest:
            break
        held, level = n, (goal - used) / rest
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def cells(sources: DataFrame, cell, total: int, chunk: int = CHUNK) -> DataFrame:
    """A row for each cell of each source (skey, blocks, slots, lo, hi).

    A source may have as many cells as the mix has slots, `total`. So its range is first cut at every `chunk` cells, and these parts
    are dealt to a number of tasks that grows with the total before they are cut into cells.
    """
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 22)
    ends = sources.select("skey", "blocks", "slots", "lo", "hi", cell(F.col("lo")).alias("a"), cell(F.col("hi")).alias("b"))
    parts = ends.withColumn("part", F.explode(F.sequence(F.expr(f"a div {chunk}"), F.expr(f"b div {chunk}")))).repartition(tasks, "skey", "part")  # a number that is given is not cut down for rows that are still few
    inside = F.sequence(F.greatest("a", F.col("part") * chunk), F.least("b", F.col("part") * chunk + chunk - 1))
    return parts.select("skey", "blocks", "slots", "lo", "hi", F.explode(inside).alias("cell"))


@dataclass
class Mix:
    """placed: each row's place in its source's line; pieces: its words [first, last) in each block; schedule: the block of each slot."""

    placed: DataFrame
    pieces: DataFrame
    schedule: DataFrame


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, epochs: int = 2, block_words: int = 256, min_blocks: int = 256, seed: int = 7) -> Mix:
    """The mix of the sources to their weights.

    Each source's documents are shuffled by hash and laid end to end; blocks of L words cut that line, L being block_words or
    source_size / min_blocks where that is less. Slot i of the schedule lands at the golden-ratio point of i among the
    sources' cumulative slot counts; its rank among its source's slots names the block, starting again after the last one.
    A source takes ceil(target / L) slots at most and never more than epochs rounds, so no document passes epochs * size.

    Sizes are counts of words (null text: 0); a null source is a source of its own, ranked last. Repeated rows are laid out
    each on its own. An empty table gives two empty tables. Other columns are ignored. The same rows give the same mix.
    """
    spark = docs.sparkSession
    sizes = cut(sized(docs, seed), "mix-sizes")
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / min_blocks)))
    sources = source_targets(sizes, weights, ratio, epochs).withColumn("L", length.cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("L")).cast("long")).withColumn("slots", F.col("target") / F.col("L"))
    sources = cut(running_totals(cut(sources, "mix-slots"), ["skey"], ["slots"], "mix-cumulative").drop("idx"), "mix-plan")
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0]
    n = int(-(-total // 1))
    # sources are cut at the cells of the unit interval, one cell a slot, so that the lookup is an equi-join of n + sources rows
    edge = lambda x: F.least(F.lit(GRID), F.floor(x / F.lit(max(total, 1e-9)) * F.lit(float(GRID))).cast("long"))
    cell = lambda x: F.floor(x / F.lit(float(GRID)) * F.lit(float(max(n, 1)))).cast("long")
    spans = cells(sources.where("slots > 0").withColumn("lo", edge(F.col("slots_before"))).withColumn("hi", edge(F.col("slots_before") + F.col("slots"))), cell, n)
    # the exploded side is larger than its source lets the planner think, so it must not be broadcast
    points = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    slots = points.join(spans.hint("merge"), "cell").where("u >= lo and u < hi").select("skey", "slot", "blocks", "slots")
    order = running_totals(slots, ["skey", "slot"], [], "mix-order")
    first = order.groupBy("skey").agg(F.min("idx").alias("first"))
    ranked = order.join(cut(first, "mix-first"), "skey").withColumn("rank", F.col("idx") - F.col("first"))
    schedule = ranked.where((F.col("rank") < F.ceil("slots")) & (F.col("rank") < F.col("blocks") * epochs)).select("slot", "skey", "rank", F.pmod("rank", "blocks").alias("block"), F.expr("rank div blocks").alias("round"))

    laid = running_totals(sizes, ["skey", "key", "doc_id"], ["size"], "mix-laid")
    placed = laid.join(sources.select("skey", "source_size", "source_start", "target", "L"), "skey").withColumn("start", F.col("size_before") - F.col("source_start"))
    placed = placed.select("doc_id", "skey", "key", "start", "size", "source_size", "target", "L", "idx")
    pieces = placed.where("size > 0").select("idx", "skey", "start", "size", "L", F.explode(F.expr("sequence(start div L, (start + size - 1) div L)")).alias("block"))
    pieces = pieces.withColumn("first", F.greatest("start", F.col("block") * F.col("L")) - F.col("start")).withColumn("last", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("L")) - F.col("start"))
    return Mix(placed, pieces, schedule)


def mix_sources(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables: documents (doc_id, skey, key, start, size, source_size, target, taken) and schedule (slot, skey, rank, block); see `plan`."""
    mix = plan(docs, **options)
    times = mix.schedule.groupBy("skey", "block").agg(F.count("*").alias("times"))
    taken = mix.pieces.join(times, ["skey", "block"]).groupBy("idx").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
    out = mix.placed.join(taken, "idx", "left").select("doc_id", "skey", "key", "start", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, mix.schedule


def stretches(mix: Mix) -> DataFrame:
    """(doc_id, skey, key, size, stretches): what the mix takes of each row, as an array of (round, first, last, slot), in order of round and place.

    A round is one pass over a source's blocks. Neighbouring blocks that a round takes of a row are one stretch of its words
    [first, last), with the slot that comes first. Rows equal in id, source and text are one here, with the stretches of all.
    """
    joined = mix.pieces.join(mix.schedule.select("skey", "block", "slot", "round"), ["skey", "block"])
    order = W.partitionBy("idx", "round").orderBy("first")  # a row's blocks in a round: as many as its length makes
    joined = joined.withColumn("new", (F.col("first") != F.lag("last", 1, -1).over(order)).cast("long"))
    joined = joined.withColumn("run", F.sum("new").over(order))
    runs = joined.groupBy("idx", "round", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("slot").alias("slot"))
    runs = runs.join(mix.placed.select("idx", "doc_id", "skey", "key", "size"), "idx")
    return runs.groupBy("doc_id", "skey", "key").agg(F.min("size").alias("size"), F.sort_array(F.collect_list(F.struct("round", "first", "last", "slot"))).alias("stretches"))


def apply_mix(docs: DataFrame, in_order: bool = False, **options) -> DataFrame:
    """The words that the mix takes, as rows with the columns of docs: one for each stretch of a row's words that a round takes.

    A stretch of all words is the whole text; another is the text from its first word's start to its last word's end, and n_chars,
    where there is such a column, becomes its length. Rows that the mix takes nothing of, so all without words, don't come.
    Of rows equal in id, source and text one stands for all, as often as they are taken together. in_order: rows come by slot of
    the schedule. The same rows give the same mix. An empty table gives an empty one.
    """
    mix, names = plan(docs, **options), docs.columns
    taken = cut(stretches(mix).toDF("_id", "_skey", "_k", "_size", "_found"), "mix-taken")
    rows = docs.withColumn("_source", source_key()).withColumn("_key", F.xxhash64(F.lit(options.get("seed", 7)), "doc_id", "text"))
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")) & (F.col("_source") == F.col("_skey")))
    repeats = cut(mix.placed.groupBy("doc_id", "skey", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "skey", "key").toDF("_rid", "_rskey", "_rk"), "mix-repeats")
    if repeats.limit(1).count():  # one of each repeated row stands for all
        marked = joined.join(repeats, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_k") == F.col("_rk")) & (F.col("_skey") == F.col("_rskey")), "left")
        joined = marked.where("_rk is null").unionByName(marked.where("_rk is not null").dropDuplicates(["_id", "_k", "_skey"]))
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def deal(batches):
        for b in slices(batches, text, 2 << 20):
            which, words, slots = [], [], []
            for r, (t, size, found) in enumerate(zip(*(b.column(c).to_pylist() for c in (text, len(names), len(names) + 1)))):
                at = None
                for x in found:
                    if x["last"] - x["first"] < size:
                        at = at or [m.span() for m in _WORD.finditer(t)]
                        words.append(t[at[x["first"]][0] : at[x["last"] - 1][1]])
                    else:
                        words.append(t)
                    which.append(r)
                    slots.append(x["slot"])
            part = b.select(names).take(pa.array(which, pa.int64()))
            columns = part.columns
            columns[text] = pa.array(words, part.schema.field(text).type)
            if chars is not None:
                columns[chars] = pa.array([n if w == t else len(w) for n, w, t in zip(part.column(chars).to_pylist(), words, part.column(text).to_pylist())], part.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slots, pa.int64())], names=[*names, "_slot"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    dealt = map_arrow(joined.select(*names, "_size", "_found"), deal, f"{schema}_slot bigint")
    return (dealt.orderBy("_slot", "doc_id") if in_order else dealt).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
