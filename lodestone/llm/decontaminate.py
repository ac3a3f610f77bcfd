"""Benchmark decontamination with DataFrame functions only: a prefix-filtered set join, verified over item-sized windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, lowered, table

BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Keys of documents that are broadcast at most (16 bytes each where ids are numbers); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Stands among the shingles for the row itself.
COUNTED = 0x5EED0F0C0DE
#: Stand for a null doc_id in the joins: of a number, and of text.
NO_ID, NO_TEXT_ID = -(1 << 63), "\x00"


def words_of(column):
    return F.regexp_extract_all(lowered(column), F.lit(BENCH_WORD), F.lit(0))


def _shingles(words):
    """Hashes of every word with the next one; the last entry is of the last word alone."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, ww, w1, w2: the windows of every item, as words and two hashes of them."""
    items = benchmark.select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("iw")).where(F.size("iw") > 0)
    k = F.least(F.size("iw"), F.lit(window))
    each = items.select("item_id", "iw", k.alias("k"), F.explode(F.sequence(F.lit(1), F.size("iw") - k + 1)).alias("s"))
    return each.select("item_id", F.slice("iw", F.col("s"), F.col("k")).alias("ww")).withColumns({"w1": F.xxhash64("ww"), "w2": F.xxhash64(F.lit(1), "ww")})


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key (hash of the text), n_words, n_hit, items (sorted strings of the item_ids with an occurring window) for every row of docs.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Windows that items share are
    one. Shingles are pairs of words (a lone word for one-word windows). Each window is looked up by its rarest shingle over all
    documents only (the prefix that containment makes necessary); what meets is bounded by position and length and then compared
    word by word. Only texts that some window may occur in are split a second time.
    Null texts have no words; null ids are judged like others. Rows of docs with equal ids are judged each by its own text; item rows with equal ids count as
    one item. Without benchmark rows nothing is hit. An empty table gives an empty one. doc_id may be a number or text. Other columns are ignored.
    """
    none = F.lit(NO_TEXT_ID if docs.schema["doc_id"].dataType.simpleString() == "string" else NO_ID)
    rows = docs.select(F.coalesce("doc_id", none).alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))
    held = cut(_windows(benchmark, window), "bench-held")
    windows = cut(held.dropDuplicates(["w1", "w2"]).select("w1", "w2", "ww", F.size("ww").alias("k")), "bench-windows")
    short = windows.where("k = 1").limit(1).count() > 0

    # windows of one set of items are one class, so that a prompt that many items share costs a document one row an item
    sets = held.select("w1", "w2", "item_id").distinct().groupBy("w1", "w2").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("item_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("y"))
    sets = cut(sets, "bench-sets")
    speaker = sets.groupBy("c", "x", "y").agg(F.min(F.struct("w1", "w2")).alias("m")).select("c", "x", "y", "m.w1", "m.w2")
    members = cut(held.select("w1", "w2", "item_id").distinct().join(speaker, ["w1", "w2"]).select("c", "x", "y", F.col("item_id").cast("string").alias("item")), "bench-members")

    grams = windows.select("w1", "w2", "k", F.posexplode(_shingles(F.col("ww"))).alias("off", "g")).where("k = 1 or off < k - 1")
    grams = cut(grams, "bench-shingles")
    vocabulary = grams.select("g").unionByName(docs.sparkSession.range(1).select(F.lit(COUNTED).alias("g"))).distinct()
    vocabulary = cut(vocabulary, "bench-vocabulary")

    # explode(array(x)) keeps x as one computed column: a lambda below reads it instead of splitting the text for each element
    split = rows.where("text is not null").select("doc_id", "row_key", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    lists = [F.array(F.lit(COUNTED)), _shingles(F.col("w"))]
    if short:
        lists.append(F.transform("w", lambda x: F.xxhash64(x)))
    seen = split.select("doc_id", "row_key", F.size("w").alias("n"), F.posexplode(F.concat(*lists)).alias("i", "g"))
    # place -1 is the row's own entry, which carries its count of words
    met = seen.join(vocabulary, "g", "left_semi").select("doc_id", "row_key", "n", F.when(F.col("i") > F.col("n"), F.col("i") - F.col("n") - 1).otherwise(F.col("i") - 1).alias("pos"), "g")
    met = cut(met, "bench-met")
    counted, found = met.where("pos < 0"), met.where("pos >= 0")

    # rarity over all documents, then the rarest shingle of each window
    rarity = found.groupBy("g").agg(F.count("*").alias("freq"))
    ranked = grams.join(rarity, "g", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    anchors = ranked.groupBy("w1", "w2", "k").agg(F.min(F.struct("freq", "off", "g")).alias("a")).where("a.freq > 0")
    anchors = cut(anchors.select("w1", "w2", "k", F.col("a.off").alias("off"), F.col("a.g").alias("g")), "bench-anchors")

    # positional and length bounds: the window, laid at this place, must lie inside the document
    pairs = found.join(anchors, "g").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 and start + k <= n")
    pairs = pairs.select("doc_id", "row_key", "start", "k", "w1", "w2").distinct()
    wanted = cut(pairs.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "k", "w1", "w2")).alias("wanted")), "bench-wanted")

    # only rows with a candidate get their words compared: while those are few their keys are broadcast, and no other text is shuffled
    keys = wanted.select("doc_id", "row_key")
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    likely = rows.where("text is not null").join(F.broadcast(keys) if few else keys, ["doc_id", "row_key"], "left_semi")
    texts = likely.join(wanted, ["doc_id", "row_key"]).select("doc_id", "row_key", "wanted", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    pieces = F.transform("wanted", lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["w1"].alias("w1"), c["w2"].alias("w2"), F.slice("w", c["start"] + 1, c["k"]).alias("dw")))
    hits = texts.select("doc_id", "row_key", F.inline(pieces)).join(windows.drop("k"), ["w1", "w2"]).where(F.col("dw") == F.col("ww"))
    hits = cut(hits.select("doc_id", "row_key", "start", "k", "w1", "w2").distinct(), "bench-hits")

    runs = hits.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("k")).alias("e")))).alias("runs"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    merged = F.aggregate("runs", start, lambda a, r: F.struct(F.greatest(a["end"], r["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["end"], r["s"]))).alias("n")), lambda a: a["n"])
    classes = hits.select("doc_id", "row_key", "w1", "w2").distinct().join(sets, ["w1", "w2"]).select("doc_id", "row_key", "c", "x", "y").distinct()
    named = classes.join(members, ["c", "x", "y"]).groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = cut(runs.select("doc_id", "row_key", merged.cast("long").alias("n_hit")).join(named, ["doc_id", "row_key"]), "bench-hit")

    all_rows = counted.select("doc_id", "row_key", F.col("n").cast("long").alias("n_words")).unionByName(rows.where("text is null").select("doc_id", "row_key", F.lit(0).cast("long").alias("n_words")))
    out = all_rows.join(hit, ["doc_id", "row_key"], "left")
    return out.select(F.nullif("doc_id", none).alias("doc_id"), "row_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS k, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1:s + k], ' ') AS t FROM iw),
kk AS (SELECT DISTINCT k FROM win),
dw AS (SELECT d.doc_id, d.r, kk.k, d.w, unnest(range(0, len(d.w) - kk.k + 1)) AS p FROM d, kk WHERE len(d.w) >= kk.k),
hit AS (SELECT dw.doc_id, dw.r, dw.p, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.t = array_to_string(dw.w[dw.p + 1:dw.p + dw.k], ' ')),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY r)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.r = d.r LEFT JOIN its ON its.r = d.r
"""
