"""Benchmark decontamination by SimHash over item-sized windows (DataFrame operations only).

An item-sized window is any run of an item's number of shingles in a text, those that hang over the text's
beginning or end included. A weighted Jaccard similarity of t needs shared shingles of t times the item's weight,
so the running sums of shared weight along a text say which windows could be similar at all; all others
are left out without loss. Windows with the same content are handled once, whatever number of texts holds them.

Each content and item gets a 64-bit SimHash whose bits are the signs of sums of +-sqrt(weight). The cosine of two such
vectors is the shared weight over the geometric mean of both totals, at least 2t / (1 + t) for similarity t:
0.889 for 0.8, or 9.7 of 64 bits apart with a standard deviation of 2.9. RADIUS is 3.6 of these above.

The multi-index cuts a fingerprint into BLOCKS blocks. Two fingerprints within RADIUS bits are within
REACH[k] bits in some block k, because the REACH sum to RADIUS - BLOCKS + 1. The items' side lists every value within that reach,
so that a window looks up one value a block, and finds all fingerprints within the radius. Candidates are verified by
exact weighted shingle similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, bytes_of, durable, if_small, table, tidy

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 5, 20
EDGES = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
REACH = [(RADIUS - BLOCKS + 1 + k) // BLOCKS for k in range(BLOCKS)]
#: Places of a text whose windows are cut by one row.
STRETCH = 4096
#: A word of a text in lower case.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """Hashes of each five consecutive words; texts of fewer words have none.

    The words are bound to a variable first: named in the inner lambda, they would be made anew for each shingle.
    """

    def of(w: Column) -> Column:
        last = F.size(w) - SHINGLE
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(*(w[i + (k - 1)] for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]


#: A bit is set where the hashes that have it outweigh the others. One small expression over an
#: array: 64 sums side by side would be compiled into very large methods, at a great cost in memory.
SIMHASH = """aggregate(sequence(0, 63), 0L, (bits, k) -> bits | if(
    round(aggregate(xs, 0D, (t, e) -> t + if(getbit(e.x, k) = 1, e.r, -e.r)), 9) > 0, shiftleft(1L, k), 0L))"""


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` has the keys, s (distinct in a key) and w; returns the keys, xs (s and w), total weight and fingerprint.

    What it returns is written: left in the plan, the expression would be copied to each use.
    """
    entry = F.struct("s", "w", F.sqrt("w").alias("r"), F.xxhash64("s", F.lit(64)).alias("x"))
    packed = rows.groupBy(*keys).agg(F.sum("w").alias("total"), F.array_sort(F.collect_list(entry)).alias("xs"))  # as long as a window
    return durable(packed.select(*keys, "total", F.expr(SIMHASH).alias("print"), F.transform("xs", lambda e: F.struct(e["s"].alias("s"), e["w"].alias("w"))).alias("xs")))


def blocks(fingerprint: Column) -> list[Column]:
    """The values of the BLOCKS blocks of bits."""
    return [F.shiftrightunsigned(fingerprint, EDGES[k]).bitwiseAND(F.lit((1 << (EDGES[k + 1] - EDGES[k])) - 1).cast("bigint")) for k in range(BLOCKS)]


def looked_up(fingerprint: Column) -> Column:
    """Where a window looks: block and value, one a block."""
    return F.array(*(F.struct(F.lit(k).alias("block"), v.alias("value")) for k, v in enumerate(blocks(fingerprint))))


def listed(fingerprint: Column) -> Column:
    """Where an item is listed: block and value, every value within the block's reach."""
    def near(k: int, value: Column) -> Column:
        every = F.sequence(F.lit(0).cast("bigint"), F.lit((1 << (EDGES[k + 1] - EDGES[k])) - 1).cast("bigint"))
        masks = F.filter(every, lambda x: F.bit_count(x) <= REACH[k])
        return F.transform(masks, lambda x: F.struct(F.lit(k).alias("block"), x.bitwiseXOR(value).alias("value")))

    return F.concat(*(near(k, v) for k, v in enumerate(blocks(fingerprint))))


def _windows(docs: DataFrame, known: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id, h, a, m: first place (below 0 for one that hangs over) and size of each window that holds enough of an item.

    A window holds a shingle if the shingle's last place before the window's end lies in it, so each hit
    counts from a window's size before it, or just after the same shingle's hit before, up to itself.
    """
    text = ["doc_id", "h"]
    hits = docs.select(*text, F.posexplode(shingle_hashes(word_hashes(F.col("text")))).alias("p", "s")).join(known, "s", "left_semi")
    hits = hits.distinct().join(postings, "s")  # equal rows of an id are one
    own = [*text, "item", "m", "least"]
    before = F.lag("p").over(Window.partitionBy(*text, "item", "s").orderBy("p"))
    hits = hits.withColumn("a", F.greatest(F.col("p") - F.col("m") + 1, F.coalesce(before + 1, F.col("p") - F.col("m") + 1)))
    steps = hits.select(*own, F.inline(F.array(F.struct("a", "w"), F.struct((F.col("p") + 1).alias("a"), (-F.col("w")).alias("w")))))
    steps = steps.groupBy(*own, "a").agg(F.sum("w").alias("w"))
    along = Window.partitionBy(*text, "item").orderBy("a")
    held = steps.select(*own, "a", F.sum("w").over(along).alias("held"), F.lead("a").over(along).alias("stop")).where("held >= least and stop is not null")
    return held.select(*text, "m", F.explode(F.sequence("a", F.col("stop") - 1)).alias("a")).distinct()


@tidy
def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Where texts of ``docs`` (doc_id, text) repeat ``items`` (item_id, text).

    Weights are ln(1 + items / items that have the shingle), of a shingle in no item as if in one. One row
    a document and item whose most similar item-sized window reaches ``threshold`` in weighted
    Jaccard similarity of shingle sets: doc_id, item_id, similarity (6 places), start_word and n_words of
    that window (of equally similar ones the first, then the shortest).

    Items and texts of fewer than five words have no shingle and match nothing, nor do nulls; rows with a null id
    are left out, as they can't be named. Of different texts that share an id the most similar window counts, and repeated
    rows count once. Very long texts are cut into stretches of STRETCH places. Empty tables give no rows.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("h", F.xxhash64("text"))
    texts = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), shingle_hashes(word_hashes(F.col("text"))).alias("s")).where("size(s) > 0")
    # equal items are looked up once
    unique = durable(texts.groupBy("s").agg(F.min("item_id").alias("item"), F.collect_set("item_id").alias("item_ids")).withColumn("m", F.size("s")))
    n_items = float(unique.count())
    parts = unique.select("item", "m", F.explode(F.array_distinct("s")).alias("s"))
    weighted = parts.join(parts.groupBy("s").agg(F.log(1 + F.lit(n_items) / F.count("item")).alias("w")), "s")
    # the weight that a window must share, with room for the rounding of similarities
    least = weighted.groupBy("item").agg((F.sum("w") * (threshold - 1e-6) - 1e-9).alias("least"))
    postings = durable(weighted.join(least, "item"))
    small = bytes_of(postings) <= BROADCAST_BYTES // 4
    side = F.broadcast if small else (lambda rows: rows)  # the items' tables are all of about this size
    weights = postings.select("s", "w").distinct()
    item_prints = _fingerprints(postings.select("item", "m", "s", "w"), ["item", "m"])
    spots = _windows(docs, side(weights.select("s")), side(postings))
    lists = durable(spots.groupBy("doc_id", "h", F.floor(F.col("a") / STRETCH).alias("stretch")).agg(F.collect_list(F.struct("a", "m")).alias("windows")))  # STRETCH times the sizes of items
    again = docs.join(if_small(lists), ["doc_id", "h"]).select("doc_id", "windows", shingle_hashes(word_hashes(F.col("text"))).alias("all"))
    span = lambda x: F.struct(F.greatest(x["a"], F.lit(0)).alias("lo"), F.least(x["a"] + x["m"], F.size("all")).alias("hi"), x["m"].alias("m"))
    cut = again.select("doc_id", F.explode(F.transform("windows", span)).alias("x"), "all")
    cut = cut.select("doc_id", "x.lo", (F.col("x.hi") - F.col("x.lo")).alias("n"), "x.m", F.array_sort(F.array_distinct(F.slice("all", F.col("x.lo") + 1, F.col("x.hi") - F.col("x.lo")))).alias("s"))
    content = ["k1", "k2", "m"]
    cut = durable(cut.withColumns({"k1": F.xxhash64("s"), "k2": F.xxhash64(F.lit(2), "s")}).distinct())
    unseen = F.log(F.lit(1 + n_items))
    shingles = cut.groupBy(*content).agg(F.first("s").alias("s")).select(*content, F.explode("s").alias("s"))
    prints = _fingerprints(shingles.join(side(weights), "s", "left").withColumn("w", F.coalesce("w", unseen)), content)
    index = durable(item_prints.select("item", "m", F.col("print").alias("item_print"), F.inline(listed(F.col("print")))))
    near = prints.select(*content, "print", F.inline(looked_up(F.col("print")))).join(if_small(index), ["m", "block", "value"])
    near = durable(near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select(*content, "item").distinct())
    # exact verification, once a content and item
    own = item_prints.select("item", F.col("xs.s").alias("item_s"), F.col("total").alias("item_total"))
    pairs = near.join(prints.select(*content, "xs", "total"), content).join(side(own), "item")
    both = F.aggregate(F.filter("xs", lambda e: F.array_contains("item_s", e["s"])), F.lit(0.0), lambda acc, e: acc + e["w"])
    scored = pairs.select(*content, "item", both.alias("both"), "total", "item_total").withColumn("similarity", F.round(F.col("both") / (F.col("total") + F.col("item_total") - F.col("both")), 6))
    scored = durable(scored.where(F.col("similarity") >= threshold).select(*content, "item", "similarity"))
    found = cut.select(*content, "doc_id", "lo", "n").join(if_small(scored), content)
    best = found.groupBy("doc_id", "item").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "lo", "n")).alias("x"))
    return best.join(side(unique.select("item", "item_ids")), "item").select("doc_id", F.explode("item_ids").alias("item_id"), (-F.col("x.less")).alias("similarity"), F.col("x.lo").cast("bigint").alias("start_word"), (F.col("x.n") + SHINGLE - 1).cast("bigint").alias("n_words"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle(docs: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same without fingerprints: every item-sized window that has a shingle of the item is compared."""
    words = lambda t: f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
    shingles = f"CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) ELSE [] END"
    return f"""
    WITH it AS (SELECT item_id, s, len(s) AS m FROM (SELECT item_id, {shingles} AS s FROM (SELECT item_id, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL)) WHERE len(s) > 0),
    dd AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {words("text")} AS w FROM {docs} WHERE doc_id IS NOT NULL))),
    u AS (SELECT s, m, min(item_id) AS item FROM it GROUP BY s, m),
    c AS (SELECT count(*)::DOUBLE AS n FROM u),
    ip AS (SELECT DISTINCT item, m, unnest(s) AS x FROM u),
    wt AS (SELECT x, ln(1 + (SELECT n FROM c) / count(*)) AS w FROM ip GROUP BY x),
    iw AS (SELECT item, m, x, w FROM ip JOIN wt USING (x)),
    itot AS (SELECT item, sum(w) AS item_total FROM iw GROUP BY item),
    dp AS (SELECT row_number() OVER () AS r, doc_id, s FROM dd WHERE len(s) > 0),
    hits AS (SELECT DISTINCT r, item, m, unnest(range(p - m + 1, p + 1)) AS a FROM (SELECT r, unnest(s) AS x, unnest(range(len(s))) AS p FROM dp) JOIN ip USING (x)),
    win AS (SELECT DISTINCT r, doc_id, item, greatest(a, 0) AS lo, least(a + m, len(s)) - greatest(a, 0) AS n, list_distinct(s[greatest(a, 0) + 1:least(a + m, len(s))]) AS ws FROM hits JOIN dp USING (r)),
    ex AS (SELECT r, doc_id, item, lo, n, unnest(ws) AS x FROM win),
    sc AS (SELECT r, doc_id, ex.item, lo, ex.n, sum(coalesce(wt.w, ln(1 + (SELECT n FROM c)))) AS total, coalesce(sum(iw.w), 0) AS both_
      FROM ex LEFT JOIN wt ON wt.x = ex.x LEFT JOIN iw ON iw.item = ex.item AND iw.x = ex.x GROUP BY ALL),
    f AS (SELECT doc_id, item, lo, n, round(both_ / (total + item_total - both_), 6) AS similarity FROM sc JOIN itot USING (item)),
    best AS (SELECT doc_id, item, similarity, lo, n, row_number() OVER (PARTITION BY doc_id, item ORDER BY similarity DESC, lo, n) AS k FROM f WHERE similarity >= {threshold})
    SELECT doc_id, item_id, similarity, lo::BIGINT AS start_word, (n + {SHINGLE - 1})::BIGINT AS n_words FROM best JOIN u USING (item) JOIN it ON it.s = u.s WHERE k = 1"""
