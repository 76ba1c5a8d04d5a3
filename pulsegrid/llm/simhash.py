"""Document fingerprints by SimHash (operator 3); DataFrame functions only.

Method: the terms of a text are its three-word shingles (all words together
when there are fewer).  Each occurrence's 64-bit hash votes on every bit, so a
term weighs as often as it occurs; a bit of the fingerprint is set if more than
half of the weight votes for it.  Two vote counts share one 64-bit sum, so a
text takes 32 sums in one aggregation, which combines on the map side.

``neighbours`` finds all pairs of fingerprints within a Hamming radius with
permuted block tables: the bits are cut into ``blocks`` blocks; with radius r,
at least ``blocks - r`` of them are equal, so each choice of that many blocks
is a table whose key is their bits.  Equal fingerprints are one node.

Defined cases: null and empty texts have no terms and the fingerprint 0; where
an order of documents is needed, rows without an id come first and rows that
repeat an id follow one another in the order of a hash of their texts, so that
of equal rows each but the last has its equal as the next; a single document is
its own next one; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BITS = 64
SHINGLE = 3
_PAIR = (1 << 32) | 1
#: Ids that share a range when next ids are found.
RANGE_ROWS = 20_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def votes(words_col: str = "w", shingle: int = SHINGLE) -> tuple[Column, Column]:
    """An array of the places of a text's terms, and the hash of the term at the place ``i`` (columns for an exploded row)."""
    last = F.greatest(F.size(words_col) - shingle, F.lit(0))
    # beyond the end get() is null and the hash skips it, so that a short text is one term of all its words
    return F.sequence(F.lit(0), last), F.xxhash64(*[F.get(words_col, F.col("i") + k) for k in range(shingle)])


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(keys, fingerprint long) for each text; ``keys`` must identify the rows."""
    places, term = votes(shingle=shingle)
    w = df.select(*keys, words(F.col(text_col)).alias("w"))
    each = w.select(*keys, "w", F.explode(places).alias("i"))
    each = each.select(*keys, (F.size("w") > 0).cast("long").alias("one"), term.alias("h"))
    sums = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(_PAIR)) * F.col("one")).alias(f"v{k}") for k in range(32)]
    summed = each.groupBy(*keys).agg(F.sum("one").alias("n"), *sums)
    low = [F.when((F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2) > F.col("n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(32)]
    high = [F.when((F.shiftright(f"v{k}", 32) * 2) > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k + 32)).otherwise(F.lit(0).cast("long")) for k in range(32)]
    return summed.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), low + high).alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def shown(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def block_keys(fingerprint: Column, radius: int, blocks: int) -> list[Column]:
    """The key of each table: its number and the bits of the blocks chosen for it."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        keys.append(F.struct(F.lit(number).alias("t"), fingerprint.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("bits")))
    return keys


def neighbours(fps: DataFrame, radius: int = 3, blocks: int = 6, col: str = "fingerprint") -> DataFrame:
    """(a, b, distance) for every two different fingerprints a < b within ``radius``; each pair once, none is missed."""
    nodes = fps.select(F.col(col).alias("f")).where("f is not null").distinct()
    keyed = nodes.select("f", F.explode(F.array(*block_keys(F.col("f"), radius, blocks))).alias("key"))
    a, b = keyed.select("key", F.col("f").alias("a")), keyed.select("key", F.col("f").alias("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= radius)).select("a", "b")
    return pairs.distinct().withColumn("distance", distance(F.col("a"), F.col("b")))


def with_neighbours(nodes: DataFrame, order: list[str], facts: list[str]) -> DataFrame:
    """Adds next_<c> and last_<c> of the next and the previous row in ``order``, in a circle, for each fact and order column.

    ``nodes`` is a thin table whose order columns tell its rows apart.  Rows go
    to ranges with about equally many rows, by a sample of the order; a window
    works inside a range, and the ends of the ranges, a row of each, are joined.
    """
    spark, cols = nodes.sparkSession, [*order, *facts]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // RANGE_ROWS))
    held = stored(nodes.repartitionByRange(min(n, 10_000), *order).withColumn("_range", F.spark_partition_id()), "id-ranges")
    row = F.struct(*cols)
    ends = held.groupBy("_range").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    every = Window.orderBy("_range")  # one row a range
    around = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_range", F.coalesce(F.lead("_first").over(every), F.first("_first").over(around)).alias("_after"), F.coalesce(F.lag("_last").over(every), F.last("_last").over(around)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    out = held.select("*", F.lead(row).over(inside).alias("_next"), F.lag(row).over(inside).alias("_prev")).join(ends, "_range")
    out = out.withColumns({"_next": F.coalesce("_next", "_after"), "_prev": F.coalesce("_prev", "_before")})
    return out.select(*cols, *[F.col("_next")[c].alias(f"next_{c}") for c in cols], *[F.col("_prev")[c].alias(f"last_{c}") for c in cols])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint as longs) for every row.

    The edited text has its last floor(n_chars / 4) characters replaced by the
    first as many of the next document.  Equal rows are one node with a number.
    A thin table of (id, hash of the text, size) gives each node its neighbours;
    texts then are shuffled once, by node; of the next document only the head
    that is needed travels, and all further sums of a node stay where its text is.
    """
    key = ["named", "doc_id", "mark"]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    nodes = docs.select(*key, F.length("text").cast("long").alias("n_chars")).groupBy(*key).agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    nodes = stored(nodes, "documents-by-id")
    nodes = stored(with_neighbours(nodes, key, ["n_chars"]).join(nodes.select(*key, "copies"), key), "document-order")
    if nodes.where("copies > 1").limit(1).count():
        docs = docs.dropDuplicates(key)
    both = docs.join(nodes, key)
    cut = lambda n: F.floor(F.col(n) / 4).cast("int")
    heads = both.select(*[F.col(f"last_{c}").alias(c) for c in key], F.substring("text", F.lit(1), cut("last_n_chars")).alias("head"))
    rest = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut("n_chars"))
    # a copy's next document is the copy after it
    own = F.when(F.col("copies") > 1, F.concat(rest, F.substring("text", F.lit(1), cut("n_chars"))))
    texts = both.join(heads, key).select(*key, "text", F.concat(rest, "head").alias("edited"), own.alias("again"))
    digests = texts.select(*key, F.sha2("edited", 256).alias("edited_sha256"), F.sha2("again", 256).alias("again_sha256"))
    each = texts.select(*key, F.posexplode(F.array("text", "edited", "again")).alias("which", "text")).where("text is not null")
    fps = fingerprints(each, [*key, "which"])
    of = lambda k: F.max(F.when(F.col("which") == k, F.col("fingerprint")))
    fps = fps.groupBy(*key).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"), of(2).alias("again_fingerprint"))
    got = stored(digests.join(fps, key).join(nodes, key), "fingerprints")
    after = [f"next_{c}" for c in key]
    following = got.select(*[F.col(c).alias(a) for c, a in zip(key, after, strict=True)], F.col("fingerprint").alias("next_fingerprint"))
    name = F.when(F.col("named"), F.col("doc_id")).alias("doc_id")
    last = got.join(following, after).select(name, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
    copies = got.where("copies > 1").withColumn("_copy", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
    copies = copies.select(name, "n_chars", F.col("again_sha256").alias("edited_sha256"), "fingerprint", F.col("again_fingerprint").alias("edited_fingerprint"), F.col("fingerprint").alias("next_fingerprint"))
    return last.unionByName(copies)
