"""Benchmark decontamination with SimHash windows of the items' sizes.

A window of a document can only be similar to an item if it shares a shingle with some item of
that size. So windows begin where a shared shingle says that an item would begin; a bit set of
the items' shingles finds the few that are shared. Distinct
windows get a SimHash; multi-index blocks bring together all windows and items of one size
whose fingerprints are within the radius, and the exact similarity of the weighted shingles
(each weighing as often as it occurs) decides. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graspmeter.llm.common import row_key, written

#: Words of a shingle, and the least similarity of a leak.
SHINGLE, SIMILARITY = 5, 0.8
#: Bit distance up to which pairs are found. Shingles that are 0.8 similar have fingerprints
#: 9.7 bits apart on average, with a deviation of 2.9.
RADIUS = 19
#: Bits of the fingerprint blocks; with a distance of 19 some block differs in 3 bits at most.
BLOCKS = (13, 13, 13, 13, 12)
#: Longs of the bit set of the items' shingles: a million bits.
CELLS = 1 << 14


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; the first or last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash for each run of ``size`` words, in order; none for fewer words."""
    each = F.transform(
        F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(*[F.get(words, i - 1 + k) for k in range(size)])
    )
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<long>"))


def with_simhash(df: DataFrame, hashes: str) -> DataFrame:
    """``df`` with column ``fp``: bits that over half of the hashes have set. Counts sit in pairs in one long."""
    ones = F.lit((1 << 32) + 1)

    def lane(j: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(ones))

    counted = df.select("*", *[lane(j).alias(f"lane{j}") for j in range(32)])
    bits = F.lit(0).cast("long")
    for bit in range(64):
        count = F.shiftrightunsigned(f"lane{bit % 32}", 32 * (bit // 32)).bitwiseAND(F.lit((1 << 32) - 1))
        bits = bits.bitwiseOR(F.shiftleft((2 * count > F.size(hashes)).cast("long"), bit))
    return counted.withColumn("fp", bits).drop(*[f"lane{j}" for j in range(32)])


def weighted(hashes: Column) -> Column:
    """The shingles as a set in which the second occurrence of one differs from the first, and so on."""
    ordered = F.array_sort(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.array_position(ordered, h)))


def blocks(fp: str) -> Column:
    """The fingerprint's blocks as structs ``(block, value)``."""
    made, low = [], 0
    for number, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        made.append(F.struct(F.lit(number).alias("block"), value.cast("int").alias("value")))
        low += width
    return F.array(*made)


def near_blocks(items: DataFrame, radius: int) -> DataFrame:
    """``(size, item_fp)`` under each block value that a fingerprint within the radius can have."""
    most = radius // len(BLOCKS)
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << max(BLOCKS)) - 1)), lambda m: F.bit_count(m) <= most)
    return (
        items.select("size", F.col("fp").alias("item_fp"), F.explode(blocks("fp")).alias("b"))
        .select("size", "item_fp", "b.block", "b.value", F.explode(flips).alias("flip"))
        .select("size", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    )


def item_bits(items: DataFrame) -> DataFrame:
    """``(cell, bits)``: the hashes of all items' shingles as bits of at most ``CELLS`` longs."""
    return (
        items.select(F.explode("hashes").alias("h"))
        .select(F.col("h").bitwiseAND(F.lit(CELLS - 1)).alias("cell"), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
    )


def shared_shingles(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """``(id, pos, hash)`` of the shingles of ``docs`` that an item may have.

    The bit set, a literal of fixed size, leaves out nearly all others before anything is spread
    or shuffled. What it lets through by chance goes with the join that follows, so its size
    costs no result.
    """
    cells = dict(item_bits(items).collect())
    bits = F.split(F.lit(",".join(str(cells.get(c, 0)) for c in range(CELLS))), ",").cast("array<long>")

    def told(h: Column, i: Column) -> Column:
        cell = F.element_at(bits, (h.bitwiseAND(F.lit(CELLS - 1)) + 1).cast("int"))
        held = F.getbit(cell, F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.when(held, F.struct(i.alias("pos"), h.alias("hash")))

    # The words stay a column of their own, for a lambda would split the text at every word.
    split = docs.select("id", words_of(F.col("text")).alias("words"))
    return split.select("id", F.inline(F.array_compact(F.transform(shingle_hashes(F.col("words"), size), told))))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    size: int = SHINGLE,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that it holds: similarity, bit distance and first word of the best window.

    Null and empty texts, and items or documents of fewer than ``size`` words, match nothing
    (so short an item can't be told from a common phrase). Rows with the same id count as one
    document, items with the same text are all reported, other columns are not read, and an
    empty table on either side gives an empty result.
    """
    prepared = benchmark.select(F.col(item_col).alias("item_id"), F.filter(words_of(F.col(item_text_col)), lambda w: w != "").alias("words"))
    prepared = prepared.select("item_id", F.size("words").alias("size"), shingle_hashes(F.col("words"), size).alias("hashes")).where(F.size("hashes") > 0)
    items = written(with_simhash(prepared, "hashes").withColumn("shingles", weighted(F.col("hashes"))), "items")

    # Where an item of a size would begin, given a shingle of it.
    anchors = written(items.select("size", F.posexplode("hashes").alias("at", "hash")).distinct(), "anchors")
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    begins = written(
        shared_shingles(named, items, size).join(anchors, "hash").select("id", "size", (F.col("pos") - F.col("at")).alias("begin")).distinct(), "begins"
    )
    by_document = begins.groupBy("id").agg(F.collect_list(F.struct("size", "begin")).alias("begins")).withColumnRenamed("id", "of")
    begin = F.greatest(F.lit(0), F.least(F.col("begin"), F.size("words") - F.col("size")))
    hits = written(
        named.join(by_document, F.col("id").eqNullSafe(F.col("of")))
        .select("id", words_of(F.col("text")).alias("words"), "begins")
        .select("id", "words", F.inline("begins"))
        .select("id", "size", begin.alias("first_word"), F.concat_ws(" ", F.slice("words", begin + 1, F.col("size"))).alias("window"))
        .distinct(),
        "windows",
    )
    distinct = hits.select("size", "window").distinct().withColumn("hashes", shingle_hashes(F.split("window", " "), size))
    windows = written(
        with_simhash(distinct.where(F.size("hashes") > 0), "hashes").withColumn("shingles", weighted(F.col("hashes"))).drop("hashes"), "prints"
    )

    fps = windows.select("size", "fp").distinct()
    looked_up = fps.select("size", "fp", F.explode(blocks("fp")).alias("b")).select("size", "fp", "b.block", "b.value")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    close = (
        looked_up.join(near_blocks(items.select("size", "fp").distinct(), radius), ["size", "block", "value"])
        .where(distance <= radius)
        .select("size", "fp", "item_fp", distance.cast("int").alias("distance"))
        .distinct()
    )
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    sides = windows.join(close, ["size", "fp"]).join(
        items.select("size", F.col("fp").alias("item_fp"), "item_id", F.col("shingles").alias("item_shingles")), ["size", "item_fp"]
    )
    verified = written(
        sides.select("size", "window", "item_id", "distance", (shared / (F.size("shingles") + F.size("item_shingles") - shared)).alias("similarity"))
        .where(F.col("similarity") >= similarity),
        "verified",
    )
    best = F.max(F.struct("similarity", -F.col("first_word"), -F.col("distance"))).alias("b")
    return (
        hits.join(verified, ["size", "window"])
        .groupBy("id", "item_id")
        .agg(best)
        .select(
            F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("b.similarity").alias("similarity"),
            (-F.col("b.col3")).alias("distance"), (-F.col("b.col2")).alias("first_word"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item of the benchmark, with or without id.

    Of rows that share an id each is judged by its own text. Nulls and empty tables are as in
    ``contaminated``; all columns stay as they are.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("__key"), text_col)
    leaks = contaminated(keyed, benchmark, id_col="__key", text_col=text_col).select(F.col("__key").alias("__of")).distinct()
    return docs.join(leaks, row_key(id_col, text_col) == F.col("__of"), "left_anti")
