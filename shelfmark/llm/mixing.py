"""Mixing sources to target weights by thresholds on a hash of each document.

The words of every (source, hash bucket) are summed; the running sums of a source tell in
which bucket its budget ends, and only that bucket is split further. The hash thresholds
that result are a plain filter: no document is sorted, and budgets that grow only add
documents (their thresholds are nested).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut, stored

HASH_BITS = 60
LEVEL_BITS = 12
BROADCAST_SOURCES = 20_000  # rows of a source table that may be broadcast; counted before


def count_words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash(key: Column) -> Column:
    """60 evenly spread bits that depend on the key alone."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _join_sources(docs: DataFrame, sources: DataFrame, rows: int, on: list, how: str) -> DataFrame:
    """Join documents with a table of at most one row for each source.

    A counted small table is broadcast. A larger one is repeated under a few salts, so the
    rows of a large source spread over that many tasks.
    """
    if rows <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), on, how)
    salts = 32
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = docs.withColumn("_salt", F.pmod(F.col("_hash"), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def _weighted(sources: DataFrame, weights: list[int]) -> DataFrame:
    """Give each source its weight by its place in code point order, null last.

    The place is the row's number within its range partition plus the rows of the
    partitions before; only partition counts reach the driver.
    """
    ranged = cut(
        sources.withColumn("_null", F.col("_source").isNull())
        .repartitionByRange("_null", "_source")
        .withColumn("_part", F.spark_partition_id())
    )
    counts = sorted(ranged.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    order = Window.partitionBy("_part").orderBy("_null", "_source")
    place = F.row_number().over(order) - 1 + (shift[F.col("_part")] if before else F.lit(0))
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranged.withColumn("_weight", F.get(cycle, (place % len(weights)).cast("int"))).drop("_part", "_null")


def source_targets(
    sources: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, at_most: float = 2.0
) -> DataFrame:
    """(_source, source_size) with the words each source is to give, in column target.

    ``share`` times all words are shared by weight; no target exceeds ``at_most`` times its
    source, and what is cut off is shared again by weight until nothing is above. Each
    round is one sum over the sources; only the totals reach the driver.
    """
    table = cut(_weighted(sources, list(weights)))
    limit = F.col("source_size") * F.lit(float(at_most))
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    budget, unit, full = share * whole, 0.0, F.lit(False)
    while True:
        held, weight, n_full = table.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)),
            F.count(F.when(full, F.lit(1))),
        ).first()
        unit = (budget - held) / weight if weight else 0.0
        now_full = full | (F.lit(unit) * F.col("_weight") > limit)
        if table.filter(now_full).count() == n_full:
            return table.withColumn("target", F.when(full, limit).otherwise(F.lit(unit) * F.col("_weight")))
        full = F.lit(unit) * F.col("_weight") > limit


def _thresholds(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """The hash below which a source's documents are taken once more, in column _below.

    No other threshold on the hash brings the words below it nearer to the source's budget.
    """
    front = sources.select(
        F.col("_id"), F.col("_extra").alias("_room"), F.lit(0).cast("long").alias("_prefix")
    )
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = _join_sources(sized, front, n_sources, ["_id"], "inner")
        if level > 1:
            inside = inside.filter(F.shiftright("_hash", shift + LEVEL_BITS) == F.col("_prefix"))
        if level == 2:  # from here on only the documents of the boundary buckets are read
            inside = stored(inside, "mix-boundary")
            sized = inside.select(*sized.columns)
        buckets = inside.groupBy("_id", F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.sum("size").alias("_words"), F.first("_room").alias("_room")
        )
        up_to = Window.partitionBy("_id").orderBy("_bucket")
        running = buckets.withColumn("_sum", F.sum("_words").over(up_to))
        # The first bucket that no longer fits holds the end of the budget.
        edge = running.filter(F.col("_sum") > F.col("_room")).groupBy("_id").agg(
            F.min_by(F.struct("_bucket", "_words", "_sum", "_room"), "_bucket").alias("_edge")
        )
        left = F.col("_edge._room") - (F.col("_edge._sum") - F.col("_edge._words"))
        end = F.col("_edge._bucket")
        if shift == 0:  # one document, or equal keys: taken if that comes nearer to the budget
            end = end + (F.col("_edge._words") - left < left).cast("long")
        beyond = (F.col("_prefix") + 1) * F.lit(1 << LEVEL_BITS)  # a source that fits whole
        front = cut(
            front.join(edge, "_id", "left").select(
                "_id",
                F.coalesce(left, F.col("_room")).alias("_room"),
                F.coalesce(end, beyond).cast("long").alias("_prefix"),
            )
        )
    return front.select("_id", F.col("_prefix").alias("_below"))


def _source_id(source: Column) -> Column:
    return F.struct(source.isNull(), F.coalesce(source, F.lit("")))


def _mix_plan(
    sized: DataFrame, weights: tuple[int, ...], share: float, at_most: int
) -> tuple[DataFrame, int]:
    """A row per source: source_size, target, whole copies and threshold; and how many rows."""
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights=weights, share=share, at_most=float(at_most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = cut(
        targets.withColumn("_copies", whole.cast("long"))
        .withColumn("_extra", F.col("target") - F.col("_copies") * F.col("source_size"))
        .withColumn("_id", _source_id(F.col("_source")))
    )
    n_sources = sources.count()
    inside = sized.select(_source_id(F.col("_source")).alias("_id"), "size", "_hash")
    below = _thresholds(inside, sources, n_sources)
    return sources.select("_id", "source_size", "target", "_copies").join(below, "_id"), n_sources


def _mixed(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share: float, at_most: int) -> DataFrame:
    """(_row, size, source_size, target, copies): each row as a struct, and what is taken of it."""
    sized = stored(
        docs.select(
            F.col(source).alias("_source"), count_words(F.col(text)).alias("size"), document_hash(F.col(key)).alias("_hash")
        ),
        "mix-sizes",
    )
    plan, n_sources = _mix_plan(sized, weights, share, at_most)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        _source_id(F.col(source)).alias("_id"),
        count_words(F.col(text)).alias("size"),
        document_hash(F.col(key)).alias("_hash"),
    )
    joined = _join_sources(rows, plan, n_sources, ["_id"], "inner")
    copies = F.col("_copies") + (F.col("_hash") < F.col("_below")).cast("long")
    return joined.select("_row", "size", "source_size", "target", copies.alias("copies"))


def mix_sources(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    at_most: int = 2,
) -> DataFrame:
    """How many words the mix takes of every document.

    Returns key, size (words of the whole text, null: 0), source_size, target (words its
    source is to give) and taken: floor(target / source_size) whole copies of each document
    of the source, and one more of those whose hash lies below the source's threshold.
    What a source gives misses its target by at most half of one document (or one group of
    equal keys). A null source is a source; rows with equal keys are taken alike. An empty
    table gives no rows; a source without words has target 0. Other columns are ignored.
    """
    mixed = _mixed(docs.select(key, text, source), key, text, source, weights, share, at_most)
    return mixed.select(
        F.col(f"_row.`{key}`").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def take_mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    at_most: int = 2,
) -> DataFrame:
    """The rows that the mix takes, all columns, and copies, size, source_size, target, taken.

    A row that is taken twice comes once, with copies 2. Columns of the input with one of
    the added names give way to those.
    """
    added = ["copies", "size", "source_size", "target", "taken"]
    mixed = _mixed(docs, key, text, source, weights, share, at_most).withColumn("taken", F.col("size") * F.col("copies"))
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added]
    return mixed.filter(F.col("copies") > 0).select(*own, *added)
