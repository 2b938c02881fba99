"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import free_name, keyed
from skyledger.session import stage

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_SHARD = 1000
SHARDS_PER_GROUP = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, text: Column, seed: int) -> Column:
    """A reproducible shuffle key of a row's id and text, the same in any engine that has md5."""
    digits = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), digits, F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source its size and target: ``share`` of all sizes by weight, at most ``cap`` x its size.

    ``sizes`` is (source, source_size), one row a source. Weights repeat over the sources by code
    point, null last. What a cap cuts off is shared again by weight among the others. In the order of
    size by weight the capped sources come first, so the level at which the others settle follows from
    running sums: the first source that its own prefix's level doesn't reach, and all after it, get
    weight x level. Windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    ranked = sizes.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = [F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")]
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    settled = F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))
    return (
        ranked.withColumn("level", level)
        .withColumn("settled", F.max(settled).over(whole))
        .withColumn(
            "target", F.least(F.col("most"), F.coalesce(F.col("settled") * F.col("w"), F.col("most")))
        )
        .select("source", "source_size", "target")
    )


def apportion(parts: DataFrame, by: list[str], weight: str, seats: str, most: str | None = None) -> DataFrame:
    """``parts`` with the integer column ``quota``: ``seats`` of each group ``by``, by Sainte-Laguë.

    The seats of a group go one by one to the highest quotient weight / (2 s + 1), s being what the
    part already has; ties go to the smaller ``part``. A part with as many seats as ``most`` takes part
    no longer. Seats are not handed out one at a time: at the divisor total / seats a part gets weight /
    divisor, rounded, and a group of n parts is then off by at most n / 2 seats, of which a part can
    lose or gain its share. Only the quotients within that reach of the rounded value are ranked, about
    8 n in all. ``most`` must be at least what a divisor of total / seats allows, rounded down: then it
    moves less than one seat a part, which the reach covers as well.
    """
    group = Window.partitionBy(*by)
    w, n = F.col(weight).cast("double"), F.count(F.lit(1)).over(group)
    total = F.sum(w).over(group)
    limit = F.col(most) if most else F.lit((1 << 62))
    sized = (
        parts.withColumn("_n", n)
        .withColumn("_total", total)
        .withColumn(
            "_near",
            F.when(F.col("_total") > 0, F.floor(w * F.col(seats) / F.col("_total") + 0.5)).otherwise(0),
        )
        .withColumn(
            "_reach",
            F.when(F.col("_total") > 0, F.ceil(w / F.col("_total") * F.col("_n") * 2) + 2).otherwise(0),
        )
        .withColumn("_low", F.greatest(F.lit(0), F.least(F.col("_near"), limit) - F.col("_reach")))
        .withColumn("_high", F.least(F.col("_near") + F.col("_reach"), limit - 1))
        .withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    )
    quotients = (
        sized.where((w > 0) & (F.col("_low") <= F.col("_high")))
        .select(*by, "part", "_left", w.alias("_w"), F.explode(F.sequence("_low", "_high")).alias("_s"))
        .withColumn("_q", F.col("_w") / (2 * F.col("_s") + 1))
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_q"), "part", "_s"))
    won = (
        quotients.withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(*by, "part")
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "part"]]
    out = sized.alias("a").join(won.alias("b"), same, "left")
    return out.select(
        *[F.col(f"a.{c}") for c in parts.columns],
        (F.col("a._low") + F.coalesce(F.col("b._won"), F.lit(0))).cast("long").alias("quota"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block: int = 8,
    seed: int = 42,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, its shard and its source.

    The mix is made of blocks of ``block`` words. Sources get their blocks by Sainte-Laguë from their
    targets; the shards of a source, one for about 1,000 of its documents, get theirs by Sainte-Laguë
    from their sizes, in two steps: groups of 1,024 shards first, then the shards of a group. So every
    shard has an integer quota, of no more blocks than ``cap`` x its size asks for, and no window ranks
    more than the shards of a group or the groups of a source. In a shard the documents lie end to end in
    a seeded order of id and text; the quota is taken block by block from the front, and once more from
    the front when the shard is used up, which the cap limits to ``cap`` passes. A source is within one
    block of its target, and one block for each shard that its cap cuts in the middle of a block.

    Null or empty texts have size 0 and are taken 0 times; they need no shard and have the number -1. A
    repeated or null doc_id is a document a row. Rows that are equal in id and text are interchangeable:
    more of them than a shard holds are dealt over shards by row.
    """
    return _mix(docs, F.monotonically_increasing_id(), weights, share, cap, block, seed).drop("row")


def _mix(docs: DataFrame, row: Column, weights=(5, 2, 1), share=1.5, cap=2, block=8, seed=42) -> DataFrame:
    """The columns of ``mix`` and the row key."""
    rows = stage(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            seeded(F.col("doc_id"), F.col("text"), seed).alias("order"), row.alias("row"),
        ),
        "mix-sizes",
    )
    has_words = F.col("size") > 0
    copies = stage(
        rows.where(has_words).groupBy("order").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > ROWS_PER_SHARD)
        .select("order", F.ceil(F.col("n") / ROWS_PER_SHARD).alias("k")),
        "mix-copies",
    )
    spread = _deal(rows.where(has_words), copies)
    counts = stage(
        rows.groupBy("source").agg(
            F.sum("size").alias("source_size"),
            F.greatest(F.lit(1), F.ceil(F.count_if(has_words) / ROWS_PER_SHARD)).cast("long").alias("shards"),
        ),
        "mix-sources",
    )
    number = F.conv(F.left("o.order", F.lit(8)), 16, 10).cast("long")
    placed = stage(
        spread.alias("o").join(counts.alias("c"), F.col("o.source").eqNullSafe(F.col("c.source"))).select(
            "o.doc_id", "o.source", "o.size", "o.order", "o.row", F.pmod(number, F.col("c.shards")).alias("part")
        ),
        "mix-placed",
    )
    wanted = targets(counts.select("source", "source_size"), weights, share, cap)
    total = Window.partitionBy(F.lit(0))
    blocks = F.floor(F.sum("target").over(total) / block + 0.5).cast("long")
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    sources = apportion(
        wanted.withColumn("part", F.row_number().over(by_name)).withColumn("seats", blocks)
        .withColumn("one", F.lit(1)),
        ["one"], "target", "seats",
    )
    sources = stage(sources.select("source", "source_size", "target", F.col("quota").alias("seats")), "mix-targets")

    room = F.ceil(F.lit(cap) * F.col("shard_size") / block)
    shards = stage(
        placed.groupBy("source", "part")
        .agg(F.sum("size").alias("shard_size"))
        .withColumn("room", room)
        .withColumn("group", F.floor(F.col("part") / SHARDS_PER_GROUP)),
        "mix-shards",
    )
    groups = shards.groupBy("source", F.col("group").alias("part")).agg(
        F.sum("shard_size").alias("group_size"), F.sum("room").alias("room")
    )
    asked = groups.alias("h").join(sources.alias("s"), F.col("s.source").eqNullSafe(F.col("h.source"))).select(
        "h.source", "h.part", "h.group_size", "h.room", "s.seats"
    )
    first = apportion(asked, ["source"], "group_size", "seats", "room").select(
        "source", F.col("part").alias("group"), F.col("quota").alias("seats")
    )
    within = shards.alias("h").join(
        first.alias("s"),
        F.col("s.source").eqNullSafe(F.col("h.source")) & (F.col("s.group") == F.col("h.group")),
    ).select("h.source", "h.group", "h.part", "h.shard_size", "h.room", "s.seats")
    quotas = stage(apportion(within, ["source", "group"], "shard_size", "seats", "room"), "mix-quotas").withColumn(
        "words", F.least(F.col("quota") * block, F.lit(cap) * F.col("shard_size"))
    )
    full = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    ahead = (
        Window.partitionBy("d.source", "d.part")
        .orderBy("d.order", "d.doc_id", "d.size", "d.row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = (
        placed.alias("d")
        .join(
            quotas.withColumn("passes", full).alias("q"),
            F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.part") == F.col("q.part")),
        )
        .withColumn("at", F.coalesce(F.sum("d.size").over(ahead), F.lit(0)))
    )
    rest = F.col("q.words") - F.col("q.passes") * F.col("q.shard_size")
    front = F.greatest(F.lit(0), F.least(F.col("d.size"), rest - F.col("at")))
    taken = laid.select(
        "d.doc_id", "d.size", (F.col("q.passes") * F.col("d.size") + front).cast("long").alias("taken"),
        F.col("d.part").alias("shard"), F.col("d.source").alias("source"), "d.row",
    )
    nothing = rows.where(~has_words).select(
        "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(-1).cast("long").alias("shard"), "source", "row"
    )
    every = taken.unionByName(nothing).alias("t")
    return every.join(sources.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select(
        "t.doc_id", "t.size", "s.source_size", "s.target", "t.taken", "t.shard", "t.source", "t.row"
    )


def _deal(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` with a new place for the rows of ``copies`` (order, k): the i-th of equal rows goes to part
    i mod k of its class, so that the parts are the same whatever the order of the rows.

    Rows are numbered within the tasks that numbered them first, behind those of the tasks before: no
    window holds a class.
    """
    task = F.shiftright("row", 33)  # the upper bits of a monotonic id
    many = rows.join(copies, "order").withColumn("task", task)
    begins = many.groupBy("order", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("order").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("order", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("order", "task").orderBy("row"))
    numbered = many.withColumn("at", within).join(begins, ["order", "task"])
    part = F.pmod(F.col("begin") + F.col("at"), F.col("k")).cast("string")
    dealt = numbered.withColumn("order", F.md5(F.concat_ws(":", "order", part))).select(*rows.columns)
    return rows.join(copies.select("order"), "order", "left_anti").select(*rows.columns).unionByName(dealt)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: whole copies, then a part where the quota ends.

    A document taken k times its size comes k times; what is left over keeps its first words and the
    white space between them. ``n_chars``, where there is such a column, follows the new text.
    Documents of which nothing is taken go. Shares come back by the row key of a staged copy, so rows
    with a null or repeated doc_id each keep their own words.
    """
    rows, row = keyed(docs, "mix-rows")
    size_name, taken_name = (free_name(rows, f"__mix_{c}") for c in ("size", "taken"))
    size, taken = F.col(size_name), F.col(taken_name)
    shares = _mix(rows, F.col(row), **options).where("taken > 0").select(
        F.col("row").alias(row), F.col("size").alias(size_name), F.col("taken").alias(taken_name)
    )
    rest = F.pmod(taken, size).cast("int")
    spaced = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(spaced, F.lit(1), F.greatest(rest, F.lit(1))), "")
    copies = F.concat(
        F.array_repeat(F.col("text"), F.floor(taken / size).cast("int")),
        F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")),
    )
    out = rows.join(shares, row).withColumn("text", F.explode(copies))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
