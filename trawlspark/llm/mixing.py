"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies wanted of each document. Whole copies
are certain; for the rest r, documents are ranked by the Pareto ratio of random odds u / (1 - u) to
inclusion odds r / (1 - r), and the smallest are taken until the words add up to what the source still
needs. The document at the border gives only the words that are missing, so a source's words are its
target up to rounding. With a `tilt` column, documents of one source differ in r (unequal odds).

The cut is found without sorting a source: ratios fall into BINS bins (counted with map-side sums),
cumulative sums over bins give the bin of the border, and only documents of that bin are ordered. A
source with a third of all rows is thus one row for each bin. Texts are read once, for their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlspark.llm.stage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BINS = 1 << 16
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """sources (source, ...) with `weight`: weights in turn by code point order of source, null last.

    The place is the row's place in its range partition plus the rows of earlier partitions; only one
    count for each partition reaches the driver.
    """
    spread = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(
        F.col("source").isNull(), "source"
    )
    at = F.monotonically_increasing_id()
    placed = written(spread.select("*", F.shiftright(at, 33).alias("__p"), at.bitwiseAND((1 << 33) - 1).alias("__i")), "sources")
    before, offsets = 0, []
    for r in placed.groupBy("__p").count().orderBy("__p").collect():
        offsets += [F.lit(r["__p"]), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*offsets), F.col("__p")) if offsets else F.lit(0)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((start + F.col("__i")) % len(weights)).cast("int"))
    return placed.select("*", weight.alias("weight")).drop("__p", "__i")


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES
) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources share `share` times the sum of all sizes by weight; none gets more than `most` times its
    own size, and what it cannot take goes to the others by weight, again until none is above. Each
    round is one small aggregate over the sources; a source that reaches its bound stays there.
    """
    if share > most:
        raise ValueError("share must not exceed most: the sources could not take it")
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    table = ranked(totals, weights)
    bound = most * F.col("source_size")
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = -1.0, F.lit(False)
    while True:
        free, taken = table.agg(
            F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, bound))
        ).first()
        new = (wanted - (taken or 0)) / free if free else level
        if new <= level or not free:
            break
        level, capped = new, bound <= F.lit(new) * F.col("weight")
    target = F.when(bound <= F.lit(level) * F.col("weight"), bound).otherwise(F.lit(level) * F.col("weight"))
    return table.withColumn("target", target.cast("double"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: str = SEED,
    text: str = "text",
    tilt: str | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each document.

    copies: whole copies; taken: words of the mix, whole copies and the part of one more. Random
    numbers are the md5 of seed and doc_id, so reruns agree. Rows with the same doc_id tie and are
    ordered by size, then by their text's hash; equal rows are interchangeable. A null doc_id is the
    id `null`, a null source a source of its own (last), a null text has size 0. Documents of size 0
    take no words. tilt: a positive column by which the inclusion odds of the last copy are multiplied
    within a source (null: 1); the order changes, the words taken do not.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    sized = written(
        docs.select(
            "doc_id", "source", size_of(text).alias("size"), uniform.alias("__u"),
            F.xxhash64(text).alias("__x"),
            (F.coalesce(F.col(tilt).cast("double"), F.lit(1.0)) if tilt else F.lit(1.0)).alias("__t"),
        ),
        "sizes",
    )
    goal = written(targets(sized, weights, share), "targets").withColumn(
        "whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    )
    missing = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    rest = F.greatest(missing, F.lit(0)) / F.greatest("source_size", F.lit(1))
    goal = goal.select(
        F.col("source").alias("s"), "source_size", "target", "whole",
        F.greatest(missing, F.lit(0)).alias("__need"), F.least(rest, F.lit(1 - 1e-9)).alias("__r"),
    )
    odds = F.col("__r") / (1 - F.col("__r")) * F.greatest("__t", F.lit(1e-12))
    # ratio / (1 + ratio): the same order, between 0 and 1
    ratio = F.col("__u") / (F.col("__u") + (1 - F.col("__u")) * odds)
    joined = sized.join(goal, sized["source"].eqNullSafe(goal["s"])).drop("s")
    drawn = joined.withColumn("__q", ratio).withColumn("__bin", F.floor(F.col("__q") * BINS).cast("int"))
    drawn = written(drawn, "drawn")
    bins = drawn.where("__need > 0").groupBy("source", "__bin").agg(F.sum("size").alias("n"), F.max("__need").alias("need"))
    upto = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        bins.withColumn("upto", F.sum("n").over(upto))
        .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min("__bin").alias("__edge"), F.min(F.col("need") - F.col("upto") + F.col("n")).alias("__left"))
    )
    cut = drawn.join(edge, drawn["source"].eqNullSafe(edge["s"]), "left").drop("s")
    inner = F.col("__bin") == F.col("__edge")
    plain = cut.where(~F.coalesce(inner, F.lit(False))).withColumn(
        "__more", F.when(F.col("__bin") < F.col("__edge"), F.col("size")).otherwise(F.lit(0))
    )
    earlier = Window.partitionBy("source").orderBy("__q", "doc_id", "size", "__x")
    border = cut.where(inner).withColumn(
        "__before", F.sum("size").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    )
    border = border.withColumn(
        "__more", F.least("size", F.greatest(F.col("__left") - F.col("__before"), F.lit(0)))
    ).drop("__before")
    out = plain.unionByName(border)
    full = (F.col("__more") == F.col("size")) & (F.col("size") > 0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.when(full, 1).otherwise(0)).alias("copies"),
        (F.col("whole") * F.col("size") + F.col("__more")).cast("long").alias("taken"),
        "__x",
    )


def shares(docs: DataFrame, **options) -> DataFrame:
    """The mix without its inner columns."""
    return mix(docs, **options).drop("__x", "copies")


def materialise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs as the mix takes them: whole copies as repeated rows, the part of a further
    copy as a row with the first words that are taken. Documents of which nothing is taken are absent.

    Rows with equal doc_id and text are matched in any order: what they take is added up and dealt
    out again evenly.
    """
    took = mix(docs, text=text, **options).groupBy("doc_id", "__x").agg(
        F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count("*").alias("__n")
    )
    took = took.select(F.col("doc_id").alias("__id"), F.col("__x").alias("__y"), "__taken", "__size", "__n")
    rows = docs.withColumn("__x", F.xxhash64(text))
    found = rows.join(took, rows["doc_id"].eqNullSafe(took["__id"]) & (F.col("__x") == F.col("__y")))
    copies = F.col("__taken") / F.col("__n")
    whole = F.floor(copies / F.greatest("__size", F.lit(1))).cast("int")
    part = F.round(copies).cast("long") - whole * F.col("__size")
    found = found.withColumn("__whole", whole).withColumn("__part", part)
    kept = F.when(F.col("__part") > 0, F.col("__whole") + 1).otherwise(F.col("__whole"))
    each = found.withColumn("__k", F.explode(F.sequence(F.lit(1), F.greatest(kept, F.lit(1))))).where(kept > 0)
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("__part").cast("int")), "")
    cut = F.when(F.col("__k") <= F.col("__whole"), F.col(text)).otherwise(head)
    return each.withColumn(text, cut).select(docs.columns)
