"""Mix sources to target weights with weighted sampling without replacement (exponential keys), in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, text_or_empty

#: Hex digits of the md5 that make a document's uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(key: Column) -> Column:
    """A number in (0, 1) from a key, the same in every run."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text (n from 1) with the blanks before and between them; the whole text if it has fewer."""
    # The text is cut behind each word, without going on behind the last one that is wanted.
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (n + 1).cast("int"))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def text_quality(text: str = "text") -> Column:
    """A document's weight when none is given: the share of its code points that no symbol takes, 0.05 at least."""
    full = text_or_empty(text)
    symbols = F.length(full) - F.length(F.translate(full, "#$%&*|!<>{}[]=_~^\\", ""))
    return F.greatest(F.lit(0.05), 1.0 - symbols / F.greatest(F.length(full), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with the column target added.

    Sources in the order of their code points, null last, get the weights in turn and share ``share`` times all sizes by
    weight. No source gets over ``most`` times its size; what is over goes to the others by weight until none is above.
    That fixed point is a water level: with the sources sorted by cap over weight, the first so many are at their caps
    and the rest share what is left. There is a row per source, so the windows are small.
    """
    ordered = sizes.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ordered.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_n").asc())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    levels = weighted.withColumns({
        "_left": F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_open": F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    # A source is at its cap if the level with it still open would be above the cap.
    level = levels.withColumn("_level", F.col("_left") / F.col("_open")).withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    water = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_n").alias("n"), F.col("_level").alias("level")))).over(everything)["level"]
    return level.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(water * F.col("_w"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, buckets: int = 4096) -> DataFrame:
    """docs with size, source_size (long), target (double), copies, part and taken (long) added.

    ``copies`` is how often the mix takes the whole document, ``part`` how many first words it takes once more (0 if none),
    ``taken`` the words of both together. A source with target t and size s first takes floor(t / s) complete epochs. For
    the rest, documents are ordered by the exponential key -ln(u) / quality, u a hash of the id, and each is taken once
    more as far as the budget that the keys before it leave. The document at a source's edge is taken in part, so what a
    source takes is its target without the fraction of a word, however small it is and however long its documents are;
    reruns agree. ``first_words`` gives the text of a part.

    The prefix sums take two levels, so that no source lies in one task: the keys of a source go to ``buckets`` ranges
    about even in number of documents, the ranges are summed, and only a range's documents are sorted together.

    Null and empty texts have size 0, and so 0 copies and no part. Null sources are one source. Rows that share an id have
    the same key; ties go by the hash of the text, and repeats of one row are interchangeable. A null or non-positive
    quality counts as the smallest positive one used. An empty table gives an empty one. Other columns pass through;
    ValueError if one bears the name of an added column.
    """
    fresh(docs, "size", "source_size", "target", "copies", "part", "taken", "_key", "_bucket", "_tie", "_base", "_name", "_none")
    weight = F.greatest(F.lit(0.05), F.coalesce(quality if quality is not None else text_quality(text), F.lit(0.05)))
    keyed = docs.withColumns({"size": word_count(text), "_key": -F.log(uniform(F.col(doc_id))) / weight, "_tie": F.xxhash64(text_or_empty(text))})
    # Keys that are never null keep the join and the window on one exchange.
    keyed = keyed.withColumns({"_bucket": F.floor((1 - F.exp(-F.col("_key"))) * buckets), "_name": F.coalesce(F.col(source), F.lit("")), "_none": F.col(source).isNull()})
    placed = keyed.join(_ranges(keyed, weights, share, most), ["_name", "_none", "_bucket"])
    own = W.partitionBy("_name", "_none", "_bucket").orderBy("_key", "_tie").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("size").over(own), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target") - epochs * F.col("source_size")) - before
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    whole = (F.col("size") > 0) & (F.col("_more") == F.col("size"))
    out = placed.withColumns({"_epochs": F.when(F.col("size") > 0, epochs).otherwise(0).cast("long"), "_more": once_more}).withColumns({
        "copies": F.col("_epochs") + F.when(whole, 1).otherwise(0),
        "part": F.when(whole, 0).otherwise(F.col("_more")).cast("long"),
        "taken": F.col("_epochs") * F.col("size") + F.col("_more"),
    })
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "part", "taken")


def _ranges(keyed: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """For each source and range of keys: its place, the size of the ranges before it, the source's size and target."""
    name = F.when(~F.col("_none"), F.col("_name"))
    by_range = keyed.groupBy("_name", "_none", "_bucket").agg(F.sum("size").alias("_sum"))
    sizes = by_range.groupBy("_name", "_none").agg(F.sum("_sum").alias("source_size")).select(name.alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, most).select(F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"), "source_size", "target")
    before = W.partitionBy("_name", "_none").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = by_range.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return bases.join(targets, ["_name", "_none"])
