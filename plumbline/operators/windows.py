"""Context around a chunk, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between two parts of a context.
GAP = "\n\n"


def spans(chunks: DataFrame, targets: DataFrame, radius: int, most: int) -> DataFrame:
    """``target_id, document_id, place, low, high``: which places of its document the context of each target covers.

    Each round takes the next chunk on the left, then on the right, within ``radius`` indexes and as long as all fits into
    ``most`` characters; a side ends at its first chunk that doesn't fit. Chunks of one index are told apart by their ids.
    A frame of a document's rows carries lengths alone, so no chunk meets another by a join.
    """
    asked = targets.select(F.col("id").alias("target_id")).distinct()
    sized = chunks.select("id", "document_id", "chunk_index", F.char_length("content").alias("length"))
    documents = sized.join(asked, sized.id == asked.target_id, "left_semi").select("document_id").distinct()
    sized = sized.join(documents, "document_id", "left_semi")
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    sized = sized.withColumn("place", F.row_number().over(order))
    index = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(-radius, radius)
    near = sized.withColumn("near", F.array_sort(F.collect_list(F.struct("place", "length")).over(index)))
    return near.join(asked, near.id == asked.target_id).select("target_id", "document_id", "place", *_reach(F.col("place"), F.col("near"), most))


def _reach(place: Column, near: Column, most: int) -> tuple[Column, Column]:
    """The first and last place of a context, decided on the array of places and lengths around the target."""
    at = F.array_position(near["place"], place).cast("int")
    length = lambda i: F.element_at(near["length"], i)
    start = F.struct(length(at).alias("used"), at.alias("low"), at.alias("high"), F.lit(True).alias("left"), F.lit(True).alias("right"))

    def side(s: Column, next_: Column, open_: str) -> tuple[Column, Column]:
        inside = s[open_] & (next_ >= 1) & (next_ <= F.size(near))
        # An index outside would be an error, so the length is looked up only inside.
        used = F.when(inside, s["used"] + len(GAP) + length(F.greatest(F.lit(1), F.least(next_, F.size(near)))))
        return F.coalesce(used <= most, F.lit(False)), used

    def step(s: Column, _: Column) -> Column:
        left, used = side(s, s["low"] - 1, "left")
        s = F.struct(F.when(left, used).otherwise(s["used"]).alias("used"), (s["low"] - left.cast("int")).alias("low"), s["high"].alias("high"), left.alias("left"), s["right"].alias("right"))
        right, used = side(s, s["high"] + 1, "right")
        return F.struct(F.when(right, used).otherwise(s["used"]).alias("used"), s["low"].alias("low"), (s["high"] + right.cast("int")).alias("high"), s["left"].alias("left"), right.alias("right"))

    # A target that fills the budget stands alone.
    rounds = F.when(length(at) < most, F.size(near)).otherwise(F.lit(0))
    found = F.aggregate(F.slice(F.sequence(F.lit(0), F.size(near)), 2, rounds), start, step)
    first = F.element_at(near["place"], at) - at
    return (first + found["low"]).alias("low"), (first + found["high"]).alias("high")


def chunk_windows(chunks: DataFrame, targets: DataFrame, radius: int = 1, most: int = 2000) -> DataFrame:
    """``target_id, context`` of each target (id) that is a chunk: the texts that ``spans`` finds, a target alone cut to ``most`` characters.

    chunks: ``id, document_id, chunk_index, content``. Texts are fetched by document and place; a null text is empty.
    """
    chunks = chunks.withColumn("content", F.coalesce("content", F.lit("")))
    wanted = spans(chunks, targets, radius, most).select("target_id", "document_id", F.explode(F.sequence("low", "high")).alias("place"))
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    texts = chunks.withColumn("place", F.row_number().over(order)).select("document_id", "place", "content")
    parts = wanted.join(texts, ["document_id", "place"]).groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("p"))
    text = F.array_join(F.col("p.content"), GAP)
    return parts.select("target_id", F.when(F.size("p") == 1, F.left(text, F.lit(most))).otherwise(text).alias("context"))
