"""Pages by content: blocks of given heights fill pages in order, with collapsing spaces and paragraphs that keep with the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paginate(blocks: DataFrame, document: list[str], order: str, room: Column) -> DataFrame:
    """``page`` (from 1) of each block.

    ``blocks``: ``kind`` (paragraph, table or break), ``height`` without spaces, ``before, after`` (spaces), ``keep_next``,
    ``break_before``, ``style, contextual``; ``room`` is the height of a page. A break opens a page, as does a paragraph
    that breaks before unless it is on an empty page already. Between paragraphs the larger space counts; contextual
    ones of one style have none before them. A block goes to the next page if what is before it on its page and its
    height, without the space after it, don't fit; one that keeps with the next needs room for that, too. A block that is
    higher than a page stands alone.

    Explicit breaks start anew, so a document is cut there: each piece is one
    ordered array, folded by one state (page, height so far, last space), whose only list are the places at which
    pages begin; pages of the pieces before are added by a window.
    """
    along = Window.partitionBy(*document).orderBy(order)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    full = F.when(F.col("kind") == "paragraph", number("height") + number("before") + number("after")).when(F.col("kind") == "table", number("height")).otherwise(0.0)
    opens = (F.col("kind") == "break") | flag("break_before")
    seen = blocks.withColumns({"__next": F.when(flag("keep_next"), F.coalesce(F.lead(full).over(along), F.lit(0.0))).otherwise(0.0), "__piece": F.count_if(opens).over(along), "__room": room.cast("double")})
    item = F.struct(F.col(order).alias("ord"), "kind", number("height").alias("height"), number("before").alias("before"), number("after").alias("after"), F.col("__next").alias("next"), "style", flag("contextual").alias("contextual"))
    pieces = seen.groupBy(*document, "__piece").agg(F.array_sort(F.collect_list(item)).alias("__items"), F.first("__room").alias("__room"), F.max(F.col("kind") == "break").alias("__break"))
    kind = dict(seen.dtypes)
    start = F.struct(
        F.lit(0.0).alias("y"), F.lit(0.0).alias("after"), F.lit(None).cast(kind["style"]).alias("style"), F.lit(False).alias("para"), F.lit(0).alias("held"), F.array().cast(f"array<{kind[order]}>").alias("starts"),
    )

    def step(s: Column, b: Column) -> Column:
        para = b["kind"] == "paragraph"
        before = F.when(para & ~(s["para"] & b["contextual"] & s["style"].eqNullSafe(b["style"])), b["before"]).otherwise(0.0)
        y = s["y"] - F.when(para, F.least(s["after"], before)).otherwise(0.0)
        high = F.when(para, before + b["height"]).otherwise(b["height"])
        turn = (s["held"] > 0) & (y + high + F.when(para, b["next"]).otherwise(0.0) > F.col("__room")) & (F.when(para, y > 0).otherwise(True))
        after = F.when(para, b["after"]).otherwise(0.0)
        placed = F.struct(
            (F.when(turn, 0.0).otherwise(y) + high + after).alias("y"), after.alias("after"), F.when(para, b["style"]).alias("style"), para.alias("para"), (F.when(turn, 0).otherwise(s["held"]) + 1).alias("held"),
            F.when(turn, F.array_append(s["starts"], b["ord"])).otherwise(s["starts"]).alias("starts"),
        )
        return F.when(b["kind"] == "break", s).otherwise(placed)

    folded = pieces.withColumn("__starts", F.aggregate("__items", start, step)["starts"]).withColumn("__filled", F.exists("__items", lambda b: b["kind"] != "break"))
    along = Window.partitionBy(*document).orderBy("__piece")
    opened = F.when(F.col("__piece") == 0, 0).when(F.col("__break"), 1).when(F.coalesce(F.lag("__filled").over(along), F.lit(False)), 1).otherwise(0)
    turned = F.coalesce(F.sum(F.size("__starts")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = folded.withColumn("__opened", opened).withColumn("__before", F.sum("__opened").over(along) + turned)
    placed = numbered.select(*document, "__starts", "__before", F.explode(F.transform("__items", lambda b: b["ord"])).alias(order))
    page = (F.col("__before") + 1 + F.size(F.filter("__starts", lambda s: s <= F.col(order)))).cast("int")
    return blocks.join(placed.select(*document, order, page.alias("page")), [*document, order])
