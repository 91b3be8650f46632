"""Page text from positioned words: lines by a sweep over gaps, the left half of a page before the right one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words whose tops are no further apart than this, one after another, are one line; so far apart across, they are parted by a space.
LINE_GAP, WORD_GAP = 3.0, 3.0


def page_texts(words: DataFrame, line_gap: float = LINE_GAP, word_gap: float = WORD_GAP) -> DataFrame:
    """doc, page, text of words(doc, page, width, x0, x1, top, text).

    A word lies in the half that holds its middle. In a half, words are swept from the top; where the next one lies more than line_gap
    lower a line begins. A line is read by x0; words closer than word_gap are joined. The halves' texts are parted by a line break, also
    where one is empty. All windows are within a page. Words without text or place don't count.
    """
    known = words.filter("text is not null and text != '' and x0 is not null and x1 is not null and top is not null and width is not null")
    halved = known.withColumn("half", F.when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, 0).otherwise(1))
    down = Window.partitionBy("doc", "page", "half").orderBy("top", "x0", "x1", "text")
    begins = (F.col("top") - F.lag("top").over(down) > line_gap).cast("int")
    lined = halved.withColumn("_begins", F.coalesce(begins, F.lit(0))).withColumn("line", F.sum("_begins").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    across = Window.partitionBy("doc", "page", "half", "line").orderBy("x0", "x1", "top", "text")
    place = F.row_number().over(across)
    glue = F.when((place > 1) & (F.col("x0") - F.lag("x1").over(across) > word_gap), " ").otherwise("")
    parts = lined.select("doc", "page", "half", "line", place.alias("place"), F.concat(glue, "text").alias("part"))
    text_of = lambda c, field: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[field])
    lines = parts.groupBy("doc", "page", "half", "line").agg(F.array_join(text_of(("place", "part"), "part"), "").alias("text"))
    halves = lines.groupBy("doc", "page", "half").agg(F.array_join(text_of(("line", "text"), "text"), "\n").alias("text"))
    side = lambda k: F.coalesce(F.max(F.when(F.col("half") == k, F.col("text"))), F.lit(""))
    return halves.groupBy("doc", "page").agg(F.concat(side(0), F.lit("\n"), side(1)).alias("text"))
