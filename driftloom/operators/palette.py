"""The command palette's fuzzy search: the best titles for many queries at once, in the JVM alone.

A title matches where the query's letters stand in it one after the other (spaces of the query don't count): a letter gives 1, 2 more right
behind the one before, 3 more at a word's start; a hundredth for each letter of the title goes. Matching takes the next occurrence each time.

Titles meet a query by its rarest letter, an equi-join; a mask of letters rules out titles that lack another. Then the score's bound,
from letters, word starts and length, decides what is scored: first the `top` highest bounds, whose scores give a threshold, then all that can reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise


#: Fixed value: how many parts each letter's titles are dealt out to.
PARTS = 16


def letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: (c != "") & (c != " "))


def mask(chars: Column) -> Column:
    """A bit for each letter, by its code modulo 64."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(bit(c)))


def score(chars: Column, title: Column) -> Column:
    """Score of the letters in a lower-cased title, null where they don't match."""
    none = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("sum"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        at = F.call_function("locate", c, title, acc["at"] + 2) - 1
        start = (at == 0) | F.call_function("substring", title, at, F.lit(1)).rlike("[^a-z0-9]")
        gain = F.lit(1) + F.when((at == acc["at"] + 1) & (acc["at"] >= 0), 2).otherwise(0) + F.when(start, 3).otherwise(0)
        ok = acc["ok"] & (at >= 0)
        return F.struct(F.when(ok, at).otherwise(acc["at"]).alias("at"), F.when(ok, acc["sum"] + gain).otherwise(acc["sum"]).alias("sum"), ok.alias("ok"))

    return F.aggregate(chars, none, step, lambda acc: F.when(acc["ok"], acc["sum"] - F.char_length(title) / 100))


def best_titles(queries: DataFrame, titles: DataFrame, top: int = 50) -> DataFrame:
    """query, id, score, place: the `top` best titles (id, title) of each distinct query, equal scores by title, then id. Null and empty queries, and
    queries of spaces alone, give no rows; null titles match nothing."""
    asked = queries.select("query").distinct().select("query", letters(F.col("query")).alias("chars")).filter(F.size("chars") > 0)
    texts = titles.filter("title IS NOT NULL").select("id", "title", F.lower("title").alias("low"))
    texts = texts.withColumns({"mask": mask(letters(F.col("title"))), "starts": F.size(F.regexp_extract_all("low", F.lit(r"(?:^|[^a-z0-9])."), F.lit(0)))})
    held = texts.select("id", F.explode(F.array_distinct(letters(F.col("title")))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.select("query", "chars", F.explode("chars").alias("c")).join(held, "c", "left").groupBy("query", "chars").agg(F.min_by("c", F.struct(F.coalesce("df", F.lit(0)), "c")).alias("c"))
    posted = texts.withColumn("c", F.explode(F.array_distinct(letters(F.col("title")))))
    n = F.size("chars")
    # a word's start gives 3 more, a neighbour 2; both together only behind a sign that is itself asked for
    signs = F.size(F.filter("chars", lambda c: c.rlike("[^a-z0-9]")))
    starts = F.least(n, F.col("starts"))
    bound = n + 3 * starts + 2 * (n - starts) + 2 * F.least(signs + 0, starts) - F.char_length("low") / 100
    # postings are many more than Spark takes them for: a shuffled join, whose letters are dealt out
    asking = rarest.withColumn("need", mask(F.col("chars"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = asking.join(posted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).hint("merge"), ["c", "part"]).filter(F.col("need").bitwiseAND(F.bitwise_not("mask")) == 0)
    met = materialise(met.select("query", "chars", "id", "title", "low", bound.alias("bound")), "titles")
    by = Window.partitionBy("query")
    order = lambda s: by.orderBy(F.desc(s), "title", "id")
    first = met.withColumn("k", F.row_number().over(order("bound"))).filter(F.col("k") <= top).withColumn("score", score(F.col("chars"), F.col("low")))
    least = first.filter("score IS NOT NULL").groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= top).select("query", "least")
    rest = met.join(least, "query", "left").filter("least IS NULL OR bound >= least - 1e-9").withColumn("score", score(F.col("chars"), F.col("low"))).filter("score IS NOT NULL")
    return rest.withColumn("place", F.row_number().over(order("score"))).filter(F.col("place") <= top).select("query", "id", "score", "place")
