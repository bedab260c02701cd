"""Chat formatting in budgeted windows, with DataFrame functions alone.

A formatted window is `<s>`, then turns, then `</s>`; a turn is `[TURN role]text[/TURN]`, and one that an earlier window
has already had (the system turn, or history) is `[CTX role]text[/TURN]`. In texts and roles & [ ] < > are written as
entities, so a control string can't come from a text, and reading back is exact. The loss mask of a window is a list of
(start, length) in code points over its new assistant turns: repeated targets are masked out.

A turn's tokens are counted as the bytes of its formatted form, which no byte-level vocabulary passes, so a window holds to
its budget under each of them; exact counts may be given as a column. Prefix sums of turn tokens over each conversation (one window function over the rows, sorted by turn) choose the
spans: a window ends before the first turn that would pass the budget; the next one repeats the system turn and the
last turns before it as far as `history` tokens and `history_turns` turns allow. A turn larger than the budget has a
window to itself. The conversation's rows are gathered once, on its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTITIES = [("&", "&amp;"), ("[", "&lsq;"), ("]", "&rsq;"), ("<", "&lt;"), (">", "&gt;")]
ENDS = len("<s></s>")
TURN = r"\[(TURN|CTX) ([^\]]*)\]([^\[]*)\[/TURN\]"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def format_windows(conversations: DataFrame, budget: int = 2048, history: int = 384, history_turns: int = 3, tokens: Column | None = None) -> DataFrame:
    """Returns a row for each window: conv_id, window (from 0), formatted, loss (array of start, length), n_new, n_repeated.

    tokens: a column with the tokens of a row's formatted turn, if they are known. Rows are taken by turn, ties by role and text; repeated rows are turns of their own. Null texts and roles are
    empty. A null conv_id is a conversation. A system turn counts as such where it comes first. An empty
    table gives no rows; a conversation that is its system turn alone gives one window. Very long texts are turns like others, in a
    window of their own where they pass the budget; a conversation is put together in one row."""
    size = F.octet_length(escape(F.col("role"))) + F.octet_length(escape(F.col("text"))) + len("[TURN ][/TURN]")
    given = F.lit(None) if tokens is None else tokens
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), given.cast("long").alias("given"))
    size = F.coalesce("given", size.cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("tok", size).withColumn("sys", (F.col("i") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("cum", F.sum(F.when(F.col("sys"), F.lit(0)).otherwise(F.col("tok"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.struct("i", "cum", "tok", "sys", F.col("role").alias("who"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    conv = conv.withColumn("body", F.filter("turns", lambda x: ~x["sys"])).withColumn("head", F.filter("turns", lambda x: x["sys"]))
    conv = conv.withColumn("room", F.lit(budget - ENDS).cast("long") - F.coalesce(F.get("head", F.lit(0))["tok"], F.lit(0)))

    def before(x: Column) -> Column:
        return x["cum"] - x["tok"]

    def opened(acc: Column, x: Column) -> Column:
        """The state after a window begins at turn x, with as much history as fits."""
        at = x["i"] - F.size("head")  # from 1 in body
        near = F.slice("body", F.greatest(F.lit(1), at - history_turns), F.least(at - 1, F.lit(history_turns)))
        fits = F.filter(near, lambda y: (before(x) - before(y) <= history) & (x["cum"] - before(y) <= F.col("room")))
        base = F.when(F.size(fits) > 0, before(F.get(fits, F.lit(0)))).otherwise(before(x))
        return F.struct(F.concat(acc["w"], F.array(F.struct(at.cast("int").alias("s"), F.size(fits).cast("int").alias("h")))).alias("w"), base.cast("long").alias("base"))

    start = F.struct(F.array().cast("array<struct<s:int,h:int>>").alias("w"), F.lit(0).cast("long").alias("base"))
    step = lambda acc, x: F.when((F.size(acc["w"]) == 0) | (x["cum"] - acc["base"] > F.col("room")), opened(acc, x)).otherwise(acc)
    conv = conv.withColumn("w", F.aggregate("body", start, step, lambda acc: acc["w"]))
    conv = conv.withColumn("w", F.when(F.size("w") == 0, F.array(F.struct(F.lit(1).alias("s"), F.lit(0).alias("h")))).otherwise(F.col("w")))

    piece = lambda kind: lambda x: F.struct(F.concat(kind, x["role"], F.lit("]")).alias("open"), x["text"].alias("text"), ((x["who"] == "assistant") & (kind == "[TURN ")).alias("target"))
    ctx, new = F.lit("[CTX "), F.lit("[TURN ")

    def window(at: Column, k: Column) -> Column:
        """The k-th window's number and pieces."""
        stop = F.coalesce(F.get("w", k + 1)["s"], F.size("body") + 1)
        pieces = F.concat(F.transform("head", piece(F.when(k == 0, new).otherwise(ctx))), F.transform(F.slice("body", at["s"] - at["h"], at["h"]), piece(ctx)), F.transform(F.slice("body", at["s"], stop - at["s"]), piece(new)))
        return F.struct(k.alias("window"), pieces.alias("pieces"))

    out = conv.select("conv_id", F.explode(F.transform("w", window)).alias("x")).select("conv_id", "x.window", "x.pieces")
    close = len("[/TURN]")
    begin = F.struct(F.lit(len("<s>")).cast("int").alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def placed(acc: Column, x: Column) -> Column:
        at, n = acc["pos"] + F.char_length(x["open"]), F.char_length(x["text"])
        span = F.array(F.struct(at.cast("int").alias("start"), n.cast("int").alias("length")))
        return F.struct((at + n + close).cast("int").alias("pos"), F.when(x["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda x: F.concat(x["open"], x["text"], F.lit("[/TURN]"))), ""), F.lit("</s>"))
    repeated = F.size(F.filter("pieces", lambda x: x["open"].startswith("[CTX ")))
    return out.select("conv_id", "window", text.alias("formatted"), F.aggregate("pieces", begin, placed, lambda acc: acc["spans"]).alias("loss"), (F.size("pieces") - repeated).alias("n_new"), repeated.alias("n_repeated"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted texts and masks alone."""
    parts = F.arrays_zip(*(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(g)).alias(n) for g, n in ((1, "kind"), (2, "role"), (3, "text"))))
    turns = F.transform(F.filter(parts, lambda x: x["kind"] == "TURN"), lambda x: F.concat(unescape(x["role"]), F.lit("\n"), unescape(x["text"]), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = windows.select("conv_id", "window", turns.alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("formatted").alias("chars"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    every, masked = F.flatten(F.col("w.turns")), F.array_join(F.col("w.loss"), "")
    return conv.select("conv_id", F.size(every).cast("long").alias("n_turns"), F.sha2(F.array_join(every, ""), 256).alias("turns_sha256"), F.char_length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars")
