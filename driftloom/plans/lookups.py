"""Queries of the posting index, the palette, JSON flattening, stream decoding and the snapshot source."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import variants
from ..operators import concepts, palette, postings
from ..sources import snapshots
from ..streaming import decoders, drafts
from .registry import query, read

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: Documents as files: a third is written again in capitals, a seventh goes.
FILES = """f AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 1),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f WHERE text IS NOT NULL),
w AS (SELECT path, line, unnest(regexp_extract_all(t, '""" + NAME + """')) AS word, generate_subscripts(regexp_extract_all(t, '""" + NAME + """'), 1) AS nth FROM l)"""


def indexed(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    loud = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return postings.Index(spark).update(docs).update(docs.filter("doc_id % 3 = 0").withColumn("text", loud)).delete(docs.filter("doc_id % 7 = 1"))


def asked_words(spark, sf):
    return read(spark, sf, "benchmark", "item_id", "text").select("item_id", F.regexp_extract_all("text", F.lit(postings.WORD), F.lit(0)).alias("words"))


@query(f"""WITH {FILES}, q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{NAME}')) AS word FROM benchmark)
SELECT word, count(DISTINCT path) AS files, count(*) AS total, min(path::BIGINT) AS first FROM w JOIN q USING (word) GROUP BY word""")
def s9_whole_words(spark, sf):
    """Occurrences of the benchmark's words in an index that was built, updated and deleted from; the SQL scans."""
    found = indexed(spark, sf).lookup(asked_words(spark, sf).select(F.explode("words").alias("word")))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("places")).cast("long").alias("total"), F.min(F.col("path").cast("long")).alias("first"))


@query(f"""WITH {FILES}, b AS (SELECT item_id, regexp_extract_all(text, '{NAME}') AS ws FROM benchmark), q AS (SELECT item_id AS phrase, ws[1:4] AS ws FROM b WHERE len(ws) >= 4)
SELECT phrase, w.path::BIGINT AS path, w.line, w.nth FROM q JOIN w ON w.word = ws[1] JOIN w x ON x.path = w.path AND x.line = w.line AND x.nth = w.nth + 1 AND x.word = ws[2]
JOIN w y ON y.path = w.path AND y.line = w.line AND y.nth = w.nth + 2 AND y.word = ws[3] JOIN w z ON z.path = w.path AND z.line = w.line AND z.nth = w.nth + 3 AND z.word = ws[4]""")
def s9_phrases(spark, sf):
    asked = asked_words(spark, sf).filter(F.size("words") >= 4).select(F.col("item_id").alias("phrase"), F.slice("words", 1, 4).alias("words"))
    return indexed(spark, sf).phrases(asked).select("phrase", F.col("path").cast("long").alias("path"), F.col("line").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"))


TITLE = "p_name || ' ' || lower(p_type) || ' #' || p_size"


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey AS id, {TITLE} AS title FROM part), q AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(lower(p_type), 1, 1) || ' ' || p_size % 10 AS query FROM part),
m AS (SELECT query, replace(query, ' ', '') AS ch, id, title, 0 AS k, 0 AS pos, -2 AS prev, 0 AS score FROM q, t
 UNION ALL SELECT query, ch, id, title, k + 1, i, i, score + 1 + CASE WHEN i = prev + 1 THEN 2 ELSE 0 END + CASE WHEN i = 1 OR regexp_matches(substr(title, i - 1, 1), '[^a-z0-9]') THEN 3 ELSE 0 END
 FROM (SELECT *, pos + strpos(substr(title, pos + 1), substr(ch, k + 1, 1)) AS i FROM m WHERE k < len(ch) AND strpos(substr(title, pos + 1), substr(ch, k + 1, 1)) > 0)),
s AS (SELECT query, id, title, score - len(title) / 100 AS score FROM m WHERE k = len(ch))
SELECT query, id, round(score, 6) AS score, row_number() OVER w AS place FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, title, id) QUALIFY row_number() OVER w <= 50""")
def o19_best_titles(spark, sf):
    p = read(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size")
    titles = p.select(F.col("p_partkey").alias("id"), F.expr(TITLE).alias("title"))
    asked = p.select(F.concat(F.substring("p_name", 1, 2), F.substring(F.lower("p_type"), 1, 1), F.lit(" "), (F.col("p_size") % 10).cast("string")).alias("query"))
    return palette.best_titles(asked, titles).select("query", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


#: Events' properties among nested values, arrays and plural forms; every eleventh is cut short.
NESTED = """'{"props":' || props || ',"list":[1,{"deep":"' || event_type || '"},[]],"item_one":"a","item_other":"b","n":null' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END"""


def nested(spark, sf):
    return variants.flattened(read(spark, sf, "events", "event_id", "event_type", "props").select("event_id", F.expr(NESTED).alias("text")), ["event_id"], "text")


@query("""WITH j AS (SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, event_type FROM events WHERE event_id % 11 <> 0)
SELECT event_id, 'props.k' AS key, k AS value FROM j UNION ALL SELECT event_id, 'list.0', '1' FROM j UNION ALL SELECT event_id, 'list.1.deep', '"' || event_type || '"' FROM j
UNION ALL SELECT event_id, 'item_one', '"a"' FROM j UNION ALL SELECT event_id, 'item_other', '"b"' FROM j UNION ALL SELECT event_id, 'n', 'null' FROM j""")
def f_flattened_json(spark, sf):
    return nested(spark, sf)


@query("""WITH k AS (SELECT user_id AS u, event_type || '_' || CASE WHEN event_id % 3 = 0 THEN 'one' WHEN event_id % 3 = 1 THEN 'other' ELSE 'x' END AS key, event_id % 5 < 2 AS old FROM events),
b AS (SELECT *, regexp_replace(key, '_(one|other)$', '') AS base FROM k) SELECT u, base AS key, count(DISTINCT key) AS forms FROM b WHERE old AND NOT EXISTS (SELECT 1 FROM b n WHERE NOT n.old AND n.u = b.u AND n.base = b.base) GROUP BY ALL""")
def u9_orphan_keys(spark, sf):
    k = F.col("event_id") % 3
    rows = read(spark, sf, "events").select(F.col("user_id").alias("u"), F.concat_ws("_", "event_type", F.when(k == 0, "one").when(k == 1, "other").otherwise("x")).alias("key"), (F.col("event_id") % 5 < 2).alias("old"))
    return variants.orphans(rows.filter("old").drop("old"), rows.filter("NOT old").drop("old"), ["u"])


@query("SELECT conv_id::VARCHAR AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') AS data FROM conversations QUALIFY coalesce(text, '') <> '' OR turn < max(turn) OVER (PARTITION BY conv_id)")
def t7_stream_records(spark, sf):
    """Conversations as streams of lines, cut every seven bytes; the SQL has them uncut."""
    decoders.register(spark)
    rows = read(spark, sf, "conversations", "conv_id", "turn", "text").withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  "))
    # a line's end comes with the next line's beginning, so that every chunk but the first goes on with a half record
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    bytes_ = F.encode(F.concat(F.when(F.col("turn") == first, "").otherwise("\n"), F.col("text")), "utf-8")
    cut = rows.select("conv_id", "turn", bytes_.alias("b")).select("conv_id", "turn", "b", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("b") / 7).cast("int"))).alias("i"))
    chunks = cut.select("conv_id", (F.col("turn") * (1 << 24) + F.col("i")).alias("n"), F.expr("substring(b, i * 7 + 1, 7)").alias("data"))
    chunks.createOrReplaceTempView("_chunks")
    return spark.sql("SELECT stream, n, data FROM stream_records(TABLE(_chunks) PARTITION BY (conv_id) ORDER BY (n), 'lines')")


@query("SELECT doc_id::VARCHAR || '/' || source AS path, text FROM documents WHERE lang = 'de'")
def s7_snapshot_source(spark, sf):
    """Documents written as a snapshot for each language, one of which is read."""
    where = snapshots.written(read(spark, sf, "documents", "doc_id", "source", "lang", "text").select(F.col("lang").alias("revision"), F.concat_ws("/", F.col("doc_id").cast("string"), "source").alias("path"), "text"))
    return snapshots.read(spark, where).filter("revision = 'de'").select("path", "text")


@query()
def t9_draft_changes(spark, sf):
    """Events as changes of a draft for each user, replayed in order; the stream of them gives the same (see its tests)."""
    ev = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    k = F.col("event_id")
    kind = F.when(k % 10 < 6, "add").when(k % 10 < 8, "edit").when(k % 10 < 9, "discard").otherwise(F.when(k % 100 == 99, "clear").otherwise("edit"))
    return drafts.replayed(ev.select(F.col("user_id").cast("string").alias("draft"), k.alias("seq"), "ts", kind.alias("kind"), F.concat(F.lit("d"), (k % 7 + 1).cast("string")).alias("id"), F.col("event_type").alias("path"), (k % 50).cast("int").alias("line"), F.concat(F.lit("note "), k.cast("string")).alias("body"), F.lit("h").alias("head")))


@query("""WITH g AS (SELECT p_brand AS cs, p_name AS nm, p_size AS sz, p_type AS ty, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL), k AS (SELECT *, nm || ' <num> <str>' AS pattern, regexp_extract(nm, '[a-z]+$') AS stem FROM g),
m AS (SELECT cs, stem, pattern, count(*) AS groups, min(first) AS first_group, sum(n)::BIGINT AS units FROM k GROUP BY ALL)
SELECT cs, stem, pattern, groups, first_group, units, row_number() OVER (PARTITION BY cs, stem ORDER BY units DESC, pattern) AS place FROM m""")
def a13_concept_patterns(spark, sf):
    """Groups of parts by name, size and type, merged where only the size and the type differ."""
    p = read(spark, sf, "part").groupBy(F.col("p_brand").alias("change_set_id"), "p_name", "p_size", "p_type").agg(F.count(F.lit(1)).alias("count"), F.min("p_partkey").alias("place"))
    key = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.concat(F.lit('"'), "p_type", F.lit('"')))
    groups = p.select("change_set_id", F.col("place").alias("group_id"), key.alias("key"), F.col("p_name").alias("label"), F.lit("").alias("old"), F.lit("").alias("new"), "count", F.lit(True).alias("mechanical"), "place")
    stems = p.select("change_set_id", F.regexp_extract("p_name", "[a-z]+$", 0).alias("stem")).distinct()
    got = concepts.patterns(groups, stems)
    return got.select(F.col("change_set_id").alias("cs"), "stem", "pattern", F.size("group_ids").cast("long").alias("groups"), F.get("group_ids", 0).alias("first_group"), "units", F.col("place").cast("long").alias("place"))
