"""Benchmark decontamination (operator 4), in DataFrame functions only.

Words are runs of bytes outside ASCII punctuation, digits staying, with A-Z in
lower case. A window is ``n`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window of its own length. The set of windows
is broadcast as a hash set inside the plan when it holds no more than
``max_broadcast`` texts, and every window of a document is looked up in it by its
whole normalised text, so that a hit is verified as it is found. Beyond that
size windows become rows and meet the items in a shuffled join; the results are
the same.

Every row of the documents gives one row, judged by its own text: rows without
id, rows that repeat an id and rows that repeat id and text as well. Nulls have
no words; empty texts neither; very long texts are taken whole. Items without
words match nothing. A repeated item id joins its texts' windows. An empty table
of documents gives an empty table, an empty benchmark hits nothing. Other columns
pass through ``remove_contaminated`` only, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, salted_left_join, table

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of normalised words; empty for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT)
    return F.filter(parts, lambda w: w != "")


def windows_of(words: Column, n: int) -> Column:
    """Texts of all windows of n consecutive words, in order."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(
        F.array().cast("array<string>")
    )


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, window), each once."""
    words = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    whole = F.when(F.size("w") < n, F.array(F.concat_ws(" ", "w"))).otherwise(windows_of(F.col("w"), n))
    return words.select("item_id", size.alias("size"), F.explode(whole).alias("window")).distinct()


MAX_BROADCAST = 10_000  # window texts in the plan, about a megabyte


def scan(docs: DataFrame, windows: DataFrame, row: str, text_col: str, max_broadcast: int) -> DataFrame:
    """(row, words, hits) for every row of docs: hits are (start from 1, size, window) of every occurrence."""
    few = windows.select("size", "window").distinct().limit(max_broadcast + 1).collect()  # bounded by max_broadcast
    by_size: dict[int, list[str]] = {}
    for found in few:
        by_size.setdefault(found["size"], []).append(found["window"])
    docs = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    if len(few) > max_broadcast:
        return _scan_joined(docs, windows, sorted({r["size"] for r in windows.select("size").distinct().collect()}))

    def hits_of(words: Column) -> Column:
        return reduce(lambda x, y: F.concat(x, y), [_hits_of_size(words, size, texts) for size, texts in sorted(by_size.items())], _no_hits())

    both = bind(words_of(F.col("text")), lambda w: F.struct(w.alias("words"), hits_of(w).alias("hits")))
    return docs.select("row", both.alias("x")).select("row", "x.words", "x.hits")


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once: as a lambda variable it cannot be copied into inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hits_of_size(words: Column, size: int, texts: list[str]) -> Column:
    """Occurrences of windows of one size; the first words are looked up before a window's text is made."""
    first = sorted({t.split(" ", 1)[0] for t in texts})
    starts = F.filter(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.element_at(words, i).isin(first))
    made = F.transform(starts, lambda i: F.struct(i.cast("int").alias("at"), F.lit(size).alias("size"), F.concat_ws(" ", F.slice(words, i, size)).alias("window")))
    return F.when(F.size(words) >= size, F.filter(made, lambda x: x["window"].isin(texts))).otherwise(_no_hits())


def _numbered(words: Column, size: int) -> Column:
    return F.transform(windows_of(words, size), lambda w, i: F.struct((i + 1).cast("int").alias("at"), F.lit(size).alias("size"), w.alias("window")))


def _no_hits() -> Column:
    return F.expr("cast(array() as array<struct<at:int,size:int,window:string>>)")


def _scan_joined(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same with windows as rows, for item sets too large to broadcast; texts meet their hits by digest."""
    keyed = docs.select("row", words_of(F.col("text")).alias("words")).withColumn("key", F.unhex(F.sha2(F.concat_ws(" ", "words"), 256)))
    made = bind(F.col("words"), lambda w: F.concat(*[_numbered(w, size) for size in sizes]))
    rows = keyed.select("key", F.explode(made).alias("x"))
    hit = rows.join(windows.select(F.col("window").alias("_w")).distinct(), F.col("x.window") == F.col("_w"), "left_semi")
    hits = hit.groupBy("key").agg(F.sort_array(F.collect_set("x")).alias("hits"))  # at most the windows of one text
    return salted_left_join(keyed, hits, "key", "row").select("row", "words", F.coalesce("hits", _no_hits()).alias("hits"))


def hit_positions(hits: Column) -> Column:
    """Distinct word positions inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    windows = item_windows(benchmark, n, item_col, item_text)
    found = scan(docs, windows, id_col, text_col, max_broadcast).select(
        F.col("row").alias("doc_id"), F.size("words").cast("long").alias("n_words"), F.size(hit_positions(F.col("hits"))).cast("long").alias("n_hit"),
        F.concat_ws("\n", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["window"])))).alias("found"),
    )
    found = materialize(found, "window-hits")  # used twice: the texts are scanned once
    # each different set of windows meets its items once, and rows meet the items of their set; most rows have none
    owners = windows.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    sets = found.where("found != ''").select("found").distinct().withColumn("window", F.explode(F.split("found", "\n")))
    items = sets.join(owners, "window").groupBy("found").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    out = salted_left_join(found, items, "found", "doc_id").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without the rows that hold a benchmark window, each judged by its own text."""
    windows = item_windows(benchmark, n, "item_id", "text")
    clean = scan(docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text")), windows, "_doc", "_text", max_broadcast)
    return clean.where(F.size("hits") == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, text) with the words of hits taken out; what is left is the normalised words, one space apart."""
    found = scan(docs, item_windows(benchmark, n, "item_id", "text"), id_col, text_col, max_broadcast)
    places = F.sequence(F.lit(1), F.size("words"))
    kept = F.when(F.size("words") > 0, F.array_except(places, hit_positions(F.col("hits"))))
    return found.select(F.col("row").alias("doc_id"), bind(F.col("words"), lambda w: F.concat_ws(" ", F.transform(kept, lambda i: F.element_at(w, i)))).alias("text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH item_words AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)
), hits AS (
    SELECT d.doc_id, d.i, d.size, b.item_id FROM doc_windows d JOIN item_windows b ON d.win = b.win
), per_doc AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), per_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_items USING (doc_id)
"""
