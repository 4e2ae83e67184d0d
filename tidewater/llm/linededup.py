"""Line dedup by a suffix array over line ids (operator 2), in DataFrame functions only.

Documents are sequences of non-blank lines; blank lines stay where they are. A
line is deleted when it lies in a run of consecutive lines with at least
``min_words`` words in total whose lines occur, in the same order, at an earlier
place (by doc_id, then place in the document). The first copy of every run stays.

Suffixes are sorted by prefix doubling: level k ranks all runs of 2^k lines that
occur twice or more, from pairs of ranks of level k-1; ranks come from a range
partitioned sort, so they are places in the suffix array, and a group of equal
rank is a longest-common-prefix interval of depth 2^k. Suffixes whose group has
one member are settled and leave. A run of any length l is named by the ranks of
its first and last 2^k lines (2^k <= l < 2^(k+1)), which makes the groups of
equal names the intervals of depth l, and the least position in one is the copy
to keep.

Maximal runs need not be listed to be covered: every line of a repeated run of
enough words lies in the shortest run of enough words that begins at some line,
or that ends at some line, within it. Those two runs a line have the same length
wherever the same lines stand, so their groups are complete.

Null texts have no lines. Null ids sort first. Rows that repeat both id and text
count as one document and come back alike. Line ids are 128-bit digests. All
columns of the input pass through, but for those named n_lines, n_deleted or
emptied, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, table

MIN_WORDS = 50
SALTS = 16
DOC = ["d", "t"]  # id and text digest: the key of a document


def words_in(line: Column) -> Column:
    """Runs of characters that are no white space."""
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text_col).alias("t")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, no, h, w): non-blank lines with their number among all non-blank lines."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.where(F.col(text_col).isNotNull()).select(*_key(id_col, text_col), F.posexplode(lines).alias("no", "line"))
    return rows.select(*DOC, "no", F.unhex(F.md5("line")).alias("h"), words_in(F.col("line")).alias("w"))


def _spread_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows to one row a key, a hot key over SALTS tasks."""
    left = rows.withColumn("_s", F.pmod(F.xxhash64(*DOC, "no"), F.lit(SALTS)).cast("int"))
    right = groups.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.join(right.hint("merge"), [*keys, "_s"]).drop("_s")  # small as a file, its SALTS copies are too many to pass through the driver


def rank_groups(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds rank: how many suffixes stand in smaller groups. Sorted by range; only a count a partition reaches the driver."""
    dealt = materialize(groups.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    ends, total = {}, 0
    for row in sorted(dealt.groupBy("_part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["_part"]):
        ends[row["_part"]] = total
        total += row["n"]
    if not ends:
        return dealt.select(*keys, F.lit(0).cast("long").alias("rank"))
    # a constant of the plan: as a table of the driver's rows it would start Python on every executor
    starts = F.expr(f"array({', '.join(f'{ends.get(i, 0)}L' for i in range(max(ends) + 1))})")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select(*keys, (F.get(starts, F.col("_part")) + before).alias("rank"))


def _level(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(d, t, no, rank, ...) of the rows whose key occurs twice or more."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _spread_join(rows, rank_groups(groups, keys, f"{name}-groups"), keys).drop(*keys)


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, t, no, size): the shortest runs of enough words that begin, and that end, at each line of ``lines``.

    Words count up to min_words a line, so that the frame of a line spans fewer
    than 2 * min_words lines.
    """
    by_doc = Window.partitionBy(*DOC).orderBy("no")
    isles = lines.withColumn("isle", F.col("no") - F.row_number().over(by_doc))  # neighbours in the text
    in_isle = Window.partitionBy(*DOC, "isle").orderBy("no")
    w = F.least(F.col("w"), F.lit(min_words)).cast("long")
    cum = isles.withColumn("c", F.sum(w).over(in_isle)).withColumn("b", F.col("c") - w)
    cum = cum.withColumn("total", F.max("c").over(Window.partitionBy(*DOC, "isle"))).withColumn("low", F.min("no").over(Window.partitionBy(*DOC, "isle")))
    cum = cum.withColumn("high", F.max("no").over(Window.partitionBy(*DOC, "isle")))
    ahead = F.min("no").over(Window.partitionBy(*DOC, "isle").orderBy("b").rangeBetween(min_words, 2 * min_words - 1))
    behind = F.max("no").over(Window.partitionBy(*DOC, "isle").orderBy("c").rangeBetween(1 - 2 * min_words, -min_words))
    both = cum.withColumn("ahead", ahead).withColumn("behind", behind)
    from_here = F.when(F.col("total") - F.col("b") >= min_words, F.struct(F.col("no").alias("no"), (F.coalesce("ahead", F.col("high") + 1) - F.col("no")).alias("size")))
    start = F.coalesce(F.col("behind") + 1, F.col("low"))
    to_here = F.when(F.col("c") >= min_words, F.struct(start.alias("no"), (F.col("no") - start + 1).alias("size")))
    return both.select(*DOC, F.explode(F.array_distinct(F.array_compact(F.array(from_here, to_here)))).alias("x")).select(*DOC, "x.no", "x.size").distinct()


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, gone): numbers of the lines to delete, by document."""
    rows = _lines(docs, id_col, text_col)
    repeated = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = _spread_join(rows, rank_groups(repeated, ["h"], "lines-0"), ["h"]).drop("h").dropDuplicates([*DOC, "no"])
    level = materialize(level, "level-0")
    runs = materialize(shortest_runs(level, min_words).withColumn("k", F.floor(F.log2(F.col("size"))).cast("int")), "runs")
    top = runs.agg(F.max("k")).first()[0]
    level, found, k = level.drop("w"), [], 0
    while top is not None and k <= top:
        mine = runs.where(F.col("k") == k)
        tail = level.select(*DOC, F.col("no").alias("at"), F.col("rank").alias("tail"))
        named = mine.join(level, [*DOC, "no"]).withColumn("at", F.col("no") + F.col("size") - (1 << k)).join(tail, [*DOC, "at"])
        named = named.select(*DOC, "no", "size", "rank", "tail")
        names = ["size", "rank", "tail"]
        first = named.groupBy(*names).agg(F.min(F.struct(*DOC, "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        copies = _spread_join(named, first, names).where(F.struct(*DOC, "no") > F.col("first"))
        found.append(materialize(copies.select(*DOC, "no", "size"), f"copies-{k}"))
        k += 1
        if k > top:
            break
        ahead = level.select(*DOC, (F.col("no") - (1 << (k - 1))).alias("no"), F.col("rank").alias("next"))
        level = materialize(_level(level.join(ahead, [*DOC, "no"]).withColumnRenamed("rank", "first_half"), ["first_half", "next"], f"level-{k}"), f"level-{k}")
        if level.isEmpty():
            break
    if not found:
        return level.select(*DOC, F.array("no").alias("gone")).limit(0)
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    lines = union.select(*DOC, F.explode(F.sequence("no", F.col("no") + F.col("size") - 1)).alias("no"))
    return lines.groupBy(*DOC).agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies taken out of the text; adds n_lines, n_deleted and emptied.

    ``emptied``: the document had lines and has none left.
    """
    gone = later_copies(docs, id_col, text_col, min_words)
    joined = docs.select(F.struct("*").alias("row"), *_key(id_col, text_col)).join(gone, DOC, "left")
    old = F.col("row")[text_col]
    lines = F.split(old, "\n")
    real = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    # linear in the lines: places of the non-blank lines, then the set of places that stay. Each is bound to
    # a lambda variable, as the optimizer would otherwise evaluate it again for every line.
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def rebuilt(held: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(held) - 1)
        solid = F.filter(places, lambda i: real(F.get(held, i)))
        bad = bind(solid, lambda s: F.transform("gone", lambda g: F.get(s, g)))
        return bind(F.array_except(places, bad), lambda stay: F.concat_ws("\n", F.transform(stay, lambda i: F.get(held, i))))

    text = F.when(F.col("gone").isNull(), old).otherwise(bind(lines, rebuilt))
    n_lines = F.coalesce(F.size(F.filter(lines, real)), F.lit(0)).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    made = joined.select(
        "row", text.alias("new"), F.when(old.isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(n_gone).alias("n_deleted")
    )
    own = ("n_lines", "n_deleted", "emptied")
    kept = [(F.col("new") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in own]
    return made.select(*kept, "n_lines", "n_deleted", ((F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_deleted"))).alias("emptied"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "emptied", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP2_SQL = r"""
WITH docs AS (
    SELECT doc_id, string_split(text, chr(10)) AS raw, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents WHERE text IS NOT NULL
), counted AS (
    SELECT doc_id, raw, lines, list_transform(lines, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS w FROM docs
), places AS (
    SELECT doc_id, lines, w, unnest(range(1, len(lines) + 1)) AS i FROM counted
), runs AS (
    SELECT doc_id, lines, i, list_filter(range(i, len(w) + 1), lambda j: list_sum(w[i : j]) >= 50) AS e, list_filter(range(1, i + 1), lambda j: list_sum(w[j : i]) >= 50) AS s FROM places
), blocks AS (
    SELECT doc_id, i AS a, e[1] AS b, array_to_string(lines[i : e[1]], chr(10)) AS block FROM runs WHERE len(e) > 0
    UNION SELECT doc_id, s[len(s)] AS a, i AS b, array_to_string(lines[s[len(s)] : i], chr(10)) AS block FROM runs WHERE len(s) > 0
), marked AS (
    SELECT doc_id, a, b, row_number() OVER (PARTITION BY block ORDER BY doc_id, a) AS copy FROM blocks
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM marked WHERE copy > 1
), per_doc AS (SELECT doc_id, count(*) AS n, list(p) AS gone FROM gone GROUP BY doc_id
), real_no AS (
    SELECT doc_id, x, k, sum(CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS p
    FROM (SELECT doc_id, unnest(raw) AS x, unnest(range(1, len(raw) + 1)) AS k FROM docs)
), kept AS (
    SELECT r.doc_id, string_agg(x, chr(10) ORDER BY k) AS text FROM real_no r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.p = g.p AND regexp_matches(x, '[^\x20\x09-\x0D]')
    WHERE g.p IS NULL GROUP BY r.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(c.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted,
       coalesce(len(c.lines), 0) > 0 AND coalesce(len(c.lines), 0) = coalesce(n, 0) AS emptied, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
