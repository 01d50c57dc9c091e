"""Removal of repeated passages by overlapping three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import common

#: Lines of a window.
WINDOW = 3
_BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s, e, a, b, c, k): the windows of each document.

    A line counts with its hash unless it is blank; its ends are trimmed first. A window is three
    counting lines in a row, k = 3 with hashes a, b, c, and covers the lines s to e (from 0), blank
    ones between them too. A document of one or two counting lines is one window of k lines."""
    hashed = docs.select(
        F.col("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.filter(
            F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_BLANK)).alias("line"))),
            lambda x: x["line"] != "",
        ).alias("full"),
    ).select("doc_id", "text_hash", F.transform("full", lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"))).alias("l"))
    n = F.size("l")
    part = lambda i: F.coalesce(F.get("l", i)["h"], F.lit(0).cast("long"))
    window = lambda i: F.struct(
        F.get("l", i)["at"].alias("s"),
        F.get("l", F.least(i + WINDOW - 1, n - 1))["at"].alias("e"),
        part(i).alias("a"),
        part(i + 1).alias("b"),
        part(i + 2).alias("c"),
        F.least(n, F.lit(WINDOW)).alias("k"),
    )
    starts = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    return hashed.where(n > 0).select("doc_id", "text_hash", F.inline(F.transform(starts, window)))


def repeated_spans(windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): the line ranges of a document's windows that occur before, in the
    order of (doc_id, text_hash, s).

    Counts and first places are combined before they are shuffled; windows come back only to the
    keys that occur twice, by an equi-join that adaptive execution splits at a hot key."""
    place = F.struct("doc_id", "text_hash", "s")
    first = windows.groupBy("a", "b", "c", "k").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    later = windows.join(first.where("n > 1").drop("n"), ["a", "b", "c", "k"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with later occurrences of repeated windows taken out of text,
    and two columns more: n_lines and n_removed.

    Covered ranges are merged, so overlapping windows go as one passage; what is left is joined by
    line feeds, '' if nothing is. The earliest copy of a line always stays, because a covered line
    has an equal one in an earlier place. Null text stays null with no line; an empty text is one
    blank line. Rows that repeat doc_id and text are one document and get equal results; rows of one
    doc_id with other texts are documents in the order of their text's hash; a null doc_id is before
    all others. Other columns pass through; of the same two names, they are replaced. An empty table
    gives an empty one."""
    docs = docs.drop("n_lines", "n_removed")
    spans = repeated_spans(common.cut(line_windows(docs))).select(
        F.col("doc_id").alias("_quillon_id"),
        F.col("text_hash").alias("_quillon_hash"),
        # spans rise in both ends: an island begins where a span starts behind the end before it
        F.filter("spans", lambda x, i: (i == 0) | (x["s"] > F.get("spans", i - 1)["e"])).alias("_quillon_from"),
        F.filter("spans", lambda x, i: (i == F.size("spans") - 1) | (F.get("spans", i + 1)["s"] > x["e"])).alias("_quillon_to"),
    )
    marked = docs.withColumn("_quillon_own", F.xxhash64("text"))
    found = marked.join(
        spans,
        marked["doc_id"].eqNullSafe(spans["_quillon_id"]) & (marked["_quillon_own"] == spans["_quillon_hash"]),
        "left",
    ).withColumn("_quillon_lines", _lines(F.col("text")))  # behind the shuffle, which carries text alone
    lines, starts, ends = F.col("_quillon_lines"), F.col("_quillon_from"), F.col("_quillon_to")
    total = F.coalesce(F.size(lines), F.lit(0))
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(ends, j - 1)["e"] + 1)
    stop = lambda j: F.when(j == F.size(starts), total).otherwise(F.get(starts, j)["s"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), lambda j: F.slice(lines, begin(j) + 1, stop(j) - begin(j))))
    gone = F.aggregate(F.arrays_zip(starts.alias("f"), ends.alias("t")), F.lit(0), lambda x, y: x + y["t"]["e"] - y["f"]["s"] + 1)
    return found.select(
        *[F.when(starts.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(total).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
    )


#: The same in DuckDB SQL: doc_id, text, n_lines, n_removed.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
c AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w0 AS (
  SELECT doc_id, idx, n, pos AS s, t AS a,
         lead(t, 1) OVER d AS b, lead(t, 2) OVER d AS c,
         lead(pos, 1) OVER d AS p1, lead(pos, 2) OVER d AS p2
  FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
w AS (
  SELECT doc_id, s, coalesce(p2, p1, s) AS e,
         row_number() OVER (PARTITION BY a, b, c, least(n, 3) ORDER BY doc_id, s) AS nth
  FROM w0 WHERE idx <= greatest(n - 2, 1)),
r AS (
  SELECT DISTINCT l.doc_id, l.pos FROM w JOIN l ON l.doc_id = w.doc_id AND l.pos BETWEEN w.s AND w.e
  WHERE w.nth > 1)
SELECT l.doc_id,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE r.pos IS NULL), '') AS text,
       count(*) AS n_lines, count(r.pos) AS n_removed
FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.pos = l.pos
GROUP BY l.doc_id
"""
