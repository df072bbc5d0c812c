"""Line deduplication by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it,
divided by the number of the host's pages; lines above the ratio are boilerplate of that site and
are dropped from its pages. A line must stand on at least ``least`` pages, so that sites of few pages
keep theirs.

At most (lines per page) / ratio lines of a host can exceed the ratio, so a host's boilerplate
fits one row; the rows are broadcast if they hold at most BROADCAST lines together, else joined.

Nulls: a page without host keeps all lines; null or empty html has no lines and text ''.
A line repeated on a page counts once for the page and is dropped at each place. Pages are
rows: repeated rows count as pages. A line at exactly the ratio stays. Very long pages and lines are
read whole. An empty table gives no rows. Only page_id, url and html are looked at, so other columns
may have any names. An unclosed script, style or comment hides the rest of its page, as in a browser.
A host with a great part of all pages needs no task of its own: counts are summed before the shuffle, and beyond BROADCAST
the join is a sort-merge join whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BROADCAST = 500_000
#: Written alike for Java and for RE2.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
BLOCK = r"(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|aside|h[1-6]|br|title|table|tr|td|th|body|html|head|main|form|pre|blockquote|figure)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """The host of a URL, lower case; null if it has none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def lines_of(html: Column) -> Column:
    """Trimmed non-empty lines of the visible text, block elements on lines of their own."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BLOCK, "\n"), TAG, "")
    lines = F.split(F.regexp_replace(text, r"[ \t\r\f]+", " "), "\n", -1)
    return F.coalesce(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def drop_boilerplate(df: DataFrame, lines: str, host: str, ratio: float = 0.3, least: int = 3) -> DataFrame:
    """``df`` with ``kept``: the array column ``lines`` without the lines that exceed ``ratio`` on their ``host``.

    ``df`` is read three times, so it should be a table or as cheap as one.
    """
    scratch = Scratch(df.sparkSession, "line-dedup")
    pages = df.where(F.col(host).isNotNull())
    totals = pages.groupBy(host).agg(F.count("*").alias("__pages")).withColumnRenamed(host, "__host")
    seen = pages.select(F.col(host).alias("__host"), F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("__line"))
    seen = seen.groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    common = seen.join(totals, "__host").where(F.col("__n") > F.lit(ratio) * F.col("__pages"))
    common = scratch.write(common.groupBy("__host").agg(F.collect_list("__line").alias("__drop")), "common")
    held = common.agg(F.sum(F.size("__drop"))).first()[0] or 0
    joined = df.join(F.broadcast(common) if held <= BROADCAST else common, df[host] == common["__host"], "left")
    # a hash set finds the page's own boilerplate; its lines are then compared with those few only
    joined = joined.withColumn("__own", F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), "__drop"))
    kept = F.filter(lines, lambda x: ~F.array_contains("__own", F.xxhash64(x)))
    return joined.withColumn("kept", F.when(F.coalesce(F.size("__own"), F.lit(0)) <= 0, F.col(lines)).otherwise(kept)).drop("__host", "__drop", "__own")


def dedup_page_lines(df: DataFrame, ratio: float = 0.3, least: int = 3) -> DataFrame:
    """page_id, url, host, n_lines, n_dropped, text of every page with (page_id, url, html).

    The lines are cut out of the pages once and written; counting and dropping read them.
    """
    pages = df.select("page_id", "url", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    pages = Scratch(df.sparkSession, "page-lines").write(pages, "lines")
    out = drop_boilerplate(pages, "lines", "host", ratio, least)
    return out.select(
        "page_id", "url", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def oracle(ratio: float = 0.3, least: int = 3) -> str:
    sub = lambda x, pattern, to: f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    text = sub(sub(sub(sub("html", HIDDEN, "chr(10)"), BLOCK, "chr(10)"), TAG, "''"), r"[ \t\r\f]+", "' '")
    return f"""
WITH p AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         coalesce(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), []) AS lines
  FROM pages),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line),
totals AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host),
common AS (SELECT host, list(line) AS gone FROM seen JOIN totals USING (host) WHERE n >= {least} AND n > {ratio}e0 * pages GROUP BY host),
kept AS (SELECT p.*, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
         FROM p LEFT JOIN common USING (host))
SELECT page_id, url, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text FROM kept"""
