"""Boilerplate lines by their frequency within a site: a line on too large a share of a host's pages is dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import col, join_checked, written

RATIO = 0.2
MIN_PAGES = 5
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: Applied in turn to html, the same in RE2 as here.
DROP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>"
SPLIT = rf"(?i)</?(?:{BLOCKS})(?:[ \t\r\n/][^>]*)?>|\n"
TAGS = r"<[^>]*>"
EDGES = r"^[ \t\r]+|[ \t\r]+$"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty if the address has none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def html_lines(html: Column) -> Column:
    """Text lines: html cut at block tags and line feeds, other tags removed, trimmed, empty ones left out."""
    cut = F.split(F.regexp_replace(html, DROP, ""), SPLIT)
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(F.regexp_replace(x, TAGS, ""), EDGES, "")), lambda x: x != "")


def line_key(line: Column) -> Column:
    """128 bits that stand for a line where it would be shuffled or sent: hashes from two seeds, so that neither follows from the other."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, n) of pages (host, lines): lines on more than ratio of the pages of a host that has at least min_pages."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_pages)
    keys = F.array_distinct(F.transform("lines", line_key))
    # a line on no more than ratio * min_pages pages can't be one, whatever its host's total
    seen = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(ratio * min_pages))
    return seen.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "key", "n")


def drop_site_boilerplate(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, host, text, n_lines, n_dropped) of every row; text joins the kept lines with line feeds.

    A page with a null address or none that has a host belongs to no site and keeps all its lines; its host is null or
    empty. Null html gives null text and 0 lines, empty html an empty text. A line counts once a page; rows that repeat a
    page count as pages each. Html of any length is read whole.
    An empty table gives an empty result; extra columns are not read, whatever their names.
    """
    own = pages.select(col(id_col).alias("page_id"), host(col(url)).alias("host"), html_lines(col(html)).alias("lines"))
    lines = written(own, "lines")
    named = lines.where("host <> '' and lines is not null").select("host", "lines")
    # a host has at most its mean lines a page / ratio of these
    bad = written(boilerplate_lines(named, ratio, min_pages).groupBy("host").agg(F.collect_list("key").alias("bad")), "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size("bad") * 48 + 64), F.lit(0)).alias("b")).first()["b"]
    joined = join_checked(lines, bad, ["host"], "left", max(1, size // max(1, bad.count())))
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", line_key(x))))
    return joined.withColumn("kept", kept).select(
        "page_id", "host", F.concat_ws("\n", "kept").alias("joined"), "lines", "kept",
    ).select("page_id", "host", F.when(F.col("lines").isNotNull(), F.col("joined")).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped"))


SQL = f"""
    with cut as (
        select page_id, lower(regexp_extract(url, '{HOST}', 1)) host,
               list_filter(list_transform(string_split_regex(regexp_replace(html, '{DROP}', '', 'g'), '{SPLIT}'),
                   lambda x: regexp_replace(regexp_replace(x, '{TAGS}', '', 'g'), '{EDGES}', '', 'g')), lambda x: x <> '') lines
        from pages),
    totals as (select host, count(*) total from cut where host <> '' and lines is not null group by host having count(*) >= {MIN_PAGES}),
    seen as (select host, line, count(*) n from (select host, unnest(list_distinct(lines)) line from cut where host <> '') group by host, line),
    bad as (select host, list(line) bad from seen join totals using (host) where n > {RATIO}::double * total group by host),
    kept as (select page_id, host, lines, case when bad is null then lines else list_filter(lines, lambda x: not list_contains(bad, x)) end kept
             from cut left join bad using (host))
    select page_id, host, case when lines is not null then coalesce(array_to_string(kept, chr(10)), '') end "text",
           coalesce(len(lines), 0)::bigint n_lines, coalesce(len(lines) - len(kept), 0)::bigint n_dropped
    from kept
"""
