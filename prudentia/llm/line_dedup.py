"""Lines that a site repeats on its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.llm.common import BLANKS, own_columns, stored

#: A line goes if more than this share of its site's pages have it, and at least so many.
RATIO = 0.1
LEAST_PAGES = 3
#: Elements that stand on lines of their own, and parts of a page that hold no text.
BLOCKS = ("p|div|br|li|ul|ol|nav|h[1-6]|title|head|body|html|header|footer|main|article|section|aside|form|table|tr|td|th|"
          "blockquote|pre|figure|figcaption|dl|dt|dd|hr|option|select")
NO_TEXT = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; NULL if there is none."""
    rest = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(rest, F.lit(""))


def page_text(html: Column) -> Column:
    """Text of a page: blocks on lines of their own, tags, scripts, styles and comments gone, entities as they are."""
    shown = F.regexp_replace(html, NO_TEXT, "")
    lines = F.regexp_replace(shown, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(lines, "<[^>]*>", "")


def _key(line: Column) -> Column:
    """128 bits, as text, that stand for a line without its outer blanks; NULL for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.md5(bare.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """site, keys: per site the lines on more than ``ratio`` of its pages and on ``least_pages`` at least.

    ``pages`` has site and content. A page counts once for a line, however often it has
    it: its lines are made distinct within the row. Counts are partial sums keyed by site
    and line, so neither a hot site nor a hot line gathers rows. A site's array is bounded
    by its mean number of lines a page divided by ``ratio``. Without ``copies`` pages of equal
    text count as one; they are told apart by 128 bits.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split("content", "\n"), _key), lambda k: k.isNotNull()))
    if copies:
        pages = pages.select("site", lines.alias("lines"))
    else:
        text = F.unhex(F.md5(F.col("content").cast("binary")))
        pages = pages.select("site", text.alias("text"), lines.alias("lines")).dropDuplicates(["site", "text"])
    total = pages.groupBy("site").agg(F.count("*").alias("pages"))
    counted = (pages.select("site", F.explode("lines").alias("key")).groupBy("site", "key")
               .agg(F.count("*").alias("n")).where(F.col("n") >= least_pages))
    common = counted.join(total, counted["site"].eqNullSafe(total["site"])).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy(counted["site"]).agg(F.collect_list("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, site: Column, text: str = "text", ratio: float = RATIO,
                        least_pages: int = LEAST_PAGES, copies: bool = True) -> DataFrame:
    """``docs`` without the lines that their site repeats, and ``lines_dropped`` (long) added.

    Lines end at a line feed and are compared without outer blanks; blank lines are no
    boilerplate. Rows without a site form a site of their own. A NULL text stays NULL, a
    text that loses every line becomes empty, and no row goes. Repeated rows count as
    pages of their own unless ``copies`` is false. An empty table gives no rows. Other columns
    keep their names and values; ``lines_dropped`` replaces a column of that name.

    The repeated lines are stored first, so that Spark knows their size: it sends them to
    the tasks where they are few, and else joins by site, a hot one split.
    """
    packed = docs.select(own_columns(docs, text, "lines_dropped"), site.cast("string").alias("site"),
                         F.col(f"`{text}`").cast("string").alias("content"))
    repeated = stored(boilerplate(packed, ratio, least_pages, copies).withColumnRenamed("site", "of"), "boilerplate")
    lines = F.split("content", "\n")
    known = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("keys"), _key(x)), F.lit(False)))
    left = packed.join(repeated, F.col("site").eqNullSafe(F.col("of")), "left").withColumn(
        "left", F.when(F.col("keys").isNull(), lines).otherwise(known))
    columns = [F.array_join("left", "\n").alias(c) if c == text else F.col("own").getField(c).alias(c)
               for c in docs.columns if c != "lines_dropped"]
    return left.select(*columns, F.coalesce(F.size(lines) - F.size("left"), F.lit(0)).cast("long").alias("lines_dropped"))
