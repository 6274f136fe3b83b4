"""Page layout, links and crawling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..storage import save
from . import markup
from .numbering import numbered, ordered, part


def outside(blocks: DataFrame, tables: DataFrame, page: str = "page") -> DataFrame:
    """Blocks that overlap no table rectangle of their page; touching edges do not overlap."""
    b, t = blocks.alias("b"), tables.alias("t")
    meet = (F.col(f"b.{page}") == F.col(f"t.{page}")) & (F.col("b.x0") < F.col("t.x1")) & (F.col("b.x1") > F.col("t.x0")) & (F.col("b.y0") < F.col("t.y1")) & (F.col("b.y1") > F.col("t.y0"))
    return b.join(t, meet, "left_anti")


def links(trees: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, href, link): every non-empty ``a[href]`` outside boilerplate, normalised against the page's ``url``; repeats stay."""
    keys = keys or ("page_id",)
    each = trees.select(*keys, "url", F.posexplode("hrefs").alias("pos", "href"))
    return each.select(*keys, "pos", "href", U.normalised(F.col("href"), F.col("url")).alias("link"))


def is_crawled(link: Column, domain: str) -> Column:
    return U.is_internal(link, domain) & ~U.is_skipped(link)


def is_pdf(href: Column) -> Column:
    return F.lower(href).endswith(".pdf")


def site(pages: DataFrame, least: int = 20) -> DataFrame:
    """(key, url, n, hrefs): one page for each normalised address, the smallest page_id of it, with the length of its text and its links."""
    trees = markup.parsed(pages).withColumn("n", markup.text_length(least))
    found = trees.select(U.normalised(F.lit(""), F.col("url")).alias("key"), "page_id", "url", "n", "hrefs")
    return found.groupBy("key").agg(F.min_by(F.struct("url", "n", "hrefs"), "page_id").alias("page")).select("key", "page.*")


def _in_order(level: DataFrame, saved: int, most: int) -> DataFrame:
    """The pages of a level that are popped before ``most`` pages are saved; ``saved`` were before it."""
    parts = ordered(level, "no").withColumn("_part", part())
    good = F.col("saved").cast("long")
    sums = parts.groupBy("_part").agg(F.sum(good).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.coalesce(F.sum(good).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = parts.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    return held.filter(F.col("_before") + F.col("_inside") + saved < most).select(*level.columns)


def crawl(web: DataFrame, seeds: DataFrame, domain: str, *, most_pages: int = 8000, most_pdfs: int = 2000, least: int = 100) -> DataFrame:
    """(no, url, depth, status, text_file, pdfs): the log of a breadth-first crawl of ``web`` (key, url, n, hrefs) from ``seeds`` (no, url).

    Addresses are taken in the order in which a queue would give them: by level,
    then by the number of the page that names them first, then by the link's place on
    it.  A page is saved if its text is longer than ``least``; the crawl ends with the
    page that is the ``most_pages``-th saved one.  What is skipped, or not in
    ``web``, is in the log too, and links of skipped pages are followed.  A PDF
    belongs to the first page that names it, up to ``most_pdfs`` of them; pdfs has
    their addresses and file names in the order of the page.

    A level is one join with the pages, one minimum per address, one anti-join with what
    is known and one numbering; each is saved, so lost executors cost nothing and lineage does not grow.
    """
    none = F.lit(None).cast("string")
    first = seeds.select(F.regexp_replace("url", "/+$", "").alias("address"), F.struct(F.col("no").cast("long").alias("no"), F.lit(0).alias("pos")).alias("rank"))
    ahead = first.groupBy("address").agg(F.min("rank").alias("rank"))
    known, done, count, saved, depth = None, None, 0, 0, 0
    while True:
        level = numbered(ahead, "rank", name="at").select("address", (F.col("at") + count).alias("no"))
        level = level.join(web, F.col("address") == F.col("key"), "left").withColumn("saved", F.coalesce(F.col("n") > least, F.lit(False)))
        level = save(level.select("no", "address", F.lit(depth).alias("depth"), "saved", "url", "hrefs"))
        here = level.agg(F.count("*").alias("pages"), F.count_if("saved").alias("saved")).first()
        if not here["pages"]:
            break
        if saved + here["saved"] >= most_pages:
            level = save(_in_order(level, saved, most_pages))
        done = level if done is None else done.union(level)
        count, saved, depth = count + here["pages"], saved + here["saved"], depth + 1
        if saved >= most_pages:
            break
        named = links(level.filter("hrefs is not null"), "no").filter(is_crawled(F.col("link"), domain))
        named = named.groupBy(F.col("link").alias("address")).agg(F.min(F.struct("no", "pos")).alias("rank"))
        known = level.select("address") if known is None else known.union(level.select("address"))
        ahead = save(named.join(known, "address", "left_anti"))
    if done is None:
        return level.select("no", F.col("address").alias("url"), "depth", none.alias("status"), none.alias("text_file"), F.array().cast("array<struct<url:string,file:string>>").alias("pdfs"))
    pdfs = links(done.filter("hrefs is not null"), "no").filter(is_pdf(F.col("href"))).groupBy("link").agg(F.min(F.struct("no", "pos")).alias("rank"))
    pdfs = numbered(pdfs, "rank", name="pdf").filter(F.col("pdf") < most_pdfs)
    files = pdfs.groupBy(F.col("rank.no").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank.pos", F.col("link").alias("url"), U.pdf_name(F.col("link")).alias("file")))).alias("pdfs"))
    log = done.join(files, F.col("no") == F.col("of"), "left")
    out = log.select(
        "no", F.col("address").alias("url"), "depth", F.when(F.col("saved"), "saved").otherwise("skipped").alias("status"),
        F.when(F.col("saved"), F.concat(U.key(F.col("address")), F.lit(".txt"))).alias("text_file"),
        F.coalesce(F.transform("pdfs", lambda x: F.struct(x["url"].alias("url"), x["file"].alias("file"))), F.array().cast("array<struct<url:string,file:string>>")).alias("pdfs"),
    )
    return out
