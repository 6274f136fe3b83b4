"""Crawl and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import markup as M
from ..operators import pages as P
from ..registry import query, spread, table
from .cleaning import _quoted

URLS = [
    "https://x", "https://noexample.com.evil.com/", "mailto:x@example.com", "https://a.b/?u=example.com", "http://example.com:80/wp-content/x", "https://example.com/a.JSP", "https://example.com/feed/",
    "https://example.com/docs/My%20File (1).pdf", "https://example.com/a/b.c.pdf?x=1", "https://example.com/p/", "https://example.com/A/x.PDF", "https://sub.example.com/very/" + "long" * 40 + ".pdf",
]
DOMAIN = "example.com"
URL_INPUT = "(SELECT url FROM pages UNION ALL SELECT url FROM (VALUES " + ", ".join(f"({_quoted(u)})" for u in URLS) + ") u(url))"
HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").union(spark.createDataFrame([(u,) for u in URLS], "url string"))


@query("url_key", f"SELECT url, substr(md5(url), 1, 12) AS key FROM {URL_INPUT}")
def url_key(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.key(F.col("url")).alias("key"))


@query("url_internal", f"SELECT url, contains({HOST}, '{DOMAIN}') AS internal FROM {URL_INPUT}")
def url_internal(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.is_internal(F.col("url"), DOMAIN).alias("internal"))


SKIP_SQL = "(" + " OR ".join([f"contains(lower(url), '{x}')" for x in U.SKIP_ANYWHERE] + [f"starts_with({PATH}, '{x}')" for x in U.SKIP_PATHS]) + ")"


@query("url_skip", f"SELECT url, {SKIP_SQL} AS skipped FROM {URL_INPUT}")
def url_skip(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.is_skipped(F.col("url")).alias("skipped"))


PDF_NAME = rf"substr(regexp_replace(substr(md5(url), 1, 12) || '_' || regexp_extract(regexp_extract({PATH}, '([^/]*)$', 1), '^(.+?)(\.[^.]*)?$', 1), '[^\p{{L}}\p{{N}}_.-]', '_', 'g'), 1, 96) || regexp_extract(regexp_extract({PATH}, '([^/]*)$', 1), '^.+?(\.[^.]*)$', 1)"


@query("pdf_filename", f"SELECT url, {PDF_NAME} AS name FROM {URL_INPUT}")
def pdf_filename(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.pdf_name(F.col("url")).alias("name"))


def _tags(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in sorted(names)) + "]"


_ENDS = "MAP {" + ", ".join(f"'{k}': {_tags(v)}" for k, v in sorted(M.ENDS.items())) + "}"
_WEIGHTS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in M.WEIGHT.items()) + "}"
_BAD, _WANTED = _tags(M.BOILERPLATE_TAGS), _tags(M.PARAGRAPH_TAGS)


def _weight(tag: str) -> str:
    return f"coalesce({_WEIGHTS}[{tag}], 100)"


def _plain(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return rf"regexp_replace({x}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _attribute(name: str) -> str:
    found = [rf"nullif(regexp_extract(t, '(?is)\s{name}\s*=\s*{quote}([^{quote or chr(92) + 's>'}]*)', 1), '')" for quote in ('"', "''")]
    return f"coalesce({', '.join(found)}, " + rf"""regexp_extract(t, '(?is)\s{name}\s*=\s*([^\s>"'']+)', 1))"""


def dom(pages: str) -> str:
    """CTEs over (page_id, url, html): a stack of open elements, one token of every page at a time.

    ``el``: visible elements (page_id, i, tag, t, inside: the numbers of the elements around it);
    ``pc``: visible pieces (page_id, i, piece, inside); ``ar``: the number of each page's content area;
    ``pg``: runs of paragraphs (page_id, pos, text); ``hr``: hrefs (page_id, url, pos, href).
    """
    script = r"<(?:script|style)(?:\s[^>]*)?>.*?</(?:script|style)\s*>"
    k = "list_max(list_transform(list_filter(range(1, len(stack) + 1), lambda j: {}), lambda j: j))"
    kept = f"stack[1:coalesce({k.format(f'NOT list_contains(coalesce({_ENDS}[tag], []), stack[j].tag)')}, 0)]"
    at = f"coalesce({k.format('stack[j].tag = tag')}, 0)"
    heavier = f"len(list_filter(stack[{at} + 1:], lambda e: {_weight('e.tag')} > {_weight('tag')}))"
    return rf"""
tk AS MATERIALIZED (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '(?is)<!--.*?-->|<![^>]*>|{script}|</?[a-z][^>]*>|[^<]+|<') AS ts FROM {pages}),
tt AS MATERIALIZED (SELECT page_id, i, t, CASE WHEN regexp_matches(t, '(?is)^{script}$') THEN 'text' WHEN regexp_matches(t, '^</[A-Za-z]') THEN 'end' WHEN regexp_matches(t, '^<[A-Za-z]') THEN 'start' WHEN regexp_matches(t, '^<!') THEN 'none' ELSE 'text' END AS kind,
  lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM (SELECT page_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS t FROM tk)),
st(page_id, i, before, stack) AS (SELECT page_id, 0::BIGINT, []::STRUCT(tag VARCHAR, no BIGINT)[], []::STRUCT(tag VARCHAR, no BIGINT)[] FROM tk UNION ALL
  SELECT page_id, tt.i, CASE WHEN kind = 'start' THEN {kept} ELSE stack END,
    CASE WHEN kind = 'start' THEN CASE WHEN tag IN ({', '.join(f"'{x}'" for x in sorted(M.VOID))}) OR ends_with(t, '/>') THEN {kept} ELSE list_append({kept}, {{'tag': tag, 'no': tt.i}}) END
      WHEN kind = 'end' AND {at} > 0 AND {heavier} = 0 THEN stack[1:{at} - 1] ELSE stack END
  FROM st JOIN tt USING (page_id) WHERE tt.i = st.i + 1),
ev AS MATERIALIZED (SELECT page_id, st.i, kind, tag, t, list_transform(before, lambda e: e.no) AS inside FROM st JOIN tt USING (page_id, i) WHERE len(list_filter(before, lambda e: list_contains({_BAD}, e.tag))) = 0 AND NOT (list_contains({_BAD}, tag) AND kind <> 'end')),
el AS MATERIALIZED (SELECT page_id, i, tag, t, inside FROM ev WHERE kind = 'start'),
pc AS MATERIALIZED (SELECT page_id, i, {_plain('t')} AS piece, inside FROM ev WHERE kind = 'text' AND {_plain('t')} <> ''),
ar AS MATERIALIZED (SELECT page_id, min(r).i AS area, min(r).tag AS tag FROM (SELECT page_id, {{'rule': CASE WHEN tag = 'main' THEN 1 WHEN tag = 'article' THEN 2 WHEN regexp_matches({_attribute('id')}, '(?i){M.AREA_NAMES}') THEN 3 WHEN regexp_matches({_attribute('class')}, '(?i){M.AREA_NAMES}') THEN 4 WHEN tag = 'body' THEN 5 END, 'i': i, 'tag': tag}} AS r FROM el) WHERE r.rule IS NOT NULL GROUP BY page_id),
pg AS MATERIALIZED (SELECT e.page_id, row_number() OVER (PARTITION BY e.page_id ORDER BY e.i) - 1 AS pos, string_agg(piece, ' ' ORDER BY pc.i) AS text FROM el e LEFT JOIN ar ON ar.page_id = e.page_id JOIN pc ON pc.page_id = e.page_id AND list_contains(pc.inside, e.i)
  WHERE list_contains({_WANTED}, e.tag) AND (area IS NULL OR list_contains(e.inside, area)) GROUP BY e.page_id, e.i),
pp AS (SELECT * FROM pg WHERE length(text) >= 20 AND coalesce(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')), 0)::DOUBLE > 0.85, false)),
ln AS MATERIALIZED (SELECT page_id, url, coalesce(n, 0) AS n FROM tk LEFT JOIN (SELECT page_id, (sum(length(text) + 1) - 1)::BIGINT AS n FROM pp GROUP BY page_id) USING (page_id)),
hr AS MATERIALIZED (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, href FROM (SELECT page_id, i, {_plain(_attribute('href'))} AS href FROM el WHERE tag = 'a') JOIN tk USING (page_id) WHERE href <> '')
"""


def resolved_sql(href: str, base: str) -> str:
    """Absolute form of a reference, dot segments folded from left to right, without fragment and trailing slashes."""
    ref, whole = f"split_part({href}, '#', 1)", f"split_part({base}, '#', 1)"
    bare = f"split_part({whole}, '?', 1)"
    origin, own = f"regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)", f"split_part({ref}, '?', 1)"
    folder = f"regexp_replace(substr({bare}, length({origin}) + 1), '[^/]*$', '')"
    path = f"CASE WHEN starts_with({own}, '/') THEN {own} ELSE CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {own} END"
    parts = f"string_split({path}, '/')"
    fold = f"list_reduce(list_prepend('', list_filter({parts}, lambda x, k: k > 1 AND (x <> '' OR k = len({parts})))), lambda a, x: CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END)"
    rest = f"substr({ref}, length({own}) + 1)"
    return f"""rtrim(CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} WHEN starts_with({ref}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || {ref} WHEN {ref} = '' THEN {whole}
  WHEN starts_with({ref}, '?') THEN {bare} || {ref} ELSE {origin} || {fold} || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END || {rest} END, '/')"""


#: Forms of references, put against the address of every page.
REFERENCES = ["", "/p/q/#top", "?q=1", "#s", "//k.y/z//", "https://o.p/x#y", "c/d", "mailto:a@b.c", "/", ".", "./", "..", "../g", "../../../g", "./g/.", "g/./h//i", "a/../../b?c=/../d", "/x/../y/", "g;x=1/../y", "..g", "g..", "/./a/b/../c/."]


@query("url_normalise", f"SELECT page_id, href, {resolved_sql('href', 'url')} AS link FROM (SELECT page_id, url, unnest([{', '.join(map(_quoted, REFERENCES))}]) AS href FROM pages)")
def url_normalise(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, REFERENCES))).alias("href"))
    return each.select("page_id", "href", U.normalised(F.col("href"), F.col("url")).alias("link"))


def web(spark, sf_dir):
    """``pages`` with links between them, which they lack: after the text of page i come links to the pages 2i + 1, 2i + 2 and 7i mod n in several spellings, to addresses that are no page, and to PDFs."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    i, n = F.col("page_id"), F.lit(pages.count())
    to = pages.select(i.alias("to"), F.regexp_replace("url", "&", "&amp;").alias("address"))
    asked = pages.select("page_id", F.explode(F.array(2 * i + 1, 2 * i + 2, (7 * i) % n)).alias("to")).distinct()
    named = asked.join(to, "to").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("to", "address"))).alias("named"))
    near = F.transform(F.coalesce("named", F.array().cast("array<struct<to:bigint,address:string>>")), lambda x, k: F.concat(F.lit("<p>see <a class=x href="), F.when(k % 2 == 0, F.concat(F.lit('"'), x["address"], F.lit('"'))).otherwise(F.concat(F.lit("' "), x["address"], F.lit("#part'"))), F.lit(">next</a>")))
    more = F.concat(
        F.lit("<div id=x><div><a href=/files/doc"), (i % 40).cast("string"), F.lit('.pdf>one</a><a href="../files/./doc'), (i % 7).cast("string"),
        F.lit('.PDF">two</a></div><a href="/img/x.png">no</a><a href="mailto:a@example.com">no</a></div><nav><div><a href="/hidden">no</a></div><nav></nav><a href="/hidden2">no</a></nav><a href="lost/page'), (i % 11).cast("string"), F.lit('">lost</a>'),
    )
    return pages.join(named, "page_id", "left").select("page_id", "url", F.concat("html", F.array_join(near, ""), more).alias("html"))


WEB = """(SELECT page_id, url, html || coalesce(near, '') || '<div id=x><div><a href=/files/doc' || page_id % 40 || '.pdf>one</a><a href="../files/./doc' || page_id % 7 || '.PDF">two</a></div><a href="/img/x.png">no</a><a href="mailto:a@example.com">no</a></div><nav><div><a href="/hidden">no</a></div><nav></nav><a href="/hidden2">no</a></nav><a href="lost/page' || page_id % 11 || '">lost</a>' AS html
  FROM pages LEFT JOIN (SELECT page_id, string_agg('<p>see <a class=x href=' || CASE WHEN k % 2 = 0 THEN '"' || address || '"' ELSE ''' ' || address || '#part''' END || '>next</a>', '' ORDER BY k) AS near FROM (
    SELECT a.page_id, replace(b.url, '&', '&amp;') AS address, row_number() OVER (PARTITION BY a.page_id ORDER BY a.x) - 1 AS k FROM (SELECT DISTINCT page_id, unnest([2 * page_id + 1, 2 * page_id + 2, (7 * page_id) % (SELECT count(*) FROM pages)]) AS x FROM pages) a JOIN pages b ON b.page_id = a.x) GROUP BY page_id) USING (page_id))"""


def trees(spark, sf_dir):
    return M.parsed(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


@query("html_links", f"WITH RECURSIVE {dom(WEB)}, l AS (SELECT page_id, href, {resolved_sql('href', 'url')} AS url FROM hr) SELECT page_id, href, url AS link, count(*) AS n FROM l WHERE contains({HOST}, 'example') AND NOT {SKIP_SQL} GROUP BY ALL")
def html_links(spark, sf_dir):
    every = P.links(M.parsed(web(spark, sf_dir)))
    return every.filter(P.is_crawled(F.col("link"), "example")).groupBy("page_id", "href", "link").agg(F.count("*").alias("n"))


@query("html_pdf_links", f"WITH RECURSIVE {dom(WEB)} SELECT page_id, {resolved_sql('href', 'url')} AS link FROM hr WHERE ends_with(lower(href), '.pdf')")
def html_pdf_links(spark, sf_dir):
    return P.links(M.parsed(web(spark, sf_dir))).filter(P.is_pdf(F.col("href"))).select("page_id", "link")


@query("html_strip_boilerplate", f"WITH RECURSIVE {dom('pages')} SELECT page_id, md5(coalesce(string_agg(piece, chr(10) ORDER BY i), '')) AS digest, count(piece) AS pieces FROM tk LEFT JOIN pc USING (page_id) GROUP BY page_id")
def html_strip_boilerplate(spark, sf_dir):
    """Text pieces outside boilerplate subtrees, nested ones included."""
    return trees(spark, sf_dir).select("page_id", F.md5(F.array_join("pieces", "\n")).alias("digest"), F.size("pieces").cast("long").alias("pieces"))


@query("html_content_area", f"WITH RECURSIVE {dom('pages')} SELECT page_id, coalesce(ar.tag, '') AS area, md5(coalesce(string_agg(piece, ' ' ORDER BY pc.i), '')) AS digest FROM tk LEFT JOIN ar USING (page_id) LEFT JOIN pc ON pc.page_id = tk.page_id AND (area IS NULL OR list_contains(pc.inside, area)) GROUP BY page_id, ar.tag")
def html_content_area(spark, sf_dir):
    return trees(spark, sf_dir).select("page_id", "area", F.md5(M.area_text()).alias("digest"))


@query("html_text", f"WITH RECURSIVE {dom('pages')} SELECT page_id, pos::INT AS pos, text FROM pp")
def html_text(spark, sf_dir):
    return M.paragraphs(trees(spark, sf_dir))


@query("page_save_filter", f"WITH RECURSIVE {dom('pages')} SELECT page_id, substr(md5({resolved_sql(chr(39) * 2, 'url')}), 1, 12) || '.txt' AS file, n FROM ln WHERE n > 100")
def page_save_filter(spark, sf_dir):
    """Pages whose extracted text is longer than 100 characters."""
    n = trees(spark, sf_dir).select("page_id", "url", M.text_length().alias("n")).filter("n > 100")
    return n.select("page_id", F.concat(U.key(U.normalised(F.lit(""), F.col("url"))), F.lit(".txt")).alias("file"), "n")


#: Levels that the SQL goes down; a tree of page i over 2i + 1 and 2i + 2 needs no more for 8,000 pages.
LEVELS = 14


def crawl_sql(most_pages: int, most_pdfs: int) -> str:
    """The crawl level by level: new addresses in the order of the first link to them, then the cap of saved pages by running counts over all."""
    pdf_name = PDF_NAME.replace("url", "link")
    out = [
        f"WITH RECURSIVE {dom(WEB)}",
        f"site AS MATERIALIZED (SELECT key, min_by({{'id': page_id, 'n': n, 'url': url}}, page_id) AS page FROM (SELECT *, {resolved_sql(chr(39) * 2, 'url')} AS key FROM ln) GROUP BY key)",
        f"lk AS MATERIALIZED (SELECT page_id, pos, href, {resolved_sql('href', 'url')} AS link FROM hr)",
        f"go AS MATERIALIZED (SELECT page_id, pos, link FROM (SELECT *, link AS url FROM lk) WHERE contains({HOST}, 'example') AND NOT {SKIP_SQL})",
        f"l0 AS MATERIALIZED (SELECT address, 0 AS depth, row_number() OVER (ORDER BY no) - 1 AS no FROM (SELECT rtrim(url, '/') AS address, min(page_id) AS no FROM pages WHERE page_id IN (0, 3) GROUP BY 1))",
    ]
    for d in range(1, LEVELS):
        seen = " UNION ALL ".join(f"SELECT address FROM l{k}" for k in range(d))
        out.append(f"""l{d} AS MATERIALIZED (SELECT address, {d} AS depth, (SELECT count(*) FROM ({seen})) + row_number() OVER (ORDER BY rank) - 1 AS no FROM (
  SELECT link AS address, min({{'no': no, 'pos': pos}}) AS rank FROM l{d - 1} JOIN site ON site.key = address JOIN go ON go.page_id = site.page.id WHERE link NOT IN ({seen}) GROUP BY link))""")
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(LEVELS))
    return ",\n".join(out) + f""",
v AS (SELECT a.*, site.page.id AS id, coalesce(site.page.n > 100, false) AS saved FROM ({every}) a LEFT JOIN site ON site.key = address),
c AS MATERIALIZED (SELECT * FROM (SELECT *, coalesce(sum(saved::INT) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM v) WHERE earlier < {most_pages}),
f AS (SELECT link, min({{'no': no, 'pos': pos}}) AS rank FROM c JOIN lk ON lk.page_id = c.id WHERE ends_with(lower(href), '.pdf') GROUP BY link ORDER BY rank LIMIT {most_pdfs}),
g AS (SELECT rank.no AS no, string_agg(link || ' ' || {pdf_name}, chr(10) ORDER BY rank.pos) AS pdfs FROM f GROUP BY rank.no)
SELECT no, address AS url, depth, CASE WHEN saved THEN 'saved' ELSE 'skipped' END AS status, CASE WHEN saved THEN substr(md5(address), 1, 12) || '.txt' END AS text_file, coalesce(pdfs, '') AS pdfs FROM c LEFT JOIN g USING (no)"""


def _crawled(spark, sf_dir, most_pages: int, most_pdfs: int):
    pages = web(spark, sf_dir)
    seeds = table(spark, sf_dir, "pages").filter(F.col("page_id").isin(0, 3)).select(F.col("page_id").alias("no"), "url")
    log = P.crawl(P.site(pages), seeds, "example", most_pages=most_pages, most_pdfs=most_pdfs)
    return log.withColumn("pdfs", F.array_join(F.transform("pdfs", lambda x: F.concat(x["url"], F.lit(" "), x["file"])), "\n"))


@query("crawl_log", crawl_sql(8000, 2000))
def crawl_log(spark, sf_dir):
    """The crawl with the caps of production: 8,000 saved pages and 2,000 PDFs."""
    return _crawled(spark, sf_dir, 8000, 2000)


@query("crawl_caps", crawl_sql(40, 25))
def crawl_caps(spark, sf_dir):
    """The same with caps that end it inside a level."""
    return _crawled(spark, sf_dir, 40, 25)


@query("crawl_reachable", crawl_sql(10**9, 0).replace("SELECT no, address AS url, depth, CASE", "SELECT address AS url, depth FROM c --", 1))
def crawl_reachable(spark, sf_dir):
    """Every address that the links of the pages lead to, and its depth."""
    return _crawled(spark, sf_dir, 10**9, 0).select("url", "depth")
