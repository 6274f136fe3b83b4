"""Page trees, links and crawling against plain walks of generated pages and sites."""

import hashlib
import html as H
import random
import re
from collections import deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lexweave import plans, registry  # noqa: F401
from lexweave.functions import urls as U
from lexweave.operators import markup as M
from lexweave.operators import pages as P

WANTED, BAD = set(M.PARAGRAPH_TAGS), set(M.BOILERPLATE_TAGS)
TEXTS = ["A plain English sentence here.", "short", "naïve café au lait, bien sûr", "привет мир как дела сегодня", "x &amp; y &lt;ok&gt; and some more words", "  padded\n text of some length ", "12345 67890 12345 67890 12345", ""]


def grown(rng, depth=0):
    """A random element (tag, id, class, children); children are elements, texts and comments.  No element that an inner one would end."""
    tag = rng.choice(["div"] * 12 + ["span"] * 6 + ["b", "section", "i", "em"] * 2 + ["article", "main", "nav", "aside", "form", "header"])
    kids = []
    for _ in range(rng.randrange(1, 5)):
        kids.append(grown(rng, depth + 1) if depth < 6 and rng.random() < 0.6 else rng.choice([*TEXTS, "<!-- no <div> -->", '<a href="x">link text that is long enough</a>']))
    return tag, rng.choice(["", "", "", "top", "mainbox", "Content"]), rng.choice(["", "", "", "a b", "x page-BODY"]), kids


def written(node):
    if isinstance(node, str):
        return node
    tag, ident, cls, kids = node
    return f"<{tag}" + f' id="{ident}"' * bool(ident) + f" class='{cls}'" * bool(cls) + ">" + "".join(map(written, kids)) + f"</{tag}>"


def walk(node, out):
    """Visible elements in document order: (tag, id, class, own texts and those below)."""
    tag, ident, cls, kids = node
    if tag in BAD:
        return []
    mine = len(out)
    out.append(None)
    texts, held = [], ""
    for kid in [*kids, None]:
        if isinstance(kid, str) and not kid.startswith("<"):
            held += H.unescape(kid)
            continue
        if held.strip():
            texts.append(held.strip())
        held = ""
        if isinstance(kid, tuple):
            texts += walk(kid, out)
        elif kid and kid.startswith("<a"):
            out.append(("a", "", "", ["link text that is long enough"], len(out) + 1))
            texts.append("link text that is long enough")
    out[mine] = (tag, ident, cls, texts, len(out))
    return texts


def expected(root):
    out = []
    walk(root, out)
    pattern = re.compile("content|main|body", re.I)
    for test in (lambda e: e[0] == "main", lambda e: e[0] == "article", lambda e: pattern.search(e[1]), lambda e: pattern.search(e[2]), lambda e: e[0] == "body"):
        at = next((k for k, e in enumerate(out) if test(e)), None)
        if at is not None:
            break
    inside = out if at is None else out[at + 1 : out[at][4]]
    kept = []
    for tag, _, _, texts, _ in inside:
        text = " ".join(texts)
        letters = [c for c in text if c.isalpha()]
        if tag in WANTED and len(text) >= 20 and letters and sum(c.isascii() for c in letters) / len(letters) > 0.85:
            kept.append(text)
    return kept


def test_generated_pages(spark):
    rng = random.Random(11)
    roots = [("body", "", "", [grown(rng) for _ in range(3)]) for _ in range(300)]
    want = {k: expected(r) for k, r in enumerate(roots)}
    pages = spark.createDataFrame([(k, f"https://h.x/{k}", written(r)) for k, r in enumerate(roots)], "page_id long, url string, html string").repartition(3)
    trees = M.parsed(pages).cache()
    got = {k: [] for k in want}
    for r in M.paragraphs(trees).orderBy("page_id", "pos").collect():
        got[r.page_id].append(r.text)
    assert got == want and sum(map(len, want.values())) > 300
    for r in trees.select("page_id", M.text_length().alias("n"), M.page_text().alias("text")).collect():
        assert r.text == "\n".join(want[r.page_id]) and r.n == len(r.text)


@pytest.mark.parametrize(("html", "pieces", "area", "hrefs"), [
    (None, [], "", []),
    ("plain < text & more", ["plain < text & more"], "", []),
    ("<p>one<p>two<ul><li>a<li>b<p>c</ul>d", ["one", "two", "a", "b", "c", "d"], "", []),
    ("<nav><nav>x</nav>y</nav>z", ["z"], "", []),
    ("<div><form><div></form>still hidden</div></form>out</div>", ["out"], "", []),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"], "", []),
    ("<div>a</p></span>b</div>", ["a", "b"], "", []),
    ("<p>a<div>b</p>c</div>", ["a", "b", "c"], "", []),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><noscript><p>n</noscript>t", ["t"], "", []),
    ("<body><div id=x-Content>a<main>b</main></div>", ["a", "b"], "main", []),
    ("<body><div class='no'>a</div><div id=x-Content>b</div>", ["a", "b"], "div", []),
    ("<a href=/u?a=1&amp;b=2>x</a><a>no</a><a href>no</a><a href='  '>no</a><A HREF=' y '>z</A><footer><a href=f>f</a></footer><a href=/s />", ["x", "no", "no", "no", "z"], "", ["/u?a=1&b=2", "y", "/s"]),
    ("<p>never closed <b>bold", ["never closed", "bold"], "", []),
    ("<footer>hidden to the end <div>x", [], "", []),
])
def test_broken_pages(html, pieces, area, hrefs):
    tree = M.Tree(html or "")
    k = tree.area()
    assert (tree.pieces, tree.elements[k][0] if k >= 0 else "", tree.hrefs) == (pieces, area, hrefs)


def test_deep_pages_are_stored_once(spark):
    html = "<div>" * 3000 + "some words that are English enough" + "</div>" * 3000
    tree = M.parsed(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert tree.first().pieces == ["some words that are English enough"]
    assert tree.select(M.text_length()).first()[0] == 3000 * 35 - 1 and M.paragraphs(tree).count() == 3000


BASE = "http://a/b/c/d;p?q"
EXAMPLES = "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x"


@pytest.mark.parametrize("base", [BASE, "https://h.x", "https://h.x/a/b/", "https://h.x/a?z=/1#f", "https://h.x/a/../b/"])
def test_references(spark, base):
    """The published examples, and others; the standard library resolves alike."""
    hrefs = ["", *EXAMPLES.split(), "c/d//e", "//k.y/z//", "https://o.p/x#y", "mailto:a@b.c"]
    got = {r.h: r.u for r in spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", U.normalised(F.col("h"), F.lit(base)).alias("u")).collect()}
    assert got == {h: urljoin(base, h).split("#")[0].rstrip("/") for h in hrefs}


def brute_crawl(site, seeds, domain, most_pages, most_pdfs):
    queue, visited, pdfs_seen, log, saved = deque(seeds), set(), [], [], 0
    while queue and saved < most_pages:
        url = queue.popleft().rstrip("/")
        if url in visited:
            continue
        visited.add(url)
        base, n, hrefs = site.get(url, ("", 0, []))
        good = n > 100
        saved += good
        full = [urljoin(base, h).split("#")[0].rstrip("/") for h in hrefs]
        queue += [u for u in full if domain in re.sub(r"^[a-z]+:(//([^/?#]*))?.*$", r"\2", u) and not re.search(r"\.png|/feed/", u)]
        files = []
        for h, u in zip(hrefs, full):
            if h.lower().endswith(".pdf") and u not in pdfs_seen and len(pdfs_seen) < most_pdfs:
                pdfs_seen.append(u)
                files.append(u)
        log.append((len(log), url, "saved" if good else "skipped", hashlib.md5(url.encode()).hexdigest()[:12] + ".txt" if good else None, tuple(files)))
    return log


@pytest.mark.parametrize(("most_pages", "most_pdfs"), [(8000, 2000), (1, 3), (17, 9), (60, 0)])
def test_crawl(spark, most_pages, most_pdfs):
    rng = random.Random(3)
    site = {}
    for k in range(150):
        hrefs = [rng.choice([f"/p{rng.randrange(180)}", f"p{rng.randrange(180)}/", f"../p{rng.randrange(180)}#x", f"https://www.h.x/p{rng.randrange(180)}", "/img/a.png", "https://other.y/p1", f"/f{rng.randrange(30)}.pdf", f"https://z.z/F{k % 9}.PDF", "/feed/1", "mailto:x@h.x"]) for _ in range(rng.randrange(6))]
        site[f"https://{rng.choice(['', 'www.'])}h.x/p{k}"] = (None, rng.choice([0, 100, 101, 500]), hrefs)
    site = {u: (u, n, hrefs) for u, (_, n, hrefs) in site.items()}
    web = spark.createDataFrame([(u, u, n, hrefs) for u, (_, n, hrefs) in site.items()], "key string, url string, n long, hrefs array<string>").repartition(4)
    seeds = ["https://h.x/p0/", "https://www.h.x/p5", "https://h.x/p0", *[f"https://h.x/p{k}" for k in range(9, 30)], "https://nowhere.h.x"]
    got = P.crawl(web, spark.createDataFrame(list(enumerate(seeds)), "no long, url string"), "h.x", most_pages=most_pages, most_pdfs=most_pdfs)
    rows = [(r.no, r.url, r.status, r.text_file, tuple(p.url for p in r.pdfs)) for r in got.orderBy("no").collect()]
    assert rows == brute_crawl(site, seeds, "h.x", most_pages, most_pdfs)


def test_crawl_from_nowhere(spark):
    web = spark.createDataFrame([], "key string, url string, n long, hrefs array<string>")
    seeds = spark.createDataFrame([], "no long, url string")
    assert P.crawl(web, seeds, "x").count() == 0
    assert [(r.url, r.status) for r in P.crawl(web, seeds.union(spark.createDataFrame([(0, "https://a.x/")], seeds.schema)), "x").collect()] == [("https://a.x", "skipped")]


def test_site_takes_the_first_of_an_address(spark):
    pages = spark.createDataFrame([(2, "https://h.x/a/", "<p>two"), (1, "https://h.x/a#f", "<a href=z>"), (3, "https://h.x/b", None)], "page_id long, url string, html string")
    assert {(r.key, r.url, tuple(r.hrefs)) for r in P.site(pages).collect()} == {("https://h.x/a", "https://h.x/a#f", ("z",)), ("https://h.x/b", "https://h.x/b", ())}


@pytest.mark.parametrize("name", ["html_content_area", "html_strip_boilerplate", "html_text", "page_save_filter"])
def test_references_need_their_semicolon(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    words = "some words that are English enough to be kept " * 3
    pages = [f"<title>a &amp;&amp;&amp</title><p>{words}", f"<body><p>{words}&lt;b &amp;lt; &quot</p><p>{words}&amp;&am", f"<p>AT&T &copy &notit; {words}&", f"<article><p>{words}&quot;&ltx &amp;amp</article>"]
    rows = [(k, f"https://h.x/{k}", html) for k, html in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in want.description]).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_text_of_pages_cut_inside_a_tag(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    words = "some words that are English enough to be kept " * 3
    pages = [f"<body><p>{words}</p", f"<body><p>{words}<foot", f"<p>{words}<", f"<p>{words} a<b and <i>{words}</i", f"<div><p>{words}<!-- no end", f"<div>{words}<script>var t='</p>'", f"<div>{words}<script>x</script>{words}<!DOC"]
    spark.createDataFrame([(k, f"https://h.x/{k}", html) for k, html in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["html_text"])
    got = registry.QUERIES["html_text"](spark, str(tmp_path)).select(*[d[0] for d in want.description]).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
