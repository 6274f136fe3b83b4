from lexweave.llm.html import extract_text, to_text


def test_blocks_lists_and_tables():
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script>
    <body><h1>Head &amp; more</h1><p>one <b>two</b>\n three<p>four<br>five
    <ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>
    <table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td colspan=2>a wide cell</table>
    <pre> keep\n   this</pre><div hidden>no</div><div style="Display : none">no</div><!-- no -->end"""
    assert to_text(page).split("\n") == [
        "Head & more", "", "one two three", "", "four", "five", "", "- x", "- y", "  3. z", "  4. w", "",
        "Name   Qty", "apple  10", "a wide cell", "", " keep", "   this", "", "end",
    ]


def test_broken_markup():
    assert to_text("a</b></p>b<") == "a\n\nb<"
    assert to_text("<p>a<div>b</p>c") == "a\n\nb\n\nc"
    assert to_text("<td>x</td>") == "x"
    assert to_text("<table>x<tr>y<td>z</table>w").endswith("w")
    assert to_text("</ul></li></table>x") == "x"
    assert to_text("<li>x<li>y") == "- x\n- y"
    assert to_text("<ol start=x><li>a</ol>") == "1. a"
    assert to_text("<script>never closed") == ""
    assert to_text("<!-- never closed") == ""
    assert to_text("<div>" * 3000 + "deep") == "deep"
    assert to_text("") == to_text(None) == ""


def test_what_is_visible():
    assert to_text("x<math><mi>a</mi>=1</math>z") == "xa=1z"
    assert to_text("<svg><title>no</title><text>label</text><path/></svg> after") == "label after"
    assert to_text("<select><option>one<option selected>two</select>") == "two"
    assert to_text("<select multiple><option>one<option>two</select>") == "one two"
    assert to_text('<input value="typed"><input type=hidden value=no><input placeholder=hint><textarea>a &lt; b\nc</textarea>') == "typed hint a < b\nc"
    assert to_text("<object data=x>instead</object><video>no</video>") == "instead"
    assert to_text('<div style="visibility:hidden">no<p style="visibility: visible">yes</p>no</div>') == "yes"
    assert to_text("<details><summary>head</summary>no</details><details open><summary>a</summary>b</details>") == "head\na\nb"
    assert to_text("<dialog>no</dialog><template>no</template>x<![CDATA[no]]>y") == "xy"
    assert to_text('x<a href="unclosed>never') == "x"
    assert to_text("a<!-->b<!---->c<!-- > -->d</>e<3 f") == "abcde<3 f"
    assert to_text('<p title="a>b" class=x>q') == "q"


def test_spans():
    page = "<table><tr><td rowspan=2>ab<td>c<td>d<tr><td>long<td>f<tr><td colspan=2>wide cell here<td>g</table>"
    assert to_text(page).split("\n") == ["ab  c     d", "    long  f", "wide cell here  g"]
    assert to_text("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>") == "a  b\n   c"


def test_hostile_pages_take_linear_time():
    import time

    mb = 1 << 20
    pages = [
        "<a " * (mb // 3), "<div>" * 100_000 + "x", "<li><ul>" + "<div>" * 50_000 + "</li>" * 50_000, "<p" * (mb // 2), "<" * mb, "</" * (mb // 2), '<a b="' * (mb // 6), "<!--" * (mb // 4),
        "<b>x</b>" * (mb // 8), "<blockquote>" * 40_000 + "x<br>" * 40_000, "<table><tr><td>" * 20_000 + "x<br>" * 20_000, "<table><tr>" + "<td rowspan=9999>a" * 20_000 + "<tr><td>b" * 20_000,
        "<table><tr>" + "<td colspan=1000>a" * 50_000, "<table><tr><td>" + "y" * (mb // 2) + "<tr><td>a<td>b" * 20_000, "<table><tr>" + "<td>a" * 20_000 + "<td>" + "b<br>" * 20_000, "<ul><li>" * 60_000 + "x", "&amp" * (mb // 4),
    ]
    for page in pages:
        began = time.process_time()
        assert len(to_text(page)) <= 100 * len(page)
        assert time.process_time() - began < 5, page[:30]


def test_random_trees_against_a_plain_renderer():
    """Divs and inline elements, hidden or not: text by a recursive walk over the tree the page was made from."""
    import random

    rng = random.Random(5)

    def make(depth):
        kind = rng.choice(["div", "b", "span", "p"] if depth else ["div"])
        sight = rng.choice(["", "", "", " hidden", ' style="visibility:hidden"', ' style="visibility:visible"'])
        return kind, sight, [make(depth + 1) if depth < 4 and rng.random() < 0.5 and kind != "p" else f"w{rng.randrange(1000)}" for _ in range(rng.randrange(4))]

    def written(t):
        return t if isinstance(t, str) else f"<{t[0]}{t[1]}>" + " ".join(map(written, t[2])) + f"</{t[0]}>"

    def seen(t, visible):
        if isinstance(t, str):
            return [t] if visible else []
        if t[1] == " hidden":
            return []
        visible = visible if not t[1] else "visible" in t[1].split(":")[1]
        return [w for c in t[2] for w in seen(c, visible)]

    for _ in range(300):
        tree = make(0)
        assert to_text(written(tree)).split() == seen(tree, True)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", 5), (2, None, None, 5), (None, "u", "", 5), (1, "u", "<p>a", 5)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_text(pages).collect())
    assert got == [(0, "u", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, "", "", 0)]
    assert extract_text(pages.limit(0)).collect() == []
