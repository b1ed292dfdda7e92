from itertools import permutations

from pyspark.sql import functions as F

from logweave.llm.html_extract import extract_page, extract_text, op9_html_extraction


def test_article_blocks_and_references():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div>
    <article><header><h1>A &amp; B</h1></header><p><b>One<br>two &copy 3&nbsp;4<p>next
      line <i>i</i>n<div class="share-buttons">share</div><ul><li>x<li>y</ul><aside>side</aside><form><input value="a>b">f</form><table><tr><td>1<td>2<tr><td>3</table></article>
    <section id="comments"><article class="comment"><p>me first</p></article></section><footer>&copy; z</footer></body></html>"""
    assert extract_page(page) == "A & B\nOne two © 3 4\nnext line in\nx\ny\n1 2\n3"


def test_odd_pages():
    assert extract_page(None) == extract_page("") == extract_page("<p>") == ""
    assert extract_page("plain &am 1 < 2") == "plain &am 1 < 2"
    assert extract_page("<div><p>a</div></p></b>b<p hidden>c<p style='display: none'>d") == "a\nb"
    assert extract_page("<main><p>m</p></main><p>out") == "m"
    assert extract_page('<div class="adventure">kept</div><div id="cookie-banner">no</div><div role=navigation>no') == "kept"
    assert extract_page("<p>a<a href='x>y'>b</a><![CDATA[c&d]]>") == "abc&d"
    assert extract_page("<div>" * 3000 + "deep") == "deep"
    assert extract_page("<script>never closed") == ""
    assert extract_page("text <a href=\"unclosed>x</a>" + "<b" * 50) != None  # noqa: E711


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_go_and_shared_articles_stay(spark, tmp_path):
    same = "<div><p>Follow us</p><p>Site of the year</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{same}<div><p>own {i}</p><p>shared words</p></div></body>") for i in range(3)]
    rows += [(10 + i, f"https://H2.example/{i}?q", f"<body>{same}<div><p>own {i}</p></div></body>") for i in range(12)]
    rows += [(30 + i, f"//h2.example/{i}", f"<body>{same}<article><p>same article</p></article></body>") for i in range(8)]
    rows += [(50, None, None), (51, None, "<p>x")]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op9_html_extraction(spark, str(tmp_path)).collect()}
    assert got[0].text == "Follow us\nSite of the year\nown 0\nshared words"
    assert all(got[10 + i].text == f"own {i}" for i in range(12))
    assert all(got[30 + i].text == "same article" for i in range(8))
    assert got[50].text == "" and got[50].n_chars == 0 and got[51].text == "x" and got[51].url is None


def test_edge_tables(spark):
    pages = table(spark, [(1, "u", "<p>a")] * 7)
    odd = pages.withColumns({"key": F.lit(1), "mark": F.lit(2), "host": F.lit(3), "templates": F.lit(4)})
    assert [r.text for r in extract_text(odd, least_pages=9).collect()] == ["a"] * 7
    assert extract_text(pages.where("false")).collect() == []


def test_copies_are_one_content_and_no_page_loses_all_its_text(spark):
    copy = "<html><body><div><p>first thing</p><p>second thing</p></div></body></html>"
    rows = [(i, f"http://copies/{i}", copy) for i in range(7)] + [(9, "http://copies/9", "<p>second thing</p><p>and other words</p>")]
    turned = list(permutations(("one", "two", "three")))
    rows += [(100 + i, f"http://turned/{i}", "".join(f"<p>{x}</p>" for x in t)) for i, t in enumerate(turned)]
    rows += [(1000 + i, f"http://large/{i}", f"<body>{'<p>Notice to all</p>' if i < 6 else ''}<p>some own words here {i}</p></body>") for i in range(400)]
    rows += [(2000 + i, f"http://inner/{i}", f"<main><article><h1>own title {i}</h1><p>Sign up <b>now</b></p><ul><li>yes</ul><table><tr><td>{i}<tr><td>5</table></article></main>") for i in range(6)]
    rows += [(3000 + i, f"http://inner/again{i}", "<article><p>one article</p><p>in copies</p></article>" + f"<p>beside {i}") for i in range(6)]
    got = {r.page_id: r.text for r in extract_text(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == "first thing\nsecond thing" for i in range(7)) and got[9] == "second thing\nand other words"
    assert all(got[100 + i] == "\n".join(t) for i, t in enumerate(turned))
    assert all(got[1000 + i] == f"some own words here {i}" for i in range(400))
    assert all(got[2000 + i] == f"own title {i}\n{i}\n5" for i in range(6))
    assert all(got[3000 + i] == "one article\nin copies" for i in range(6))
