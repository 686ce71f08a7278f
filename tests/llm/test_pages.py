import random
import re
from html import unescape

import pytest

from radiolens.llm.catalog import QUERIES
from radiolens.llm.pages import ARTICLE, FURNITURE, PLAIN, blocks, common, main_text
from tests.llm.conftest import DATA


def kept(html):
    found = blocks(html)
    return [t for t, z in found if z == ARTICLE] or [t for t, z in found if z == PLAIN]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []), ("", []), ("just text", ["just text"]), ("a &lt;b&gt; &eacute;&#8364;&amp;amp; <b>c</b>d", ["a <b> é€&amp; cd"]),
        ("<p>one<br>two\n\n three<p>four", ["one two three", "four"]), ("<p>a</p><!-- <p>no</p> --><script>var t='</p>'</script><p>b", ["a", "b"]),
        ("<nav><ul><li>x</ul></nav><article><header><h1>T</h1></header><p>t</p><div class='comments'><p>c</div><aside>s</aside></article><footer>f</footer>", ["T", "t"]),
        ("<header>h</header><div class=\"cookie-notice\">n</div><div id=ad-1>a</div><p>text</p><form>f<p>g</form><p hidden>h</p>", ["text"]),
        ("<article class='comment'>no</article><article>yes<p>1 < 2 and 3 > 2</article>", ["yes", "1 < 2 and 3 > 2"]),
        ("<div role='main'><p>m</p></div><p>outside</p>", ["m"]), ("<p title='a > b'>q</p><p>cut <b", ["q", "cut"]),
        ("<div class='address'><p>x</p></div><div class=\"shade\">y</div>", ["x", "y"]), ("<textarea>t</textarea><select><option>o</select>z", ["z"]),
        ("<style>p{}</style><title>t</title>u<script>never closed", ["u"]), ("<p>a&nbsp;b  c", ["a b c"]), ("<article><div class='post-header'><h1>H</h1></div><p>p", ["H", "p"]),
        ("<nav>open<article><p>inside stays furniture</article></nav><p>x", ["x"]), ("</p></div>loose</article>", ["loose"]),
    ],
)
def test_blocks(html, want):
    assert kept(html) == want


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.sample(range(30), rng.randrange(20)), rng.sample(range(30), rng.randrange(20))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = common(a, b)
        assert got == sorted(got) and len(got) == best[-1][-1]
        places = [b.index(a[i]) for i in got]
        assert places == sorted(places)
    assert common(list("xxyx"), list("xyx")) == [0, 2] or len(common(list("xxyx"), list("xyx"))) >= 2
    assert len(common(["same"] * 20_000, ["same"] * 20_000)) == 20_000


def test_query_gives_the_articles(spark):
    rows = {r.page_id: r for r in QUERIES["op3_main_text"](spark, DATA).collect()}
    given = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(rows) == len(given)
    for page in given:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*(>|\Z)", "", x))).strip() for x in re.split(r"<p>|</p>|</?h1>", inside)]
        want = "\n".join(x for x in parts if x)
        assert rows[page.page_id].text == want and rows[page.page_id].n_chars == len(want)


def page(i, body, host="h.example.org"):
    return (i, f"https://{host}/a/{i:04d}", f"<html><body><div>Site name</div><div>Menu one</div>{body}<div>All rights kept</div></body></html>")


def test_what_neighbours_share_goes(spark):
    rows = [page(i, f"<p>Own text {i}</p><p>More of it {i * i}</p>") for i in range(40)]
    rows += [page(100, "<p>Alone</p>", "other.example.org"), (200, None, "<p>no url</p>"), (201, "https://h.example.org/x", None), (202, "not a url", "<p>odd</p>")]
    rows += [page(300, "<p>copy</p>", "c.example.org"), (301, "https://c.example.org/a/0301", page(300, "<p>copy</p>")[2]), rows[5]]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, host string, path string, n int")
    out = main_text(pages)
    assert out.columns == ["page_id", "url", "host", "path", "n", "text"]
    got = sorted((r.page_id, r.text) for r in out.collect())
    frame = "Site name\nMenu one\n{}\nAll rights kept"
    want = [(i, f"Own text {i}\nMore of it {i * i}") for i in [*range(40), 5]]
    want += [(100, frame.format("Alone")), (200, "no url"), (201, ""), (202, "odd"), (300, frame.format("copy")), (301, frame.format("copy"))]
    assert got == sorted(want)
    assert main_text(pages.limit(0)).count() == 0
