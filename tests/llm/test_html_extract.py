import html
import re

import duckdb
import numpy as np

from zonalis.llm import html_extract as hx

FIELD = hx.train()


def test_held_out_pages():
    right = total = 0
    for page, labels in hx.training_pages(150, seed=99):
        got = hx.blocks(page)
        if len(got) != len(labels):
            continue
        y = FIELD.decode([hx.features(b) for b in got])
        right += sum(a == b for a, b in zip(y, labels))
        total += len(labels)
    assert total > 1500 and right / total > 0.97


def test_viterbi_is_the_best_chain():
    r = np.random.default_rng(1)
    f = hx.Field({"a": 0, "b": 1, "c": 2}, r.normal(size=(3, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 8):
        chain = [tuple(r.choice(["a", "b", "c", "d"], 2)) for _ in range(n)]

        def score(y):
            s = f.start[y[0]] + sum(f.w.get(x, (0, 0))[k] for k, fs in zip(y, chain) for x in fs)
            return s + sum(f.trans[a][b] for a, b in zip(y, y[1:]))

        best = max(([int(c) for c in f"{i:0{n}b}"] for i in range(2**n)), key=score)
        assert f.decode(chain) == best


def test_whole_table(spark):
    """The table's pages have one layout, for which a pattern gives the same text."""
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select page_id, html from '{path}/pages.parquet'").fetchall()
    want = {}
    for i, h in rows:
        parts = re.split(r"</?(?:h1|p)>", re.search(r"(?s)<article>(.*?)</article>", h)[1])
        want[i] = "\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split())))
    got = hx.op2_html(spark, path).collect()
    assert {x.page_id: x.text for x in got} == want
    assert all(x.n_chars == len(x.text) for x in got)


def test_defined_cases(spark):
    long = "<article>" + "<p>One line of text here.</p>" * 20_000 + "</article>"
    cases = [None, "", "<html></html>", "<article><p>A &amp b&nbsp;c &#8364;<br>d\n e</p><script>x('</p>')</script><!-- <p>no</p> --><p>Second one.</article>", "<nav><a href='x>y'>Menu</a></nav><article><h1>Title", "<article><p>x < y and z</p></article>", "<p title=\"never closed><b>text", long]
    df = spark.createDataFrame([(i, None, h, "t", 1) for i, h in enumerate(cases)] + [(None, "u", cases[3], "t", 1), (3, "u", cases[3], "t", 1)], "page_id long, url string, html string, text string, i int")
    got = hx.extract(df).collect()
    by = {x.page_id: x.text for x in got}
    assert [by[i] for i in range(3)] == ["", "", ""]
    assert by[3] == by[None] == "A & b c € d e\nSecond one."
    assert by[4] == "Title" and by[5] == "x < y and z"
    assert by[7] == "\n".join(["One line of text here."] * 20_000)
    assert len(got) == 10 and hx.extract(df.limit(0)).count() == 0
