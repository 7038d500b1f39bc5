from zonalis.llm import html_extract as hx

LINE = "The committee met on Monday and agreed on the plan for the next year."


def test_only_the_list_is_dropped():
    for tag in ("noscript", "math", "svg", "iframe", "object", "xmp", "noembed", "noframes"):
        page = f"<html><head><title>t</title></head><body><article><p>{LINE}</p><{tag}>Kept words</{tag}><p>{LINE}</p></article></body></html>"
        assert "Kept words" in " ".join(b.text for b in hx.blocks(page)), tag
    for tag in ("script", "style", "template", "head"):
        assert "Lost" not in " ".join(b.text for b in hx.blocks(f"<p>{LINE}</p><{tag}>Lost words</{tag}><p>{LINE}</p>")), tag
    assert [b.text for b in hx.blocks("<p>If <math><mi>x</mi> = 2</math> holds</p><xmp>a &amp; <b>c</xmp>")] == ["If x = 2 holds", "a &amp; <b>c"]
    assert hx.blocks("<p>a</p><noscript><style>p {}</style></noscript><xmp>open")[-1].text == "open"
