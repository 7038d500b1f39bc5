import time
import tracemalloc

from html_pages import PAGES

from zonalis.llm import html_extract as hx

FIELD = hx.train()


def test_pages_in_layouts_that_training_has_not():
    """Recall and precision over blocks; README.md has the figures."""
    right = found = there = 0
    for page, want in PAGES:
        got = hx.main_text(page, FIELD).split("\n")
        right += len(set(got) & set(want))
        found, there = found + len(got), there + len(want)
        print(sorted(set(got) - set(want)), sorted(set(want) - set(got)))
    print(f"recall {right / there:.3f}, precision {right / found:.3f}, of {there} blocks")
    assert right / there >= 0.9 and right / found >= 0.9


def test_reading_is_linear_in_the_page():
    for make in (lambda n: "<div>x" * n, lambda n: "<b>x" * n + "</b>" * n, lambda n: "<b>" * n + "<p>y" * n, lambda n: "<head>" * n, lambda n: "<li><b>" * n, lambda n: "<div class='c'>" * n + "t" + "</i>" * n, lambda n: "<table><tr><td>z" * n):
        took = []
        for n in (10_000, 40_000):
            page = make(n)
            began = time.process_time()
            hx.main_text(page, FIELD)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 1, (page[:20], took)
    tracemalloc.start()
    hx.main_text("<div class='a b'>x" * 100_000, FIELD)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
