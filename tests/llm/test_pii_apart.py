import re
import time

from pii_sentences import SENTENCES

from zonalis.llm import pii

FIELD = pii.train()


def test_sentences_that_training_has_not():
    """Recall and precision over spans (places and kinds); README.md has the figures."""
    hit = found = there = 0
    for line in SENTENCES:
        text, want, at = "", set(), 0
        for m in re.finditer(r"\{(\w+)\|([^}]*)\}", line):
            text += line[at : m.start()]
            want.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        text += line[at:]
        got = set(pii.find(text, FIELD)[1])
        hit, found, there = hit + len(got & want), found + len(got), there + len(want)
        if got != want:
            print([(k, text[a:b]) for k, a, b in sorted(got - want)], [(k, text[a:b]) for k, a, b in sorted(want - got)])
    print(f"recall {hit / there:.3f}, precision {hit / found:.3f}, of {there} spans")
    assert hit / there >= 0.9 and hit / found >= 0.9


def test_long_runs_of_signs_take_time_in_proportion():
    for part in ("at dot ", "a@", "1.2 ", "(1) ", "4111 ", "at ", "x at y dot z ", "+1 2 "):
        took = []
        for n in (2000, 8000):
            began = time.process_time()
            pii.find(part * n, FIELD)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5 and took[1] < 8, (part, took)
