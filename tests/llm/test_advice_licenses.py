"""Notices wrapped at any width, and inside a longer line."""

import textwrap

import pytest

from strandmill.llm import license_scan
from strandmill.llm.decontamination import words_of
from tests.llm.helpers import docs, prose

INDEX = license_scan.Templates(license_scan.TEMPLATES, license_scan.DICE)


def brute(text):
    """Best coefficient of every template over all windows of words."""
    words = words_of(text)
    out = {}
    for size, name, _, grams in INDEX.all:
        sizes = range(max(2, int(size / 1.5)), int(size * 1.5) + 3)
        best = max((license_scan.dice(license_scan.bigrams(words[a : a + n]), grams) for n in sizes for a in range(max(1, len(words) - n + 1))), default=0)
        if best >= license_scan.DICE - 1e-12:
            out[name] = best
    return out


@pytest.mark.parametrize("width", [30, 40, 60, 72])
def test_wrapped(spark, width):
    texts = [t for group in license_scan.TEMPLATES.values() for t in group]
    rows = [(k, prose(k, 20) + "\n" + "\n\n".join(textwrap.wrap(t, width)) + "\n" + prose(50 + k, 20)) for k, t in enumerate(texts)]
    got = {(r["doc_id"], r["template"]) for r in license_scan.license_matches(docs(spark, rows)).collect()}
    names = [f"{name}#{i}" for name, group in license_scan.TEMPLATES.items() for i in range(len(group))]
    assert {(k, name) for k, name in enumerate(names)} <= got


def test_inside_a_line():
    for k, (name, t) in enumerate((f"{n}#{i}", x) for n, group in license_scan.TEMPLATES.items() for i, x in enumerate(group)):
        text = "Été İ " + prose(k, 12) + " " + t + " " + prose(70 + k, 12)
        got = {x[2]: x for x in license_scan.scan_text(text, INDEX)}
        assert {n: round(x[4], 9) for n, x in got.items()} == {n: round(d, 9) for n, d in brute(text).items()}
        a, b = got[name][:2]
        assert got[name][4] == 1 and words_of(text[a:b]) == words_of(t)


def test_many_notices_in_one_line():
    text = "see below. This project is licensed under the MIT License. " * 300
    assert len([x for x in license_scan.scan_text(text, INDEX) if x[2] == "MIT#1" and x[4] == 1]) == 300
