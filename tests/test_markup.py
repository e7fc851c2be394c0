"""Cleaning of markup: nested, unclosed and quoted forms, and tags of any length."""

from __future__ import annotations

import pytest

from gravure.operators import markup

CASES = [
    ("<script><script>a</script>b</script>c", "c"),
    ('<iframe title="a>b"/>keep<g/>', "keep<g/>"),
    ('<iframe title="a>b">gone</iframe>keep', "keep"),
    ("a<script>x<b>y", "a"),
    ("a</script>b", "a</script>b"),
    ('<script>s = "<iframe>"</script>t', "t"),
    ("<s:script>x</s:script >t<form/>u", "tu"),
    ("<script><![CDATA[ it's </script> ]]></script>t", "t"),
    ("<script>if (a < \"b\") {}</script>t", "t"),
    ("<!-- <script> it's --><a onclick='x' b='y'>t</a>", "<!-- <script> it's --><a b='y'>t</a>"),
    ("<scripted>x</scripted>", "<scripted>x</scripted>"),
    ("1 < 2 <", "1 < 2 <"),
    ("<a b='1'onclick='x'>t</a>", "<a b='1'>t</a>"),
    ("<g onload>x</g><g onload/>", "<g>x</g><g/>"),
    ("<a/onclick=x/ b>", "<a/ b>"),
    ("<svg:a\tx:onload = 'y'\nhref='javascript:z'w='1'>", "<svg:a w='1'>"),
    ("<a title='onclick=x' data-onclick='y' onclicked='z'>", "<a title='onclick=x' data-onclick='y' onclicked='z'>"),
    ("<use href='http://x'/><use href='#a'href/>", "<use/><use href='#a' href/>"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    docs = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(CASES)], "doc_id long, body string")
    return {row["doc_id"]: row["body"] for row in markup.sanitize_markup(docs).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_forbidden_elements_go_whole(cleaned, case):
    assert cleaned[case] == CASES[case][1]


def test_tag_of_very_many_attributes(spark):
    tag = "<g " + " ".join(f'a{i}="v>{i}"' for i in range(20_000)) + ">"
    docs = spark.createDataFrame([(1, tag + "<script>x</script>")], "doc_id long, body string")
    assert markup.sanitize_markup(docs).first()["body"] == tag
    assert [r["tag"] for r in markup.element_audit(docs).collect()] == ["script"]
