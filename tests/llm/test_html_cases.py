"""Pages with the text that a browser shows, worked out by hand."""

import pytest

CASES = {
    "paragraphs": ("<p>a<p>b", "a\n\nb"),
    "white space": ("<p>  a \n\t b  </p>", "a b"),
    "inline keeps its line": ("a <b>b</b><i>c</i> d", "a bc d"),
    "break": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "blocks": ("<div>a</div><div>b</div>c", "a\nb\nc"),
    "entities": ("&lt;a&gt; &amp; &eacute;&#x263A;", "<a> & \u00e9\u263a"),
    "comment": ("a<!-- no <p> -->b", "ab"),
    "script and style": ("a<script>no</script><style>p{}</style>b", "ab"),
    "title is no text": ("<title>t</title><body>b", "b"),
    "unknown end tag": ("a</nope>b", "ab"),
    "unclosed": ("<div><p>a<div>b", "a\n\nb"),
    "hidden": ("<p hidden>no</p><p>yes", "yes"),
    "author styles override hidden": ("<p hidden style='display:block'>yes", "yes"),
    "inline display": ("<p style='color:red; display : none'>no</p>b", "b"),
    "tag rule": ("<style>aside{display:none}</style><aside>no</aside>b", "b"),
    "class rule": ("<style>.x{display:none}</style><p class='y x'>no</p>b", "b"),
    "id rule": ("<style>#k{display:none}</style><p id=k>no</p>b", "b"),
    "id beats tag": ("<style>#k{display:block}p{display:none}</style><p id=k>yes</p><p>no", "yes"),
    "class beats tag": ("<style>.k{display:block}p{display:none}</style><p class=k>yes</p><p>no", "yes"),
    "later rule wins a tie": ("<style>p{display:none}p{display:block}</style><p>yes", "yes"),
    "important wins": ("<style>p{display:none!important}#k{display:block}</style><p id=k style='display:block'>no</p>b", "b"),
    "descendant": ("<style>.a .b{display:none}</style><div class=a><i><p class=b>no</p></i></div><p class=b>yes", "yes"),
    "child": ("<style>.a>p{display:none}</style><div class=a><p>no</p><div><p>yes</p></div></div>", "yes"),
    "grandchild chain": ("<style>main .a > b{display:none}</style><main><p class=a><b>no</b>x</p></main><p class=a><b>yes</b>", "x\n\nyes"),
    "attribute": ("<style>[data-x]{display:none}</style><p data-x>no</p><p>yes", "yes"),
    "attribute value": ("<style>p[lang=de]{display:none}p[class^='ad-']{display:none}</style><p lang=de>no</p><p class=ad-1>no</p><p lang=en>yes", "yes"),
    "selector list": ("<style>.a, .b{display:none}</style><p class=a>no<p class=b>no<p>yes", "yes"),
    "sibling selectors are passed over": ("<style>p+p{display:none}</style><p>a<p>b", "a\n\nb"),
    "pseudo-classes are passed over": ("<style>p:hover{display:none}</style><p>a", "a"),
    "print rules": ("<style>@media print{.nav{display:none}}</style><p class=nav>yes", "yes"),
    "screen rules": ("<style>@media screen{.nav{display:none}}</style><p class=nav>no</p>b", "b"),
    "print style sheet": ("<style media=print>p{display:none}</style><p>yes", "yes"),
    "conditions": ("<style>@media (max-width:9px){p{display:none}}@supports (x:y){p{display:none}}</style><p>yes", "yes"),
    "visibility": ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
    "open dialog": ("<dialog open>yes</dialog><dialog>no</dialog>", "yes"),
    "details": ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    "display makes a block": ("a<span style='display:block'>b</span>c", "a\nb\nc"),
    "list": ("<ul><li>a<li>b</ul>", "- a\n- b"),
    "numbered list": ("<ol start=3><li>a<li>b<li value=9>c<li>d</ol>", "3. a\n4. b\n9. c\n10. d"),
    "letters and numerals": ("<ol type=a><li>x<li>y</ol><ol type=I start=4><li>z</ol>", "a. x\nb. y\n\nIV. z"),
    "reversed list": ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    "nested list": ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    "definitions": ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    "pre": ("<pre>\n a\n  b</pre>", " a\n  b"),
    "quote": ("<blockquote>q</blockquote>a", "  q\n\na"),
    "table": ("<table><tr><th>Name<th>N<tr><td>apple<td>1</table>", "Name   N\napple  1"),
    "rowspan": ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    "long rowspan": ("<table><tr><td rowspan=2>1<br>2<br>3<td>x<tr><td>y</table>", "1  x\n2  y\n3"),
    "rowspan ends with its group": ("<table><tbody><tr><td rowspan=9>A<td>B</tbody><tbody><tr><td>C<td>D</table>", "A  B\nC  D"),
    "rowspan zero": ("<table><tr><td rowspan=0>A<td>1<tr><td>2<tr><td>3</table>", "A  1\n   2\n   3"),
    "colspan": ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>y</table>", "wide  x\na  b  y"),
    "colspan of a long cell": ("<table><tr><td>a<td>b<td>c<tr><td colspan=2>longer text<td>d</table>", "a  b         c\nlonger text  d"),
    "wide characters": ("<table><tr><td>\u6f22\u5b57<td>x<tr><td>ab<td>y</table>", "\u6f22\u5b57  x\nab    y"),
    "cells without a row": ("<table><td>1<td>2</table>", "1  2"),
    "text loose in a table": ("<table>loose<tr><td>1</table>", "loose\n\n1"),
    "element loose in a table": ("<table><tr><p>first</p><td>1</table>", "first\n\n1"),
    "nested table": ("<table><tr><td><table><tr><td>a<td>b</table><td>c</table>", "a  b  c"),
    "caption": ("<table><caption>C</caption><tr><td>1</table>", "C\n1"),
    "lines in cells": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "buttons": ("<input type=submit value=Go><input type=hidden value=no>", "Go"),
    "noscript and template": ("<noscript>no</noscript><template>no</template>a", "a"),
    "ruby": ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"),
    "svg and math": ("<svg><text>s</text></svg><math>m</math>", "sm"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_shown_text(name):
    from lodestone.llm.html_render import render

    page, want = CASES[name]
    assert render(page) == want


def test_wide_cells_keep_their_text_and_bound_the_padding():
    from lodestone.llm.html_render import render

    out = render("<table>" + f"<tr><td>{'x' * 5000}<td>y" + "<tr><td>a<td>b" * 50 + "</table>").split("\n")
    assert out[0] == "x" * 5000 + "  y" and set(out[1:]) == {"a" + " " * 201 + "b"}


def test_the_registered_query_reads_whole_pages(spark, tmp_path):
    from lodestone.llm.html_render import render
    from lodestone.llm.queries import op2_html_text

    rows = [(k, f"http://h/{k}", page) for k, (page, _) in enumerate(CASES.values())] + [(7, None, None), (7, "u", ""), (None, "u", "<p>x" * 30_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in op2_html_text(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, u, render(p), len(render(p))) for i, u, p in rows), key=repr)
