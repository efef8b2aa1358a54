import random
import re

from wattline.llm.layout import Params, extract, render


def test_implied_tags_lists_and_spacing():
    page = "<html><head><title>T</title><body><h1>Head</h1>intro<p>One<p>Two <b>bold<br>line2<ul><li>a<li>b<ol start=3 type=a><li>x<li>y</ol><li>c</ul><dl><dt>term<dd>meaning</dl>"
    assert render(page) == "Head\n\nintro\n\nOne\n\nTwo bold\nline2\n\n- a\n- b\n  c. x\n  d. y\n- c\n\nterm\n  meaning"


def test_visibility():
    page = """<style>.x, #y {display: none}</style><div class="a x">no</div><p id=y>no<p hidden>no<p style="visibility:hidden">no<b style="visibility:visible">yes</b>
    <script>var a = "</p>";</script><noscript>no</noscript><template>no</template><details><summary>sum</summary>no</details><!-- no --><input type=hidden value=no><p style="DISPLAY : none">no"""
    assert render(page) == "yes\n\nsum"


def test_tables_are_aligned():
    page = "<table><caption>Cap</caption>stray<tr><th>Name<th>Qty<tr><td rowspan=2>Apple &amp; pear<td>3<tr><td>22<tr><td colspan=2>both</table>"
    assert render(page) == "stray\n\nCap\nName          Qty\nApple & pear  3\n              22\nboth"
    assert render("<table><tr><td>" + "a" * 100 + "<td>" + "b" * 100 + "</table>") == "a" * 100 + " | " + "b" * 100
    assert render("<td>loose</td>") == "loose"


def test_preformatted_and_white_space():
    assert render("a  \n b<pre>  x\n   y </pre>c&nbsp;d") == "a b\n\n  x\n   y\n\nc\xa0d"


def test_broken_deep_and_long_pages():
    assert render(None) == "" and render("") == "" and render("<") == "<" and render("<a href='x>text") == "text"
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<b>" * 3000 + "x") == "x"
    assert render("</p></div></td>x<!-- open") == "x"
    assert len(render("<p>word" * 20000).split()) == 20000
    assert render("<ul>" + "<li>a<ul>" * 400) .count("a") == 400


def test_on_spark(spark):
    df = spark.createDataFrame([(1, "<p>a<p>b", "x"), (2, None, "x"), (None, "", "x"), (1, "<p>a<p>b", "x")], "page_id long, html string, n_lines string")
    assert sorted(((r.page_id or 0, r.text, r.n_lines) for r in extract(df).collect())) == [(0, "", 0), (1, "a\n\nb", 3), (1, "a\n\nb", 3), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0
    assert Params().deepest < 200


def test_no_text_of_broken_tables_is_lost():
    assert render("<table><tr><table><tr><td>text</table></table>") == "text"
    assert render("<table><tr><td>a<tbody><table><tr><td>b</table>") == "a\n\nb"
    assert render("<table><table><caption>cap</caption><tr><td>x</table>y") == "cap\nx\n\ny"
    assert render("<table><colgroup>loose<col></colgroup><tr><td>x</table>") == "loose\n\nx"
    assert render("<table><tr><td><table><tr><td>in</table>out</table>") == "in\n\nout"
    rng = random.Random(5)
    tags = [f"<{s}{t}>" for t in ("table", "tbody", "tr", "td", "th", "caption", "colgroup", "col", "p", "b", "ul", "li", "pre", "form", "select", "option", "template") for s in ("", "/") if not (t == "template" or t == "col" and s)]
    for _ in range(4000):
        parts = [rng.choice(tags) if rng.random() < 0.7 else f" w{i} " for i in range(rng.randrange(4, 40))]
        words = sorted(p.strip() for p in parts if p.startswith(" "))
        assert sorted(re.findall(r"w\d+", render("".join(parts)))) == words, "".join(parts)
    deep = "<div>" * 160 + "<table><tr><td>a<td>b<table><tr><td>c" + "</div>" * 160 + "<tr>d<td>e"
    assert sorted(re.findall(r"[a-e]", render(deep))) == list("abcde")


def test_only_style_rules_that_apply_hide():
    def seen(css, page="<p class='tab'>one</p><p class='tab on'>two</p>", attrs=""):
        return render(f"<style{attrs}>{css}</style>{page}").split()

    both = ["one", "two"]
    assert seen(".tab{display:none}") == [] and seen("@media screen{.tab{display:none}}") == [] and seen("@media not print{p{display:none}}") == []
    assert seen("@media print{.tab{display:none}}") == both and seen(".tab{display:none}", attrs=" media=print") == both
    assert seen("} .tab{display:none}", attrs=" media='print'") == both and seen("} .tab{display:none}", attrs=" media='only screen'") == []
    assert seen("@media (max-width:600px){.tab{display:none}}") == both and seen("@keyframes x{from{display:none}} @supports (x:y){p{display:none}}") == both
    assert seen("@media print{a{color:red} .tab{display:none}} .on{display:none}") == ["one"]
    assert seen(".tab{display:none} .tab.on{display:block}") == ["two"]
    assert seen(".tab{display:none} .tab{display:block}") == both and seen(".tab{display:block} .tab{display:none}") == []
    assert seen(".tab{display:none} p{display:block}") == [] and seen("p{display:none} .on{display:flex}") == ["two"]
    assert seen(".tab{display:none} @media (min-width:600px){.tab{display:block}}") == both
    assert seen(".tab{display:none} @media print{.tab{display:block}}") == []
    assert seen(".tab{display:none !important} .tab.on{display:block}") == []
    assert seen(".tab{display:none} body .on{display:block} .x:hover .tab, .tab::before{display:block}") == ["two"]
    assert seen(".tab{display:none;&.on{display:block}}") == ["two"]
    assert seen(".hidden{display:none} @media(min-width:9em){.md\\:block{display:block}}", "<i class='hidden md:block'>a</i><i class=hidden>b") == ["a"]
    assert seen("a{content:'}'} .tab{visibility:hidden} b{visibility:visible}", "<p class=tab>no<b>yes</b>") == ["yes"]
    assert seen(".tab{display:none}", "<p class=tab style='display:block'>a</p><template><style>p{display:none}</style></template>") == ["a"]
    assert seen(".tab{display:none", attrs=" type=text/x") == both and seen("@media print{.tab{display:none}") == both and seen(".tab{display:none") == []
