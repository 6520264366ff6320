"""Answers read in tables against the reader of single answers."""

import random

from quire.operators import markup as M
from quire.operators import responses


def test_answers(spark):
    r = random.Random(3)
    good = '<section data-role="summary" data-title="T &amp; t"><p>a &lt; b <b>c</b></p>[[IMG_1]]</section><dl data-role="glossary"><dt>term</dt><dd>fixed</dd></dl>'
    cases = [
        None, "", "text", good, f" \n{good}\n ", f"x{good}", good + "<p/>", "```" + good, "<!DOCTYPE a>" + good, good.replace("</b>", ""), good.replace("&lt;", "&nbsp;"), good.replace("&lt;", "&"),
        good.replace("summary", "other"), good.replace(' data-title="T &amp; t"', ""), good.replace("T &amp; t", ""), good.replace("glossary", "x"), good.replace("fixed", "new"), good.replace("fixed", " "), good.replace("<dt>term</dt>", ""),
        good.replace("<dt>term</dt>", "<dt>a</dt><dt>b</dt>"), good.replace("term", "other <i>one</i>"), good.replace("<b>", '<b onclick="x">'), good.replace("<b>c</b>", "<script>x</script>"), good.replace("<b>c</b>", '<a href="JavaScript:x">c</a>'),
        good.replace("<b>c</b>", '<p><img src="x"/></p>'), good.replace("<b>c</b>", '<i onload="y"/><svg/>'), good.replace("</dl>", "<dt>n</dt><dd>m</dd></dl>"), good.replace("<dt>", "<dt> <b>").replace("</dt>", "</b>\n</dt>"), good + good,
        good.replace("<dl", "<ul/><dl"), good.replace('data-title="T &amp; t"', "data-title='Q'"), good.replace("<p>", "<p><!-- note -->").replace("</p>", "<br/></p>"),
    ]
    parts = ["<section data-role='summary' data-title='t'>", "</section>", '<dl data-role="glossary">', "</dl>", "<dt>a</dt>", "<dd>b</dd>", "<p>x</p>", "y", "<b/>"]
    cases += ["".join(r.choices(parts, k=r.randint(1, 6))) for _ in range(60)]
    cases += ["<section data-role='summary' data-title='t'>" + "".join(r.choices(("<p>x</p>", "y", "<b onx='1'/>"), k=2)) + "</section><dl data-role='glossary'>" + "".join(r.choices(("<dt>a</dt>", "<dd>b</dd>", "<dd/>", " "), k=r.randint(0, 4))) + "</dl>" for _ in range(60)]
    rows = spark.createDataFrame([(i, c, {"term": "fixed"}) for i, c in enumerate(cases)], "id int, answer string, known map<string,string>").repartition(3)
    got = {x["id"]: x for x in responses.read(rows, "answer", ("id",), "known").collect()}
    assert len(got) == len(cases)
    for i, case in enumerate(cases):
        x = got[i]
        try:
            body, title, terms = M.parse_response(case or "", {"term": "fixed"})
        except ValueError as e:
            assert x["error"] == str(e) and x["title"] is None and x["body"] is None, case
            continue
        assert x["error"] is None and x["title"] == title and {t["term"]: t["rendering"] for t in x["terms"]} == terms, case
        assert M.parse(x["body"]).inner() == body
    assert responses.read(rows.limit(0), "answer", ("id",)).collect() == []
    plan = responses.read(rows, "answer", ("id",))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
