"""Phrases, title indexes, tails, ranges and replies against plain versions."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import replies as R
from quire.operators import nested as N
from quire.operators import packing as P
from quire.operators import phrases
from quire.operators import selection as S
from quire.plans.completer import FINISHED, retry_delay, unusable
from quire.plans.settings import Settings


def leftmost_longest(text, table, skip=()):
    out, at = [], 0
    while at < len(text):
        stop = next((b for a, b in skip if a <= at < b), None)
        if stop:
            out.append(text[at:stop])
            at = stop
            continue
        end = next((a for a, _ in skip if a > at), len(text))
        best = max((p for p in table if text.startswith(p, at) and at + len(p) <= end), key=len, default=None)
        out.append(table[best] if best else text[at])
        at += len(best) if best else 1
    return "".join(out)


@pytest.mark.parametrize("block", (32 << 20, 300))
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    r = random.Random(block)
    word = lambda n: "".join(r.choice("ab软件 ") for _ in range(r.randint(1, n)))
    table = {word(5): f"<{i}>" for i in range(25)}
    texts = [None, "", "zzz"] + [word(80) for _ in range(300)] + ["ab" * 50_000]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, body string, phrase int").repartition(3)
    given = spark.createDataFrame([*table.items(), ("", "never"), (None, "x"), (next(iter(table)), "~")], "phrase string, rendering string")
    got = phrases.convert(rows, "body", given).collect()
    assert len(got) == len(texts) and all(x["phrase"] == x["id"] for x in got)
    for x in got:
        want = None if texts[x["id"]] is None else leftmost_longest(texts[x["id"]], table)
        assert x["body"] == want
    assert phrases.convert(rows.limit(0), "body", given).collect() == [] and phrases.convert(rows, "body", given.limit(0)).count() == len(texts)


def test_phrases_pass_over_code(spark):
    import re

    table = {"软件": "軟體", "a": "1", "軟": "x", "ab": "2"}
    text = "软件 ab <b a='ab'>a</b><pre>软件 <code>a</code></pre>ab<!-- a --><code class='k'>ab</code> a <script>a</script>a<code>a"
    skip = [m.span() for m in re.finditer(r"<!--.*?-->|<pre>.*?</pre>|<code class='k'>.*?</code>|<script>.*?</script>|<code>a$|<[^>]*>", text)]
    rows = spark.createDataFrame([(text,)], "t string")
    given = spark.createDataFrame(list(table.items()), "phrase string, rendering string")
    assert phrases.convert(rows, "t", given, markup=True).first()["t"] == leftmost_longest(text, table, skip)


def test_titles(spark):
    r = random.Random(1)
    titles = [(b, i, None if r.random() < 0.05 else "".join(r.choice("abAB ßü") for _ in range(r.randint(0, 9)))) for b in range(30) for i in range(r.randint(1, 12))]
    patterns = ["", "a", "AB", "ß", "abc", "b a", *{"".join(r.choice("abAB ü") for _ in range(r.randint(1, 5))) for _ in range(60)}]
    chapters = spark.createDataFrame(titles, "book_id int, idx int, title string")
    found = S.title_matches(chapters, spark.createDataFrame([(p,) for p in [*patterns, patterns[3]]], "pattern string"))
    want = set()
    for p in patterns:
        for b in range(30):
            own = [i for book, i, t in titles if book == b and t is not None and p.lower() in t.lower()]
            if len(own) == 1:
                want.add((b, p, own[0]))
    got = [tuple(x) for x in found.select("book_id", "pattern", "idx").collect()]
    assert len(got) == len(want) and set(got) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_tails(spark):
    r = random.Random(2)
    rows = [(g, i, r.choice(("", None, "x" * r.randint(1, 9), "[[IMG_1]]", "a[[CODE_2]]b", "ü" * 50))) for g in range(12) for i in range(r.choice((1, 5, 80)))]
    rows += [(99, i, "") for i in range(3000)] + [(98, i, "y") for i in range(3000)]
    got = {(x["g"], x["i"]): x["tail"] for x in P.previous_parts(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t", 25).collect()}
    assert len(got) == len(rows)
    import re

    so_far = {}
    for g, i, t in rows:
        assert got[g, i] == so_far.get(g, "")
        so_far[g] = (so_far.get(g, "") + re.sub(N.T.TOKEN, "", t or ""))[-25:]


def test_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 4999).alias("x")).union(spark.createDataFrame([(None,)], "x bigint"))
    got = P.ranged(rows, "x", 300).groupBy("_range").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).orderBy("_range").collect()
    assert got[0]["_range"] == -1 and got[0]["a"] is None and len(got) > 200
    assert all(x["b"] < y["a"] for x, y in zip(got[1:], got[2:])) and max(x["n"] for x in got) < 100


def test_replies(spark):
    texts, reasons = [None, "", " \n", "x"], [None, "stop", "end_turn", "length", "content_filter"]
    rows = spark.createDataFrame([(f, t) for f in reasons for t in texts], "f string, t string")
    for x in rows.withColumn("ok", R.usable(F.col("f"), F.col("t"))).collect():
        assert x["ok"] == (unusable(x["f"], x["t"]) is None)
    assert set(FINISHED) == {None, "stop", "end_turn"}
    urls = ["http://localhost:11434/v1", "https://[::1]:11434/v1/", "http://127.0.0.1:11434/v1//", "http://localhost/v1", "http://u@localhost:11434/v1", "http://localhost:11434/v1?x", "http://e.org:11434/v1", ""]
    made = [(u, m, v, i, o) for u in urls for m in ("m", "m-Cloud") for v in ("", "v-cloud") for i in (0.0, 1.0) for o in (0.0, 2.0)]
    rows = spark.createDataFrame(made, "u string, m string, v string, i double, o double")
    c = F.col
    for x in rows.withColumns({"l": R.local_endpoint(c("u"), c("m")), "p": R.priced(c("u"), c("m"), c("v"), c("i"), c("o"))}).collect():
        s = Settings(base_url=x["u"], model=x["m"], vision_model=x["v"], input_price=x["i"], output_price=x["o"])
        assert (x["l"], x["p"]) == (s.local(), s.priced(True)), x
    now = datetime(2026, 1, 1, tzinfo=UTC)
    asked = ["3", "-1", "99999", "2.5", "Thu, 01 Jan 2026 00:01:00 GMT", "Wed, 21 Oct 2015 07:28:00 GMT"]
    rows = spark.createDataFrame([(a, n) for a in [*asked, "soon", None] for n in (0, 3, 9)], "a string, n int")
    for x in rows.withColumn("d", R.retry_delay(c("a"), c("n"), F.lit("2026-01-01").cast("timestamp"))).collect():
        want = retry_delay(x["a"], x["n"], now)
        assert x["d"] == (want if x["a"] in asked else min(60.0, 2.0 ** x["n"])), x


def test_repaired(spark):
    cases = [("a[[IMG_1]]b[[IMG_1]][[IMG_9]]c", ["[[IMG_1]]", "[[IMG_2]]"], "a[[IMG_1]]bc", ["[[IMG_2]]"]), ("", [], "", []), ("x", ["[[CODE_1]]"], "x", ["[[CODE_1]]"]), ("[[CODE_2]][[CODE_1]]", ["[[CODE_1]]", "[[CODE_2]]"], "[[CODE_2]][[CODE_1]]", [])]
    rows = spark.createDataFrame([(t, e) for t, e, _, _ in cases], "t string, e array<string>")
    for x, (_, _, text, missing) in zip(rows.coalesce(1).select(N.repaired(F.col("t"), F.col("e")).alias("r")).collect(), cases):
        assert (x["r"]["text"], x["r"]["missing"]) == (text, missing)


def test_the_index_of_titles_is_not_gathered(spark):
    """Neither the index nor the patterns' runs are broadcast, however small their tables look."""
    from quire.plans import catalog

    plan = catalog.j24_title_match(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" in plan


def test_patterns_that_share_their_beginnings(spark):
    """Numbers have few runs of three characters between them; candidates stay in proportion to what is found."""
    titles = spark.range(1, 3001).selectExpr("1 as book_id", "id as idx", "concat('part of #', id) as title")
    found = S.title_matches(titles, titles.selectExpr("concat('#', idx) as pattern")).collect()
    want = {f"#{n}": n for n in range(301, 3001)}
    assert {r["pattern"]: r["idx"] for r in found} == want
    assert S.title_matches(titles, titles.selectExpr("cast(null as string) as pattern")).collect() == []
