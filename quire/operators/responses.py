"""Answers of a summary section and a glossary list, read and judged as rows of tags.

Well-formedness is decided by Spark's own XML reader; all else are depths, windows and aggregates over
``quire.operators.nested.tags``, an answer being one group of rows.  What is wrong with an answer is a column, the
first of the rules that it breaks; markup is taken over as it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators import nested as N

#: Elements that generated markup may not have.
FORBIDDEN = ("script", "style", "img", "svg", "object", "iframe", "link")
NO_DOCUMENT_TYPE, NOT_WELL_FORMED = "answers may define no document type or entities", "the answer is no well-formed XHTML; give the two elements and nothing around them"
NOT_TWO, LACKING = "the answer must be one section and one dl", "the summary section, its data-title or the glossary dl is missing"
ELEMENT, HANDLER, SCHEME = "generated scripts, styles or pictures; use placeholders", "generated event handlers", "generated href of an unsafe scheme"
NOT_PAIRS, EMPTY = "dt and dd must come in pairs", "a term or its rendering is empty"


def _attribute(name: str) -> Column:
    value = F.regexp_extract("tag", rf"""(?s)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(value != "", _plain(F.substring(value, F.lit(2), F.length(value) - 2)))


def _plain(text: Column) -> Column:
    """The five predefined entities; numeric references stay as written."""
    return T.unescape(F.replace(text, F.lit("&apos;"), F.lit("'")))


def read(rows: DataFrame, response: str, keep: tuple[str, ...], existing: str | None = None) -> DataFrame:
    """``keep``, ``error`` (null if all is well), ``title``, ``body`` (inside the section) and ``terms
    array<struct<term, rendering>>``; ``existing`` names a map column of renderings that terms have already.

    A missing answer is an empty one, which isn't the two elements.  Repeated rows each have a row.
    """
    known = F.col(existing) if existing else F.lit(None).cast("map<string,string>")
    text = F.coalesce(F.col(response).cast("string"), F.lit(""))
    parsed = F.from_xml(F.concat(F.lit("<root>"), text, F.lit("</root>")), "section struct<_x: string>, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    typed = F.upper(text).rlike("<!(?:DOCTYPE|ENTITY)")
    wrong = F.when(typed, NO_DOCUMENT_TYPE).when(parsed.isNull() | parsed["_corrupt_record"].isNotNull(), NOT_WELL_FORMED)
    x = N.tags(rows.select(*keep, known.alias("_known"), text.alias("_response"), wrong.alias("_wrong")), "_response", (*keep, "_known", "_wrong"))
    over, whole = Window.partitionBy("_doc").orderBy("n"), Window.partitionBy("_doc")
    so_far = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("name").isin(*N.VOID), 0).when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    starts, named = F.col("kind") != "close", F.col("name") != ""
    x = x.withColumn("_step", step).withColumn("_after", F.sum("_step").over(so_far)).withColumn("_depth", F.col("_after") - F.col("_step"))
    top = starts & named & (F.col("_depth") == 0)
    x = x.withColumns({"_top": top, "_part": F.count_if(top).over(so_far)})
    one = lambda name, role: F.when(F.col("_top") & (F.col("name") == name) & (_attribute("data-role") == role), F.col("_part"))
    x = x.withColumns({"_section": F.min(one("section", "summary")).over(whole), "_list": F.min(one("dl", "glossary")).over(whole)})
    in_section, in_list = F.col("_part") == F.col("_section"), F.col("_part") == F.col("_list")
    entry = in_list & starts & (F.col("_depth") == 1) & F.col("name").isin("dt", "dd")
    x = x.withColumn("_entry", F.count_if(entry).over(so_far)).withColumn("_entry_before", F.lag("_entry", 1, 0).over(over))
    inside, deeper = F.col("_depth") >= 1, in_section & (F.col("_depth") >= 1) & starts & named
    broken = F.when(deeper & F.col("name").isin(*FORBIDDEN), F.struct("n", F.lit(0).alias("k"), F.lit(ELEMENT).alias("m")))
    broken = broken.when(deeper & F.col("tag").rlike(r"(?i)\son[^\s=>]*\s*="), F.struct("n", F.lit(1).alias("k"), F.lit(HANDLER).alias("m")))
    broken = broken.when(deeper & F.lower(_attribute("href")).rlike("^(?:javascript|data):"), F.struct("n", F.lit(2).alias("k"), F.lit(SCHEME).alias("m")))
    own_tag = F.when((F.col("_after") >= 1) & ~F.col("_top"), F.col("tag")).otherwise("")
    piece = F.when(in_section & (inside | (F.col("_after") >= 1)), F.struct("n", F.concat(F.when(inside, F.col("text")).otherwise(""), own_tag).alias("s")))
    said = F.when(in_list & (F.col("_depth") >= 2) & (F.col("text") != ""), F.struct(F.col("_entry_before").alias("e"), "n", _plain(F.col("text")).alias("s")))
    docs = x.groupBy("_doc", *keep, "_wrong").agg(
        F.first("_known").alias("_known"), F.count_if("_top").alias("_tops"), F.max((F.col("_depth") == 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")).alias("_around"),
        F.max(F.when(F.col("_top") & in_section, _attribute("data-title"))).alias("title"), F.max("_list").alias("_list"), F.min(broken).alias("_broken"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "").alias("body"),
        F.array_sort(F.collect_list(F.when(entry, F.struct(F.col("_entry").alias("e"), "name")))).alias("_entries"), F.array_sort(F.collect_list(said)).alias("_said"),
    )
    texts = F.transform("_entries", lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(F.filter("_said", lambda t: t["e"] == e["e"]), lambda t: t["s"]), ""), r"^\s+|\s+$", "")))
    paired = (F.size("_entries") % 2 == 0) & F.forall(F.transform("_entries", lambda e, i: e["name"] == F.when(i % 2 == 0, "dt").otherwise("dd")), lambda ok: ok)
    docs = docs.withColumn("_texts", texts)
    pairs = F.when(F.size("_texts") >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size("_texts") / 2).cast("int") - 1), lambda i: F.struct(F.get("_texts", 2 * i).alias("term"), F.get("_texts", 2 * i + 1).alias("rendering")))).otherwise(F.array().cast("array<struct<term: string, rendering: string>>"))
    docs = docs.withColumn("terms", pairs)
    old = lambda p: F.when(F.col("_known").isNotNull(), F.try_element_at("_known", p["term"]))
    fault = lambda p: F.when((p["term"] == "") | (p["rendering"] == ""), EMPTY).when(F.coalesce(old(p) != p["rendering"], F.lit(False)), F.concat(F.lit("term conflict: '"), p["term"], F.lit("' is '"), old(p), F.lit("' already")))
    faults = F.filter(F.transform("terms", fault), lambda m: m.isNotNull())
    error = F.coalesce("_wrong", F.when((F.col("_tops") != 2) | F.col("_around"), NOT_TWO), F.when(F.col("title").isNull() | (F.col("title") == "") | F.col("_list").isNull(), LACKING), F.col("_broken.m"), F.when(~paired, NOT_PAIRS), F.get(faults, F.lit(0)))
    docs = docs.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return docs.select(*keep, "error", good("title"), good("body"), good("terms"))
