"""Markup as nested sets: tags are rows with places, elements are intervals, ancestors are interval tests.

A document is cut at its tags by one expression inside the JVM.  Depths are running sums of opening and closing
tags, per name (or per set of names), so that an element that is never closed disturbs no other: an end tag closes
the last open element of its own name, one without any is ignored, and an element without an end tag stands for its
tag alone.  Comments, declarations, CDATA, scripts and styles are single tags whatever is inside them.  Text and
tags are taken over as they are written.

All of it is one exchange by document, windows and aggregates: no Python, and nothing wider than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T

#: A tag, comment or declaration, and whole scripts and styles; for Java's and for RE2's expressions.
TAG = r"""(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<[!?][^>]*>|</?[a-z][^\s/>"']*[^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*>"""
NAME = r"^</?([A-Za-z][^\s/>]*)"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "script", "style")
WRAPPERS = ("section", "div", "article", "main", "body")
BLOCKS = ("figure", "pre", "div", "section")
#: Documents are dealt over at least so many partitions, as a task sorts the tags of its documents several times.
LEAST_PARTITIONS = 64
_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def weight(text: Column) -> Column:
    """A size that adds up: a third of it, rounded up, is the estimate of tokens."""
    return (6 * F.length(text) - 5 * T.ascii_count(text)).cast("bigint")


def tags(rows: DataFrame, markup: str, keep: tuple[str, ...]) -> DataFrame:
    """A row a tag and one for the end of each document: ``keep``, ``_doc``, ``n`` (from 0), ``text`` before the
    tag, ``tag`` (empty at the end), ``name`` in lower case, ``kind`` (open, close, whole) and ``at``, the code
    point that the text begins at.

    Rows are documents, also those alike; a missing markup is empty.  The one exchange deals whole documents, before
    their tags become rows.  Its partitions have a number, so they aren't merged by the size of what is compressed
    there, which tags and their windows exceed many times.
    """
    source = F.coalesce(F.col(markup).cast("string"), F.lit(""))
    docs = rows.select(*keep, F.monotonically_increasing_id().alias("_doc"), source.alias("_markup"))
    docs = docs.repartition(max(LEAST_PARTITIONS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_doc")
    cut = F.arrays_zip(F.split("_markup", TAG, -1).alias("text"), F.regexp_extract_all("_markup", F.lit(TAG), F.lit(0)).alias("tag"))
    out = docs.select(*keep, "_doc", F.posexplode(cut).alias("n", "x")).select(*keep, "_doc", F.col("n").cast("bigint").alias("n"), "x.text", F.coalesce("x.tag", F.lit("")).alias("tag"))
    out = out.withColumn("name", F.lower(F.regexp_extract("tag", NAME, 1)))
    whole = F.col("name").isin("", *VOID) | F.col("tag").rlike(r"/\s*>$")
    out = out.withColumn("kind", F.when(F.col("tag").startswith("</"), "close").when(whole, "whole").otherwise("open"))
    before = Window.partitionBy("_doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("at", F.coalesce(F.sum(F.length("text") + F.length("tag")).over(before), F.lit(0)))


def depths(events: DataFrame, opens: Column, closes: Column, by: tuple[str, ...], prefix: str) -> DataFrame:
    """``{prefix}_before`` and ``{prefix}_after``: how many elements are open around each row; end tags without an
    element count for nothing."""
    window = Window.partitionBy("_doc", *by).orderBy("n")
    so_far = window.rowsBetween(*_RUNNING)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    out = events.withColumn("_s", F.sum(step).over(so_far))
    out = out.withColumn(f"{prefix}_after", F.col("_s") - F.least(F.min("_s").over(so_far), F.lit(0))).drop("_s")
    return out.withColumn(f"{prefix}_before", F.lag(f"{prefix}_after", 1, 0).over(window))


def matched(events: DataFrame) -> DataFrame:
    """``level`` among open elements of one name, and ``other``: the row of an element's other tag, if it has one."""
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    out = depths(events, opens, closes, ("name",), "_own")
    level = F.when(opens, F.col("_own_after")).when(closes & (F.col("_own_before") > 0), F.col("_own_before"))
    pair = Window.partitionBy("_doc", "name", "level").orderBy("n")
    other = F.when(opens & level.isNotNull(), F.lead("n").over(pair)).when(closes & level.isNotNull(), F.lag("n").over(pair))
    return out.withColumn("level", level).withColumn("other", other).drop("_own_before", "_own_after")


def elements(rows: DataFrame, markup: str, keep: tuple[str, ...]) -> DataFrame:
    """Nested sets: ``keep``, ``n``, ``name``, ``level`` among elements of the name, ``begins`` and ``ends`` (code
    points; the tag alone where nothing closes it) and ``closed``."""
    found = matched(tags(rows, markup, keep)).withColumn("_tag", F.col("at") + F.length("text"))
    found = found.withColumn("_end", F.col("_tag") + F.length("tag"))
    last = F.lead("_end").over(Window.partitionBy("_doc", "name", "level").orderBy("n"))
    ends = F.when(F.col("other").isNotNull(), last).otherwise(F.col("_end"))
    return found.withColumn("ends", ends).where((F.col("name") != "") & F.col("kind").isin("open", "whole")).select(
        *keep, "n", "name", F.coalesce("level", F.lit(0)).cast("bigint").alias("level"), F.col("_tag").alias("begins"), "ends", F.col("other").isNotNull().alias("closed"))


def protect(
    rows: DataFrame, markup: str, keep: tuple[str, ...], figures: tuple[str, ...] = ("figure",), images: tuple[str, ...] = ("img",), code: tuple[str, ...] = ("pre", "code"), media: tuple[str, ...] = ("svg", "object"),
) -> DataFrame:
    """Figures, images, code and media give way to placeholders on lines of their own: ``keep``, ``xhtml``, and
    ``held array<struct<number, token, markup>>``; ``error`` where the source holds placeholders already.

    Numbers run through figures (nested ones too), then images outside them, then the outermost code and media.
    Figures and images inside code have placeholders inside what is held for it.
    """
    name, kind = F.col("name"), F.col("kind")
    is_figure, is_image, is_atom = name.isin(*figures), name.isin(*images), name.isin(*code, *media)
    opens, closes, whole = kind == "open", kind == "close", kind == "whole"
    over = Window.partitionBy("_doc").orderBy("n")
    so_far, all_ = over.rowsBetween(*_RUNNING), Window.partitionBy("_doc")
    x = depths(tags(rows, markup, keep), opens & is_figure, closes & is_figure, (), "f")
    inside = (F.col("f_before") > 0) | (F.col("f_after") > 0)
    out_of_figures = ~inside & ~(whole & is_figure)
    x = depths(x, opens & is_atom & out_of_figures, closes & is_atom & out_of_figures, (), "a")
    x = x.withColumns({
        "_figure": (opens | whole) & is_figure, "_figures": (F.col("f_before") == 0) & is_figure & (whole | opens),
        "_image": ~closes & is_image & out_of_figures, "_atom": (F.col("a_before") == 0) & is_atom & out_of_figures & (opens | whole),
    })
    count = lambda c, w: F.count_if(F.col(c)).over(w)
    x = x.withColumns({"_f": count("_figure", so_far), "_group": count("_figures", so_far), "_i": count("_figure", all_) + count("_image", so_far), "_a": count("_figure", all_) + count("_image", all_) + count("_atom", so_far)})
    group = Window.partitionBy("_doc", "_group")
    in_figure = inside | (whole & is_figure)
    first = F.min(F.when(F.col("_figures"), F.col("_f"))).over(group)  # the outermost figure's number
    pictured = F.count_if(in_figure & ~closes & is_image).over(group) > 0
    in_atom = (F.col("a_before") > 0) | (F.col("a_after") > 0) | F.col("_atom")
    x = x.withColumns({"_first": first, "_pictured": pictured})
    figure_kind = F.when(F.col("_pictured"), "IMG").otherwise("MEDIA")
    atom_kind = F.when(name.isin(*code), "CODE").otherwise("MEDIA")
    token = lambda k, n: F.format_string("[[%s_%d]]", k, n)
    mark = F.when(F.col("_figures"), token(figure_kind, F.col("_f"))).when(F.col("_image"), token(F.lit("IMG"), F.col("_i"))).when(F.col("_atom"), token(atom_kind, F.col("_a")))
    lines = F.concat(F.lit("\n"), mark, F.lit("\n"))
    text_of = F.when(F.col("f_before") > 0, F.col("_first")).when(F.col("a_before") > 0, F.col("_a")).otherwise(0)
    tag_of = F.when(in_figure, F.col("_first")).when(F.col("_image"), F.col("_i")).when(in_atom, F.col("_a")).otherwise(0)
    mark_of = F.when(F.col("_atom") | ~in_atom, 0).otherwise(F.col("_a"))
    piece = lambda of, k, s, t: F.struct(of.cast("bigint").alias("number"), F.lit(k).alias("k"), s.alias("s"), t.alias("token"))
    none = F.lit(None).cast("string")
    made = F.array(piece(text_of, 0, F.col("text"), none), piece(F.when(mark.isNotNull(), mark_of), 1, lines, none), piece(tag_of, 2, F.col("tag"), mark))
    made = F.when(mark.isNull() & (text_of == tag_of), F.array(piece(text_of, 0, F.concat("text", "tag"), none))).otherwise(made)  # one piece for most rows
    held = F.col("text").rlike(T.TOKEN)
    pieces = x.select(*keep, "_doc", "n", held.alias("_held"), F.explode(made).alias("p")).where("p.number is not null")
    parts = pieces.groupBy("_doc", *keep, "p.number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p.k", "p.s"))), lambda y: y["s"]), "").alias("markup"), F.min(F.when(F.col("p.k") == 2, F.struct("n", "p.token"))).alias("token"), F.max("_held").alias("_held"))
    is_text = F.col("number") == 0
    docs = parts.groupBy("_doc", *keep).agg(
        F.coalesce(F.max(F.when(is_text, F.col("markup"))), F.lit("")).alias("xhtml"),
        F.array_sort(F.collect_list(F.when(~is_text, F.struct("number", F.col("token.token").alias("token"), "markup")))).alias("held"), F.max("_held").alias("_held"))
    return docs.select(*keep, "xhtml", "held", F.when(F.col("_held"), "the source already holds placeholders").alias("error"))


def restore(rows: DataFrame, xhtml: str, held: str, keep: tuple[str, ...]) -> DataFrame:
    """Puts what is held back, twice over, as code may hold figures: ``keep``, ``restored``, and ``error`` where a
    placeholder has nothing held for it.  Paragraphs around blocks give way to what they hold."""
    by_token = F.map_from_entries(F.transform(held, lambda h: F.struct(h["token"], h["markup"])))

    def put(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(T.TOKEN), F.lit(0))
        each = F.arrays_zip(F.split(text, T.TOKEN, -1).alias("a"), found.alias("t"))
        return F.array_join(F.transform(each, lambda x: F.concat(x["a"], F.coalesce(F.try_element_at(F.col("_map"), x["t"]), x["t"], F.lit("")))), "")

    base = rows.select(*keep, F.col(xhtml).alias("_x"), by_token.alias("_map"))
    once = base.withColumn("_once", put(F.col("_x")))
    lost = F.filter(F.regexp_extract_all("_once", F.lit(T.TOKEN), F.lit(0)), lambda t: ~F.map_contains_key(F.col("_map"), t))
    twice = once.withColumn("_lost", F.get(lost, F.lit(0))).withColumn("_twice", put(F.col("_once")))
    whole = _without_paragraphs(twice.select(*keep, "_lost", "_twice"), (*keep, "_lost"))
    return whole.select(*keep, F.when(F.col("_lost").isNull(), F.col("restored")).alias("restored"), F.when(F.col("_lost").isNotNull(), F.concat(F.lit("no object is held for "), "_lost")).alias("error"))


def _without_paragraphs(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``restored``: ``_twice`` without the tags of paragraphs that hold blocks."""
    x = matched(tags(rows, "_twice", keep))
    so_far = Window.partitionBy("_doc").orderBy("n").rowsBetween(*_RUNNING)
    x = x.withColumn("_blocks", F.count_if(F.col("name").isin(*BLOCKS) & (F.col("kind") != "close")).over(so_far))
    pair = Window.partitionBy("_doc", "name", "level").orderBy("n")
    inside = F.when(F.col("kind") == "open", F.lead("_blocks").over(pair) - F.col("_blocks")).when(F.col("kind") == "close", F.col("_blocks") - F.lag("_blocks").over(pair))
    gone = (F.col("name") == "p") & F.col("other").isNotNull() & (inside > 0)
    x = x.withColumn("_s", F.when(gone, F.col("text")).otherwise(F.concat("text", "tag")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_s"))), lambda y: y["_s"]), "")
    return x.groupBy("_doc", *keep).agg(joined.alias("restored"))


def canonicalized(rows: DataFrame, xhtml: str, expected: str, keep: tuple[str, ...]) -> DataFrame:
    """Placeholders of texts (columns ``xhtml`` and ``expected``, an array) stay where they are and take the expected
    names in order: ``keep``, ``xhtml``.  Surplus ones go, lacking ones come at the end on lines of their own; those in
    attributes are cut out, with the attribute where nothing else is left in it."""
    x = tags(rows.select(*keep, F.col(xhtml).alias("_x"), F.col(expected).alias("_expected")), "_x", (*keep, "_expected"))
    over = Window.partitionBy("_doc").orderBy("n")
    found = F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))
    x = x.withColumn("_many", F.size(found)).withColumn("_upto", F.sum("_many").over(over.rowsBetween(*_RUNNING)).cast("int"))
    each = F.arrays_zip(F.split("text", T.TOKEN, -1).alias("a"), found.alias("t"))
    named = F.transform(each, lambda y, i: F.concat(y["a"], F.when(y["t"].isNotNull(), F.coalesce(F.get("_expected", F.col("_upto") - F.col("_many") + i), F.lit(""))).otherwise("")))
    value = rf"""\s+[^\s=<>"'/]+\s*=\s*(?:"\s*(?:{T.TOKEN}\s*)+"|'\s*(?:{T.TOKEN}\s*)+'|(?:{T.TOKEN})+)"""
    cut = F.regexp_replace(F.regexp_replace("tag", value, ""), rf"""(?<=["'])\s*(?:{T.TOKEN}\s*)+|(?:\s*{T.TOKEN})+\s*(?=["'])|{T.TOKEN}""", "")
    tag = F.when(F.col("tag").rlike(T.TOKEN) & (F.col("name") != ""), cut).otherwise(F.col("tag"))
    x = x.withColumn("_s", F.concat(F.when(F.col("_many") > 0, F.array_join(named, "")).otherwise(F.col("text")), tag))
    docs = x.groupBy("_doc", *keep, "_expected").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_s"))), lambda y: y["_s"]), "").alias("xhtml"), F.max("_upto").alias("_upto"))
    rest = F.slice("_expected", F.col("_upto") + 1, F.size("_expected"))
    return docs.select(*keep, F.when(F.size("_expected") > F.col("_upto"), F.concat("xhtml", F.lit("\n"), F.array_join(rest, "\n"), F.lit("\n"))).otherwise(F.col("xhtml")).alias("xhtml"))


def repaired(text: Column, expected: Column) -> Column:
    """A struct of the text without placeholders that aren't expected or come again (``text``), and of those expected
    that it lacks (``missing``), in their order."""
    found, rest = F.regexp_extract_all(text, F.lit(T.TOKEN), F.lit(0)), F.split(text, T.TOKEN, -1)

    def joined(x: Column) -> Column:
        first = lambda t, i: F.array_contains(expected, t) & (F.array_position(x["found"], t) == i + 1)
        each = F.transform(F.arrays_zip(x["rest"].alias("a"), x["found"].alias("t")), lambda y, i: F.concat(y["a"], F.when(first(y["t"], i), y["t"]).otherwise("")))
        return F.struct(F.array_join(each, "").alias("text"), F.array_except(expected, x["found"]).alias("missing"))

    return F.transform(F.array(F.struct(found.alias("found"), rest.alias("rest"))), joined)[0]


def units(rows: DataFrame, markup: str, keep: tuple[str, ...], limit: int, wrappers: tuple[str, ...] = WRAPPERS, held: str | None = None) -> DataFrame:
    """The smallest pieces that a document over the limit is cut into: ``keep``, ``_doc``, ``unit`` (from 1),
    ``weight``, ``shells`` (struct<name, tag> of the wrappers around it, outermost first), ``xhtml``.

    Only wrappers over the limit are opened, and only where no element but such wrappers is around them.  ``held``
    names a column of held markup (as ``protect`` gives it), whose sizes stand for placeholders'.
    """
    also = (held,) if held else ()
    x = matched(tags(rows, markup, (*keep, *also)))
    if held:
        size = lambda t: F.aggregate(F.filter(held, lambda h: h["token"] == t), F.lit(0).cast("bigint"), lambda n, h: n + weight(h["markup"]) - weight(h["token"]))
        more = F.aggregate(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)), F.lit(0).cast("bigint"), lambda n, t: n + size(t))
        x = x.withColumn("_text", weight(F.col("text")) + more)
    else:
        x = x.withColumn("_text", weight(F.col("text")))
    x = x.withColumn("_tag", weight(F.col("tag")))
    over = Window.partitionBy("_doc").orderBy("n")
    so_far, pair = over.rowsBetween(*_RUNNING), Window.partitionBy("_doc", "name", "level").orderBy("n")
    pairs = F.col("other").isNotNull()
    is_wrapper, step = F.col("name").isin(*wrappers), F.when(F.col("kind") == "open", 1).otherwise(-1)
    x = x.withColumns({"_upto": F.sum(F.col("_text") + F.col("_tag")).over(so_far), "_solid": F.sum(F.when(pairs & ~is_wrapper, step).otherwise(0)).over(so_far), "_all": F.sum(F.col("_text") + F.col("_tag")).over(Window.partitionBy("_doc"))})
    both = F.when(F.col("kind") == "open", F.lead("_upto").over(pair) - F.col("_upto") + F.col("_tag")).when(F.col("kind") == "close", F.col("_upto") - F.lag("_upto").over(pair) + F.lag("_tag").over(pair))
    free = F.when(F.col("kind") == "open", F.greatest("_solid", F.lead("_solid").over(pair))).otherwise(F.greatest("_solid", F.lag("_solid").over(pair)))
    x = x.withColumn("_shell", F.coalesce(pairs & is_wrapper & (free == 0) & (F.floor((both + 2) / 3) > limit) & (F.floor((F.col("_all") + 2) / 3) > limit), F.lit(False)))
    closed = F.sum(F.when(pairs & ~F.col("_shell"), step).otherwise(0)).over(so_far)
    x = x.withColumn("_cover", closed)
    x = x.withColumn("_before", F.lag("_cover", 1, 0).over(over))
    whole = F.floor((F.col("_all") + 2) / 3) <= limit
    text_new, tag_new = (F.col("_before") == 0) & (F.col("text") != ""), (F.col("_before") == 0) & (F.col("tag") != "") & ~F.col("_shell")
    first = F.col("n") == 0
    x = x.withColumns({"_new_text": F.when(whole, first).otherwise(text_new), "_new_tag": F.when(whole, F.lit(False)).otherwise(tag_new)})
    x = x.withColumn("_unit", F.sum(F.col("_new_text").cast("int") + F.col("_new_tag").cast("int")).over(so_far).cast("bigint"))
    piece = lambda u, k, s, w: F.struct(u.cast("bigint").alias("unit"), F.lit(k).alias("k"), s.alias("s"), w.alias("w"))
    text_unit = F.col("_unit") - F.col("_new_tag").cast("int")
    made = F.array(piece(text_unit, 0, F.col("text"), F.col("_text")), piece(F.when(~F.col("_shell"), F.col("_unit")), 1, F.col("tag"), F.col("_tag")))
    joint = ~F.col("_new_tag") & ~F.col("_shell")
    made = F.when(joint, F.array(piece(F.col("_unit"), 0, F.concat("text", "tag"), F.col("_text") + F.col("_tag")))).otherwise(made)  # one piece for most rows
    shell = F.when(F.col("_shell") & (F.col("kind") == "open"), F.struct("n", "other", "name", "tag", (F.col("_unit") + 1).alias("first")))
    pieces = x.select(*keep, "_doc", "n", shell.alias("_wrapper"), F.explode(made).alias("p")).where("p.s <> '' and (p.unit is not null or p.k = 1)")
    out = pieces.groupBy("_doc", *keep, F.col("p.unit").alias("unit")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p.k", "p.s"))), lambda y: y["s"]), "").alias("xhtml"), F.sum("p.w").alias("weight"), F.min("n").alias("n"),
        F.collect_list(F.when(F.col("p.unit").isNull(), F.col("_wrapper"))).alias("_shells"))
    out = out.withColumn("_shells", F.max("_shells").over(Window.partitionBy("_doc"))).where("unit is not null")
    around = F.array_sort(F.filter("_shells", lambda s: (s["n"] < F.col("n")) & (s["other"] >= F.col("n"))))
    without = lambda t: F.regexp_replace(t, r"""(?i)\s+id\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", "")
    named = F.transform(around, lambda s: F.struct(s["name"].alias("name"), F.when(s["first"] == F.col("unit"), s["tag"]).otherwise(without(s["tag"])).alias("tag")))
    return out.withColumn("shells", named).select(*keep, "_doc", "unit", "weight", "shells", "xhtml")


def split(rows: DataFrame, markup: str, keep: tuple[str, ...], limit: int = 20_000, wrappers: tuple[str, ...] = WRAPPERS, held: str | None = None) -> DataFrame:
    """Parts of at most about ``limit`` estimated tokens, cut between whole blocks; a heading without
    wrappers around it begins a part:
    ``keep``, ``part`` (from 1), ``xhtml``, ``error`` where a block that can't be divided is over the limit.

    A document is one row of the input and one group of units here.  Empty documents have no part.
    """
    from quire.operators.packing import pack_weights

    pieces = units(rows, markup, keep, limit, wrappers, held)
    opens = F.array_join(F.transform("shells", lambda s: s["tag"]), "")
    closes = F.array_join(F.transform(F.reverse("shells"), lambda s: F.concat(F.lit("</"), s["name"], F.lit(">"))), "")
    heading = F.concat(opens, "xhtml").rlike(r"(?i)^\s*<h[12][\s>]")
    shelled = pieces.withColumns({"s": F.concat(opens, "xhtml", closes), "w": F.col("weight") + weight(F.concat(opens, closes)), "heading": heading, "over": F.floor((F.col("weight") + 2) / 3) > limit})
    docs = shelled.groupBy("_doc", *keep).agg(F.array_sort(F.collect_list(F.struct("unit", "w", "heading", "s", "over"))).alias("u"))
    numbered = docs.select("_doc", *keep, F.explode(F.arrays_zip(F.col("u").alias("u"), pack_weights(F.transform("u", lambda u: F.struct(u["w"].alias("w"), u["heading"].alias("heading"))), limit).alias("part"))).alias("x"))
    rows_ = numbered.select("_doc", *keep, "x.part", F.col("x.u.unit").alias("unit"), F.col("x.u.s").alias("s"), F.col("x.u.over").alias("over"))
    parts = rows_.groupBy("_doc", *keep, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "s"))), lambda y: y["s"]), "").alias("xhtml"), F.max("over").alias("_over"))
    return parts.select(*keep, F.col("part").cast("bigint").alias("part"), "xhtml", F.when(F.col("_over"), "a block that can't be divided is over the limit").alias("error"))
