"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces, in SQL functions alone.

A paragraph is a line.  Its leaves are hashes of pieces of up to eight words that end early at a full stop, so
a tree tells where in a long paragraph a change lies.  A section is a run of paragraphs that ends after a
paragraph whose own hash says so; an inserted paragraph moves no later section's bounds.  Every node hashes its
children, the root the sections.  A fingerprint is written as

    root ':' section '=' leaf '.' leaf ',' leaf ... ';' section '=' ...

with '.' between leaves of a paragraph, ',' between paragraphs and ';' between sections.  Equal roots mean
equal texts; ``differing`` lists the sections in which two texts differ.

Defined results: null counts as the empty text, which has one section of one leaf.  Repeated rows have equal
fingerprints.  A missing doc_id comes last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.session import column, partitions

#: Up to eight words with the space around them, ending early at a word that closes a sentence.
PIECE = r"[ \t\n\x0B\f\r]*(?:[^ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r.!?][ \t\n\x0B\f\r]+){0,7}[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*"
#: A paragraph ends its section if its hash begins with one of these digits.
ENDS = "048c"
_LEAST = -(2**63)


def _hash(piece: Column) -> Column:
    return F.substring(F.md5(piece.cast("binary")), 1, 12)


def fingerprint(text: Column) -> Column:
    """The written tree of a text column."""

    def paragraph(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))
        blank = F.length(F.trim(p, F.lit(" \t\x0b\f\r"))) == 0
        return F.array_join(F.transform(F.when(blank, F.array(p)).otherwise(found), _hash), ".")

    nodes = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph)
    marked = F.transform(nodes, lambda p: F.concat(p, F.when(F.instr(F.lit(ENDS), F.substring(F.md5(p.cast("binary")), 1, 1)) > 0, F.lit(";")).otherwise(F.lit(","))))
    joined = F.regexp_replace(F.array_join(marked, ""), "[,;]$", "")
    sections = F.transform(F.split(joined, ";"), lambda s: F.concat(F.substring(F.sha2(s.cast("binary"), 256), 1, 16), F.lit("="), s))
    return F.array_join(F.transform(F.array(F.array_join(sections, ";")), lambda s: F.concat(F.sha2(F.regexp_replace(s, "=[^;]*", "").cast("binary"), 256), F.lit(":"), s)), "")


def leaves(tree: Column) -> Column:
    """The distinct leaves of a written tree."""
    return F.array_distinct(F.split(F.regexp_replace(F.substring(tree, 66, 1 << 30), "[0-9a-f]{16}=", ""), "[.,;]"))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 if the roots are equal, else twice the common leaves over both trees' leaves."""
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(leaf_likeness(leaves(a), leaves(b)))


def leaf_likeness(x: Column, y: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of the first tree that the second lacks."""
    own = lambda t: F.transform(F.split(F.substring(t, 66, 1 << 30), ";"), lambda s: F.substring(s, 1, 16))
    other = own(b)
    return F.filter(F.transform(own(a), lambda s, i: F.when(F.array_contains(other, s), F.lit(-1)).otherwise(i)), lambda i: i >= 0)


def bounds(keys: DataFrame, many: int) -> list[int]:
    """At most ``many`` values of ``key`` that cut it into ranges of about as many rows; the last is the largest.

    The number follows the number of partitions, not the rows.
    """
    shares = [(i + 1) / many for i in range(many)]
    row = keys.agg(F.percentile_approx("key", shares, 20 * many).alias("q"), F.max("key").alias("m")).first()
    return sorted({*(row["q"] or []), *([row["m"]] if row["m"] is not None else [])})


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, and ``following``: the text of the next document in descending doc_id, the first's after
    the last.  Rows of one doc_id are in descending order of their text.

    Documents are dealt by ranges of doc_id.  The last row of each range needs the first of the next lower
    one, so rows at a range's upper bound go to the range above as well: one shuffle of the texts, and no
    window over the whole table.
    """
    spark = docs.sparkSession
    key = F.coalesce(column(docs, "doc_id").cast("bigint"), F.lit(_LEAST))
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    cut = bounds(rows.select("key"), ranges or partitions(spark, 8))
    if not cut:
        return rows.select("doc_id", "text", F.lit("").alias("following"))
    step = max(1, int(len(cut) ** 0.5))
    groups = [cut[i : i + step] for i in range(0, len(cut), step)]
    coarse, fine = F.lit([g[-1] for g in groups]), F.lit([g + [g[-1]] * (step - len(g)) for g in groups])
    group = F.size(F.filter(coarse, lambda b: b < F.col("key")))
    rows = rows.withColumn("g", group)
    own = F.element_at(fine, F.col("g") + 1)
    rows = rows.withColumn("r", (F.col("g") * step + F.size(F.filter(own, lambda b: b < F.col("key")))).cast("int"))
    at_bound = F.col("key") == F.element_at(F.lit(cut), F.col("r") + 1)
    place = lambda r, extra: F.struct(r.cast("int").alias("range"), F.lit(extra).alias("extra"))
    above = F.when(F.col("r") + 1 < len(cut), F.col("r") + 1).otherwise(F.lit(0))
    dealt = rows.withColumn("place", F.explode(F.when(at_bound, F.array(place(F.col("r"), False), place(above, True))).otherwise(F.array(place(F.col("r"), False)))))
    dealt = dealt.select("doc_id", "text", "key", "place.range", "place.extra").repartition(partitions(spark), "range")
    order = Window.partitionBy("range").orderBy(F.col("extra").asc(), F.col("key").desc(), F.col("text").desc())
    return dealt.withColumn("following", F.lead("text").over(order)).where(~F.col("extra")).select("doc_id", "text", "following")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last half has given way to the beginning
    of the next document; and the likeness of both, and of the next document's fingerprint."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("following"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "text", "following", edited.alias("edited"))
    # Each tree is used more than once; the generator keeps them from being computed at each use.
    trees = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(*(fingerprint(F.col(c)).alias(c) for c in ("text", "edited", "following"))))).alias("t"))
    parts = trees.select("*", F.explode(F.array(F.struct(*(leaves(F.col(f"t.{c}")).alias(c) for c in ("text", "edited", "following"))))).alias("l"))
    near = lambda c: F.when(F.substring(F.col("t.text"), 1, 64) == F.substring(F.col(f"t.{c}"), 1, 64), F.lit(1.0)).otherwise(leaf_likeness(F.col("l.text"), F.col(f"l.{c}")))
    return parts.select("doc_id", "n_chars", "edited_sha256", F.col("t.text").alias("fingerprint"), F.col("t.edited").alias("edited_fingerprint"), near("edited").alias("near_edited"), near("following").alias("near_next"))
