"""Packages as relations: manifest, spine, labels, landmarks and chapters as tables over rows of members.

Package files are read by Spark's own XML reader, navigation documents by the tags of ``quire.operators.nested``; all
else is joins and aggregates, so a batch of books is one set of tables, whatever the size of a book.  What a strict
lookup misses is a row of ``errors``, and books with such rows have no chapters; the others go on.

Only opening an archive is Python: ``members`` gives a row a file, one archive at a time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.functions.paths import resolve_path_column
from quire.operators import inventory as I
from quire.operators import nested as N
from quire.operators.selection import front_matter

#: Where a package begins, and media types.
CONTAINER, NCX = "META-INF/container.xml", "application/x-dtbncx+xml"
READABLE = ("application/xhtml+xml", "text/html")
_CONTAINER = "rootfiles struct<rootfile: array<struct<`_full-path`: string>>>, _corrupt_record string"
_PACKAGE = """manifest struct<item: array<struct<_id: string, _href: string, `_media-type`: string, _properties: string>>>, spine struct<itemref: array<struct<_idref: string>>>,
  guide struct<reference: array<struct<_href: string, _type: string>>>, _corrupt_record string"""


class Package(NamedTuple):
    """Tables of a batch of packages, keyed by book_id."""

    manifest: DataFrame  # item_id, path, media_type, properties array; the last item of an id counts
    spine: DataFrame  # pos, idref, path, media_type, properties, item_id; only references that the manifest has
    labels: DataFrame  # path, label; the first of a path counts
    landmarks: DataFrame  # path, types; the last of a path counts, guides after navigation documents
    chapters: DataFrame  # idx from 1, item_id, path, title, body, words, images, front_matter, properties
    errors: DataFrame  # problem, detail


def members(files: DataFrame) -> DataFrame:
    """book_id (the archive's path), ``path`` and ``content`` of every file in archives (path, content); an archive
    that can't be opened is one row with a null path."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        for i in archive.infolist():
                            if not i.is_dir():
                                yield pd.DataFrame([(name, i.filename, archive.read(i))], columns=["book_id", "path", "content"])
                except (zipfile.BadZipFile, OSError):
                    yield pd.DataFrame([(name, None, None)], columns=["book_id", "path", "content"])

    return files.select("path", "content").mapInPandas(opened, "book_id string, path string, content binary")


def _xml(content: Column, schema: str) -> Column:
    """Parsed strictly; documents that define entities are refused unread."""
    text = content.cast("string")
    return F.when(~text.contains("<!ENTITY"), F.from_xml(text, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def _readable(properties: Column) -> Column:
    return F.filter(F.split(F.coalesce(properties, F.lit("")), r"\s+"), lambda p: p != "")


def read(files: DataFrame) -> Package:
    """Tables of members (book_id, path, content; string or binary).

    Members of one path: the last by content counts, as a path is one file.  A book without a container, or whose
    container or package file can't be read, has a row of errors and nothing else.
    """
    files = files.select("book_id", "path", F.col("content").cast("string").alias("content"))
    once = files.groupBy("book_id", "path").agg(F.max("content").alias("content"))
    found = once.where(F.col("path") == CONTAINER).select("book_id", _xml(F.col("content"), _CONTAINER).alias("x"))
    roots = F.filter("x.rootfiles.rootfile", lambda r: r["_full-path"].isNotNull())
    base = found.select("book_id", F.get(roots, F.lit(0))["_full-path"].alias("base"))
    every = files.select("book_id").distinct().join(base, "book_id", "left")
    package = every.join(once.select("book_id", F.col("path").alias("base"), "content"), ["book_id", "base"], "left").select("book_id", "base", F.col("content").isNotNull().alias("there"), _xml(F.col("content"), _PACKAGE).alias("x"))
    wrong = F.when(F.col("base").isNull(), "the container names no package file").when(~F.col("there"), "the archive lacks its package file").when(F.col("x").isNull() | F.col("x._corrupt_record").isNotNull(), "the package file can't be read")
    wrong = wrong.when(F.col("x.manifest").isNull() | F.col("x.spine").isNull(), "the package has no manifest or no spine")
    broken = package.select("book_id", wrong.alias("problem"), F.coalesce("base", F.lit("")).alias("detail")).where("problem is not null")
    items = package.select("book_id", "base", F.posexplode("x.manifest.item").alias("pos", "i"))
    items = items.select("book_id", "pos", F.coalesce("i._id", F.lit("")).alias("item_id"), resolve_path_column(F.col("base"), F.coalesce("i._href", F.lit(""))).alias("path"), F.coalesce("i._media-type", F.lit("")).alias("media_type"), _readable(F.col("i._properties")).alias("properties"))
    manifest = items.groupBy("book_id", "item_id").agg(F.max_by(F.struct("path", "media_type", "properties"), "pos").alias("i")).select("book_id", "item_id", "i.*")
    spine, lost = strict(package.select("book_id", F.posexplode("x.spine.itemref").alias("pos", "r")).select("book_id", "pos", F.coalesce("r._idref", F.lit("")).alias("idref")), manifest.withColumn("idref", F.col("item_id")), ["book_id", "idref"], "the spine names an item that the manifest lacks", "idref")
    labels, types = _navigation(items, once)
    guide = package.select("book_id", "base", F.posexplode("x.guide.reference").alias("n", "r")).select("book_id", resolve_path_column(F.col("base"), F.coalesce("r._href", F.lit(""))).alias("path"), F.coalesce("r._type", F.lit("")).alias("types"), F.struct(F.lit(1).alias("rank"), F.lit(0).alias("pos"), F.col("n").cast("bigint").alias("n")).alias("order"))
    landmarks = types.unionByName(guide).groupBy("book_id", "path").agg(F.max_by("types", "order").alias("types"))
    readable = spine.where(F.col("media_type").isin(*READABLE))
    with_content, absent = strict(readable, once.where("content is not null"), ["book_id", "path"], "the archive lacks a spine document", "path")
    none = every.join(readable.select("book_id").distinct(), "book_id", "left_anti").join(broken, "book_id", "left_anti").select("book_id", F.lit("no readable documents in the spine").alias("problem"), F.lit("").alias("detail"))
    errors = broken.unionByName(lost).unionByName(absent).unionByName(none)
    good = with_content.join(errors.select("book_id").distinct(), "book_id", "left_anti")
    return Package(manifest, spine, labels, landmarks, _chapters(good, labels, landmarks), errors)


def strict(rows: DataFrame, table: DataFrame, key: list[str], problem: str, detail: str) -> tuple[DataFrame, DataFrame]:
    """A join that must find a row for each: what it finds, and a row of errors (book_id, problem, detail) for each
    that it doesn't."""
    joined = rows.join(table.withColumn("_there", F.lit(True)), key, "left")
    missed = joined.where("_there is null").select("book_id", F.lit(problem).alias("problem"), F.col(detail).cast("string").alias("detail"))
    return joined.where("_there").drop("_there"), missed


def _navigation(items: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of paths (the first counts, documents in the manifest's order), and types of paths with their order."""
    nav = items.where(F.array_contains("properties", "nav")).select("book_id", "path", "pos", F.lit(0).alias("reader"))
    ncx = items.where(F.col("media_type") == NCX).select("book_id", "path", "pos", F.lit(1).alias("reader"))
    docs = nav.unionByName(ncx).join(files.where("content is not null"), ["book_id", "path"])
    x = N.matched(N.tags(docs, "content", ("book_id", "path", "pos", "reader")))
    over = Window.partitionBy("_doc").orderBy("n")
    before, ahead = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_doc").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    attribute = lambda name: F.regexp_extract("tag", rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)
    link = (F.col("reader") == 0) & (F.col("name") == "a") & (F.col("kind") == "open") & F.col("other").isNotNull() & F.col("tag").rlike(r"(?i)\shref\s*=")
    x = x.withColumn("_open", F.last(F.when(link, F.struct("n", "other")), ignorenulls=True).over(before))
    words = F.trim(F.regexp_replace(T.unescape(F.col("text")), r"\s+", " "))
    inside = x.where((F.col("_open.other") >= F.col("n")) & (words != "")).select("_doc", F.col("_open.n").alias("n"), F.col("n").alias("k"), words.alias("w"))
    texts = inside.groupBy("_doc", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda y: y["w"]), " ").alias("label"))
    links = x.where(link).select("_doc", "book_id", "path", "pos", "n", attribute("href").alias("reference"), attribute("epub:type").alias("types")).join(texts, ["_doc", "n"], "left").withColumn("label", F.coalesce("label", F.lit("")))
    point = (F.col("reader") == 1) & (F.col("name") == "navpoint") & (F.col("kind") == "open")
    source = F.when((F.col("name") == "content") & (F.col("kind") != "close"), F.struct("n", attribute("src").alias("v")))
    label = F.when((F.col("name") == "text") & (F.col("kind") == "close"), F.struct("n", words.alias("v")))
    points = x.withColumns({"_source": F.last(source, ignorenulls=True).over(ahead), "_label": F.last(label, ignorenulls=True).over(ahead)}).where(point & (F.col("_source.n") < F.col("other")) & (F.col("_label.n") < F.col("other")))
    points = points.select("_doc", "book_id", "path", "pos", "n", F.col("_source.v").alias("reference"), F.lit("").alias("types"), F.col("_label.v").alias("label"))
    rows = links.unionByName(points).withColumn("target", resolve_path_column(F.col("path"), T.unescape(F.col("reference"))))
    labels = rows.groupBy("book_id", F.col("target").alias("path")).agg(F.min_by("label", F.struct("pos", "n")).alias("label"))
    types = rows.where("types <> ''").select("book_id", F.col("target").alias("path"), "types", F.struct(F.lit(0).alias("rank"), "pos", "n").alias("order"))
    return labels, types


def _chapters(spine: DataFrame, labels: DataFrame, landmarks: DataFrame) -> DataFrame:
    rows = spine.join(labels, ["book_id", "path"], "left").join(landmarks, ["book_id", "path"], "left")
    body = F.regexp_extract("content", r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    own = F.array_join(F.regexp_extract_all("content", F.lit(r"""(?i)\sepub:type\s*=\s*["']([^"']*)["']"""), F.lit(1)), " ")
    idx = F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))  # of one package file's rows
    properties = F.array_join("properties", " ")
    made = rows.withColumn("body", body).withColumn("visible", T.unescape(T.visible_text(F.col("body"))))
    return made.select(
        "book_id", idx.alias("idx"), "item_id", "path", I.title(F.col("body"), F.col("label"), F.col("path")).alias("title"), "body", T.word_count(F.col("visible")).alias("words"), T.image_count(F.col("body")).alias("images"),
        front_matter(F.concat_ws(" ", own, "types"), F.col("path"), properties).alias("front_matter"), properties.alias("properties"))
