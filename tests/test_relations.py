"""Packages as relations against the reader of single books; misses are rows of errors."""

import io
import zipfile

from conftest import CHAPTERS, package
from quire.sources import epub, relations


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def changed(data, **new):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
    for old, (a, b) in new.items():
        name = next(f for f in files if f.endswith(old.replace("_", ".")))
        files[name] = files[name].replace(a, b)
    return archive({k: v for k, v in files.items() if v != b"gone"})


def test_books(spark):
    rows = [("a.xhtml", "Label", "<p>x &amp; y</p>"), ("b.xhtml", "B", '<p epub:type="toc">y</p>')]
    guide = '<guide><reference href="Text/b.xhtml" type="cover"/></guide>'
    good = {
        "plain": package(CHAPTERS), "fallback": package(rows, guide), "unlabelled": package(rows, nav_labels=False),
        "prefixed": changed(package(CHAPTERS), content_opf=(b"<package xmlns=", b"<opf:package xmlns:opf=\"x\" xmlns=")),
    }
    good["prefixed"] = changed(good["prefixed"], content_opf=(b"</package>", b"</opf:package>"))
    twice = changed(package(CHAPTERS), content_opf=(b"<manifest>", b'<manifest><item id="i1" href="Text/three.xhtml" media-type="text/plain"/>'))
    good["twice"] = twice
    bad = {
        "lost item": changed(package(CHAPTERS), content_opf=(b"<spine>", b'<spine><itemref idref="none"/>')),
        "lost file": changed(package(CHAPTERS), two_xhtml=(zipfile.ZipFile(io.BytesIO(package(CHAPTERS))).read("OEBPS/Text/two.xhtml"), b"gone")),
        "broken": changed(package(CHAPTERS), content_opf=(b"</package>", b"")),
        "entity": changed(package(CHAPTERS), content_opf=(b"<?xml version='1.0'?>", b"<!DOCTYPE p [<!ENTITY e 'x'>]>")),
        "no spine": changed(package(CHAPTERS), content_opf=(b'<itemref idref="i0"/><itemref idref="i1"/><itemref idref="i2"/>', b"")),
        "no container": archive({"x": "y"}), "empty container": archive({"META-INF/container.xml": "<container/>"}), "no archive": b"nothing",
    }
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in (good | bad).items()], "path string, content binary")
    p = relations.read(relations.members(files))
    chapters = {}
    for x in p.chapters.collect():
        chapters.setdefault(x["book_id"], []).append(x)
    assert chapters.keys() == good.keys()
    for name, data in good.items():
        want = epub.read_book(data)
        own = sorted(chapters[name], key=lambda x: x["idx"])
        assert [(x["idx"], x["item_id"], x["path"], x["title"], x["words"], x["images"], x["front_matter"], x["properties"]) for x in own] == [(c.index, c.item_id, c.path, c.title, c.words, c.images, c.front_matter, c.properties) for c in want.chapters]
        of = lambda frame, *columns: {tuple(x[c] for c in columns) for x in frame.where(f"book_id = '{name}'").collect()}
        assert of(p.labels, "path", "label") == set(want.labels.items())
        assert of(p.landmarks, "path", "types") == set(want.landmarks.items())
        last = {i: (i, path, media) for i, path, media, _ in want.manifest}
        assert of(p.manifest, "item_id", "path", "media_type") == set(last.values())
    problems = {x["book_id"]: (x["problem"], x["detail"]) for x in p.errors.collect()}
    assert problems.keys() == bad.keys()
    assert problems["lost item"] == ("the spine names an item that the manifest lacks", "none") and problems["lost file"] == ("the archive lacks a spine document", "OEBPS/Text/two.xhtml")
    assert problems["broken"][0] == problems["entity"][0] == "the package file can't be read"
    assert problems["no container"][0] == problems["empty container"][0] == problems["no archive"][0] == "the container names no package file"


def test_empty(spark):
    p = relations.read(spark.createDataFrame([], "book_id string, path string, content string"))
    assert all(frame.collect() == [] for frame in p)
    plan = p.chapters._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
