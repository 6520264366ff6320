import io
import os
import sys
import zipfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def package(chapters, guide="", extra=None, nav_labels=True) -> bytes:
    """A small book: chapters are (file, title, body)."""
    items = "".join(f'<item id="i{n}" href="Text/{f}" media-type="application/xhtml+xml"/>' for n, (f, _, _) in enumerate(chapters))
    refs = "".join(f'<itemref idref="i{n}"/>' for n in range(len(chapters)))
    links = "".join(f'<li><a href="Text/{f}">{t}</a></li>' for f, t, _ in chapters) if nav_labels else ""
    opf = f"""<?xml version='1.0'?><package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
    <dc:identifier id="uid">book-1</dc:identifier><dc:title>A book</dc:title><dc:language>fr</dc:language></metadata>
    <manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="png" href="Images/a.png" media-type="image/png"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{refs}</spine>{guide}</package>"""
    ncx = "".join(f'<navPoint><navLabel><text>ncx {t}</text></navLabel><content src="Text/{f}#x"/></navPoint>' for f, t, _ in chapters)
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>',
        "META-INF/signatures.xml": "<s/>", "OEBPS/content.opf": opf, "OEBPS/toc.ncx": f"<ncx><navMap>{ncx}</navMap></ncx>",
        "OEBPS/nav.xhtml": f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>',
        **{f"OEBPS/Text/{f}": f"<html><head><title>x</title></head><body class='c'>{b}</body></html>" for f, _, b in chapters}, **(extra or {}),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/", "")
        for name, data in files.items():
            z.writestr(name, data)
        z.writestr("OEBPS/Images/a.png", b"\x89PNGdata")
    return out.getvalue()


CHAPTERS = [
    ("copyright.xhtml", "Rights", "<h1>Copyright</h1><p>All rights.</p>"),
    ("two.xhtml", "Queues", '<h1 id="top">About queues</h1><h2 id="why">Why</h2><p>Queues are lines of people. See <a href="three.xhtml#later">later</a> and <a href="gone.xhtml">gone</a>.</p><figure id="f"><img src="../Images/a.png" alt="A"/><figcaption>Old</figcaption></figure><pre><code>a  &lt; b</code></pre>'),
    ("three.xhtml", "Delivery", '<h1>Delivery</h1><h2 id="later">Later</h2><p>Back to <a href="two.xhtml#why">why</a>.</p>'),
]


@pytest.fixture
def book_bytes() -> bytes:
    return package(CHAPTERS)
