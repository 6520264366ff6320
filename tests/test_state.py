"""State tables: two writers, retried writes, reads at a version, snapshots; captions stored once."""

import subprocess
import sys
import textwrap
import threading

from pyspark.sql import functions as F

from conftest import ROOT
from quire.operators.state import StateStore
from quire.plans import captions


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def table(frame):
    return {r[0]: r[-1] for r in frame.collect()}


def test_versions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    assert store.read("responses").collect() == [] and store.compact("responses") is None
    assert store.write("responses", rows(spark, ("a", "1"), ("b", "1"))) == 1
    assert store.write("responses", rows(spark, ("a", "2"), ("a", "3"), ("c", None)), token="job 7") == 2
    assert store.write("responses", rows(spark, ("a", "9")), token="job 7") is None  # a retried write
    assert table(store.read("responses")) == {"a": "3", "b": "1", "c": None} and table(store.read("responses", 1)) == {"a": "1", "b": "1"}
    assert store.write("responses", rows(spark, ("b", "x"), ("b", "y")), -F.ascii("value")) == 3
    assert store.compact("responses") == 4 and table(store.read("responses")) == {"a": "3", "b": "x", "c": None}
    assert store.write("responses", rows(spark, ("c", "4"))) == 5
    assert table(store.read("responses")) == {"a": "3", "b": "x", "c": "4"} and table(store.read("responses", 2)) == {"a": "3", "b": "1", "c": None}
    assert [k for _, k, _ in store.versions("responses")] == ["delta", "delta", "delta", "snapshot", "delta"]
    terms = lambda v: spark.createDataFrame([("s", "t", v)], "scope string, term string, rendering string")
    store.write("glossary", terms("first"))
    store.write("glossary", terms("a later one"))
    assert table(store.read("glossary")) == {"s": "first"}
    assert list((tmp_path / "responses" / "staged").iterdir()) == [] or all(p.name.startswith(".") for p in (tmp_path / "responses" / "staged").iterdir())


def test_two_writers(spark, tmp_path):
    found: list = []

    def write(who):
        store = StateStore(spark, str(tmp_path))
        for n in range(6):
            found.append(store.write("responses", rows(spark, ("hot", f"{who}-{n}"), (f"{who}-{n}", "own"))))

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = StateStore(spark, str(tmp_path))
    assert sorted(found) == list(range(1, 13)) == [n for n, _, _ in store.versions("responses")]
    now = table(store.read("responses"))
    assert len(now) == 13 and now["hot"] == next(v for k, v in table(store.read("responses", 12)).items() if k == "hot")
    assert table(store.read("responses", 11)).keys() < now.keys()


def test_captions(spark, tmp_path):
    store = StateStore(spark, str(tmp_path))
    pictures = spark.createDataFrame([(i, bytearray(b), "image/png") for i, b in enumerate((b"cat", b"cat", b"dog", b"bad", b"busy"))] + [(9, None, "image/png")], "use int, content binary, media string").repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def ask(content, media):
        calls.add(1)
        return {b"cat": "a cat", b"dog": "a dog", b"bad": ""}.get(content)

    want = {0: "a cat", 1: "a cat", 2: "a dog", 3: "", 4: None, 9: None}
    got = captions.describe(pictures, store, ask, "en").select("use", "caption")
    assert table(got) == want and calls.value == 4  # one call a picture
    again = captions.describe(pictures, store, ask, "en").select("use", "caption")
    assert table(again) == want and calls.value == 5  # only what failed for now is asked again
    other = captions.describe(pictures, store, ask, "fr").select("use", "caption")
    assert table(other) == want and calls.value == 9


def test_killed_tasks_store_once(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        from quire.operators.state import StateStore
        from quire.plans import captions
        from quire.plans.metrics import Metrics
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        pictures = spark.createDataFrame([(i, bytearray(b"p%d" % (i % 20)), "m") for i in range(60)], "use int, content binary, media string")
        def ask(content, media):
            if content == b"p7" and TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("killed")
            return f"{{content.decode()}} {{TaskContext.get().attemptNumber()}}"
        store = StateStore(spark, {str(tmp_path)!r})
        got = captions.describe(pictures, store, ask)
        assert got.where("caption is null").count() == 0 and got.count() == 60
        raw = spark.read.parquet({str(tmp_path)!r} + "/captions/published/*")
        assert raw.count() == 20 == raw.select("hash").distinct().count()
        def fails(batches):
            for b in batches:
                yield b
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("killed")
        metrics = Metrics()
        used = metrics.watch(spark.range(0, 1000, 1, 4).mapInArrow(fails, "id bigint"), "usage", sent=F.sum("id"), calls=F.count("*"))
        used.write.format("noop").mode("overwrite").save()
        assert metrics.of("usage") == {{"sent": 499500, "calls": 1000}}, metrics.of("usage")
        print("all right")
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert "all right" in out.stdout, out.stderr[-2000:]
