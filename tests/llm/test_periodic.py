"""Periodic runs against brute force, and the query's edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest


def brute(x, least=24):
    """Every period over the whole sequence; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(x) // 3 + 1):
        s = None
        for i in range(len(x) - q + 1):
            if i < len(x) - q and x[i] == x[i + q]:
                s = i if s is None else s
            elif s is not None:
                if i + q - s >= max(least, 3 * q):
                    found.setdefault((s, i + q), q)
                s = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences(seed):
    r = random.Random(seed)
    for _ in range(250):
        k, x = r.choice((1, 2, 3, 9)), []
        for _ in range(r.randint(0, 5)):
            word = [r.randrange(k) for _ in range(r.choice((1, 2, 3, 5, 8, 13, 30)))]
            x += (word * r.randint(1, 12))[: r.randint(1, 130)] + [r.randrange(k) for _ in range(r.choice((0, 1, 7, 40)))]
        yield x
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b  # many runs of many periods
    yield [0] * 500
    yield ([0] * 30 + [1]) * 9 + [2] + list(range(60)) * 4


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_brute_force(seed):
    from quire.llm import periodic

    for x in sequences(seed):
        assert periodic.runs(np.array(x, dtype=np.int64)) == brute(x), x


def test_blocks_of_leaves(monkeypatch):
    from quire.llm import periodic

    monkeypatch.setattr(periodic, "TOGETHER", 7)
    for x in list(sequences(9))[::5]:
        assert periodic.runs(np.array(x, dtype=np.int64)) == brute(x)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_rows(spark, tmp_path):
    from quire.llm import queries

    r = random.Random(5)
    vocabulary = ["a", "b", "Straße", "c d", "e f", "\x1cg", "\x00", "日本"]
    rows = [(None, None), (None, "x " * 50), (0, ""), (1, " \t\n\x0b\x0c\r "), (2, "one"), (3, "a b " * 40), (3, "a b " * 40), (4, "z " * 23), (5, "z " * 24)]
    for i in range(10, 160):
        word = [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
        rows.append((i, r.choice((" ", "\n", "\t ")).join([f"w{r.randrange(99)}" for _ in range(r.randint(0, 60))] + word * r.randint(1, 8) + [f"v{j}" for j in range(r.randint(0, 30))])))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i) > 5
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({}).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted((tuple(x) for x in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((expected(*x) for x in rows), key=key)


def test_long_text_and_names(spark):
    from quire.llm import periodic

    long = " ".join(f"w{i % 37_000}" for i in range(150_000))
    docs = spark.createDataFrame([(1, long, 7), (2, None, 8)], "doc_id bigint, text string, start int")
    rows = sorted(periodic.scan(docs, ("doc_id", "start")).collect())
    assert [(x["doc_id"], x["start"], x["n_words"], [tuple(y) for y in x["runs"]]) for x in rows] == [(1, 7, 150_000, [(0, 150_000, 37_000)]), (2, 8, 0, [])]
    assert rows[0]["collapsed"] == " ".join(f"w{i}" for i in range(37_000)) and rows[1]["collapsed"] == ""
    assert periodic.scan(docs.limit(0)).collect() == []
    for taken in ("runs", "Runs"):
        with pytest.raises(ValueError):
            periodic.scan(docs.withColumnRenamed("start", taken), ("doc_id", taken))
