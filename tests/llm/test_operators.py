"""Every operator against a brute-force version, on a small table of hard cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, node bigint, score double, ids string"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(n))


def texts():
    """Copies, near copies, shared passages, empty, null, blank, long and odd texts."""
    r = random.Random(5)
    base, passage = sentence(r, 120), sentence(r, 40)
    out = [base, base, base + " tail", base.replace("a", "A"), None, "", " \n\t ", "one", "one two", "one two three four", "One  two\nthree four"]
    for i in range(6):
        ws = base.split()
        ws[10 * i + 3] = f"changed{i}"
        out.append(" ".join(ws))
    out += [sentence(r, 30) + "\n" + passage + "\n" + sentence(r, 30) for _ in range(6)]
    out += ["For " * 300, "x" * 3000, "日本語のテキスト。" * 20, "it's we'll 'tis '' 12 ½ ² naïve — “q” <|endoftext|> end ", "a\n\n\nb  c \n d\r\n", "word " * 2500, "a%%% b*** " * 30, "tab\tand nbsp em"]
    out += [f"Released under the MIT License. {sentence(r, 5)} Apache License, Version 2.0 cc-by-nc CC BY NC", "licensed under the GNU General Public License, version 3", "the mit license under the mit"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    made = [(i * 3, x, "en", "s", 1, 7, 8, 0.5, "x") for i, x in enumerate(t)]
    made.append((None, t[0], None, None, None, None, None, None, None))
    made += [(900, "same row twice " * 12, "en", "s", 1, 7, 8, 0.5, "x")] * 2
    made.append((900, "another text of the same id " * 9, "en", "s", 1, 7, 8, 0.5, "x"))
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def same(found, expected):
    key = lambda x: tuple((v is not None, v) if not isinstance(v, float) else (True, round(v, 9)) for v in x)
    assert sorted(map(key, found)) == sorted(map(key, expected))


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_bpe(docs, rows, nothing):
    from quire.llm import bpe

    t = library()
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    same(collected(bpe.round_trip(docs, PATH, ("doc_id",), bpe.digests, bpe.DIGEST_FIELDS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
    plain = bpe.round_trip(docs, PATH, ("doc_id", "text", "score"))
    assert all(r["decoded"] == (r["text"] or "") for r in plain.collect())
    assert bpe.round_trip(nothing, PATH).count() == 0
    assert bpe.decode(PATH, [10**6, -1]) == ""


def test_long_words_by_heap():
    from quire.llm import bpe

    array, r = bpe.RankArray(PATH), random.Random(1)
    for n in (161, 400):
        word = "".join(r.choice("abcth e").strip() or "q" for _ in range(n)).encode()
        parts = [array.first[b] for b in word]
        heap = array.encode_long(list(parts))
        limit, bpe.LONG_WORD = bpe.LONG_WORD, 10**9
        try:
            assert array.encode(word) == heap
        finally:
            bpe.LONG_WORD = limit


def test_token_files(spark, docs, rows, nothing, tmp_path):
    from quire.llm import token_files

    t, want, start = library(), [], 0
    key = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]])):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    token_files.write(docs, PATH, str(tmp_path / "a"), files=3)
    same(collected(token_files.checksums(token_files.read(spark, str(tmp_path / "a"))), "doc_id", "start", "n_tokens", "ids_crc32"), want)
    assert "ids" not in token_files.read(spark, str(tmp_path / "a"), with_ids=False).columns
    token_files.write(nothing, PATH, str(tmp_path / "b"))
    assert token_files.checksums(token_files.read(spark, str(tmp_path / "b"))).count() == 0


def test_token_counts(docs, rows, nothing):
    from quire.llm import token_counts as C

    t, want = library(), []
    for r in rows:
        x = r[1] or ""
        offsets = t.encode(x, add_special_tokens=False).offsets
        want.append((r[0], len(offsets), [sum(a <= s < b for s, _ in offsets) for _, a, b in C.lines(x)]))
    found = [(r["doc_id"], r["n_tokens"], [int(s["tokens"]) for s in r["sections"]]) for r in C.attribute(docs, PATH).collect()]
    order = lambda x: (x[0] is None, x)
    assert sorted(((a is None, a or 0, b, c) for a, b, c in found)) == sorted(((a is None, a or 0, b, c) for a, b, c in want)) and order
    assert C.attribute(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        C.attribute(docs, PATH, rule="odd")


def test_allocation_rules():
    from quire.llm.token_counts import allocate

    starts, ends = np.array([0, 4, 10]), np.array([4, 10, 12])  # the second token crosses 6
    sections = np.array([[0, 6], [6, 12], [3, 3]])
    assert allocate(starts, ends, sections, "start")[0].tolist() == [2, 1, 0]
    assert allocate(starts, ends, sections, "end")[0].tolist() == [1, 2, 0]
    split, crossing = allocate(starts, ends, sections, "split")
    assert np.allclose(split, [1 + 2 / 6, 1 + 4 / 6, 0]) and crossing.tolist() == [1, 1, 0]


def test_leaks(spark, docs, rows, nothing):
    from quire.llm import leaks

    passage = texts()[17].split("\n")[1]
    items = [(1, passage), (2, "One two, THREE four"), (3, ""), (4, None), (11, passage.upper()), (2, "one two"), (None, passage), (5, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, x in items:
        w = WORDS.findall(low(x))
        for k in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for r in rows:
        w, hit, ids = WORDS.findall(low(r[1])), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        want.append((r[0], len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(collected(leaks.report(leaks.scan(docs, bench)), *columns), want)
    limit, leaks.BLOCK_WINDOWS = leaks.BLOCK_WINDOWS, 5
    try:  # the same in several blocks
        same(collected(leaks.report(leaks.scan(docs.coalesce(1), bench)), *columns), want)
    finally:
        leaks.BLOCK_WINDOWS = limit
    assert leaks.scan(nothing, bench).count() == 0 and leaks.scan(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert leaks.scan(docs, bench, keep=("doc_id", "text", "score")).count() == len(rows)


def brute_components(rows):
    w = lambda x: re.findall(r"[^\x20\x09-\x0D]+", low(x))
    sets = []
    for r in rows:
        ws = w(r[1])
        sets.append({tuple(ws[i : i + 4]) for i in range(len(ws) - 3)} if len(ws) > 3 else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), r[0] if not sets[i] else least.get(root(i))) for i, r in enumerate(rows)], root, sets


def test_near_duplicates(docs, rows, nothing):
    from quire.llm import jaccard

    want, root, sets = brute_components(rows)
    same(collected(jaccard.components(docs), "doc_id", "n_shingles", "component_id"), want)
    limit, jaccard.BLOCK = jaccard.BLOCK, 4
    try:  # large blocks in parts
        same(collected(jaccard.components(docs), "doc_id", "n_shingles", "component_id"), want)
    finally:
        jaccard.BLOCK = limit
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    n = len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
    assert kept.count() == n and {r["doc_id"] for r in kept.collect()} >= {c for _, k, c in want if k and c is not None}
    assert jaccard.components(nothing).count() == 0 and jaccard.representatives(nothing).count() == 0


def test_blocks_with_pivots(spark, monkeypatch):
    """Chains, hubs and strangers in blocks that all meet pivots first, against brute force."""
    from quire.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "PARTS", 1)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    r, rows = random.Random(9), []
    for _ in range(3):
        ws = sentence(r, 70).split()
        for i in range(25):  # each differs a little from the one before, so the ends of a chain are far apart
            rows.append((len(rows), " ".join(ws)))
            ws = list(ws)
            ws[r.randrange(len(ws))] = f"new{i}"
    common = sentence(r, 30)
    rows += [(len(rows) + i, f"{common} {sentence(r, 12)}") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    same(collected(jaccard.components(docs), "doc_id", "n_shingles", "component_id"), brute_components(rows)[0])


def test_signature_trees_find_every_link():
    from quire.llm.jaccard import SignatureTree, _bitmap

    r = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = r.integers(0, 2**62, int(r.integers(1, 400)), dtype=np.uint64)
        for _ in range(int(r.integers(1, 5))):
            keep = base[r.random(len(base)) > r.choice([0.0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.append(keep, r.integers(0, 2**62, int(r.integers(0, 12)), dtype=np.uint64))))
    sets = [s for s in sets if len(s)]
    tree = SignatureTree.of_sets(sets, 85)
    tree.link()
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            x = len(np.intersect1d(sets[i], sets[j]))
            if 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x):
                parent[root(i)] = root(j)
    groups = lambda f: sorted(sorted(i for i in range(len(sets)) if f(i) == k) for k in {f(i) for i in range(len(sets))})
    assert groups(tree.root) == groups(root)
    loose = SignatureTree.of_bitmaps([len(s) for s in sets], [_bitmap(s) for s in sets], 85)
    loose.link()
    assert all(loose.root(i) == loose.root(j) for g in groups(root) for i in g for j in g)


def test_components(spark, tmp_path):
    from quire.llm.components import stars

    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {x["node"]: x["root"] for x in stars(spark.createDataFrame(edges, "a bigint, b bigint"), str(tmp_path)).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}


def brute_repeats(rows, hashes):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashes[rows[i][1]]))
    for i in order:
        who, b = (rows[i][0], rows[i][1]), (rows[i][1] or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            first = seen.setdefault(b[p : p + 100], (who, p))
            if first != (who, p):
                gone[p : p + 100] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((rows[i][0], len(b), int(gone.sum()), int((edges == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def test_repeats(docs, rows, nothing):
    from quire.llm import repeats

    hashes = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("k")).collect()}
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(collected(repeats.report(repeats.dedupe(docs)), *columns), brute_repeats(rows, hashes))
    assert repeats.dedupe(nothing).count() == 0
    whole = repeats.dedupe(docs, ("doc_id", "score"), characters=True).collect()
    assert all(r["kept"].decode() is not None for r in whole) and len(whole) == len(rows)
    with pytest.raises(ValueError):
        repeats.dedupe(docs, ("doc_id", "h"))


def test_heavy_grams_give_the_same(spark, monkeypatch):
    """Every text sampled, grams heavy from three places on: a common line, whole copies, a run of blanks."""
    from quire.llm import repeats

    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, copy = some(60), some(700)
    rows = [(i, some(r.randint(20, 300)) + line + some(r.randint(20, 300)) if i % 3 else copy + some(i % 4) + " " * 400) for i in range(90)]
    rows += [(200 + i, line * 5 + some(20)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute_repeats(rows, {t: i for i, (_, t) in enumerate(rows)})
    same(collected(repeats.report(repeats.dedupe(docs)), *columns), want)
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HEAVY", 3)
    same(collected(repeats.report(repeats.dedupe(docs)), *columns), want)


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    from quire.llm import repeats

    data = np.frombuffer(random.Random(3).randbytes(5000), dtype=np.uint8)
    strings = lambda found: sorted((int(a), int(g)) for f, _ in found for lo, hi, g, at in zip(f["lo"], f["hi"], f["gram"], f["at"]) for a in range(lo, hi + 1))
    whole = strings(repeats._scanned(data, np.array([0, 5000]), None))
    monkeypatch.setattr(repeats, "PIECE_BYTES", 700)
    assert strings(repeats._scanned(data, np.array([0, 5000]), None)) == whole and len(whole) == 4901


def test_bytes_decide_what_hashes_take_for_equal():
    from quire.llm import repeats

    r = np.random.default_rng(4)
    data = r.integers(0, 255, 600, dtype=np.uint8)
    data[300:410] = data[0:110]
    rows = np.zeros(4, dtype=repeats._ROW)
    rows["doc"], rows["span"] = np.arange(4), 10
    found = repeats.Contexts(rows, np.array([0, 120, 300, 450]), data)
    kept, repeated = found.combined()  # all four have one hash; the third alone repeats the first
    assert sorted(kept.tolist()) == [0, 1, 3] and repeated.tolist() == [2]


def test_places_are_even(spark):
    from quire.llm.session import places

    own = places(13, 3).tolist()
    rows = spark.createDataFrame([(int(x),) for x in own], "label int").select(F.pmod(F.hash("label"), F.lit(13)).alias("p")).collect()
    assert [r["p"] for r in rows] == [i // 3 for i in range(39)]


def test_equal_strings():
    from quire.llm.repeats import equal_strings

    r = np.random.default_rng(1)
    data = r.integers(0, 2, 4000, dtype=np.uint8)
    starts = np.arange(0, 3900)
    at, tie = equal_strings(data, starts, np.zeros(len(starts), int), 12)
    strings = [data[s : s + 12].tobytes() for s in starts]
    many = {s for s in strings if strings.count(s) > 1}
    assert {int(i) for i in at} == {i for i, s in enumerate(strings) if s in many}
    assert len({(strings[i], t) for i, t in zip(at.tolist(), tie.tolist())}) == len(many)


def test_licenses(docs, rows, nothing):
    from quire.llm import licenses

    want = []
    for r in rows:
        w = WORDS.findall(low(r[1]))
        at = [(k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((r[0], len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    found = licenses.report(licenses.scan(docs))
    same(collected(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    gpl = [r for r in found.collect() if r["labels"] == "gpl-3"]
    assert len(gpl) == 1 and gpl[0]["score"] == 1.0 and found.where("score < 0 or score > 1").count() == 0
    assert licenses.scan(nothing).count() == 0


def test_fingerprints(docs, rows, nothing):
    from quire.llm import merkle

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    want = []
    for i, r in enumerate(order):
        x, y = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(x) // 2
        want.append((r[0], len(x), sha((x[: len(x) - k] + y[:k]).encode())))
    found = merkle.edited_fingerprints(docs)
    same(collected(found, "doc_id", "n_chars", "edited_sha256"), want)
    got = found.collect()
    text = {r[0]: r[1] or "" for r in rows if r[0] != 900}
    prints = {(text[r["doc_id"]], r["fingerprint"]) for r in got if r["doc_id"] in text}
    assert len(prints) == len({t for t, _ in prints}) == len({f for _, f in prints})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 3)["near_next"] == 1.0  # a copy follows
    assert merkle.edited_fingerprints(nothing).count() == 0


def test_trees_locate_edits(spark):
    from quire.llm import merkle

    lines = [f"Line {i} has some words. And a second sentence {i}." for i in range(40)]
    changed = [*lines[:20], "Something else.", *lines[21:]]
    inserted = [*lines[:5], "An inserted line.", *lines[5:]]
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(x)) for x in (lines, changed, inserted)], "a string, b string")
    trees = rows.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    out = trees.select(merkle.likeness(F.col("a"), F.col("b")).alias("near"), F.size(merkle.differing(F.col("a"), F.col("b"))).alias("n")).collect()
    assert out[0] == (1.0, 0) and all(0.9 < r["near"] < 1 and 1 <= r["n"] <= 2 for r in out[1:])


def test_toxicity(spark, docs, nothing):
    from quire.llm import toxicity

    r = random.Random(8)
    made, labels = [], []
    for i in range(900):
        ws, bad = sentence(r, 60).split(), i % 6 == 0
        for k in range(3 if bad else 0):
            ws.insert(r.randrange(len(ws)), r.choice(["grobian", "schuft", "lump"]))
        made.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame([*labels, (5, None), (None, 1), (7, 9)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, y)
    out = {x["doc_id"]: x["score"] for x in toxicity.score(d, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.95
    assert toxicity.score(docs, model, ("doc_id", "text")).where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.fit(nothing, y.limit(0))
    assert {x["score"] for x in toxicity.score(docs, empty).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy many things here now for you</div>
<main><h1>Head &amp; line</h1><p>First  paragraph<br>of&nbsp;text, long enough to read.<p>Short.<p><b>Bold not closed. More words follow here.
<aside>Related</aside><form>Name <input></form><p>Last one, with a <a href="x">link</a> inside of it.</p>
<section id="comments"><p>I think that this is a fine page and so on</p></section></main><footer>&copy; Us"""


def test_pages(spark, nothing):
    from quire.llm import pages

    want = "Head & line\n\nFirst paragraph of text, long enough to read.\n\nShort.\n\nBold not closed. More words follow here.\n\nLast one, with a link inside of it."
    assert pages.main_text(PAGE) == want
    soup = "<div><a>a</a> <a>b</a></div><div>" + "A plain block of many words without links. " * 4 + "</div><div>" + "And another one of the same kind as it. " * 4 + "</div><div><a>terms</a></div>"
    assert pages.main_text(soup).count("\n\n") == 1 and "terms" not in pages.main_text(soup)
    for odd in ("", "<", "<p", "</p></div>", "<script>never ends", "<!-- x", "&amp;" * 3, "<a href='x>y"):
        pages.main_text(odd)
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    assert sorted(r["text"] for r in pages.extract(df).collect()) == ["", want, want]


def test_plans_of_native_operators(docs):
    from quire.llm import licenses, merkle

    for df in (merkle.edited_fingerprints(docs.select("doc_id", "text").limit(5)), licenses.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
