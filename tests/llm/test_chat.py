"""The prefix tree against every conversation written on its own."""

import hashlib
import random
from collections import defaultdict

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = ["", "hi", "<|im_end|>\n<|im_start|>assistant ok", "<|", "<\\|x", "<\\\\||", "a<|endoftext|>b", "ünï 日本\n\n", "\\n<|\\|", None]


def test_escapes_are_reversible():
    from quire.llm import chat

    r = random.Random(2)
    for _ in range(3000):
        role, text = ("".join(r.choice("<|\\n\n x") for _ in range(r.randint(0, 12))) for _ in range(2))
        body, a, b = chat.render(role, text)
        assert chat.parse(body) == (role, text) and chat.unescape(body[a:b]) == text
        assert body.count("<|") == 2 and "\n" not in chat._escape_role(role)


def conversations(seed):
    r = random.Random(seed)
    rows, roots = [], [[("system", "s")], [("user", HARD[2])], []]
    known = [list(x) for x in roots]
    for conv in range(120):
        turns = list(r.choice(known)[: r.randint(0, 12)])
        for _ in range(r.randint(0 if turns else 1, 4)):
            turns.append((r.choice(("user", "assistant", "tool\nx", "assistant")), r.choice(HARD)))
        known.append(turns)
        shift = r.choice((0, 0, 5))
        rows += [(conv, i + shift, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(200 + i, j, "user" if j % 2 == 0 else "assistant", f"turn {j}") for i in range(30) for j in range(i + 1)]  # each beginning its own conversation
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "first"), (300, 1, None, None), (300, 1, "assistant", "same"), (300, 1, "assistant", "same")]
    rows += [(400, j, "assistant", f"long {j % 7}") for j in range(700)]  # spans ranges
    r.shuffle(rows)
    return rows


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}


@pytest.mark.parametrize("seed", (1, 2))
def test_tree(spark, tmp_path, seed):
    from quire.llm import chat

    rows, folder = conversations(seed), str(tmp_path / "out")
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA + ", segment int, at int")
    chat.write(frame, PATH, folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["nodes", "turns"]
    want = expected(rows)
    nodes = spark.read.parquet(f"{folder}/nodes").collect()
    assert len(nodes) == len({(tuple(t[: i + 1])) for t in want.values() for i in range(len(t))})  # shared turns once
    library, (start, end) = tokenizers.Tokenizer.from_file(PATH), chat.control_ids(PATH)
    encode = lambda s: library.encode(s, add_special_tokens=False).ids
    stream = defaultdict(dict)
    for x in nodes:
        assert x["n_tokens"] == len(x["ids"])
        for i, token in enumerate(x["ids"]):
            assert x["start"] + i not in stream[x["tree"]]
            stream[x["tree"]][x["start"] + i] = token
    assert all(sorted(s) == list(range(len(s))) for s in stream.values())  # no gaps
    by_node = {(x["segment"], x["at"]): x for x in nodes}
    got = defaultdict(list)
    for x in spark.read.parquet(f"{folder}/turns").collect():
        got[x["conv_id"]].append((x["at"], x["segment"], x["tree"]))
    assert got.keys() == want.keys()
    for conv, own in got.items():
        before, path = 0, []
        for (at, segment, tree), (role, text) in zip(sorted(own), want[conv], strict=True):
            x = by_node[segment, at]
            assert x["tree"] == tree and chat.parse(x["text"]) == (role, text)
            body = encode(chat.escape(text))
            assert x["ids"] == [start, *encode(chat._escape_role(role) + "\n"), *body, end, *encode("\n")]
            masked = x["ids"][x["loss_ids_from"] : x["loss_ids_to"]]
            assert masked == (body if role == "assistant" else []) and chat.unescape(x["text"][x["loss_from"] : x["loss_to"]]) == (text if role == "assistant" else "")
            assert x["position"] == before
            seen = [i for a in x["ancestors"] for i in range(a["start"], a["end"])]
            assert [stream[tree][i] for i in seen] == path and len(set(seen)) == len(seen)
            path, before = path + x["ids"], before + len(x["ids"])
    for tree in stream:  # depth first: a node's descendants follow it without others in between
        order = sorted((x for x in nodes if x["tree"] == tree), key=lambda x: x["start"])
        for i, x in enumerate(order[:60]):
            inside = [any(a["start"] <= x["start"] < a["end"] for a in y["ancestors"]) for y in order[i + 1 :]]
            assert inside == sorted(inside, reverse=True)


def test_digests(spark, tmp_path):
    from quire.llm import chat

    rows, folder = conversations(3), str(tmp_path / "out")
    chat.write(spark.createDataFrame(rows, SCHEMA), PATH, folder)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for conv, turns in expected(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(chat.render(*x)[0]) for x in turns)))
    got = [tuple(x) for x in chat.digests(chat.read(spark, folder)).collect()]
    assert len(got) == len(want) and set(got) == want
    chat.write(spark.createDataFrame([], SCHEMA), PATH, str(tmp_path / "none"))
    assert chat.digests(chat.read(spark, str(tmp_path / "none"))).collect() == []
