"""Chat formatting as a prefix tree: turns that conversations share from their beginning on are written once.

A turn is written as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end.  Inside texts and
roles every ``<|`` gets a backslash in between (and ``<\\|`` one more, and so on), so that no text holds a control
string and unescaping is exact; in roles, backslashes and line ends are escaped as well.  The two control strings
have ids of their own after the vocabulary's; texts never yield them.

A node of the tree is a turn after a given beginning.  The conversation with most turns of those that go through
a node (then the smallest conv_id) is the node's segment and writes it.  A conversation's nodes of one segment are
in a row, and a path meets at most the square root of twice the number of nodes of segments, so paths stay short
also where each turn was logged as a conversation of its own.  Segments are put depth first: a segment's own
nodes, then what branches off, the deepest branch first.  Nodes carry their place in the tree's stream of tokens
(``start``), the position of their first token (``position``: tokens on the path before it) and the intervals of
the stream that they attend to besides their own (``ancestors``).

Beginnings are told apart by a polynomial hash of 127 bits over SHA-2-sized digests of turns.  Positions, token
counts and hashes are running sums along ranges of (conv_id, turn): each task sums its range, and what one range
hands to the next is one row a range, so that a conversation may span many tasks.  Stream places are running sums
along ranges of the depth-first order.  A join by node is left to Spark's skew handling.

Defined results: turns are in the order of turn (missing ones first), role, text; rows that are alike in all are
turns of their own.  A missing text or role is empty; a missing conv_id is one conversation and counts as the
smallest 64-bit number.  An empty table gives empty outputs.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.pretokens import library_ids, vocabulary
from quire.llm.session import bounded_batches, column, drop, lean, materialised, partitions

START, END = "<|im_start|>", "<|im_end|>"
LEAST = -(1 << 63)
#: A prime and a multiplier of the polynomial hash.
_PRIME, _STEP = (1 << 127) - 1, 0x5BD1E9955BD1E9954F1BBCDCBFA53E0B
_BODY = "c bigint, text string, loss_from bigint, loss_to bigint, ids array<int>, loss_ids_from int, loss_ids_to int, amount bigint, digest binary"
_LOCAL = "part int, row bigint, first boolean, at bigint, before bigint, h binary"
NODES = ("tree", "start", "position", "n_tokens", "segment", "at", "text", "loss_from", "loss_to", "ids", "loss_ids_from", "loss_ids_to", "ancestors")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where in it the escaped text begins and ends."""
    head = f"{START}{_escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = formatted.removeprefix(START).partition("\n")
    return _unescape_role(role), unescape(rest.removesuffix(f"{END}\n"))


def control_ids(path: str) -> tuple[int, int]:
    """Ids of the two control strings: the first after the vocabulary."""
    n = len(vocabulary(path)[1])
    return n, n + 1


def _encoded(path: str, loss: tuple[str, ...]):
    """Of batches of c, role and text: formatted turns with their ids, spans under the loss, and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, end = control_ids(path)
        for batch in batches:
            roles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = [render(r, t) for r, t in zip(roles, texts)]
            heads, at = library_ids(path, pa.array([_escape_role(r) + "\n" for r in roles], pa.string()))
            bodies, to = library_ids(path, pa.array([m[0][m[1] : m[2]] for m in made], pa.string()))
            close = library_ids(path, pa.array(["\n"], pa.string()))[0]
            ids = [np.concatenate(([start], heads[at[i] : at[i + 1]], bodies[to[i] : to[i + 1]], [end], close)).astype(np.int32) for i in range(len(made))]
            own = [r in loss for r in roles]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            first, size = 1 + np.diff(at), np.diff(to)
            places = np.append(0, np.cumsum(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if o else 0 for m, o in zip(made, own)], pa.int64()), pa.array([m[2] if o else 0 for m, o in zip(made, own)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))),
                    pa.array(np.where(own, first, 0).astype(np.int32)), pa.array(np.where(own, first + size, 0).astype(np.int32)), pa.array(n),
                    pa.array([hashlib.blake2b(m[0].encode(), digest_size=16).digest() for m in made], pa.binary()),
                ], ["c", "text", "loss_from", "loss_to", "ids", "loss_ids_from", "loss_ids_to", "amount", "digest"],
            )

    return run


def _joined(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int, int]:
    """Rows, amount and hash of two stretches in a row."""
    return x[0] + y[0], x[1] + y[1], (x[2] * pow(_STEP, y[0], _PRIME) + y[2]) % _PRIME


def running(ranges: DataFrame, group: str, folder: str, name: str) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """Running sums of the columns ``amount`` and ``digest`` within ``group``, over ranges in order.

    ``ranges`` is dealt by range and sorted, by ``group`` first.  The written table has, for each row, the rows
    and the amount ``before`` it in its range's stretch of the group, the hash so far, and whether the stretch is
    the range's ``first``; the dictionary has what came before such a first stretch, a row a range.
    """
    place = [f.name for f in ranges.schema.fields]
    g, a, d = place.index(group), place.index("amount"), place.index("digest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, now, first = TaskContext.get().partitionId(), 0, None, True
        at = amount = h = 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for key, size, digest in zip(*(batch.column(i).to_pylist() for i in (g, a, d))):
                if key != now:
                    first, now, at, amount, h = now is None, key, 0, 0, 0
                h = (h * _STEP + int.from_bytes(digest, "big")) % _PRIME
                for x, v in zip(out, (first, at, amount, h.to_bytes(16, "big"))):
                    x.append(v)
                at, amount = at + 1, amount + size
            n = batch.num_rows
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), *(pa.array(x, t) for x, t in zip(out, (pa.bool_(), pa.int64(), pa.int64(), pa.binary())))]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*place, "part", "row", "first", "at", "before", "h"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    local = materialised(ranges.mapInArrow(lean(scan), f"{schema}, {_LOCAL}"), folder, name)
    ends = local.groupBy("part").agg(F.min_by(group, "row").alias("begins"), F.max_by(F.struct(F.col(group).alias("k"), "at", F.expr("before + amount").alias("total"), "h"), "row").alias("last"))
    carried, before, key = {}, (0, 0, 0), None
    for part, begins, last in sorted(ends.collect()):  # a row a range
        own = (last["at"] + 1, last["total"], int.from_bytes(last["h"], "big"))
        if key is not None and begins == key:
            carried[part] = before
            own = _joined(before, own) if last["k"] == begins else own
        key, before = last["k"], own
    return local, carried


def _whole(local: DataFrame, carried: dict[int, tuple[int, int, int]]) -> DataFrame:
    """``at`` and ``before`` of the whole group."""
    rows = local.sparkSession.createDataFrame([(p, n, a) for p, (n, a, _) in carried.items()], "part int, more_at bigint, more_before bigint")
    add = lambda c: F.when(F.col("first"), F.coalesce(F.col(f"more_{c}"), F.lit(0))).otherwise(0) + F.col(c)
    return local.join(F.broadcast(rows), "part", "left").withColumns({c: add(c) for c in ("at", "before")}).drop("more_at", "more_before")


def _hashes(local: DataFrame, carried: dict[int, tuple[int, int, int]]) -> DataFrame:
    """c, at, amount and the hash of the conversation up to each turn; no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h = [], []
            for part, first, n, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if first and part in carried:
                    m, _, v = _joined(carried[part], (n + 1, 0, int.from_bytes(own, "big")))
                    n, own = m - 1, v.to_bytes(16, "big")
                at.append(n)
                h.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array(h, pa.binary())], ["c", "amount", "at", "h"])

    return local.select("c", "amount", "part", "first", "at", "h").mapInArrow(lean(run), "c bigint, amount bigint, at bigint, h binary")


def write(conversations: DataFrame, path: str, folder: str, loss: tuple[str, ...] = ("assistant",)) -> None:
    """Formats all conversations into two tables below ``folder``.

    ``nodes``: the trees' turns in depth-first order (NODES; ``loss_from`` and ``loss_to`` are code points of
    ``text``, ``loss_ids_from`` and ``loss_ids_to`` places in ``ids``).  ``turns``: for each conversation's turn
    its tree and node (``segment``, ``at``).
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    names = (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))
    rows = conversations.select(*(column(conversations, c).cast(kind).alias(c) for c, kind in names))
    rows = rows.select(F.coalesce("conv_id", F.lit(LEAST)).alias("c"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    by = [F.col("c").asc(), F.col("turn").asc_nulls_first()]
    ranges = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by, "role", "text")
    work = f"{folder}/work"
    local, carried = running(ranges.select("c", "role", "text").mapInArrow(lean(_encoded(path, loss)), _BODY), "c", work, "bodies")
    turns = materialised(_turns(_hashes(local, carried)), work, "turns")
    paths = materialised(_paths(turns), work, "paths")
    segments = _segments(paths, work)
    bodies = _whole(local.select("c", "text", "loss_from", "loss_to", "ids", "loss_ids_from", "loss_ids_to", F.col("amount").alias("n_tokens"), "part", "first", "at", "before"), carried)
    nodes = bodies.join(segments, "c").where(F.col("at") >= F.col("begins"))
    start = F.col("place") + F.col("before") - F.col("base")
    own = F.struct(F.col("place").alias("start"), start.alias("end"))
    seen = F.when(start > F.col("place"), F.concat("ancestors", F.array(own))).otherwise(F.col("ancestors"))
    named = nodes.withColumns({"start": start, "position": F.col("before"), "segment": F.col("c"), "ancestors": seen}).select(*NODES)
    named.repartitionByRange(partitions(spark), "tree", "start").sortWithinPartitions("tree", "start").write.option("compression", "zstd").parquet(f"{folder}/nodes")
    trees = paths.select("c", F.col("path")[0]["segment"].alias("tree"))
    turns.join(trees, "c").select(F.when(F.col("c") != LEAST, F.col("c")).alias("conv_id"), "at", "tree", "segment").write.option("compression", "zstd").parquet(f"{folder}/turns")
    drop(spark, work)


def _turns(hashes: DataFrame) -> DataFrame:
    """c, at, amount and the segment that writes the turn's node."""
    long = hashes.join(hashes.groupBy("c").agg(F.count("*").alias("n")), "c")
    writer = long.groupBy("h").agg(F.min(F.struct(-F.col("n"), F.col("c")))["c"].alias("segment"))
    return long.join(writer, "h").select("c", "at", "amount", "segment")


def _paths(turns: DataFrame) -> DataFrame:
    """c and ``path``: the stretches of its turns by segment, from the root on."""
    parts = turns.groupBy("c", "segment").agg(F.min("at").alias("begins"), (F.max("at") + 1).alias("ends"), F.sum("amount").alias("tokens"))
    return parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("begins", "ends", "segment", "tokens"))).alias("path"))


def _segments(paths: DataFrame, work: str) -> DataFrame:
    """Of each conversation that writes nodes: its tree, where its first node begins, its place, its ancestors."""
    spark = paths.sparkSession
    last = F.element_at("path", -1)
    own = paths.where(last["segment"] == F.col("c")).withColumn("above", F.slice("path", F.lit(1), F.size("path") - 1))
    turned = F.transform("above", lambda p, i: F.struct((-p["ends"]).alias("ends"), F.get(F.col("path"), i + 1)["segment"].alias("segment")))
    base = F.aggregate("above", F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"])
    own = own.select("c", F.col("path")[0]["segment"].alias("tree"), turned.alias("order"), last["begins"].alias("begins"), last["tokens"].alias("amount"), base.alias("base"), "above", F.lit(b"").alias("digest"))
    ranges = own.repartitionByRange(partitions(spark), "tree", "order").sortWithinPartitions("tree", "order").drop("order")
    placed = materialised(_whole(*running(ranges, "tree", work, "order")).select("c", "tree", "begins", "base", "above", F.col("before").alias("place")), work, "placed")
    above = placed.select("c", F.posexplode("above").alias("k", "p")).select("c", "k", F.col("p.segment").alias("s"), "p.tokens")
    seen = above.join(placed.select(F.col("c").alias("s"), "place"), "s").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", F.col("place").alias("start"), (F.col("place") + F.col("tokens")).alias("end")))).alias("seen"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    ancestors = F.coalesce(F.transform("seen", lambda x: F.struct(x["start"], x["end"])), none)
    return placed.join(seen, "c", "left").select("c", "tree", "begins", "base", "place", ancestors.alias("ancestors"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation's turns from the written tables: conv_id, at, and its node's columns."""
    nodes = spark.read.parquet(f"{folder}/nodes")
    return spark.read.parquet(f"{folder}/turns").join(nodes.drop("tree"), ["segment", "at"])


def digests(turns: DataFrame) -> DataFrame:
    """Digests of conversations as ``read`` gives them; a conversation is a stream of turns, none is held."""
    kept = turns.select("conv_id", "at", "text", "loss_from", "loss_to")
    dealt = kept.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    names = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, n, chars, formatted, whole, under = None, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows: list[tuple] = []
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if not begun or conv != now:
                    if begun:
                        rows.append((now, n, whole.hexdigest(), chars, under.hexdigest(), formatted))
                    now, begun, n, chars, formatted, whole, under = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                whole.update("{}\n{}\n".format(*parse(text)).encode())
                masked = unescape(text[a:b])
                under.update(masked.encode())
                n, chars, formatted = n + 1, chars + len(masked), formatted + len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.values())], list(names))
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, n, whole.hexdigest(), chars, under.hexdigest(), formatted), names.values())], list(names))

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return dealt.mapInArrow(lean(run), schema)
