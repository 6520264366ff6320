"""Near-duplicate components by an exact n-gram Jaccard join with signature trees.

1. Every text gives its set of distinct word shingles; texts with one set are one class from here on.
2. Shingles are ordered by a frequency class, then by hash.  Frequencies come from a table of counters over all
   texts, whose size follows the input up to a bound; any one order is right, and this one keeps phrases that many
   texts share out of prefixes.  Two sets that reach the threshold have a shingle of both prefixes in common.
3. Classes that share a prefix shingle form a list, cut where the next size is too large for a link.  A list's
   members join the block of its first class.  That is linear in the postings, and any two classes of a list
   are together in a block.
4. In a block, a signature tree holds the members: leaves and nodes have OR-combined token bitmaps, size
   ranges, and how many tokens share a bit.  A dual traversal prunes node pairs whose largest possible overlap
   is too small, or which are already one group; what is left falls into small groups of possible links.
5. Only members of such groups fetch their sets.  In a group the same tree, over its own tokens, finds the
   pairs to compare exactly.  What leaves is a spanning forest, not pairs.
6. Blocks over ``BLOCK`` are cut into parts, and every pair of parts is a block of its own.  That copies a member
   once a part, so members of blocks over ``PARTS * BLOCK`` are first compared with a few pivots, in rounds, as many
   rows as members.  Members that are connected this way need no further comparison with each other: of such a
   block only the pairs with a member outside its largest connected group are left, which are cut into parts.
7. Components of the edges take the smallest doc_id.

Shingles are 56-bit hashes below their frequency class.  Defined results: null and empty texts, and texts
without words, have no shingles and stay alone; rows of one doc_id are linked like others; a missing doc_id is
no candidate for a component's smallest, and a component of such rows alone has none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.components import stars
from quire.llm.membership import bitmap, has, size_for
from quire.llm.session import bounded_batches, column, drop, free_names, lean, materialised, partitions, shared_folder
from quire.llm.spans import LOWER_VALUE, NONSPACE, Prefix, chunks, flat, mix, shingles, words

#: Counters of the frequency table at least and at most (a byte each when broadcast, four in a task that counts), and
#: of them in one row of its shuffle.  Between the two there is one for every SHARE bytes of text.  With fewer, only
#: shingles that stand out from all that share their counter are told apart, which costs longer lists, never results.
COUNTERS, MOST_COUNTERS, COUNTER_ROW, SHARE = 1 << 24, 1 << 26, 1 << 16, 32
#: Members of a block; blocks of so many times more meet pivots first; pivots that are drawn in a round, and rounds.
BLOCK, PARTS, PIVOTS, ROUNDS = 1500, 4, 8, 2
#: Documents of a tree's leaf, children of a node, and bits of a bitmap at most.
LEAF, FAN, BITMAP = 16, 8, 1 << 15
_LEAST = -(2**63)


def _shingle_runs(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in row order, and each row's first (one more than rows); repeats are in it."""
    starts, ends, first = words(data, offsets, NONSPACE)
    h = Prefix(data, LOWER_VALUE).of(starts, ends)
    n = np.diff(first)
    runs = shingles(h, k)
    row = np.repeat(np.arange(len(n)), n)[: len(runs)]
    inside = np.arange(len(runs)) + k <= first[1:][row] if len(runs) else np.zeros(0, dtype=bool)
    out, count = runs[inside], np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = np.append(0, np.cumsum(count))[short]
        out = np.insert(out, at, [shingles(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short.tolist()])
        count[short] = 1
    return out, np.append(0, np.cumsum(count))


def counters_for(size: int) -> int:
    """Counters for so many bytes of text: a power of two."""
    return min(MOST_COUNTERS, max(COUNTERS, 1 << max(0, -(-size // SHARE) - 1).bit_length()))


def classes_of(table: np.ndarray) -> np.ndarray:
    """The frequency class of each counter (rows of COUNTER_ROW): how far, in powers of two of the usual spread, its
    count is above the median.  Both are quantiles of the counts themselves, so classes stay apart however full the
    counters are.  Hashes fill the counters, so the quantiles of a stride of them are those of all."""
    middle, upper = np.quantile(table.ravel()[:: max(1, table.size >> 20)], (0.5, 0.9), method="higher").astype(np.int64).tolist()
    bounds = middle + max(1, upper - middle) * (np.int64(1) << np.arange(40))
    out = np.empty(table.shape, dtype=np.uint8)
    for i, row in enumerate(table):
        out[i] = np.searchsorted(bounds, row.astype(np.int64), side="left")
    return out.ravel()


def frequency_classes(texts: DataFrame, k: int) -> np.ndarray:
    """One byte a counter: the class of how often its shingles occur in all texts."""
    counters = counters_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(counters, dtype=np.uint32)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in chunks(offsets):
                runs, _ = _shingle_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                slots, n = np.unique((runs >> np.uint64(8)) & np.uint64(counters - 1), return_counts=True)
                total[slots.astype(np.int64)] += n.astype(np.uint32)
        rows, pack = total.reshape(-1, COUNTER_ROW), zstandard.ZstdCompressor(level=1)
        used = np.flatnonzero(rows.any(axis=1))
        for some in np.array_split(used, 1 + len(used) // 64):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pack.compress(rows[i].tobytes()) for i in some.tolist()], pa.binary())], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(at, np.zeros(COUNTER_ROW, dtype=np.uint64))
                own += np.frombuffer(unpack.decompress(counts), dtype=np.uint32)
        for at, own in total.items():
            own = np.minimum(own, 2**32 - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["at", "counts"])

    made = texts.select("text").mapInArrow(lean(count), "at bigint, counts binary").repartition(min(partitions(texts.sparkSession), counters // COUNTER_ROW), "at").mapInArrow(lean(add), "at bigint, counts binary")
    table = np.zeros((counters // COUNTER_ROW, COUNTER_ROW), dtype=np.uint32)
    for row in made.toLocalIterator():
        table[row["at"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return classes_of(table)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int, classes: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row: frequency class, then 56 bits of hash."""
    runs, first = _shingle_runs(data, offsets, k)
    low = runs >> np.uint64(8)
    runs = classes[(low & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | low
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(runs[a:b])


def _node(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], dtype=np.uint64))[0].view(np.int64))


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for the low end of every token's hash; two to four bits a token."""
    width = max(512, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _features(texts: DataFrame, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of the set), n, the prefix of the set, and its bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            nodes, sizes, prefixes, bitmaps = [], [], [], []
            for a, b in chunks(offsets):
                for tokens in _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, shared.value):
                    n = len(tokens)
                    nodes.append(_node(tokens) if n else None)
                    sizes.append(n)
                    bitmaps.append(_bitmap(tokens) if n else None)
                    # From the top of the order downwards the frequent ones come first, so the prefix is at its start.
                    prefixes.append(tokens[: n - (percent * n + 99) // 100 + 1] if n else tokens)
            at = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(bitmaps, pa.binary())], ["doc_id", "h", "node", "n", "prefix", "bits"])

    return texts.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(run), "doc_id bigint, h bigint, node bigint, n bigint, prefix array<bigint>, bits binary")


def _list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(leader, member) of every list of two or more classes, cut by size; the leader is its smallest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, 0
        for batch in batches:
            token, n, node = (c.to_numpy() for c in batch.columns)
            if not len(token):
                continue
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (n[:-1] * 100 < n[1:] * percent)
            lead = node[np.flatnonzero(new)][np.cumsum(new) - 1].copy()
            if last is not None and token[0] == last[0] and last[1] * 100 >= n[0] * percent:
                run_end = np.flatnonzero(new)[1] if new.sum() > 1 else len(token)
                lead[:run_end] = leader
            last, leader = (token[-1], n[-1]), lead[-1]
            pair = np.unique(np.stack([lead, node], axis=1)[lead != node], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["leader", "member"])

    spark = postings.sparkSession
    dealt = postings.select("token", "n", "node").repartition(partitions(spark), "token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(lean(run), "leader bigint, member bigint").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """leader, cell, member, open: blocks (leader, member, open, large).  Of a large block, members that are open are
    compared with each other and with the rest, in parts; the rest are connected already."""
    half = BLOCK // 2
    small = rows.where("not large").select("leader", F.lit(0).cast("bigint").alias("cell"), "member", F.lit(True).alias("open"))
    large = rows.where("large")
    counts = large.groupBy("leader").agg(F.ceil(F.sum(F.col("open").cast("int")) / half).cast("int").alias("a"), F.ceil(F.sum((~F.col("open")).cast("int")) / half).cast("int").alias("b")).where("a > 0")
    many = F.when(F.col("open"), F.col("a")).otherwise(F.col("b"))
    parts = large.join(counts, "leader").withColumn("part", F.pmod(F.xxhash64("member"), many))
    among = lambda n: F.sequence(F.lit(0), n - 1)
    # Cells of two open parts have even numbers, those of an open and another part odd ones.
    own = F.transform(among(F.col("a")), lambda j: 2 * (F.least(F.col("part"), j).cast("bigint") * F.col("a") + F.greatest(F.col("part"), j)))
    rest = F.transform(among(F.greatest("b", F.lit(1))), lambda j: 2 * (F.col("part").cast("bigint") * F.greatest("b", F.lit(1)) + j) + 1)
    other = F.transform(among(F.col("a")), lambda i: 2 * (i.cast("bigint") * F.col("b") + F.col("part")) + 1)
    cells = F.when(F.col("open"), F.when(F.col("b") > 0, F.concat(own, rest)).otherwise(own)).otherwise(other)
    return small.unionByName(parts.select("leader", F.explode(cells).alias("cell"), "member", "open"))


def _pivot_links(rows: DataFrame, percent: int) -> DataFrame:
    """Edges a, b between pivots and members (leader, salt, other, member, tokens; pivots, which come first, have
    other 0): every link, so that pivots with a neighbour in common are connected, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots, table = None, [], None
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for leader, salt, other, member, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (leader, salt) != key:
                    key, pivots, table = (leader, salt), [], None
                own = np.frombuffer(tokens, dtype=np.uint64)
                if not other:
                    pivots.append((member, own))
                    continue
                if table is None:
                    every, at = np.unique(np.concatenate([t for _, t in pivots]), return_inverse=True)
                    held = np.zeros((len(every), len(pivots)), dtype=np.int64)
                    held[at, np.repeat(np.arange(len(pivots)), [len(t) for _, t in pivots])] = 1
                    table = every, held, np.array([len(t) for _, t in pivots])
                every, held, sizes = table
                place = np.minimum(np.searchsorted(every, own), len(every) - 1)
                shared = held[place[every[place] == own]].sum(axis=0)
                for i in np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared)).tolist():
                    if pivots[i][0] != member:
                        left.append(pivots[i][0])
                        right.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    keys = ["leader", "salt"]
    dealt = rows.select(*keys, "other", "member", "tokens").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "other")
    return dealt.mapInArrow(lean(run), "a bigint, b bigint")


def _connected(members: DataFrame, sets: DataFrame, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of large blocks (leader, member, m): leader, member, open (not of the block's largest connected group); and the
    edges that were found."""
    now, edges, before = members.withColumn("open", F.lit(True)), None, None
    for n in range(ROUNDS):
        salts = F.ceil(F.col("m") / BLOCK).cast("int")
        open_ = now.where("open").groupBy("leader").agg(F.count("*").alias("u"))
        drawn = now.where("open").join(open_, "leader").where(F.pmod(F.xxhash64("member", F.lit(n)), F.col("u")) < PIVOTS)
        drawn = drawn.select("leader", "member", "m").unionByName(members.where("leader = member").select("leader", "member", "m")).distinct()
        pivots = drawn.select("leader", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("other"), "member")
        others = members.select("leader", F.pmod(F.xxhash64("member"), salts).cast("int").alias("salt"), F.lit(1).alias("other"), "member")
        found = _pivot_links(pivots.unionByName(others).join(sets.withColumnRenamed("node", "member"), "member"), percent)
        found = materialised(found if edges is None else found.unionByName(edges), folder, f"pivots{n}")
        roots = stars(found, f"{folder}/pivots{n}-roots").withColumnRenamed("node", "member")
        rooted = members.join(roots, "member", "left").select("leader", "member", "m", F.coalesce("root", "member").alias("root"))
        main = rooted.groupBy("leader", "root").count().groupBy("leader").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        now = materialised(rooted.join(main, "leader").select("leader", "member", "m", (F.col("root") != F.col("main")).alias("open")), folder, f"open{n}")
        edges, left = found, now.where("open").count()
        if not left or before is not None and left * 10 > before * 9:
            break
        before = left
    return now.select("leader", "member", "open"), edges


def _key(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    return mix(node.view(np.uint64) ^ mix(label.view(np.uint64) + np.uint64(1)))


def _chosen_sets(texts: DataFrame, k: int, classes: np.ndarray, bits: np.ndarray) -> DataFrame:
    """node and its set, of texts that the bitmap has (a few more may pass)."""
    shared = texts.sparkSession.sparkContext.broadcast((classes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = shared.value
        for batch in batches:
            label = np.array([_LEAST if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
            data, offsets = flat(batch.column(1))
            nodes, sets = [], []
            for a, b in chunks(offsets):
                for i, tokens in enumerate(_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, table)):
                    if len(tokens):
                        node = _node(tokens)
                        if has(wanted, _key(np.array([node]), label[a + i : a + i + 1]))[0]:
                            nodes.append(node)
                            sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    return texts.select("doc_id", "text").mapInArrow(lean(run), "node bigint, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


class SignatureTree:
    """Members of a block under nodes of OR-combined bitmaps, size ranges and slack.

    ``bits`` has a row of 64-bit words a member and ``slack`` its tokens beyond one a bit, which is what two
    sets can share beyond their common bits.  ``near`` decides pairs that the bound leaves; without it they
    are joined as they are.
    """

    def __init__(self, size: np.ndarray, bits: np.ndarray, slack: np.ndarray, percent: int, near: Callable[[int, np.ndarray], list[int]] | None = None, weight: np.ndarray | None = None, first: np.ndarray | None = None) -> None:
        self.size, self.bits, self.slack, self.percent, self.near = size, bits, slack, percent, near
        self.weight = weight if weight is not None else np.bitwise_count(bits & np.bitwise_or.reduce(bits, axis=0)).sum(axis=1) / np.maximum(1, size)
        self.order = np.lexsort((size, first)) if first is not None else np.argsort(size, kind="stable")
        self.parent = list(range(len(size)))
        self.levels = self._levels()

    @classmethod
    def of_bitmaps(cls, size: list[int], maps: list[bytes], percent: int) -> SignatureTree:
        """Of bitmaps of several widths: brought to the middle one, the wider folded, the narrower repeated."""
        width = sorted(len(m) for m in maps)[len(maps) // 2]
        rows, slack = np.empty((len(maps), width), dtype=np.uint8), np.empty(len(maps), dtype=np.int64)
        for i, m in enumerate(maps):
            own = np.frombuffer(m, dtype=np.uint8)
            own = np.bitwise_or.reduce(own.reshape(-1, width), axis=0) if len(own) >= width else own
            slack[i] = size[i] - int(np.bitwise_count(own).sum())
            rows[i] = np.resize(own, width)
        bits = rows.view(np.uint64)
        lowest = np.argmax(bits != 0, axis=1) * 64 + np.log2((bits & -bits.view(np.int64).astype(np.uint64))[np.arange(len(bits)), np.argmax(bits != 0, axis=1)].astype(np.float64) + 1e-9).astype(np.int64)
        return cls(np.array(size, dtype=np.int64), bits, slack, percent, first=lowest)

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], percent: int) -> SignatureTree:
        """Of whole sets: bits number the tokens that two members at least have, so small blocks are exact."""
        size = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, local, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = count > 1  # a token of one member is in no overlap
        number = np.cumsum(common) - 1
        keep = common[local]
        local, owner = number[local[keep]], owner[keep]
        tokens = int(common.sum())
        width = max(64, min(BITMAP, -(-tokens // 64) * 64))
        grid = np.zeros((len(sets), width), dtype=bool)
        grid[owner, local % width] = True
        held = np.bincount(owner, minlength=len(sets))
        weight = np.bincount(owner, weights=np.bincount(local, minlength=1)[local], minlength=len(sets)) / np.maximum(1, size)
        first = np.full(len(sets), 1 << 62, dtype=np.int64)
        np.minimum.at(first, owner, local)

        def near(i: int, others: np.ndarray) -> list[int]:
            return [j for j in others.tolist() if 100 * (x := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= percent * (len(sets[i]) + len(sets[j]) - x)]

        return cls(size, np.packbits(grid, axis=1, bitorder="little").view(np.uint64), held - grid.sum(axis=1), percent, None if tokens <= BITMAP else near, weight, first)

    def _levels(self) -> list[tuple[np.ndarray, ...]]:
        """From the leaves upwards: bitmap, least and largest size, slack of each node."""
        o, levels = self.order, []
        cut = np.arange(0, len(o), LEAF)
        now = (np.bitwise_or.reduceat(self.bits[o], cut, axis=0), np.minimum.reduceat(self.size[o], cut), np.maximum.reduceat(self.size[o], cut), np.maximum.reduceat(self.slack[o], cut))
        levels.append(now)
        while len(now[1]) > 1:
            cut = np.arange(0, len(now[1]), FAN)
            now = (np.bitwise_or.reduceat(now[0], cut, axis=0), np.minimum.reduceat(now[1], cut), np.maximum.reduceat(now[2], cut), np.maximum.reduceat(now[3], cut))
            levels.append(now)
        return levels

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def least(self, total: np.ndarray | int):
        """The overlap that sizes of this sum need: 100 * i >= percent * (total - i)."""
        return -(-self.percent * total // (100 + self.percent))

    def compare(self, i: int, others: np.ndarray) -> None:
        """Links i with those of the others that reach the threshold."""
        others = others[(self.size[others] * 100 >= self.percent * self.size[i]) & (self.size[i] * 100 >= self.percent * self.size[others])]
        if not len(others):
            return
        shared = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64) + np.minimum(self.slack[others], self.slack[i])
        left = others[shared >= self.least(self.size[others] + self.size[i])]
        for j in self.near(i, left) if self.near else left.tolist():
            self.join(i, j)

    def possible(self, level: int, x: int, ys: np.ndarray) -> np.ndarray:
        """Of nodes on one level, those whose members may reach the threshold with members of node x."""
        bits, low, high, slack = self.levels[level]
        ys = ys[(high[ys] * 100 >= self.percent * low[x]) & (high[x] * 100 >= self.percent * low[ys])]
        most = np.bitwise_count(bits[ys] & bits[x]).sum(axis=1, dtype=np.int64) + np.minimum(slack[ys], slack[x])
        most = np.minimum(most, np.minimum(high[ys], high[x]))
        return ys[most >= self.least(low[ys] + low[x])]

    def link(self) -> None:
        """Dual traversal from the top.  The member nearest to all is compared first: it joins most copies."""
        n = len(self.size)
        if n == 2:
            self.compare(0, np.array([1]))
            return
        everyone = np.arange(n)
        for i in np.argsort(-self.weight, kind="stable")[: 1 + n // 200].tolist():
            apart = np.array([j for j in range(n) if self.root(j) != self.root(i)], dtype=np.int64) if n > LEAF else everyone[everyone != i]
            self.compare(i, apart)
        self._visit(len(self.levels) - 1, 0, np.array([0]))

    def _members(self, level: int, x: int) -> np.ndarray:
        span = LEAF * FAN**level
        return self.order[x * span : (x + 1) * span]

    def _visit(self, level: int, x: int, ys: np.ndarray) -> None:
        """Compares node x with nodes ys >= x of its level."""
        ys = self.possible(level, x, ys)
        if not len(ys):
            return
        if level == 0:
            right = np.concatenate([self._members(0, y) for y in ys.tolist()])
            roots = np.array([self.root(j) for j in right.tolist()])
            own = self._members(0, x)
            for p, i in enumerate(own.tolist()):
                apart = roots != self.root(i)
                if x in ys:
                    apart[: p + 1] = False  # ys is ascending, so x's own members come first
                if apart.any():
                    self.compare(i, right[apart])
                    roots = np.array([self.root(j) for j in roots.tolist()])
            return
        children = len(self.levels[level - 1][1])
        below = np.concatenate([np.arange(y * FAN, min((y + 1) * FAN, children)) for y in ys.tolist()])
        for c in range(x * FAN, min((x + 1) * FAN, children)):
            self._visit(level - 1, c, below[below >= c])

    def forest(self) -> list[tuple[int, int]]:
        return [(self.root(i), i) for i in range(len(self.size)) if self.root(i) != i]


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """leader, cell, part, member: the groups of possible links in every block that have an open member, by bitmaps
    alone."""

    def solve(key: tuple, nodes: list[int], sizes: list[int], maps: list[bytes], fresh: list[bool]) -> Iterator[tuple[int, int, int, int]]:
        if len(nodes) > 1:
            tree = SignatureTree.of_bitmaps(sizes, maps, percent)
            tree.link()
            roots = [tree.root(i) for i in range(len(nodes))]
            many, wanted = Counter(roots), {r for r, f in zip(roots, fresh) if f}
            yield from ((*key, r, node) for r, node in zip(roots, nodes) if many[r] > 1 and r in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sizes, maps, fresh = (0, 0), [], [], [], []
        names = ["leader", "cell", "part", "member"]
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for leader, cell, member, n, bits, f in zip(*(c.to_pylist() for c in batch.columns)):
                if (leader, cell) != key:
                    out += solve(key, nodes, sizes, maps, fresh)
                    key, nodes, sizes, maps, fresh = (leader, cell), [], [], [], []
                nodes.append(member)
                sizes.append(n)
                maps.append(bits)
                fresh.append(f)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names)
        out = list(solve(key, nodes, sizes, maps, fresh))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names)

    dealt = rows.select("leader", "cell", "member", "n", "bits", "open").repartition(partitions(rows.sparkSession), "leader", "cell").sortWithinPartitions("leader", "cell")
    return dealt.mapInArrow(lean(run), "leader bigint, cell bigint, part bigint, member bigint")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Edges a, b of every group's spanning forest."""

    def solve(nodes: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        if len(nodes) < 2:
            return [], []
        tree = SignatureTree.of_sets(sets, percent)
        tree.link()
        forest = tree.forest()
        return [nodes[i] for i, _ in forest], [nodes[j] for _, j in forest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        left: list[int] = []
        right: list[int] = []
        for batch in batches:
            for leader, cell, part, member, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (leader, cell, part) != key:
                    a, b = solve(nodes, sets)
                    left, right = left + a, right + b
                    key, nodes, sets = (leader, cell, part), [], []
                nodes.append(member)
                sets.append(np.frombuffer(tokens, dtype=np.uint64))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
                left, right = [], []
        a, b = solve(nodes, sets)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["leader", "cell", "part"]
    dealt = rows.select(*keys, "member", "tokens").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lean(run), "a bigint, b bigint")


def components(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """One row a document: doc_id, h (hash of its text), n_shingles, node (its set's hash), root (its
    component's smallest node; both null without shingles) and component_id.

    Two documents link when 100 * intersection >= percent * union of their distinct word shingles.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark)
    texts = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    classes = frequency_classes(texts, shingle)
    features = materialised(_features(texts, shingle, percent, classes), folder, "features")
    real = features.where("node is not null")
    labels = real.groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(_LEAST)).alias("label"))
    sets = real.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    pairs = materialised(_list_pairs(sets.select(F.explode("prefix").alias("token"), "n", "node"), percent), folder, "pairs")
    bitmaps = real.groupBy(F.col("node").alias("member")).agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        chosen = labels.join(nodes.distinct(), "node").select("node", "label")
        wanted = bitmap(chosen, lambda b: _key(b.column(0).to_numpy(), b.column(1).to_numpy()), size_for(chosen.count()))
        return _chosen_sets(texts, shingle, classes, wanted)

    blocks = pairs.unionByName(pairs.select("leader", F.col("leader").alias("member")).distinct())
    large = materialised(pairs.groupBy("leader").agg((F.count("*") + 1).alias("m")).where(F.col("m") > BLOCK), folder, "large")
    rows, known, many = blocks.select("leader", "member", F.lit(True).alias("open"), F.lit(False).alias("large")), None, PARTS * BLOCK
    most = large.agg(F.max("m")).first()[0]
    if most is not None:
        rows = blocks.join(large, "leader", "left").select("leader", "member", F.lit(True).alias("open"), F.col("m").isNotNull().alias("large"), F.coalesce("m", F.lit(0)).alias("m"))
        if most > many:
            members = materialised(blocks.join(large.where(F.col("m") > many), "leader"), folder, "members")
            sets_ = materialised(sets_of(members.select(F.col("member").alias("node"))), folder, "sets")
            found, known = _connected(members, sets_, percent, folder)
            rows = rows.where(F.col("m") <= many).drop("m").unionByName(found.withColumn("large", F.lit(True)))
        rows = rows.drop("m")
    groups = materialised(_groups(_cells(rows).join(bitmaps, "member"), percent), folder, "groups")
    edges = _links(groups.join(sets_of(groups.select(F.col("member").alias("node"))).withColumnRenamed("node", "member"), "member"), percent)
    edges = edges if known is None else edges.unionByName(known)
    roots = stars(edges, folder)
    for name in ("pairs", "large", "groups", "members", "sets", *(f"{x}{n}" for n in range(ROUNDS) for x in ("pivots", "open")), *(f"pivots{n}-roots" for n in range(ROUNDS))):
        drop(spark, f"{folder}/{name}")  # read for the last time, or never written
    rooted = labels.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("label") != _LEAST, F.col("label")).alias("label"))
    smallest = rooted.groupBy("root").agg(F.min("label").alias("component_id"))
    by_node = rooted.select("node", "root").join(smallest, "root")
    out = features.select("doc_id", "h", "n", "node").join(by_node, "node", "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "node", "root", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest doc_id (a missing one
    counts as largest; of rows alike in it, that of the smallest hash of the text), and every row without
    shingles.  Only rows that may have to go are shuffled.  Columns must not be called ``_d``, ``_h``, ``_best`` or
    ``_n`` (ValueError)."""
    spark = docs.sparkSession
    free_names(tuple(docs.columns), ("_d", "_h", "_best", "_n"))
    d = lambda c: F.coalesce(c.cast("bigint"), F.lit(2**63 - 1))
    found = materialised(components(docs, shingle, percent).where("node is not null").select(d(F.col("doc_id")).alias("_d"), F.col("h").alias("_h"), "root"), shared_folder(spark), "found")
    best = found.groupBy("root").agg(F.min(F.struct("_d", "_h")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    doubtful = materialised(found.join(best, "root").groupBy("_d", "_h").agg(F.max(F.struct("_d", "_h") == F.col("best")).alias("_best")), shared_folder(spark), "doubtful")
    bits = bitmap(doubtful.select("_d", "_h"), lambda b: _key(b.column(0).to_numpy(), b.column(1).to_numpy()), size_for(doubtful.count()))
    shared = spark.sparkContext.broadcast(bits)
    keyed = docs.select("*", d(column(docs, "doc_id")).alias("_d"), F.xxhash64(column(docs, "text").cast("string")).alias("_h"))

    def marked(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = has(shared.value, _key(batch.column("_d").to_numpy(), batch.column("_h").to_numpy()))
                yield batch.filter(pa.array(mask if inside else ~mask))

        return keyed.mapInArrow(lean(run), keyed.schema)

    one = Window.partitionBy("_d", "_h").orderBy(F.lit(0))
    checked = marked(True).join(doubtful, ["_d", "_h"], "left").withColumn("_n", F.row_number().over(one))
    checked = checked.where("_best is null or (_best and _n = 1)")
    return marked(False).drop("_d", "_h").unionByName(checked.drop("_d", "_h", "_best", "_n"))
