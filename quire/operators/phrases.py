"""Phrase conversion: leftmost-longest replacement of a table's phrases in whole texts, code left as it is.

The table is read in blocks of bounded size, each broadcast.  A block's phrases are an Aho-Corasick automaton in the
task, which gives the longest match at each place; a batch of texts passes the blocks one after another and carries
those matches, so that a table of several blocks gives the same result with one automaton in memory.  Then the matches
are taken from left to right, each the longest at its place.

Defined results: missing texts stay missing; an empty phrase matches nothing; of several renderings of a phrase the
smallest counts; a missing rendering is empty.  In markup, tags (also placeholders' lines are text), comments, and
what is inside code, pre, script and style elements are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's phrases and renderings, which are broadcast.
BLOCK_BYTES = 32 << 20
_KEPT = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(code|pre|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[^>]*>")


def longest(automaton, text: str, markup: bool) -> dict[int, tuple[int, str]]:
    """The longest match at each place of a text."""
    out: dict[int, tuple[int, str]] = {}
    at, n = 0, len(text)
    while at <= n:
        tag = _KEPT.search(text, at) if markup else None
        end = tag.start() if tag else n
        for last, (size, rendering) in automaton.iter(text, at, end):
            start = last - size + 1
            if start >= at and size > out.get(start, (0, ""))[0]:
                out[start] = (size, rendering)
        if not tag:
            break
        at = tag.end()
    return out


def applied(text: str, matches: dict[int, tuple[int, str]]) -> str:
    """The text with its matches replaced from left to right."""
    parts, at = [], 0
    for start in sorted(matches):
        if start >= at:
            size, rendering = matches[start]
            parts += [text[at:start], rendering]
            at = start + size
    return "".join([*parts, text[at:]])


def blocks(table: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The table (phrase, rendering) in blocks of at most about ``BLOCK_BYTES``; one is on the driver at a time."""
    rows = table.where("phrase <> ''").groupBy("phrase").agg(F.coalesce(F.min("rendering"), F.lit("")).alias("rendering"))
    size = rows.agg(F.sum(F.octet_length("phrase") + F.octet_length("rendering") + 64)).first()[0] or 0
    many = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1  # half full, as hashes don't deal evenly
    for b in range(many if size else 0):
        some = rows if many == 1 else rows.where(F.pmod(F.xxhash64("phrase"), F.lit(many)) == b)
        block = [(r["phrase"], r["rendering"]) for r in some.collect()]
        if block:
            yield block


def convert(rows: DataFrame, column: str, table: DataFrame, markup: bool = False) -> DataFrame:
    """``rows`` with the phrases of ``table`` (phrase, rendering) in ``column`` replaced; a narrow map."""
    context = rows.sparkSession.sparkContext
    at = rows.columns.index(column)
    known = [context.broadcast(block) for block in blocks(table)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        def automaton(block):
            out = ahocorasick.Automaton()
            for phrase, rendering in block:
                out.add_word(phrase, (len(phrase), rendering))
            out.make_automaton()
            return out

        held = automaton(known[0].value) if len(known) == 1 else None
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found: list[dict[int, tuple[int, str]]] = [{} for _ in texts]
            for block in known:  # one automaton at a time
                own = held or automaton(block.value)
                for matches, text in zip(found, texts):
                    for start, m in (longest(own, text, markup) if text else {}).items():
                        if m[0] > matches.get(start, (0, ""))[0]:
                            matches[start] = m
            new = pa.array([None if t is None else applied(t, m) for t, m in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields) if known else rows
