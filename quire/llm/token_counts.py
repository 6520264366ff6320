"""Token counts of fields and sections by offset-mapped attribution.

Each document is encoded once, whole.  Its tokens' character spans are then interval-joined to the spans of
its sections: both are sorted, so every section finds its tokens by two binary searches.  A token that
crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds the token's first character;
* ``end``: to the one that holds its last character;
* ``split``: to each in proportion to the token's characters inside.

Sections may overlap, nest and leave gaps; tokens in no section are counted as outside.  Bytes of one
character that two tokens share belong to both tokens' spans, as the library's offsets have it.

Defined results: null counts as the empty text (no tokens); an empty section has none; sections beyond the
text are cut at its end; repeated rows each get their rows; a kept column must not have a made one's name (ValueError).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.pretokens import library_ids, widths
from quire.llm.session import bounded_batches, column, free_names, lean

RULES = ("start", "end", "split")


def token_spans(path: str, text: str, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of every token; ``ids`` may give the text's ids."""
    ids = library_ids(path, pa.array([text]))[0] if ids is None else ids
    ends = np.cumsum(widths(path)[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
    first = np.append(0, ends[:-1])[: len(ends)]
    if text.isascii():
        return first, ends
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return char[first], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (rows of first, past-the-last character) and how many cross one of its bounds."""
    a, b = sections[:, 0], sections[:, 1]
    if rule == "start":
        n = np.searchsorted(starts, b) - np.searchsorted(starts, a)
    elif rule == "end":
        n = np.searchsorted(ends, b, side="right") - np.searchsorted(ends, a, side="right")
    elif rule == "split":
        total = np.zeros(len(starts) + 1)
        total[1:] = np.arange(1, len(starts) + 1)

        def upto(x: np.ndarray) -> np.ndarray:
            whole = np.searchsorted(ends, x, side="right")
            at = np.minimum(whole, max(0, len(starts) - 1))
            inside = np.clip(x - starts[at], 0, ends[at] - starts[at]) / np.maximum(1, ends[at] - starts[at]) if len(starts) else 0.0
            return total[whole] + np.where(whole < len(starts), inside, 0.0)

        n = upto(b) - upto(a)
    else:
        raise ValueError(f"rule must be one of {RULES}")
    cross = lambda x: np.searchsorted(starts, x) - np.searchsorted(ends, x, side="right")  # noqa: E731  begun before x, not ended at x
    return np.where(b > a, n, 0), np.where(b > a, cross(a) + cross(b), 0)


def lines(text: str) -> list[tuple[str, int, int]]:
    """Sections by line: label, first and past-the-last character; a line's end belongs to it."""
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        end = min(len(text), at + len(line) + 1)
        out.append((str(n), at, end))
        at = end
    return out if text else []


def attribute(docs: DataFrame, path: str, sections: Callable[[str], list[tuple[str, int, int]]] = lines, rule: str = "start", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_outside`` (tokens with their first character in no section) and
    ``sections array<struct<label, start, end, tokens double, crossing>>``; a narrow map of whole texts."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(docs.sparkSession)
    free_names(keep, ("n_tokens", "n_outside", "sections"))
    source = docs.select(*(column(docs, c).alias(c) for c in keep), column(docs, "text").cast("string").alias("_text_"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, outside, rows, ends = [], [], {k: [] for k in ("label", "start", "end", "tokens", "crossing")}, [0]
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ids, at = library_ids(path, batch.column(len(keep)))
            for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()):
                starts, stops = token_spans(path, text, ids[a:b])
                own = sections(text)
                spans = np.array([(min(a, len(text)), min(b, len(text))) for _, a, b in own], dtype=np.int64).reshape(-1, 2)
                n, crossing = allocate(starts, stops, spans, rule)
                covered = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(covered, spans[:, 0], 1)
                np.add.at(covered, spans[:, 1], -1)
                total.append(len(starts))
                outside.append(int((np.cumsum(covered)[starts] <= 0).sum()))
                rows["label"] += [x[0] for x in own]
                for k, v in (("start", spans[:, 0]), ("end", spans[:, 1]), ("tokens", n), ("crossing", crossing)):
                    rows[k].append(np.asarray(v))
                ends.append(ends[-1] + len(own))
            flat = [pa.array(rows["label"], pa.string()), *(pa.array(np.concatenate(rows[k]) if rows[k] else [], t) for k, t in (("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total, pa.int64()), pa.array(outside, pa.int64()), lists], [*keep, "n_tokens", "n_outside", "sections"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(lean(run), ", ".join([*kept, "n_tokens bigint", "n_outside bigint", "sections array<struct<label: string, start: bigint, end: bigint, tokens: double, crossing: bigint>>"]))
