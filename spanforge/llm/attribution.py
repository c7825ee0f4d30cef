"""Token counts of a document's parts: whole texts are encoded once, and tokens are dealt to parts by their spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.tokens import encoder
from spanforge.llm.words import frugal

TOKENIZER = "byte_bpe_50k.json"
#: Which byte of a token decides the part that gets it.
RULES = ("first", "middle", "last")
#: Bytes of text attributed at a time.
CHUNK = 1 << 23


def token_bytes(texts: pa.Array, tokenizer: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every token in the texts' joined bytes. A byte-level vocabulary drops none, so lengths add up."""
    enc = encoder(tokenizer, True)
    ids, _ = enc.encode(texts)
    ends = np.cumsum(enc.bytes[ids], dtype=np.int64)
    return ends - enc.bytes[ids], ends


def anchors(first: np.ndarray, end: np.ndarray, rule: str) -> np.ndarray:
    """The byte that decides: each token has one, so parts that cover a text share its tokens without loss or doubles."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    return {"first": first, "middle": (first + end - 1) // 2, "last": end - 1}[rule]


def line_parts(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end) of every line: \\n-split, each newline with the line that it ends."""
    breaks = np.flatnonzero(joined == 10) + 1
    of = np.searchsorted(starts, breaks - 1, "right") - 1
    # a start shared by several documents (empty ones) belongs to the last: the newline's own document has bytes
    doc = np.concatenate([np.arange(len(starts)), of])
    first = np.concatenate([starts, breaks])
    order = np.lexsort((first, doc))
    doc, first = doc[order], first[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.empty(0, bool)
    end = np.where(last, ends[doc], np.append(first[1:], 0))
    return doc, first, end


def attribute(docs: DataFrame, rule: str = "middle", sections: str | None = None, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, section, name, start, end, n_tokens, n_crossing and doc_tokens, one row per section of each row.

    Sections are a document's lines, or the spans of column `sections` (array of struct name, start, end in
    code points, in any order; they may overlap or leave gaps, and ends beyond the text are cut). start and
    end are code points. A token goes to the sections that hold its deciding byte (`rule`); n_crossing counts
    those of them that also reach outside. Lines share all tokens of a document. A null or empty text has
    one empty line, and null sections are none. Repeated rows are attributed each; an empty table is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            texts = batch.column(1).cast(pa.string()).fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                yield some(batch.slice(at, stop - at), pa.concat_arrays([texts.slice(at, stop - at)]))
                at = stop

    def some(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        length = pc.binary_length(texts).to_numpy().astype(np.int64)
        ends = np.cumsum(length)
        starts = ends - length
        joined = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
        # code points before each byte, and the byte that begins each code point
        begins = (joined & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(begins)])
        name: list[str | None] | None = None
        if sections is None:
            doc, first, end = line_parts(joined, starts, ends)
        else:
            byte_of = np.append(np.flatnonzero(begins), len(joined))
            rows = [(i, s) for i, v in enumerate(batch.column(2).to_pylist()) for s in v or [] if s]
            doc = np.array([i for i, _ in rows], np.int64)
            name = [s["name"] for _, s in rows]
            low, high = points[starts[doc]], points[ends[doc]]
            a = np.clip(low + np.array([s["start"] or 0 for _, s in rows], np.int64), low, high)
            b = np.clip(low + np.array([s["end"] or 0 for _, s in rows], np.int64), a, high)
            first, end = byte_of[a], byte_of[b]
        t_first, t_end = token_bytes(texts, tokenizer)
        by = anchors(t_first, t_end, rule)
        lo, hi = np.searchsorted(by, first), np.searchsorted(by, end)
        # among the tokens lo..hi-1 those that begin before the section or end after it are at its two ends
        before = np.clip(np.searchsorted(t_first, first), lo, hi) - lo
        after = hi - np.clip(np.searchsorted(t_end, end, "right"), lo, hi)
        both = (hi - lo == 1) & (before == 1) & (after == 1)
        whole = np.searchsorted(t_first, ends) - np.searchsorted(t_first, starts)
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        columns = [
            batch.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(name or [None] * len(doc), pa.string()),
            pa.array(points[first] - points[starts[doc]]), pa.array(points[end] - points[starts[doc]]), pa.array(hi - lo), pa.array(before + after - both), pa.array(whole[doc]),
        ]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if i > 2 else c for i, c in enumerate(columns)], names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    needed = ["doc_id", F.col(f"`{text}`"), *([F.col(f"`{sections}`")] if sections else [])]
    return docs.select(*needed).mapInArrow(run, f"doc_id {kind}, section int, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
