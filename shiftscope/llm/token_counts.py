"""Operator 4: offset-mapped attribution of tokens to fields and sections.

A document is rendered once, as its fields in order, each followed by a line
feed, and encoded once as a whole.  The vocabulary is byte-level, so the tokens'
byte lengths give their byte spans, and counting the code points before a byte
turns those into character spans.  The token spans are joined to the field spans
by interval: both are sorted, so two binary searches per token give the run of
fields that it overlaps.

A token that crosses a boundary is allocated by an explicit rule:
``first`` (the field of its first character), ``last``, ``largest`` (the field
with most of its characters, the earlier one on a tie) or ``split`` (each field
gets the share of the characters it holds).  A character of several bytes that
two tokens share belongs to both spans.

The line feed after a field belongs to that field; the text is divided into
``head`` (its first line, line feed included) and ``body`` (the rest).  Nulls:
a null field is an empty one, with a span that holds its line feed alone.
An empty section has an empty span and no tokens.  Repeated rows are counted
each for itself, a null doc_id is kept, and an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import documents

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "largest", "split")
SECTIONS = ("source", "lang", "head", "body")
#: texts are encoded in parts of about this many characters, cut where no token can cross
PART = 1 << 16
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])


class Encoder:
    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text.  A lone space between two letters always begins a token, so cuts there change nothing."""
        if len(text) <= 2 * PART:
            return np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        out, begin = [], 0
        while begin < len(text):
            end = begin + PART
            while end < len(text):
                end = text.find(" ", end)
                if end < 0:
                    end = len(text)
                elif end + 1 < len(text) and text[end - 1].isalpha() and text[end + 1].isalpha():
                    break
                else:
                    end += 1
            out += self.encoding.encode_ordinary(text[begin:end])
            begin = end
        return np.array(out, dtype=np.int64)


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens with the given byte lengths over a text's bytes."""
    ends = np.cumsum(lengths)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(LEAD[np.frombuffer(data, dtype=np.uint8)], out=before[1:])
    # the character of the first byte, and the one after the character of the last byte
    return before[ends - lengths + 1] - 1, before[ends]


def interval_join(start: np.ndarray, end: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (token, field, characters in common) of sorted, disjoint fields; empty spans overlap nothing."""
    low = np.searchsorted(stop, start, side="right")
    high = np.searchsorted(begin, end, side="left")
    count = np.maximum(0, high - low)
    token = np.repeat(np.arange(len(start)), count)
    field = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    common = np.minimum(end[token], stop[field]) - np.maximum(start[token], begin[field])
    real = common > 0
    return token[real], field[real], common[real]


def allocate(token: np.ndarray, field: np.ndarray, common: np.ndarray, fields: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per field by the rule, and how many tokens that touch the field cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    crossing = np.zeros(len(token), dtype=bool)
    crossing[1:] |= token[1:] == token[:-1]
    crossing[:-1] |= token[1:] == token[:-1]
    crossed = np.bincount(field[crossing], minlength=fields)
    if rule == "split":
        total = np.bincount(token, weights=common)
        return np.bincount(field, weights=common / total[token], minlength=fields), crossed
    order = {"first": (field, token), "last": (-field, token), "largest": (field, -common, token)}[rule]
    chosen = np.lexsort(order)
    chosen = chosen[np.append(True, token[chosen][1:] != token[chosen][:-1])] if len(chosen) else chosen
    return np.bincount(field[chosen], minlength=fields).astype(float), crossed


def sections_of(source: str | None, lang: str | None, text: str | None) -> tuple[str, list[int]]:
    """The rendered document and the bounds of its sections, in characters."""
    text = text or ""
    head = text.find("\n") + 1 or len(text)
    front = [(source or "") + "\n", (lang or "") + "\n"]
    bounds = [0, len(front[0]), len(front[0]) + len(front[1])]
    return "".join(front) + text, [*bounds, bounds[2] + head, bounds[2] + len(text)]


COUNTS = "doc_id long, section string, char_start long, char_end long, n_tokens double, n_crossing long, doc_tokens long"


def attribute(docs: DataFrame, rule: str = "largest") -> DataFrame:
    """Tokens of every section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        names = [x.split()[0] for x in COUNTS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, *parts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                whole, bounds = sections_of(*parts)
                ids = encoder.encode(whole)
                spans = token_spans(whole.encode(), encoder.lengths[ids])
                begin, stop = np.array(bounds[:-1]), np.array(bounds[1:])
                counts, crossed = allocate(*interval_join(*spans, begin, stop), len(begin), rule)
                rows += [(doc_id, *x, len(ids)) for x in zip(SECTIONS, bounds[:-1], bounds[1:], counts.tolist(), crossed.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in ("source", "lang", "text"))]
    return docs.select(*columns).mapInArrow(run, COUNTS)


def query(spark, sf_dir: str) -> DataFrame:
    return attribute(documents(spark, sf_dir))
