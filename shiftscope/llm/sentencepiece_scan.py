"""Operator 10: SentencePiece encoding by a max-plus parallel scan, and decoding.

Segmenting a text into vocabulary pieces with the greatest sum of scores is a
longest path, a product in the max-plus semiring.  A piece has at most ``K``
characters, so all that a chunk of text needs to know of its left neighbour is
its boundary state: how many of the chunk's first characters the neighbour's
last piece already covers (0 to K-1).  Each chunk of a giant document yields its
K x K transfer matrix on its own; the matrices are combined associatively into
the best score of every boundary state, the states on the best path follow from
the right end, and every chunk is then backtraced on its own between its two
states.  The chunks of a document are rows of their own all the way.

No piece has a space after another character, so no piece crosses the place
before a space that follows another character; more generally none crosses
between two bytes that stand side by side in no piece.  Texts are cut at such
places into parts, whose hashes are looked up in a bounded memo; the parts that
are new are solved side by side, one lattice step of all of them at a time.  Only
a chunk without any such place runs the full lattice for all its boundary states.

The vocabulary file that is available is a byte-fallback BPE model.  Its pieces
and scores define the lattice here, so the ids are the best-scoring ones and not
those of the merge order (scores under half of ``UNKNOWN`` are raised to that).
A character without a piece becomes its UTF-8 byte
pieces, at the score ``UNKNOWN``; that also holds for a literal U+2581, so
decoding gives back every text exactly.  Ties: the longer last piece inside a
chunk, the lower boundary state between chunks.

Documents of one chunk are encoded in one pass and go no further; only the chunks
of giant ones are dealt out over tasks, by a hash of the text, so a lost executor's
part is made again the same.  Checksums of a giant's ids and text are combined from
those of its chunks.

Nulls: a null text encodes to no ids, as does an empty one; a null doc_id is
kept, repeated rows are encoded each for itself, and an empty table gives an
empty result.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import documents, durable, small_batches, text_groups
from shiftscope.llm.textops import SECOND, HashIndex, U, distinct_pairs, mix, span_hashes

MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 15
UNKNOWN = -100_000.0
MEMO = 400_000
#: parts of more bytes are solved one by one
LONG = 64
LOW = -1e300
#: chunks of giant documents that a task takes at a time
CHUNKS_EACH = 64
#: pieces are looked up by a polynomial over a table of bytes modulo 2**64, with their first 8 bytes as a check
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mix((np.arange(256, dtype=U) + U(1)) * U(_BASE))


def _piece_hash(piece: bytes) -> int:
    total, power = 0, 1
    for b in piece:
        total, power = total + int(_TABLE[b]) * power & 0xFFFFFFFFFFFFFFFF, power * _BASE & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([total + len(piece) & 0xFFFFFFFFFFFFFFFF], dtype=U))[0])


class Lattice:
    """The pieces of a SentencePiece model, by text, with a space for the model's space mark."""

    def __init__(self, name: str = MODEL, memo: int = MEMO):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes: list[int] = [0] * 256
        self.texts: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.pieces[text] = (max(model.get_score(i), UNKNOWN / 2), i)
                self.texts.append(text.encode())
        self.longest = max(map(len, self.pieces))
        if any(" " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("a piece has a space after another character")
        self.reach: dict[str, int] = {}  # the longest piece by its first two characters
        for p in self.pieces:
            self.reach[p[:2]] = max(len(p), self.reach.get(p[:2], 1))
        # pairs of bytes at the borders of characters inside pieces, and inside characters; between others no piece crosses
        self.joined = np.zeros(1 << 16, dtype=bool)
        for first in range(256):
            self.joined[first * 256 + 128 : first * 256 + 192] = True
        for p in self.pieces:
            raw = np.frombuffer(p.encode(), dtype=np.uint8).astype(np.int64)
            self.joined[raw[:-1] * 256 + raw[1:]] = True
        names = [p.encode() for p in self.pieces]
        self.widest = max(map(len, names))
        self.index = HashIndex(len(names))
        self.index.add(np.array([_piece_hash(n) for n in names], dtype=U), np.array([int.from_bytes(n[:8], "little") for n in names], dtype=U))
        self.scores = np.array([s for s, _ in self.pieces.values()])
        self.ids = np.array([i for _, i in self.pieces.values()], dtype=np.uint32)
        self.byte_ids = np.array(self.bytes, dtype=np.uint32)
        self.limit = memo
        self.clear()

    def edges(self, text: str, at: int, end: int) -> list[tuple[int, float]]:
        """Lengths and scores of what can begin at a place, up to ``end``."""
        found = [(n, p[0]) for n in range(1, min(self.longest, end - at) + 1) if (p := self.pieces.get(text[at : at + n]))]
        if not found or found[0][0] != 1:
            found.insert(0, (1, UNKNOWN))
        return found

    def ids_of(self, part: str) -> list[int]:
        found = self.pieces.get(part)
        return [found[1]] if found else [self.bytes[b] for b in part.encode()]

    def best(self, text: str, begin: int, end: int) -> tuple[float, list[int]]:
        """Best score and ids from one place to another (longer last piece on ties)."""
        text = text[begin:end]
        n = len(text)
        score, back = [LOW] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        pieces, reach = self.pieces.get, self.reach.get
        for i in range(n):
            base = score[i]
            one = pieces(text[i])
            value = base + (one[0] if one else UNKNOWN)
            if value > score[i + 1]:
                score[i + 1], back[i + 1] = value, 1
            for j in range(i + 2, min(n, i + reach(text[i : i + 2], 1)) + 1):
                found = pieces(text[i:j])
                if found and base + found[0] >= score[j] and (base + found[0] > score[j] or j - i > back[j]):
                    score[j], back[j] = base + found[0], j - i
        cuts, at = [], n
        while at:
            cuts.append((at - back[at], at))
            at -= back[at]
        ids: list[int] = []
        for a, b in reversed(cuts):
            found = pieces(text[a:b])
            if found:
                ids.append(found[1])
            else:
                ids += [self.bytes[v] for v in text[a:b].encode()]
        return score[n], ids

    def clear(self) -> None:
        self.memo = HashIndex(2 * self.limit)
        self.ends = np.zeros(1025, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.totals = np.zeros(1024)

    def _store(self, hashes: np.ndarray, checks: np.ndarray, totals: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        known, n = self.memo.known, self.memo.known + len(hashes)
        while n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while n > len(self.totals):
            self.totals = np.concatenate([self.totals, np.zeros_like(self.totals)])
        self.ends[known + 1 : n + 1] = self.ends[known] + np.cumsum(lengths)
        while self.ends[n] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.ends[known] : self.ends[n]] = ids
        self.totals[known:n] = totals
        self.memo.add(hashes, checks)

    def _solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, numbers of ids and ids of many short parts side by side."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        n, longest = len(starts), int(sizes.max())
        at = np.minimum(starts + np.arange(longest)[:, None], len(data) - 1)
        inside = np.arange(longest)[:, None] < sizes
        raw = np.where(inside, data[at], 0)  # (place, part)
        lead = (raw & 0xC0) != 0x80
        steps = np.ones(longest, dtype=U)
        steps[1:] = U(_BASE)
        back_steps = np.ones(longest, dtype=U)
        back_steps[1:] = U(_INVERSE)
        up, down = np.multiply.accumulate(steps), np.multiply.accumulate(back_steps)
        sums = np.zeros((longest + 1, n), dtype=U)
        np.cumsum(_TABLE[raw] * up[:, None], axis=0, out=sums[1:])
        active = np.searchsorted(-sizes, -np.arange(longest) - 1, side="right")
        best = np.full((longest + 1, n), LOW)
        best[0] = 0.0
        back, via = np.zeros((longest + 1, n), dtype=np.int16), np.full((longest + 1, n), -1, dtype=np.int32)
        lanes8 = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))
        for t in range(longest):
            lanes = np.flatnonzero(lead[t, : active[t]])
            if not lanes.size:
                continue
            width, left = 0, lanes
            chars = np.zeros(n, dtype=np.int64)
            head = np.zeros(n, dtype=U)
            head[lanes] = lanes8[starts[lanes] + t]
            while left.size and width < self.widest:
                width += 1
                left = left[t + width <= sizes[left]]
                # a piece ends where a character does
                stop = (t + width == sizes[left]) | lead[np.minimum(t + width, longest - 1), left]
                here = left[stop]
                if not here.size:
                    continue
                hashes = mix((sums[t + width, here] - sums[t, here]) * down[t] + U(width))
                piece = self.index.get(hashes, head[here] & U((1 << 8 * min(width, 8)) - 1))
                first = chars[here] == 0
                chars[here] += 1
                value = best[t, here] + np.where(piece >= 0, self.scores[np.maximum(piece, 0)], np.where(first, UNKNOWN, LOW))
                old = best[t + width, here]
                better = (value > old) | (value == old) & (width > back[t + width, here])
                better &= (piece >= 0) | first
                won = here[better]
                best[t + width, won], back[t + width, won], via[t + width, won] = value[better], width, piece[better]
        totals = best[sizes, np.arange(n)]
        # backtrace: tokens from the right end, then each part's tokens in order
        place, part = sizes.copy(), np.arange(n)
        owners, orders, found = [], [], []
        step = 0
        while part.size:
            width, piece = back[place, part].astype(np.int64), via[place, part]
            whole = piece >= 0
            owners.append(part[whole])
            orders.append(np.full(int(whole.sum()), step * 8))
            found.append(self.ids[piece[whole]])
            for k in range(4):  # a character without a piece: its bytes, the last one first
                some = ~whole & (width > k)
                owners.append(part[some])
                orders.append(np.full(int(some.sum()), step * 8 + k))
                found.append(self.byte_ids[raw[place[some] - 1 - k, part[some]]])
            place = place - width
            part, place = part[place > 0], place[place > 0]
            step += 1
        owners, orders, found = np.concatenate(owners), np.concatenate(orders), np.concatenate(found)
        original = order[owners]
        sort = np.lexsort((-orders, original))
        lengths = np.bincount(original, minlength=n)
        scores = np.empty(n)
        scores[order] = totals
        return scores, lengths, found[sort]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Memo numbers of the parts; new ones are solved first."""
        hashes, checks = span_hashes(data, starts, ends), span_hashes(data, starts, ends, SECOND)
        at = self.memo.get(hashes, checks)
        if (missing := np.flatnonzero(at < 0)).size:
            where = missing[distinct_pairs(hashes[missing], checks[missing])]
            if self.memo.known + len(where) > self.limit:
                self.clear()
                where = distinct_pairs(hashes, checks)
            short = ends[where] - starts[where] <= LONG
            for i in range(0, int(short.sum()), 1 << 14):
                own = where[short][i : i + (1 << 14)]
                self._store(hashes[own], checks[own], *self._solve(data, starts[own], ends[own]))
            for k in where[~short].tolist():
                text = data[starts[k] : ends[k]].tobytes().decode()
                score, ids = self.best(text, 0, len(text))
                self._store(hashes[k : k + 1], checks[k : k + 1], np.array([score]), np.array([len(ids)]), np.array(ids, dtype=np.uint32))
            at = self.memo.get(hashes, checks)
        return at

    def spans(self, texts: list[str]) -> list[tuple[float, bytes]]:
        """Best score and ids of texts that begin and end at places no piece crosses."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            return [(0.0, b"") for _ in texts]
        bounds = np.cumsum([0, *(len(r) for r in raw)])
        edge = np.zeros(len(data), dtype=bool)
        edge[1:] = ~self.joined[data[:-1].astype(np.int32) * 256 + data[1:]]
        edge[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        at = self._look_up(data, starts, ends)
        begins = self.ends[at]
        lengths = self.ends[at + 1] - begins
        sums = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(lengths, out=sums[1:])
        ids = self.flat[np.arange(sums[-1]) + np.repeat(begins - sums[:-1], lengths)].astype("<u4")
        totals = np.zeros(len(at) + 1)
        np.cumsum(self.totals[at], out=totals[1:])
        first = np.searchsorted(starts, bounds)
        return [(float(totals[b] - totals[a]), ids[sums[a] : sums[b]].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]

    def span(self, text: str) -> tuple[float, bytes]:
        return self.spans([text])[0]

    def barriers(self, text: str, end: int) -> tuple[int, int] | None:
        """First and last place up to ``end`` that no piece crosses and that every boundary state reaches."""
        first = last = None
        for m in re.finditer(r"(?<=[^ ]) ", text[self.longest - 1 : end]):
            first = m.start() + self.longest - 1
            break
        if first is None:
            return None
        at = end
        while at > first:
            at = text.rfind(" ", first, at)
            if at <= first:
                break
            if text[at - 1] != " ":
                last = at
                break
        return first, last if last is not None else first

    def _from_states(self, text: str, stop: int) -> np.ndarray:
        """Best scores from each boundary state (rows) to each of ``stop`` .. ``stop`` + K - 1, by pieces that begin before ``stop``."""
        k = self.longest
        scores = np.full((min(len(text), stop + k - 1) + 1, k), LOW)
        for s in range(min(k, len(scores))):
            scores[s, s] = 0.0
        for i in range(min(stop, len(scores) - 1)):
            for width, value in self.edges(text, i, len(text)):
                if i + width < len(scores):
                    np.maximum(scores[i + width], scores[i] + value, out=scores[i + width])
        out = np.full((k, k), LOW)
        tail = scores[stop : stop + k]
        out[:, : len(tail)] = tail.T
        return out

    def transfers(self, chunks: list[tuple[str, int]]) -> list[np.ndarray]:
        """Transfer matrices of chunks: ``size`` characters, followed in the text by up to K-1 of the next chunk."""
        cuts = [self.barriers(t, n) if n > 2 * self.longest else None for t, n in chunks]
        middles = self.spans([t[c[0] : c[1]] if c else "" for (t, _), c in zip(chunks, cuts, strict=True)])
        out = []
        for (text, size), cut, (middle, _) in zip(chunks, cuts, middles, strict=True):
            if cut is None:
                out.append(self._from_states(text, size))
                continue
            first, last = cut
            into = self._from_states(text[:first], first)[:, 0]
            out_of = self._from_states(text[last:], size - last)[0]
            out.append(np.maximum(LOW, into[:, None] + middle + out_of))
        return out

    def transfer(self, text: str, size: int) -> np.ndarray:
        return self.transfers([(text, size)])[0]

    def paths(self, chunks: list[tuple[str, int, int, int]]) -> list[bytes]:
        """Ids of chunks (text, size, enter, leave) between their two boundary states."""
        cuts = [self.barriers(t, n) if n > 2 * self.longest else None for t, n, _, _ in chunks]
        middles = self.spans([x[0][c[0] : c[1]] if c else "" for x, c in zip(chunks, cuts, strict=True)])
        out = []
        for (text, size, enter, leave), cut, (_, middle) in zip(chunks, cuts, middles, strict=True):
            first, last = cut or (enter, enter)
            head = self.best(text, enter, first)[1] if first > enter else []
            tail = self._crossing(text, last, size, size + leave)
            out.append(np.array(head, dtype="<u4").tobytes() + middle + np.array(tail, dtype="<u4").tobytes())
        return out

    def path(self, text: str, size: int, enter: int, leave: int) -> bytes:
        return self.paths([(text, size, enter, leave)])[0]

    def _crossing(self, text: str, begin: int, size: int, end: int) -> list[int]:
        """Ids from ``begin`` to ``end`` where only the last piece may go beyond ``size``."""
        if end == size:
            return self.best(text, begin, end)[1]
        best, chosen = LOW, None
        scores = self._forward(text, begin, size)
        for i in range(max(begin, end - self.longest), size):
            piece = self.pieces.get(text[i:end])
            value = piece[0] if piece else UNKNOWN if end - i == 1 else LOW
            if scores[i - begin] + value > best:
                best, chosen = scores[i - begin] + value, i
        if chosen is None:
            raise ValueError("no path between the boundary states")
        return self.best(text, begin, chosen)[1] + self.ids_of(text[chosen:end])

    def _forward(self, text: str, begin: int, end: int) -> list[float]:
        scores = [LOW] * (end - begin + 1)
        scores[0] = 0.0
        for i in range(end - begin):
            for width, s in self.edges(text, begin + i, end):
                scores[i + width] = max(scores[i + width], scores[i] + s)
        return scores

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of ids; the first chunk's without the space that encoding puts before a text."""
        table = self.texts
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])[first:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def _lattice() -> Lattice:
    """The model, held by a worker from task to task; its memo is bounded and changes no result."""
    return Lattice()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return np.maximum(LOW, (a[:, :, None] + b[None, :, :]).max(axis=1))


def prefix_scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by recursive pairing."""
    if len(matrices) <= 1:
        return list(matrices)
    pairs = [combine(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
    below = prefix_scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(below[i // 2] if i % 2 else combine(below[i // 2 - 1], matrices[i]))
    return out


def boundary_states(matrices: list[np.ndarray]) -> tuple[float, list[int]]:
    """Best score of the whole, and the boundary state before each chunk and after the last."""
    prefix = [np.append(0.0, np.full(len(matrices[0]) - 1, LOW)), *(m[0] for m in prefix_scan(matrices))]
    states = [0]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int(np.argmax(prefix[k] + matrices[k][:, states[-1]])))
    return float(prefix[-1][0]), states[::-1]


def cut_chunks(text: str, size: int, longest: int) -> list[tuple[str, int]]:
    """Chunks of a text (that begins with its space): characters with what follows them, and their own number."""
    out, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + size)
        if len(text) - end < 2 * longest:
            end = len(text)
        elif (near := text.rfind(" ", end - 64, end)) > 0 and text[near - 1] != " " and near - begin > 2 * longest:
            end = near
        out.append((text[begin : end + longest - 1], end - begin))
        begin = end
    return out


def _table(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)


def _fields(schema: str) -> tuple[list, list[str]]:
    """Arrow types and names of a schema text."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    parts = [x.split() for x in schema.split(", ")]
    return [kinds[t] for _, t in parts], [n for n, _ in parts]


def _short(docs: DataFrame, chunk: int) -> DataFrame:
    """(doc_id, score, ids) of the documents of one chunk, in one pass over them."""
    schema = "doc_id long, score double, ids binary"
    types, names = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice()
        for batch in batches:
            texts = [" " + t if t else "" for t in batch.column(1).to_pylist()]
            for i, j in text_groups(texts, 1 << 20):
                found = lattice.spans(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x for x, _ in found], types[1]), pa.array([x for _, x in found], types[2])], names=names)

    return docs.where(F.col("text").isNull() | (F.length("text") < chunk)).select("doc_id", "text").mapInArrow(run, schema)


def _giants(docs: DataFrame, chunk: int) -> DataFrame:
    """(key, doc_id, text) of the documents of several chunks; the key is a hash of the text, the same in every attempt."""
    return docs.where(F.length("text") >= chunk).select(F.md5("text").alias("key"), "doc_id", "text")


def _giant_ids(giants: DataFrame, chunk: int) -> DataFrame:
    """(key, chunk, score, ids) of every distinct giant text; the score stands on the first chunk.

    The chunks are dealt out over tasks by (key, chunk), so that a giant text is
    the work of many; copies of a text meet there and are worked on once.
    """
    spark = giants.sparkSession
    count = giants.agg(F.sum(F.ceil((F.length("text") + 1) / chunk)).alias("n")).collect()[0]["n"] or 0
    tasks = max(16, -(-count // CHUNKS_EACH), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = _fields("key string, chunk int, own int, text string")
        longest, seen = _lattice().longest, set()
        for batch in batches:
            for key, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                if key not in seen:
                    seen.add(key)
                    yield _table([(key, k, own, part) for k, (part, own) in enumerate(cut_chunks(" " + text, chunk, longest))], types, names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted batches without the rows whose first two columns repeat."""
        last = None
        for batch in batches:
            held = []
            for at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(at != last)
                last = at
            yield batch.filter(pa.array(held, pa.bool_()))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches):
            texts, own = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            found = [m.tobytes() for i, j in text_groups(texts, 1 << 20) for m in _lattice().transfers(list(zip(texts[i:j], own[i:j], strict=True)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "chunk", "matrix"])

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        found = [np.frombuffer(m, dtype=np.float64) for m in table.column("matrix").to_pylist()]
        k = int(len(found[0]) ** 0.5)
        score, at = boundary_states([m.reshape(k, k) for m in found])
        n = len(found)
        return pa.table(
            {
                "key": table.column("key"),
                "chunk": table.column("chunk"),
                "enter": pa.array(at[:-1], pa.int32()),
                "leave": pa.array(at[1:], pa.int32()),
                "score": pa.array([score, *[None] * (n - 1)], pa.float64()),
            }
        )

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in (3, 2, 4, 5)), strict=True))
            texts = batch.column(3).to_pylist()
            found = [x for i, j in text_groups(texts, 1 << 20) for x in _lattice().paths(rows[i:j])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(6), pa.array(found, pa.binary())], names=["key", "chunk", "score", "ids"])

    chunks = giants.select("key", "text").mapInArrow(cut, "key string, chunk int, own int, text string").repartition(tasks, "key", "chunk")
    transfer = chunks.sortWithinPartitions("key", "chunk").mapInArrow(matrices, "key string, chunk int, matrix binary")
    # a few hundred bytes a chunk cross the first cut; the chunks themselves are dealt out anew from the texts
    found = durable(transfer.groupBy("key").applyInArrow(states, "key string, chunk int, enter int, leave int, score double"))
    joined = chunks.join(found.repartition(tasks, "key", "chunk"), ["key", "chunk"]).sortWithinPartitions("key", "chunk")
    return joined.select("key", "chunk", "own", "text", "enter", "leave", "score").mapInArrow(paths, "key string, chunk int, score double, ids binary")


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def encode(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (key, doc_id, chunk, score, ids, split): the ids of every document, chunk by chunk.

    ``split`` says whether the document has several chunks; ``key``, a hash of
    the text, and doc_id then name it, and repeated rows repeat its chunks.  Ids
    are little-endian unsigned 32-bit; the score stands on the first chunk.
    """
    rows = _rows(docs)
    whole = _short(rows, chunk).select(F.lit(None).cast("string").alias("key"), "doc_id", F.lit(0).alias("chunk"), "score", "ids", F.lit(False).alias("split"))
    giants = _giants(rows, chunk)
    ids = giants.select("key", "doc_id").join(_giant_ids(giants, chunk), "key")
    return whole.unionByName(ids.select("key", "doc_id", "chunk", "score", "ids", F.lit(True).alias("split")))


def decode(encoded: DataFrame) -> DataFrame:
    """Rows (key, doc_id, text) from the rows of ``encode``; the chunks of one document meet in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice()
        for batch in batches:
            for k in range(batch.num_rows):
                text = lattice.decode(b"".join(batch.column(2)[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([text], pa.string())], names=["key", "doc_id", "text"])

    single = encoded.where("not split").select("key", "doc_id", F.array("ids").alias("ids"))
    many = encoded.where("split").groupBy("key", "doc_id").agg(F.expr("array_sort(collect_list(struct(chunk, ids)))").alias("x"), F.expr("count_if(chunk = 0)").alias("copies"))
    # copies of a row have brought each chunk as often
    ordered = F.expr("transform(filter(x, (v, i) -> i % copies = 0), v -> v.ids)")
    many = many.select("key", "doc_id", ordered.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return single.unionByName(many).mapInArrow(run, "key string, doc_id long, text string")


#: CRC-32: the reflected polynomial
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's (the highest bit is the constant term)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc32(a: int, b: int, b_bytes: int) -> int:
    """CRC-32 of two runs of bytes, one after the other, from the checksums of both and the second one's length."""
    power, square, n = 1 << 31, 1 << 23, b_bytes  # 1 and x**8
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, a) ^ b


PART = "n_tokens long, ids_crc32 long, n_chars long, text_bytes long, text_crc32 long"
DIGEST = "doc_id long, n_chunks int, n_tokens long, ids_crc32 long, score double, n_chars long, text_crc32 long"


def _measured(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of rows of ids, with counts and checksums of the ids and of the text they decode to."""
    schema = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    types, names = _fields(PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice()
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = lattice.decode(ids, first=not k)
                raw = text.encode()
                out.append((len(ids) // 4, zlib.crc32(ids), len(text), len(raw), zlib.crc32(raw)))
            measured = _table(out, types, names)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *measured.columns], names=[*kept, *names])

    return rows.select("chunk", "ids", *kept).mapInArrow(run, ", ".join([*(f"{c} {schema[c]}" for c in kept), PART]))


def _combined(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from the measures of its chunks: sums, and checksums of the whole; no text is gathered."""
    types, names = _fields("n_chunks int, n_tokens long, ids_crc32 long, score double, n_chars long, text_crc32 long")
    schema = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(len(keys)).to_pylist():
                parts = list({p["chunk"]: p for p in parts}.values())  # copies of a row bring each chunk again
                ids = text = 0
                for p in parts:
                    ids = joined_crc32(ids, p["ids_crc32"], 4 * p["n_tokens"])
                    text = joined_crc32(text, p["text_crc32"], p["text_bytes"])
                out.append((len(parts), sum(p["n_tokens"] for p in parts), ids, parts[0]["score"], sum(p["n_chars"] for p in parts), text))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *_table(out, types, names).columns], names=[*keys, *names])

    measures = [c.split()[0] for c in PART.split(", ")]
    grouped = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "score", *measures))).alias("parts"))
    return grouped.mapInArrow(run, ", ".join([*(f"{c} {schema[c]}" for c in keys), *(f"{n} {t}" for n, t in zip(names, ("int", "long", "long", "double", "long", "long"), strict=True))]))


def digest(encoded: DataFrame) -> DataFrame:
    """Per document: chunks, tokens, checksum of the ids, score, and length and checksum of the decoded text.

    Documents of several chunks are named by key and doc_id; repeated rows among them are one here.
    """
    columns = [x.split()[0] for x in DIGEST.split(", ")]
    single = _measured(encoded.where("not split"), ["doc_id", "score"]).withColumn("n_chunks", F.lit(1))
    many = _combined(_measured(encoded.where("split"), ["key", "doc_id", "chunk", "score"]), ["key", "doc_id"])
    return single.select(*columns).unionByName(many.select(*columns))


def digests(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``digest`` of all documents: those of one chunk end in the pass that encodes them, giant texts are measured once per text."""
    columns = [x.split()[0] for x in DIGEST.split(", ")]
    rows = _rows(docs)
    single = _measured(_short(rows, chunk).withColumn("chunk", F.lit(0)), ["doc_id", "score"]).withColumn("n_chunks", F.lit(1))
    giants = _giants(rows, chunk)
    texts = _combined(_measured(_giant_ids(giants, chunk), ["key", "chunk", "score"]), ["key"])
    return single.select(*columns).unionByName(giants.select("key", "doc_id").join(texts, "key").select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
