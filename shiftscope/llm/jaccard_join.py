"""Operator 8: exact n-gram Jaccard join over whole texts.

Documents are sets of distinct 4-word shingles (64-bit hashes); two link when
``100 * intersection >= 85 * union``.  Equal sets form one class, found by a
hash of the sorted set, and only classes go on.

Two linked sets share a shingle among the first ``n - ceil(0.85 n) + 1`` of each
under any common order.  The order here is by hash, with the corpus' most
frequent shingles (a list of fixed length, counted over all documents) last, so
that a passage that many documents share does not bring them together.  Classes
that share such a shingle are a tile.

Bitmap signatures bound the overlap of two sets from above: a bit that one
signature alone has is a shingle that the other set lacks.  Each class with a
likely partner, the tile's leader that it shares most shingles with, goes to that
leader's star, where the exact intersection of the sorted shingle arrays decides;
this settles most copies.  What is then still apart meets in tiles, the large ones
banded by size: a class stands in the tile of its own band and, as a guest, in that of the next one,
and two sets whose sizes allow a link always share one of the two.  In a tile, pairs
of different components whose bitmaps (2 bits a shingle or more) allow a link bring their components into one
cluster; a tile yields fewer edges than it has components.  Every link that is still
missing is then within a cluster.  Its classes go there, where the band, bitmaps of
the sets' own width and the exact intersection decide; pairs that are connected
already are skipped.

What outgrows a task is cut by shingles, not by rows: a star into parts that each get
the leader; a cluster into bands, and a band into parts that each get all but the
largest component, as long as that fits; beyond it, into blocks that meet in pairs.

Nulls: a null or wordless text has an empty set, size 0 and itself as component;
a null doc_id is never a component's id unless all its members' are null.
Repeated rows fall into one class.  Very long texts are sets like any other.  Ties
between leaders go to the larger class hash.  An empty table gives an empty result.
Extra columns are not read; ``one_of_each`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import byte_rows, documents, durable, fresh, group_count, most_frequent, release, sifted, small_batches, stored, text_groups, to_blob
from shiftscope.llm.components import components
from shiftscope.llm.textops import U, fold, hash_words, mix, ngram_hashes, radix_split

WORDS, PERCENT = 4, 85
#: the list of frequent shingles: its length, and the count within one slab from which a shingle is reported
FREQUENT, LOCAL = 1 << 18, 4
SLAB_SHINGLES = 1 << 20
#: postings of a frequent shingle are dealt over so many parts that each has about this many
PART_ROWS = 4096
#: tiles of a band with more rows are cut into blocks of half as many
TILE_ROWS = 4096
#: shingles that a star, or a cluster's band, brings into one task
LIMIT = 1 << 23
#: bits of a signature
BITS = 2048
#: sizes of one band differ by less than this factor, a little more than a link allows
BAND = 100 / (PERCENT - 0.1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = hash_words([t.lower() if t else t for t in texts])
    grams = ngram_hashes(words, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(np.array([fold(words[a:b]) ^ 0x5851F42D4C957F2D], dtype=U))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def class_of(shingles: np.ndarray, twice: frozenset = frozenset()) -> int:
    """Signed 64-bit id of a set; ``twice`` holds the ids that several sets of the corpus have, which a second hash tells apart."""
    first = _signed(fold(shingles))
    return _signed(fold(shingles, 1)) if first in twice else first


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sorted arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bit signature of a set, as words of 64 bits."""
    out = np.zeros(bits, dtype=np.uint8)
    out[((shingles >> U(20)) % U(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(U)


def width_for(size: int, each: int = 8) -> int:
    """Bits of a signature of a set's own width: ``each`` or more a shingle, a power of two.

    A signature of fixed width would be full for a long text and bound nothing.
    """
    return max(64, 1 << (each * size - 1).bit_length())


def possible(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sets may link, by their sizes and the bits that one signature alone has."""
    alone = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    beyond = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    most = np.minimum(n_a - alone, n_b - beyond)
    return 100 * most >= percent * (n_a + n_b - most)


class Signatures:
    """Signatures of several widths, compared at the narrower one's: the halves of a wider one are laid over each other."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([8 * len(b) for b in blobs], dtype=np.int64)
        self.place = np.zeros(len(blobs), dtype=np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(blobs[i] for i in own), dtype=U).reshape(len(own), -1)

    def at(self, which: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(which), width // 64), dtype=U)
        for w in np.unique(self.width[which]).tolist():
            own = self.width[which] == w
            part = self.rows[w][self.place[which[own]]]
            while part.shape[1] > width // 64:
                half = part.shape[1] // 2
                part = part[:, :half] | part[:, half:]
            out[own] = part
        return out

    def possible(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
        """Whether the sets x[i] and y[i], of these sizes, may link."""
        out = np.zeros(len(x), dtype=bool)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width).tolist():
            pairs = np.flatnonzero(width == w)
            step = max(1, (1 << 20) // w)
            for i in range(0, len(pairs), step):
                part = pairs[i : i + step]
                out[part] = possible(n_x[part], n_y[part], self.at(x[part], w), self.at(y[part], w))
        return out


def _scan(texts: DataFrame) -> DataFrame:
    """One pass over the texts: rows (kind, doc_id, id, node, check, n, bits), kind 0 for a document's class, 1 for a shingle's count in a slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "id", "node", "check", "n", "bits"]
        waiting: list[np.ndarray] = []
        held = 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts >= LOCAL
            values, counts = values[often].view(np.int64), counts[often]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), dtype=np.int32)), none, none, pa.array(values), none, pa.array(counts), pa.nulls(len(values), pa.binary())], names=names)

        for batch in batches:
            rows = byte_rows(batch.column(2))
            for i, j in text_groups(rows):
                sets = shingle_sets(rows[i:j])
                keys = [class_of(s) for s in sets]
                checks = [_signed(fold(s, 1)) for s in sets]
                columns = [pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([to_blob(bitmap(s, width_for(len(s), 2))) if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, dtype=np.int32)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *columns], names=names)
                for key, s in zip(keys, sets, strict=True):
                    if len(s) and key not in seen:
                        seen.add(key)
                        waiting.append(s)
                        held += len(s)
                if held > SLAB_SHINGLES:
                    yield flush()
                    waiting, held, seen = [], 0, set()
        if waiting:
            yield flush()

    return texts.select("doc_id", "id", "text").mapInArrow(run, "kind int, doc_id long, id long, node long, check long, n long, bits binary")


def _frequent(scanned: DataFrame) -> np.ndarray:
    """The most frequent shingles and their counts, by shingle: at most ``FREQUENT`` of them."""
    found = scanned.where("kind = 1").groupBy(F.col("node").alias("shingle")).agg(F.sum("n").alias("n"))
    return most_frequent(found, "shingle", FREQUENT)


def _prefix(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order."""
    size = prefix_length(len(shingles))
    if not frequent.shape[1]:
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent[0], shingles), frequent.shape[1] - 1)
    hot = frequent[0][at] == shingles
    rare = shingles[~hot]
    if len(rare) >= size:
        return rare[:size]
    last = shingles[hot][np.argsort(frequent[1][at[hot]], kind="stable")]
    return np.concatenate([rare, last[: size - len(rare)]])


def _parts(tokens: np.ndarray, nodes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Part of each posting: 0, but for shingles so frequent that their postings are dealt out by class."""
    if not frequent.shape[1]:
        return np.zeros(len(tokens), dtype=U)
    at = np.minimum(np.searchsorted(frequent[0], tokens), frequent.shape[1] - 1)
    dealt = np.where(frequent[0][at] == tokens, frequent[1][at] // U(PART_ROWS) + U(1), U(1))
    return mix(nodes) % dealt


def _postings(texts: DataFrame, frequent, twice: frozenset, groups: int) -> DataFrame:
    """(grp, blob): postings (shingle, class, set size) of all prefixes, packed by group of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes this task has posted already
        tokens: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate(tokens)
            counts = [len(x) for x in tokens]
            c = np.repeat(np.array(nodes, dtype=np.int64).view(U), counts)
            n = np.repeat(np.array(sizes, dtype=U), counts)
            order, cuts = radix_split(mix(t + _parts(t, c, frequent.value)), groups)
            packed = np.stack([t, c, n], axis=1)[order]
            used = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([to_blob(packed[cuts[g] : cuts[g + 1]]) for g in used], pa.binary())], names=["grp", "blob"])

        for batch in batches:
            rows = byte_rows(batch.column(0))
            for i, j in text_groups(rows):
                for s in shingle_sets(rows[i:j]):
                    if len(s) and (key := class_of(s, twice)) not in seen:
                        seen.add(key)
                        part = _prefix(s, frequent.value)
                        tokens.append(part)
                        nodes.append(key)
                        sizes.append(len(s))
                        held += len(part)
                if held > SLAB_SHINGLES // 2:
                    yield flush()
                    tokens, nodes, sizes, held = [], [], [], 0
        if tokens:
            yield flush()

    return texts.select("text").mapInArrow(run, "grp int, blob binary")


def _tiles(postings: DataFrame, frequent) -> DataFrame:
    """Rows (kind, a, b, n): 0 tile rows (shingle and band of sizes, class, set size), 1 partners (leader, class, shared shingles)."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, dtype=U) for b in table.column("blob").to_pylist()]).reshape(-1, 3)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        rows = rows[new]
        part = _parts(rows[:, 0], rows[:, 1], frequent.value)
        order = np.lexsort((rows[:, 1], rows[:, 2], part, rows[:, 0]))
        rows, part = rows[order], part[order]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(rows)))
        lead = np.repeat(starts, counts)
        token, node, size = rows[:, 0].copy().view(np.int64), rows[:, 1].copy().view(np.int64), rows[:, 2].astype(np.int64)
        at = np.minimum(np.searchsorted(frequent.value[0], rows[:, 0]), max(0, frequent.value.shape[1] - 1)) if frequent.value.shape[1] else None
        dealt = np.zeros(len(rows), dtype=bool) if at is None else (frequent.value[0][at] == rows[:, 0]) & (frequent.value[1][at] >= U(PART_ROWS))
        # a tile is cut where no set of the next size can link with one before; what then stands alone is no tile
        gap = first | (100 * np.append(0, size[:-1]) < PERCENT * size) & ~dealt
        run = np.cumsum(gap)
        band = mix(rows[:, 0] + (run - run[lead]).astype(U)).view(np.int64)
        tile = (np.bincount(run, minlength=len(rows) + 1)[run] > 1) | dealt
        token = np.where(run > run[lead], band, token)
        other = np.where(100 * size[lead] >= PERCENT * size, lead, np.arange(len(rows)) - 1)
        pair = (np.arange(len(rows)) != lead) & (100 * size[np.maximum(other, 0)] >= PERCENT * size)
        a, b = node[other[pair]], node[pair]
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        edge = np.ones(len(a), dtype=bool)
        edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(edge)
        shared = np.diff(np.append(begin, len(a)))
        return pa.table(
            {
                "kind": pa.array(np.concatenate([np.zeros(tile.sum(), dtype=np.int32), np.ones(len(begin), dtype=np.int32)])),
                "a": pa.array(np.concatenate([token[tile], a[begin]])),
                "b": pa.array(np.concatenate([node[tile], b[begin]])),
                "n": pa.array(np.concatenate([size[tile], shared])),
            }
        )

    return postings.groupBy("grp").applyInArrow(run, "kind int, a long, b long, n long")


class Clusters:
    """Union-find over cluster numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, i: int) -> int:
        while (j := self.parent.get(i, i)) != i:
            self.parent[i] = self.parent.get(j, j)
            i = j
        return i

    def join(self, a: int, b: int) -> bool:
        """Whether two clusters were apart before."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: int, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys (the first ``keys`` columns) from sorted batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[-1] for k in range(keys)]
        low, high = 0, table.num_rows - 1  # the first row with the last key
        while low < high:
            mid = (low + high) // 2
            if all(table.column(k)[mid] == last[k] for k in range(keys)):
                high = mid
            else:
                low = mid + 1
        if low:
            yield table.slice(0, low)
        rest = table.slice(low)
        held, rows = rest.to_batches(), rest.num_rows
        least = max(20_000, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _likely(tiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): each class b with the leader a that it shares most shingles with, if the bitmaps allow a link."""
    partners = tiles.where("kind = 1").groupBy("b", "a").agg(F.sum("n").alias("n")).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    own = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    other = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    both = partners.join(own, "b").join(other, "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            good = Signatures(batch.column(4).to_pylist() + batch.column(5).to_pylist()).possible(rows, rows + len(rows), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(good))

    return durable(both.mapInArrow(run, "a long, b long"))


def _stars(likely: DataFrame, classes: DataFrame, texts: DataFrame, twice: frozenset) -> DataFrame:
    """The likely pairs (a, b) that link, by exact intersections; a leader's text goes to each part of its star, any other's to one."""
    members = likely.join(classes.select(F.col("node").alias("b"), "id", "n"), "b").select(F.col("a").alias("lead"), F.col("b").alias("node"), "id", "n")
    parts = members.groupBy("lead").agg(F.ceil(F.sum("n") / LIMIT).cast("int").alias("parts"))
    own = members.join(parts, "lead").select("lead", F.pmod(F.xxhash64(F.lit(8), "node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "node", "id")
    leads = parts.join(classes.select(F.col("node").alias("lead"), "id"), "lead")
    leads = leads.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("lead").alias("node"), "id")
    # a written table has a known size, so that the planner can broadcast a small one
    rows = sifted(texts.select("id", "text"), stored(own.unionByName(leads), "stars"), once=True).select("lead", "part", "role", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held, last = None, None, None
        a, b = [], []
        for batch in batches:
            keys, nodes, raw = batch.column(0).to_pylist(), batch.column(3).to_pylist(), byte_rows(batch.column(4))
            at = list(zip(keys, batch.column(1).to_pylist(), nodes, strict=True))
            for i, j in text_groups(raw):
                for k, x in zip(range(i, j), shingle_sets(raw[i:j]), strict=True):
                    # copies that several tasks passed on come again; two texts may share an id
                    if at[k] == last or class_of(x, twice) != nodes[k]:
                        continue
                    last = at[k]
                    if keys[k] == nodes[k]:
                        lead, held = keys[k], x
                    elif keys[k] == lead and linked(held, x):
                        a.append(lead)
                        b.append(nodes[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "role", "node")
    return durable(dealt.mapInArrow(run, "a long, b long"))


def _banded(rows: DataFrame) -> DataFrame:
    """Every row twice: in its own band of sizes, and as a guest in the next one."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))
    return rows.withColumn("_in", F.explode(both)).select(*rows.columns, "_in.band", "_in.guest")


def _blocks(rows: DataFrame, blocks: str, salt: int) -> DataFrame:
    """Add own, low and high: rows are dealt to blocks, and each meets every block once."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(blocks)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _tile_edges(tiles: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Edges between components whose classes share a tile and may link; within a tile, fewer than it has components."""
    rows = tiles.select(F.col("a").alias("token"), F.col("b").alias("node"), "n")
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # tiles with the same classes are one tile; tiles within one component are done
    size = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    size = durable(size.where("low <> high").groupBy("mark", "rows").agg(F.min("token").alias("token")))
    rows = rows.select("token", "node", "n", "component")
    # a tile that fits a task is one band
    names = ["token", "band", "low", "high", "n", "own", "node", "component", "guest"]
    small = rows.join(size.where(F.col("rows") <= TILE_ROWS).select("token"), "token")
    small = small.withColumns({"band": F.lit(-1), "low": F.lit(0), "high": F.lit(0), "own": F.lit(0), "guest": F.lit(False)}).select(*names)
    large = _banded(rows.join(size.where(F.col("rows") > TILE_ROWS).select("token"), "token"))
    # what holds for tiles holds for their bands, and one without a row of its own has nothing to compare
    band = large.groupBy("token", "band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("guest").alias("guests"), F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("node", "guest").cast("decimal(38,0)")).alias("mark")
    )
    band = band.where("low <> high and not guests").groupBy("mark", "rows", "band").agg(F.min("token").alias("token"))
    blocks = F.when(F.col("rows") > TILE_ROWS, F.ceil(F.col("rows") / (TILE_ROWS // 2))).otherwise(1).cast("int")
    large = _blocks(large.join(band.select("token", "band", blocks.alias("blocks")), ["token", "band"]), "blocks", 9).select(*names)
    rows = small.unionByName(large).join(classes.select("node", "bits"), "node").select(*names, "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _sorted_runs(batches, 4):
            token, band, low, high, n, own, node, component, guest = (table.column(c).to_numpy() for c in range(9))
            bits = Signatures(table.column(9).to_pylist())
            tile = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            crossing = low != high
            clusters, cluster = Clusters(), component.copy()
            a, b = [], []
            alive, step = np.arange(len(n)), 0
            while alive.size:  # rows are compared with the next one, the one after that, ... of their tile
                step += 1
                alive = alive[alive + step < len(n)]
                other = alive + step
                inside = (tile[other] == tile[alive]) & (PERCENT * n[other] <= 100 * n[alive])
                alive, other = alive[inside], other[inside]
                some = (cluster[alive] != cluster[other]) & ~(guest[alive] & guest[other]) & (~crossing[alive] | (own[alive] != own[other]))
                x, y = alive[some], other[some]
                for i in range(0, len(x), 1 << 14):
                    part = slice(i, i + (1 << 14))
                    good = bits.possible(x[part], y[part], n[x[part]], n[y[part]])
                    for p, q in zip(x[part][good].tolist(), y[part][good].tolist(), strict=True):
                        if clusters.join(int(component[p]), int(component[q])):
                            a.append(int(node[p]))
                            b.append(int(node[q]))
                if step & (step - 1) == 0 and clusters.parent:  # now and then, let joined clusters drop out
                    names, inverse = np.unique(component, return_inverse=True)
                    cluster = np.array([clusters.root(int(c)) for c in names])[inverse]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("token", "band", "low", "high").sortWithinPartitions("token", "band", "low", "high", "n", "node")
    return durable(dealt.mapInArrow(run, "a long, b long"))


def _links(verified: DataFrame, more: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame, twice: frozenset) -> DataFrame:
    """Links (a, b) that connect what is connected in each cluster but not yet in ``found``, by exact intersections."""
    if not more.take(1):
        return more
    joined = components(verified.union(more)).withColumnRenamed("component", "cluster")
    open_ = joined.join(more.select(F.col("a").alias("node")), "node", "left_semi").select("cluster").distinct()
    rows = joined.join(open_, "cluster").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(classes.select("node", "id", "n"), "node")
    rows = durable(rows.select("cluster", "node", "component", "id", "n"))
    # clusters that fit a task stay whole (band -1), others go by bands
    total = rows.groupBy("cluster").agg((F.sum("n") > LIMIT).alias("large"))
    rows = rows.join(total, "cluster")
    small = rows.where("not large").select("cluster", F.lit(-1).alias("band"), F.lit(False).alias("guest"), "component", "node", "id", "n", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("own"), F.lit(False).alias("dealt"))
    banded = _banded(rows.where("large").drop("large"))
    per = banded.groupBy("cluster", "band", "component").agg(F.sum("n").alias("n"), F.min("guest").alias("guests"))
    per = per.groupBy("cluster", "band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"), F.min("guests").alias("guests"))
    per = per.where("parts > 1 and not guests")
    rest = F.col("all") - F.col("most.n")
    dealt = (rest <= LIMIT // 2) & (F.col("all") > LIMIT)
    blocks = F.when(F.col("all") <= LIMIT, 1).when(dealt, F.ceil(F.col("most.n") / (LIMIT // 2))).otherwise(F.ceil(F.col("all") / (LIMIT // 2))).cast("int")
    banded = banded.join(per.select("cluster", "band", F.col("most.component").alias("most"), dealt.alias("dealt"), blocks.alias("blocks")), ["cluster", "band"])
    names = small.columns
    # a part of the largest component, with all others beside it
    of_most = F.pmod(F.xxhash64(F.lit(11), "node"), F.col("blocks")).cast("int")
    part = F.when(F.col("component") == F.col("most"), F.array(of_most)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    beside = banded.where("dealt").withColumn("low", F.explode(part)).withColumn("high", F.col("low")).withColumn("own", F.lit(0))
    paired = _blocks(banded.where("not dealt"), "blocks", 10)
    wanted = stored(small.unionByName(beside.select(*names)).unionByName(paired.select(*names)), "clusters")
    order = ["cluster", "band", "low", "high", "n", "node"]
    shipped = sifted(texts.select("id", "text"), wanted, once=True).select(*order, "own", "component", "guest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        a, b = [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            nodes, owns, labels, guests, raw = *(batch.column(c).to_pylist() for c in (5, 6, 7, 8)), byte_rows(batch.column(9))
            for i, j in text_groups(raw):
                for k, x in zip(range(i, j), shingle_sets(raw[i:j]), strict=True):
                    if class_of(x, twice) != nodes[k]:
                        continue  # another text with the same id
                    if state is None or state.key != keys[k]:
                        state = _Cluster(keys[k])
                    for other in state.add(x, nodes[k], owns[k], labels[k], guests[k]):
                        a.append(other)
                        b.append(nodes[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sorted_ = shipped.repartition(*order[:4]).sortWithinPartitions(*order)
    return durable(sorted_.mapInArrow(run, "a long, b long"))


class _Cluster:
    """The classes of a cluster (or of one of its bands, or of two blocks of one) so far, in order of size."""

    def __init__(self, key: tuple):
        self.key = key
        self.last: int | None = None
        self.roots = Clusters()
        self.levels: dict[int, _Level] = {}

    def add(self, x: np.ndarray, node: int, own: int, label: int, guest: bool) -> list[int]:
        """One linked class of each component that the new class connects; then it belongs to all of them."""
        if node == self.last:
            return []
        self.last = node
        width = width_for(len(x))
        if len(self.levels) > 1:
            self.levels = {w: v for w, v in self.levels.items() if w >= width // 2}  # sizes beyond the band are behind for good
        out = []
        root = self.roots.root(label)
        for w, level in self.levels.items():
            level.forget(len(x))
            bits = bitmap(x, w)
            apart = (level.root[: level.count] != root) & (100 * level.sizes[: level.count] >= PERCENT * len(x))
            if guest:
                apart &= ~level.guests[: level.count]
            if self.key[2] != self.key[3]:
                apart &= level.owns[: level.count] != own
            at = np.flatnonzero(apart)
            # the first class of each other component, then all the rest
            first = at[np.unique(level.root[at], return_index=True)[1]] if at.size else at
            tried: set[int] = set()
            for some in (first, at) if 2 * len(first) < len(at) else (at,):
                for i in range(0, len(some), 1 << 10):
                    rows = some[i : i + (1 << 10)]
                    rows = rows[level.root[rows] != root]
                    for k in rows[possible(level.sizes[rows], np.int64(len(x)), level.bits[rows], bits)].tolist():
                        if level.root[k] == root or k in tried:
                            continue
                        tried.add(k)
                        if linked(level.sets[k], x):
                            out.append(level.nodes[k])
                            root = self.unite(root, int(level.root[k]))
        self.levels.setdefault(width, _Level(width)).put(x, node, own, root, guest)
        return out

    def unite(self, a: int, b: int) -> int:
        """Make two components one; returns its root."""
        self.roots.join(a, b)
        root = self.roots.root(a)
        for level in self.levels.values():
            known = level.root[: level.count]
            known[(known == a) | (known == b)] = root
        return root


class _Level:
    """The classes of a cluster whose signatures have one width."""

    def __init__(self, width: int):
        self.count = 0
        self.first = 0
        self.sets: list[np.ndarray | None] = []
        self.nodes: list[int] = []
        self.sizes, self.owns, self.root = (np.zeros(16, dtype=np.int64) for _ in range(3))
        self.guests = np.zeros(16, dtype=bool)
        self.bits = np.zeros((16, width // 64), dtype=U)
        self.width = width

    def put(self, x: np.ndarray, node: int, own: int, root: int, guest: bool) -> None:
        k = self.count
        if k == len(self.sizes):
            for name in ("sizes", "owns", "root", "guests", "bits"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.sets.append(x)
        self.nodes.append(node)
        self.sizes[k], self.owns[k], self.root[k], self.guests[k], self.bits[k] = len(x), own, root, guest, bitmap(x, self.width)
        self.count = k + 1

    def forget(self, size: int) -> None:
        """Let go of sets that are too small for this size."""
        while self.first < self.count and 100 * self.sizes[self.first] < PERCENT * size:
            self.sets[self.first] = None
            self.first += 1


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships (doc_id, node, n) of all documents, and (node, component, component_id) of all classes but the empty one."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    # a text is known by its hash, so that neither null ids nor an id of many texts brings rows together
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64("text").alias("id"), "text")
    groups = group_count(docs, 4000)
    scanned = durable(_scan(texts))
    frequent = context.broadcast(_frequent(scanned))  # at most FREQUENT pairs of numbers, 4 MB
    members = scanned.where("kind = 0")
    # ids that several sets have: n * n / 2**65 of them are expected among n sets, so a handful
    again = members.where("n > 0").groupBy("node").agg((F.min("check") < F.max("check")).alias("again")).where("again")
    twice = frozenset(r["node"] for r in again.select("node").collect())
    if twice:
        members = members.withColumn("node", F.when(F.col("node").isin(list(twice)) & (F.col("n") > 0), F.col("check")).otherwise(F.col("node")))
    classes = durable(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    tiles = durable(_tiles(_postings(texts, frequent, twice, groups), frequent))
    release(docs.sparkSession)
    verified = _stars(_likely(tiles, classes), classes, texts, twice)
    found = components(verified)
    release(docs.sparkSession)
    more = _tile_edges(tiles.where("kind = 0"), classes, found)
    found = components(verified.union(_links(verified, more, found, classes, texts, twice)))
    named = classes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.select("doc_id", "node", "n"), named.join(least, "component").select("node", "component", "component_id")


def linked_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    members, classes = join(docs)
    full = members.where("n > 0").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _with_node(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the class of each text in a column of this name."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = byte_rows(batch.column(at))
            keys = [class_of(s) for i, j in text_groups(rows) for s in shingle_sets(rows[i:j])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each component kept: one whose id names it (all columns).

    An id that names several texts stands for each of them apart.  Documents without
    words and those without an id stay.
    """
    members, classes = join(docs)
    members = members.where("doc_id is not null")
    own = members.where("n > 0").join(classes, "node").where("doc_id = component_id")
    kept = own.groupBy("component").agg(F.first("doc_id").alias("_id"), F.min("node").alias("_kept")).select("_id", "_kept")
    kept = kept.unionByName(members.where("n = 0").select(F.col("doc_id").alias("_id"), F.col("node").alias("_kept")).distinct())
    several = members.groupBy(F.col("doc_id").alias("_id")).agg((F.min("node") < F.max("node")).alias("_several")).where("_several").select("_id")
    one = kept.join(several, "_id", "left_anti")
    named = docs.join(one, docs["doc_id"] == one["_id"], "left_semi").dropDuplicates(["doc_id"])
    # only where an id names texts of several classes are the classes of its rows needed
    (node,) = fresh(docs, "_node")
    rows = _with_node(docs.join(several, docs["doc_id"] == several["_id"], "left_semi"), node)
    apart = rows.join(kept, (rows["doc_id"] == kept["_id"]) & (rows[node] == kept["_kept"]), "left_semi").dropDuplicates(["doc_id", node]).drop(node)
    return named.unionByName(apart).unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir))
