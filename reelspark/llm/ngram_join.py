"""Operator 5: n-gram Jaccard join with signature trees, and the components of its links.

A document's set holds its distinct 3-word shingles. Rows of equal sets are one node, so doc_ids (null, repeated) play
no part until the end. Two sets with 100 * |A & B| >= 90 * |A | B| must share one of the first |A| - ceil(0.9 |A|) + 1
shingles of any common order, so those shingles deal the nodes into blocks. The order puts long (rare) shingles first
and shingles found in very many prefixes last; it affects cost only, never the result. Every text is tokenised
once; the texts of nodes that must be compared in full are read again.

A node goes with the least node of a block where they share a third of its prefix; these tentative pairs hold large groups of
near copies together in linear work. Blocks that still hold different groups are searched with signature trees: leaves
are nodes with a token bitmap, inner nodes hold the OR of the bitmaps, the range of sizes and of groups. A dual
traversal goes down pairs of tree nodes and prunes those whose sizes cannot match, whose largest possible overlap is too
small, or that are one group already. The upper two levels of a large block are tables: chunks of at most about CHUNK leaves,
and families of chunks; only pairs of chunks that survive are dealt to tasks. So every pair that may be a link ends up in
one cluster of possible partners. Then whole sets decide: a cluster is searched by its own tree in one task, which returns a forest
of verified links; in a cluster over CHUNK the tentative pairs are verified first, and its chunks are dealt as above. Every set is
sent once for a cluster, no table holds all pairs of a group, and no link between components is lost.

Edge cases: null, empty and white-space texts have n_shingles 0 and are their own component; with one or two words the
whole sequence is the one shingle; rows that repeat a doc_id with other texts are separate documents; a row without
doc_id links like any other and gets the smallest real doc_id it reaches, null if there is none; a group
may be bridged by such a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables, WordHashes, components, text_hash, without

NUM, DEN = 9, 10
#: Shingles in more prefixes than this go last in the order; the list is bounded by MAX_HEAVY rows.
HEAVY = 64
MAX_HEAVY = 200_000
#: Nodes in a chunk: CHUNK at least; up to MOST_CHUNK as long as their sets stay within CHUNK_BYTES. A member of a large group is sent
#: once for each surviving pair of chunks, so larger chunks mean fewer copies.
CHUNK, MOST_CHUNK, CHUNK_BYTES = 512, 2048, 64 << 20
TEST_BYTES = 32 << 20  # bitmaps compared at a time
FAN = 8
SLICE = 500  # rows handled at a time in a Python task
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _P[3]
    h = (h ^ (h >> np.uint64(27))) * _P[4]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle tokens: 8 bits that fall with the shingle's length, then 56 bits of its hash."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = np.fromiter(map(len, words), np.int64, n)
    if n < 3:
        w = np.concatenate([w, np.full(3 - n, n, np.uint64)])
        size = np.array([size.sum(), 0, 0])
    h = mix(w[:-2] * _P[0] + w[1:-1] * _P[1] + w[2:] * _P[2])
    long = np.minimum(size[:-2] + size[1:-1] + size[2:], 255).astype(np.uint64)
    return np.unique(((np.uint64(255) - long) << np.uint64(56)) | (h >> np.uint64(8)))


def digest(tokens: np.ndarray) -> tuple[int, int, int]:
    """Size and two hashes that stand for a set."""
    return len(tokens), int(tokens.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(tokens)).view(np.int64)) if len(tokens) else 0


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def demoted(tokens: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The tokens with the heavy ones last."""
    if not len(heavy) or not len(tokens):
        return tokens
    late = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens
    return np.concatenate([tokens[~late], tokens[late]]) if late.any() else tokens


def width(n: int) -> int:
    """Bits of the bitmap of n tokens: two to four a token."""
    return max(64, 1 << int(2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    n_bits = width(len(tokens))
    at = np.unique(tokens & np.uint64(n_bits - 1)).astype(np.int64)
    bits = np.zeros(n_bits // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


PROFILE = "doc_id long, t1 long, t2 long, n int, h1 long, h2 long, tokens array<long>, bits binary"


def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text: its set's digest, a little more than its prefix, and the bitmap."""
    hashes = WordHashes()
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            sets = [shingles(t, hashes) for t in part.column(3).to_pylist()]
            n, h1, h2 = zip(*map(digest, sets))
            heads = [s[: (p := prefix_size(len(s))) + max(8, p // 2)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists(heads),
                 pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())], names=[f.split()[0] for f in PROFILE.split(", ")])


SIGNED = "row long, n int, tokens array<long>, short boolean"


def prefixes(heavy: np.ndarray) -> Callable:
    """Prefixes in the order with heavy tokens last; `short` where what was kept of the set does not tell the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, short = [], []
            for n, tokens in zip(b.column(1).to_pylist(), b.column(2)):
                tokens, p = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64), prefix_size(n)
                turned = demoted(tokens, heavy)
                late = turned is not tokens
                short.append(late and len(tokens) < n and p > len(tokens) - int(np.isin(tokens, heavy).sum()))
                out.append(turned[:p])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(out), pa.array(short, pa.bool_())], names=["row", "n", "tokens", "short"])

    return run


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            sets = [shingles(t, hashes).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["row", "set"])


def is_link(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets pass the Jaccard test."""
    for b in batches:
        good = [is_link(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(b.column("set_a"), b.column("set_b"))]
        yield b.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))


class SignatureTree:
    """Levels of nodes from the leaves up; FAN nodes make one node of the next level."""

    def __init__(self, size, bits, shared, comp):
        self.levels = [(bits, size, size, shared, comp, comp)]
        while len(self.levels[-1][1]) > FAN:
            b, lo, hi, sh, c0, c1 = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(sh, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    @staticmethod
    def possible(level, i, j):
        bits, lo, hi, shared, c0, c1 = level
        ok = (DEN * hi[i] >= NUM * lo[j]) & (DEN * hi[j] >= NUM * lo[i])
        ok &= ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j]))
        at = np.flatnonzero(ok)
        step = max(1, TEST_BYTES // bits[:1].nbytes)
        for part in (at[k : k + step] for k in range(0, len(at), step)):
            a, b = i[part], j[part]
            most = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(shared[a], shared[b])
            ok[part] = (DEN + NUM) * most >= NUM * (lo[a].astype(np.int64) + lo[b])
        return ok

    def pairs(self):
        """Pairs of leaves that may be links, by dual traversal from the top, level by level."""
        n = len(self.levels[-1][1])
        i, j = np.triu_indices(n, 0 if len(self.levels) > 1 else 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            ok = self.possible(self.levels[depth], i, j)
            i, j = i[ok], j[ok]
            if depth and len(i):
                below = len(self.levels[depth - 1][1])
                step_i, step_j = np.divmod(np.arange(FAN * FAN), FAN)
                i, j = (i[:, None] * FAN + step_i).ravel(), (j[:, None] * FAN + step_j).ravel()
                ok = (i < j if depth == 1 else i <= j) & (i < below) & (j < below)
                i, j = i[ok], j[ok]
        return i, j


def fold(bits: list[bytes], to: int | None = None) -> np.ndarray:
    """Bitmaps of different widths, all OR-folded to `to` bits or the least one; 64-bit words."""
    least = to // 8 if to else min(map(len, bits))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, least)) for b in bits]).view(np.uint64)


def folded(bits: list[bytes], size: np.ndarray, to: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Folded bitmaps, and how many tokens share a bit at the folded width: folding makes more of them collide."""
    maps = fold(bits, to)
    return maps, size - np.bitwise_count(maps).sum(1, dtype=np.int64)


def tree_of(size, bits, comp) -> tuple[SignatureTree, np.ndarray]:
    """A tree over leaves sorted by component and size, and that order."""
    size, comp = np.array(size, np.int64), np.array(comp, np.int64)
    order = np.lexsort((size, comp))
    maps, shared = folded([bits[i] for i in order], size[order])
    return SignatureTree(size[order], maps, shared, comp[order]), order


def groups(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple]:
    """(key, rows) of every group; rows come sorted by key, and a group may span batches."""
    at, held = None, []
    for b in batches:
        for k, row in zip(zip(*(b.column(c).to_pylist() for c in key)), zip(*(b.column(c).to_pylist() for c in columns))):
            if k != at:
                if held:
                    yield at, held
                at, held = k, []
            held.append(row)
    if held:
        yield at, held


def as_batches(**kinds: pa.DataType) -> Callable:
    """Turns a generator of tuples into one of record batches with these columns."""

    def wrap(rows: Callable) -> Callable:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for r in rows(batches):
                held.append(r)
                if len(held) == SLICE:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

        return run

    return wrap


@as_batches(src=pa.int64(), dst=pa.int64())
def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(least, leaf) for the leaves that have a possible partner in their block: least is the first leaf of all that hang together
    by such pairs. A block holds at most two chunks."""
    for _, rows in groups(batches, ["block"], ["row", "n", "bits", "comp"]):
        if len(rows) > 1:
            row, n, bits, comp = zip(*rows)
            tree, order = tree_of(n, bits, comp)
            i, j = (order[x] for x in tree.pairs())
            label = np.arange(len(rows))
            while True:
                before = label.copy()
                np.minimum.at(label, i, label[j])
                np.minimum.at(label, j, label[i])
                label = label[label]
                if (label == before).all():
                    break
            yield from ((row[a], row[b]) for b, a in enumerate(label) if a != b)


@as_batches(src=pa.int64(), dst=pa.int64())
def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Links between components of a block, verified on whole sets; links that join what is joined already are left out."""
    for _, rows in groups(batches, ["block"], ["row", "comp", "set"]):
        row, comp, sets = zip(*rows)
        sets = [np.frombuffer(s, np.uint64) for s in sets]
        tree, order = tree_of([len(s) for s in sets], [bitmap(s) for s in sets], comp)
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        for i, j in zip(*(order[x] for x in tree.pairs())):
            a, b = top(comp[i]), top(comp[j])
            if a != b and is_link(sets[i], sets[j]):
                parent[b] = a
                yield row[i], row[j]


def band_width(band: int) -> int:
    """Bitmap width that all members of a size band have or can be folded to."""
    return width(max(1, int((DEN / NUM) ** band * 0.999)))


NODE = "token long, band int, node long, part int, bits binary, lo int, hi int, shared int, c0 long, c1 long"
_NODE = [f.split()[0] for f in NODE.split(", ")]
_NODE_KINDS = dict(zip(_NODE, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]))


@as_batches(**_NODE_KINDS)
def chunk_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The tree node over each chunk of leaves."""
    for key, rows in groups(batches, ["token", "band", "node", "part"], ["n", "bits", "comp"]):
        n, bits, comp = zip(*rows)
        maps, shared = folded(bits, np.array(n, np.int64), band_width(key[1]))
        yield *key, np.bitwise_or.reduce(maps).tobytes(), min(n), max(n), int(shared.max()), min(comp), max(comp)


@as_batches(**_NODE_KINDS)
def family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The tree node over each family of chunk nodes, which come sorted; `part` is the last chunk's number."""
    at, held = None, None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in _NODE)):
            if r[:3] != at:
                if held:
                    yield held
                at, held = r[:3], r
                continue
            bits = (np.frombuffer(held[4], np.uint64) | np.frombuffer(r[4], np.uint64)).tobytes()
            held = (*at, max(held[3], r[3]), bits, min(held[5], r[5]), max(held[6], r[6]), max(held[7], r[7]), min(held[8], r[8]), max(held[9], r[9]))
    if held:
        yield held


def overlap_possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., a_*, b_*) whose two nodes can hold a link by the maximum possible overlap."""
    for b in batches:
        ok = []
        for x, y, *rest in zip(*(b.column(c).to_pylist() for c in ("a_bits", "b_bits", "a_shared", "b_shared", "a_lo", "b_lo"))):
            common = int(np.bitwise_count(np.frombuffer(x, np.uint64) & np.frombuffer(y, np.uint64)).sum())
            ok.append((DEN + NUM) * (common + min(rest[:2])) >= NUM * sum(rest[2:]))
        yield b.drop_columns(["a_bits", "b_bits"]).filter(pa.array(ok, pa.bool_()))


def node_pairs(a: DataFrame, b: DataFrame, on: list[str], order) -> DataFrame:
    """Pairs of tree nodes that may hold a link between different components."""
    left, right = (df.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in _NODE if c not in on]) for df, s in ((a, "a"), (b, "b")))
    fits = (DEN * F.col("a_hi") >= NUM * F.col("b_lo")) & (DEN * F.col("b_hi") >= NUM * F.col("a_lo"))
    one = (F.col("a_c0") == F.col("a_c1")) & (F.col("b_c0") == F.col("b_c1")) & (F.col("a_c0") == F.col("b_c0"))
    pairs = left.join(right, on).filter(order & fits & ~one)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if not f.name.endswith("_bits"))
    return pairs.mapInArrow(overlap_possible, schema)


def chunk_of(n: Column) -> Column:
    """Nodes to a chunk where sets have up to n shingles."""
    return F.least(F.lit(MOST_CHUNK), F.greatest(F.lit(CHUNK), F.floor(CHUNK_BYTES / 8 / n))).cast("int")


def deal_large(large: DataFrame, signed: DataFrame, t: Tables) -> DataFrame:
    """(block, row, comp) of blocks with more members than a chunk, given as (token, band, size, chunk, row, n, comp).

    A component with more members than a chunk in a block is a family of chunks of its own; the others are dealt into chunks
    by component.
    """
    per = large.groupBy("token", "band", "comp").agg(F.count("*").alias("own"))
    mixed = F.pmod(F.xxhash64("comp"), F.ceil(F.col("size") / F.col("chunk"))).cast("long")
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("own") / F.col("chunk"))).cast("int")
    own = F.col("own") > F.col("chunk")
    leaves = t(
        large.join(per, ["token", "band", "comp"])
        .select("token", "band", F.when(own, -1 - F.col("comp")).otherwise(mixed).alias("node"), F.when(own, part).otherwise(0).alias("part"), "row", "n", "comp"), "leaves"
    )
    key = ["token", "band", "node", "part"]
    bits = leaves.join(signed.select("row", "bits"), "row").select(*key, "n", "bits", "comp")
    chunks = t(bits.repartition(*key).sortWithinPartitions(*key).mapInArrow(chunk_nodes, NODE), "chunks")
    families = t(chunks.repartition(*key[:3]).sortWithinPartitions(*key[:3]).mapInArrow(family_nodes, NODE), "families")
    top = node_pairs(families, families, key[:2], F.col("a_node") <= F.col("b_node")).select(*key[:2], "a_node", "b_node")
    # down to the chunks of both families
    named = lambda s: chunks.select(*key[:2], *[F.col(c).alias(f"{s}_{c}") for c in _NODE[2:]])
    both = top.join(named("a"), [*key[:2], "a_node"]).join(named("b"), [*key[:2], "b_node"])
    both = both.filter((F.col("a_node") < F.col("b_node")) | (F.col("a_part") <= F.col("b_part")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if not f.name.endswith("_bits"))
    pairs = both.mapInArrow(overlap_possible, schema)
    block = F.xxhash64("token", "band", "a_node", "a_part", "b_node", "b_part").alias("block")
    pairs = t(pairs.select(*key[:2], block, "a_node", "a_part", "b_node", "b_part"), "chunk_pairs")
    sides = pairs.select("block", *key[:2], F.col("a_node").alias("node"), F.col("a_part").alias("part")).union(
        pairs.select("block", *key[:2], F.col("b_node").alias("node"), F.col("b_part").alias("part"))).distinct()
    return sides.join(leaves, key).select("block", "row", "comp")


def jaccard_classes(docs: DataFrame, t: Tables, heads_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(profiles, classes): every row of docs with its set's digest, and for every distinct set its component."""
    texts = docs.select(F.col("doc_id").cast("long"), text_hash(1).alias("t1"), text_hash(2).alias("t2"), "text")
    profiles = t(texts.mapInArrow(profiled, PROFILE).withColumn("row", F.monotonically_increasing_id()), "profiles")
    sized = profiles.filter("n > 0")
    # equal sets are one node: the least row stands for it
    classes = t(sized.groupBy("n", "h1", "h2").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "classes")
    kept = t(profiles.join(classes.select("row"), "row", "left_semi").select("row", "n", "t1", "t2", "tokens", "bits"), "kept")

    def sets_of(rows: DataFrame, name: str) -> DataFrame:
        """(row, set): the texts of these nodes are read again. Copies of a text are dropped before the shuffle, each text is sent
        once with its node's row, and sets are not sent at all; merged at every size, as the nodes grow with the input."""
        asked = kept.join(rows, "row", "left_semi").select("t1", "t2", "row")
        found = texts.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(asked.hint("merge"), ["t1", "t2"])
        return t(found.select("row", "text").mapInArrow(whole_sets, "row long, set binary"), name)

    def prefix_tokens(heavy: np.ndarray) -> DataFrame:
        return kept.select("row", "n", "tokens").mapInArrow(prefixes(heavy), SIGNED)

    def blocks_of(members: DataFrame, name: str) -> DataFrame:
        counted = members.select(F.explode("tokens").alias("token"), "row").groupBy("token").agg(F.count("*").alias("size"), F.min("row").alias("head"))
        return t(counted.filter("size > 1"), name)

    signed = t(prefix_tokens(np.zeros(0, np.uint64)), "signed")
    heads = blocks_of(signed, "heads")
    total = signed.agg(F.sum(F.size("tokens"))).first()[0] or 0
    limit = max(HEAVY, total // MAX_HEAVY)  # at most MAX_HEAVY tokens can be in so many prefixes
    heavy = np.sort(np.array([r[0] for r in heads.filter(F.col("size") > limit).select("token").collect()], np.int64).view(np.uint64))
    if len(heavy):
        t.drop(signed, heads)
        signed = t(prefix_tokens(heavy), "signed")
        short = signed.filter("short").select("row")
        if short.limit(1).count():  # their prefixes are taken from the whole sets
            again = sets_of(short, "short").mapInArrow(whole_prefixes(heavy), SIGNED)
            first_try, signed = signed, t(signed.filter("NOT short").unionByName(again), "signed")
            t.drop(first_try)
        heads = blocks_of(signed, "heads")

    members = signed.select(F.explode("tokens").alias("token"), "row", "n")
    shared = t(members.join(heads, "token").select("token", "row", "n", "head"), "shared")  # members of blocks of two or more
    t.drop(signed, heads)
    prefix = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    first = shared.filter((F.col("row") != F.col("head")) & F.lit(heads_first)).groupBy("row", "n", "head").agg(F.count("*").alias("blocks"))
    first = t(first.filter(3 * F.col("blocks") >= prefix).select(F.col("row").alias("src"), F.col("head").alias("dst")), "first")
    joined = components(first, t)
    comp = F.coalesce("component", "row").alias("comp")
    known = t(shared.join(joined, F.col("row") == F.col("node"), "left").select("token", "row", "n", comp), "known")
    t.drop(shared)

    # blocks in which more than one group is left, each kept once for equal member lists
    bands = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    banded = known.select("token", "row", "n", "comp", F.explode(F.array(bands, bands - 1)).alias("band"))
    blocks = banded.groupBy("token", "band").agg(
        F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
        F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"),
    ).filter("size > 1 AND c0 <> c1")
    blocks = t(blocks.groupBy("size", "x", "y", "c0", "c1").agg(F.min(F.struct("token", "band")).alias("k")).select("k.*", "size"), "blocks")
    placed = t(banded.join(blocks.hint("merge"), ["token", "band"]).select("token", "band", "size", chunk_of(F.pow(F.lit(DEN / NUM), F.col("band") + 2)).alias("chunk"), "row", "n", "comp"), "placed")
    t.drop(known, blocks)

    def dealt(of: DataFrame) -> DataFrame:
        """(block, row, comp): groups that a task can hold."""
        small = of.filter(F.col("size") <= F.col("chunk")).select(F.xxhash64("token", "band").alias("block"), "row", "comp")
        large = of.filter(F.col("size") > F.col("chunk"))
        return small.unionByName(deal_large(large, kept, t)) if large.limit(1).count() else small

    leaves = dealt(placed).join(kept.select("row", "n", "bits"), "row")
    near = t(leaves.repartition("block").sortWithinPartitions("block").mapInArrow(hits, "src long, dst long"), "near")
    clusters = components(first.unionByName(near), t).select(F.col("node").alias("row"), F.col("component").alias("token"))
    per = clusters.groupBy("token").agg(F.count("*").alias("size"))
    clusters = t(clusters.join(per, "token"), "clusters")
    sets = sets_of(clusters.select("row"), "sets")
    large = clusters.filter(F.col("size") > CHUNK).select("row")
    if large.limit(1).count():  # the tentative pairs of large clusters are verified first
        inside = first.join(large.select(F.col("row").alias("src")), "src", "left_semi")
        a = inside.join(sets.select(F.col("row").alias("src"), F.col("set").alias("set_a")), "src")
        b = a.join(sets.select(F.col("row").alias("dst"), F.col("set").alias("set_b")), "dst")
        links = t(b.select("src", "dst", "set_a", "set_b").mapInArrow(linked, "src long, dst long"), "links")
        sure = components(links, t)
    else:
        links = sure = None
    t.drop(placed, near, first)
    of = clusters.join(kept.select("row", "n"), "row")
    of = of.withColumn("comp", F.col("row")) if sure is None else of.join(sure, F.col("row") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "row"))
    # all bitmaps of a cluster fold to the width of its least set; its largest tells how many a task can hold
    band = of.groupBy("token").agg(F.min(bands).alias("band"), chunk_of(F.max("n")).alias("chunk"))
    of = t(of.join(band, "token").select("token", "band", "size", "chunk", "row", "n", "comp"), "of_clusters")
    told = dealt(of).join(sets, "row").select("block", "row", "comp", "set")
    second = t(told.repartition("block").sortWithinPartitions("block", "row").mapInArrow(forests, "src long, dst long"), "second")
    t.drop(sets, of, clusters)
    found = components(second if links is None else links.unionByName(second), t)

    # every set gets its component, named by the least real doc_id in it
    labelled = t(classes.join(found, F.col("row") == F.col("node"), "left").select("n", "h1", "h2", "least", F.coalesce("component", "row").alias("component")), "labelled")
    named = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    out = t(labelled.join(named, "component").select("n", "h1", "h2", "component", "component_id"), "components")
    t.drop(labelled, classes, kept)
    return profiles, out


def whole_prefixes(heavy: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(s, np.uint64) for s in b.column("set").to_pylist()]
            out = [demoted(s, heavy)[: prefix_size(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(s) for s in sets], pa.int32()), lists(out), pa.array([False] * len(sets))],
                                             names=["row", "n", "tokens", "short"])

    return run


def jaccard_components(docs: DataFrame, heads_first: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. heads_first=False leaves out the tentative pairs."""
    profiles, classes = jaccard_classes(docs, Tables(docs.sparkSession), heads_first)
    named = profiles.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (null last), of repeated rows any one; rows
    without words all stay."""
    t = Tables(docs.sparkSession)
    profiles, classes = jaccard_classes(docs, t)
    rows = profiles.filter("n > 0").join(classes.select("n", "h1", "h2", "component"), ["n", "h1", "h2"]).select("component", "doc_id", "t1", "t2")
    rows = t(rows, "rows")
    t.drop(profiles, classes)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    best = rows.groupBy("component").agg(least.alias("k"), F.count("*").alias("size")).filter("size > 1").select("component", "k.doc_id", "k.t1", "k.t2")
    best = t(best, "best")
    key = ["doc_id", "t1", "t2"]
    of_groups = rows.join(best.select("component"), "component", "left_semi").groupBy(*key).agg(F.count("*").alias("rows"))
    of_groups = t(of_groups, "of_groups")
    same = (of_groups.doc_id.eqNullSafe(best.doc_id)) & (of_groups.t1 == best.t1) & (of_groups.t2 == best.t2)
    dropped = t(of_groups.join(best, same, "left_anti").select(*key), "dropped")
    repeated = t(of_groups.join(best, same, "left_semi").filter("rows > 1").select(*key), "repeated")
    t.drop(rows, best, of_groups)
    return without(docs, dropped, repeated)


#: Whole-table SQL by shared shingles: fit for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
