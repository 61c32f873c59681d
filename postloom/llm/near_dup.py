"""Near-duplicate records by the chosen-path set similarity join (problem 6).

A record is the set of its k-word shingles, embedded as T minwise tokens. A tree splits the records: at a node, two of the T positions, chosen
by a hash of the node's path, each send a record to the child of its token there. With two positions a pair of similarity 1/2 stays
together on a path of depth d with a probability that falls with d (0.61 at 2, 0.40 at 5), so nodes that are too large at the first depth branch on
three positions (of the sketch): from there the probability rises with depth (0.73 at 5), and more or larger nodes cost no recall. Independent trees raise
it further; over 64 tokens, six find 0.99 of the pairs at 1/2 at depth 2 and 0.97 at depth 5. Nodes of at most ``leaf`` records are compared exhaustively on a 256-bit sketch
(up to about 2,048 that costs less than three more rows per record). Larger ones are found by counting nodes before any row of theirs is shuffled, and branch where they are: no task gets a hot
node. A node that is no longer thinned out by branching, because its records are as similar as the threshold asks, is compared in pairs of blocks; none is dropped. Candidates are verified
on the whole shingle sets. Trees are grown in rounds: only the rows of one round are on disk at a time.

Exact copies are one record: the join runs over one representative per distinct set, copies come back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.wordhash import mix, shingle_sets, text_chunks, word_hashes
from postloom.operators.lineage import release, written

T = 64
#: Bits of each token in the sketch that travels with a record, and the columns of such a row.
BITS = 4
_ROW = ["node", "id", *[f"s{i + 1}" for i in range(BITS)]]
_SCHEMA = ", ".join(f"{c} bigint" for c in _ROW)
_A = (np.random.default_rng(6).integers(0, 1 << 32, (2, T), dtype=np.uint64)).astype(np.uint32)


def minwise(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """T minwise tokens (8 bits each: two different ones look equal once in 256 cases) of each non-empty set."""
    out = np.empty((len(offsets) - 1, T), dtype=np.uint8)
    at = offsets[:-1]
    for i in range(T):
        x = (sets ^ _A[0, i]) * np.uint32(_A[1, i] | 1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        m = np.minimum.reduceat(x, at)
        out[:, i] = (m * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def sketch(sig: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each token: a 64-bit word of the low bits, one of the next ones, and so on."""
    bits = lambda b: np.packbits(((sig >> b) & 1).astype(np.uint8), axis=1).view(np.int64).reshape(-1)
    return np.stack([bits(np.uint8(b)) for b in range(BITS)], axis=1)


def _tokens(words: list[np.ndarray]) -> np.ndarray:
    """The T tokens of each sketch, of ``BITS`` bits."""
    return sum(np.unpackbits(np.ascontiguousarray(w).view(np.uint8).reshape(-1, 8), axis=1) << np.uint8(b) for b, w in enumerate(words))


def _features(k: int, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in text_chunks([len(t) for t in texts]):
                h, off = word_hashes(texts[a:b])
                sets, at = shingle_sets(h, off, k)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                at = np.append(at[:-1][some], at[-1])  # sets of empty texts have no width
                own = pa.array(ids[a:b][some])
                if with_sets:
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int32)))], ["id", "shingles"])
                    continue
                x = mix(sets.astype(np.uint64) + np.uint64(0x51ED270B))
                y = mix(x + np.uint64(0xA24BAED4963EE407))
                fp = [np.add.reduceat(v, at[:-1]).view(np.int64) for v in (x, y)]
                sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(T), len(some), [None, pa.py_buffer(minwise(sets, at).tobytes())])
                yield pa.RecordBatch.from_arrays([own, pa.array(fp[0]), pa.array(fp[1]), sig.cast(pa.binary())], ["id", "f1", "f2", "sig"])

    return run


def _children(node: np.ndarray, sig: np.ndarray, fan: int = 2) -> list[np.ndarray]:
    """``fan`` (2 or 3) child nodes of each (node, record); the positions depend on the node's path alone."""
    p = mix(node + np.uint64(0x632BE59BD9B4E019))
    one = (p % np.uint64(T)).astype(np.int64)
    step = ((p >> np.uint64(32)) % np.uint64(T - 1)).astype(np.int64)
    at = [one, (one + 1 + step) % T]
    if fan == 3:  # one of the T - 2 others
        at.append((one + 1 + (step + 1 + ((p >> np.uint64(16)) % np.uint64(T - 2)).astype(np.int64)) % (T - 1)) % T)
    row = np.arange(len(node))
    return [mix(p + (pos.astype(np.uint64) << np.uint64(20)) + sig[row, pos].astype(np.uint64) + np.uint64(1)) for pos in at]


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, T) if len(column) else np.zeros((0, T), np.uint8)


def _plant(trees: range, depth: int):
    """Rows (node, id, s1, s2, ...) of each of ``trees`` at ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sig = batch.column(0).to_numpy(), _sigs(batch.column(1))
            sk = sketch(sig)
            for t in trees:
                nodes = [np.full(len(ids), (t + 1) * 0x1000193, dtype=np.uint64)]
                for _ in range(depth):
                    nodes = [c for n in nodes for c in _children(n, sig)]
                for n in nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n.view(np.int64), ids, *sk.T)], _ROW)

    return run


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, *rest = (batch.column(i).to_numpy() for i in range(len(_ROW) + 1))
        for c in _children(node.view(np.uint64), _tokens(rest[1:-1]), 3):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.view(np.int64), *rest)], [*_ROW, "up"])


def _compare(least: int, sided: bool = False):
    """Pairs within runs of equal keys (rows sorted by key) whose sketches agree in ``least`` positions or more.

    The last run of a batch waits for the next batch. The columns after key and id are the sketch. The last column, if ``sided``, is the side of a record in a comparison of two blocks: only
    records of different sides are compared then, or all if the key is of one block.
    """
    even = np.uint64

    def pairs(k: np.ndarray, i: np.ndarray, *words: np.ndarray):
        side = words[-1] if sided else None
        words = words[: len(words) - sided]
        out = []
        d = 1
        live = np.arange(len(k) - 1)
        while len(live):
            live = live[live + d < len(k)]
            live = live[k[live] == k[live + d]]
            if not len(live):
                break
            o = live + d
            differ = words[0][live] ^ words[0][o]
            for w in words[1:]:
                differ |= w[live] ^ w[o]
            ok = T - np.bitwise_count(differ.view(even)) >= least
            if side is not None:
                ok &= (side[live] != side[o]) | (side[live] < 0)
            ok &= i[live] != i[o]
            x, y = i[live][ok], i[o][ok]
            out.append((np.minimum(x, y), np.maximum(x, y)))
            d += 1
        if out:
            x, y = np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            held = [c[cut:] for c in cols]
            done = [c[:cut] for c in cols]
            if cut and (r := pairs(*done)) is not None:
                yield r
        if held is not None and len(held[0]) and (r := pairs(*held)) is not None:
            yield r

    return run


def candidate_pairs(
    sigs: DataFrame, trees: int = 6, leaf: int = 2048, start: int = 2, depth: int = 12, least: int = 22, at_once: int = 2, similarity: tuple[int, int] = (1, 2), block: int = 8192
) -> DataFrame:
    """Distinct ``a < b`` of records that a small node puts together and whose sketches are close.

    ``sigs``: ``id, sig``. ``least`` of 64 positions must agree in their bits; a pair of similarity 0.5 is expected at 34 with a deviation of 4.
    ``at_once`` trees are grown in a round, whose pairs are written before the next. A node beyond ``leaf`` with at least ``similarity`` of its parent's records,
    or at ``depth``, is compared in blocks of ``block``: of m records each is copied m / block times.
    """
    out = None
    for t in range(0, trees, at_once):
        x = _tree_pairs(sigs, range(t, min(t + at_once, trees)), leaf, start, depth, least, similarity, block)
        out = x if out is None else out.union(x)
    return out.distinct()


def _tree_pairs(sigs: DataFrame, trees: range, leaf: int, start: int, depth: int, least: int, similarity: tuple[int, int], block: int) -> DataFrame:
    num, den = similarity
    rows = sigs.mapInArrow(_plant(trees, start), _SCHEMA)
    up = F.lit(None).cast("bigint")
    found, used = [], []
    for level in range(start, depth + 1):
        sizes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min(up).alias("up")).where(F.col("m") > leaf))
        used.append(sizes)
        small = rows.join(sizes.select("node"), "node", "left_anti").select(*_ROW)
        found.append(small.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(least), "a bigint, b bigint"))
        if sizes.isEmpty():
            break
        # most records of the parent are here still: as similar as the pairs sought
        done = F.coalesce(F.col("m") * den >= F.col("up") * num, F.lit(False)) | F.lit(level == depth)
        alike, other = sizes.where(done).select("node", "m"), sizes.where(~done).select("node", "m")
        found.append(_in_blocks(rows.join(alike, "node"), block).mapInArrow(_compare(least, True), "a bigint, b bigint"))
        if other.isEmpty():
            break
        large = written(rows.join(other, "node").select(*_ROW, "m"))
        used.append(large)
        rows, up = large.mapInArrow(_branch, _SCHEMA + ", up bigint"), F.col("up")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    out = written(out.distinct())
    release(*used)
    return out


def _agree(least: int):
    """Candidates whose whole tokens agree in ``least`` positions or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = (_sigs(b.column(2)) == _sigs(b.column(3))).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def refine(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """``pairs`` that the T tokens still allow: narrow rows are joined before the wide sets are."""
    x = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("tb")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("ta")), "a")
    return x.select("a", "b", "ta", "tb").mapInArrow(_agree(least), "a bigint, b bigint")


def _in_blocks(large: DataFrame, block: int) -> DataFrame:
    """Rows of oversized nodes (``m`` records each) keyed by pairs of blocks: every two records of a node meet under exactly one key."""
    x = large.withColumn("k", F.ceil(F.col("m") / block).cast("int"))
    x = x.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    x = x.select(*_ROW, "block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    key = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return x.select(key.alias("node"), *_ROW[1:], side.cast("bigint").alias("side")).repartition("node").sortWithinPartitions("node")


def similar_pairs(
    df: DataFrame, id_col: str, text: "F.Column", k: int = 5, similarity: tuple[int, int] = (4, 5), trees: int = 6, leaf: int = 2048, least: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(pairs ``a < b`` of representatives, members ``rep, id``): sets of k-word shingles with similarity of at least num/den.

    Members have every record with at least one shingle; records of the same set share the representative with the smallest id. Records with
    NULL or too short text belong to no pair. ``id_col`` must be unique and integer; extra columns are ignored. Empty input: empty results.
    Pairs are exact (verified on whole sets of 32-bit shingle hashes); what the trees may miss is measured in the tests.
    """
    num, den = similarity
    if least is None:  # mean agreement at the threshold less three deviations: keeps 99.8 % there
        p = num / den + (1 - num / den) / 2**BITS
        least = math.floor(T * p - 3 * (T * p * (1 - p)) ** 0.5)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    feats = written(rows.mapInArrow(_features(k, False), "id bigint, f1 bigint, f2 bigint, sig binary"))
    reps = feats.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    members = written(feats.select("id", "f1", "f2").join(reps, ["f1", "f2"]).select("rep", "id"))
    sigs = written(feats.join(members.where("rep = id").select("id"), "id", "left_semi").select("id", "sig"))
    release(feats)
    p = num / den + (1 - num / den) / 256
    whole = math.floor(T * p - 3 * (T * p * (1 - p)) ** 0.5)
    cand = written(refine(candidate_pairs(sigs, trees, leaf, least=least, similarity=similarity), sigs, whole))
    release(sigs)
    # written, so that its size is known when the join is planned: small enough, it thins the sets out before they move
    ids = written(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = rows.mapInArrow(_features(k, True), "id bigint, shingles array<int>").join(ids, "id", "left_semi")
    x = cand.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    x = x.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    # |A n B| / |A u B| >= num / den, in integers
    x = x.where(both * (num + den) >= num * (F.size("sa") + F.size("sb")))
    return x.select("a", "b"), members


def expand_copies(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records ``a < b``: across linked representatives, and among the copies of one.

    The result is as large as the stated pairs; AQE splits hot representatives in the joins.
    """
    m = members
    x = pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    x = x.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    copied = m.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    own = m.join(copied, "rep", "left_semi")
    y = own.select("rep", F.col("id").alias("a")).join(own.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b")
    return x.union(y)
