"""SimHash near-duplicates, found with a hierarchical index over Gray-ordered fingerprints.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Fingerprints that differ in at most
three bits are linked; linked documents form a component.

Equal fingerprints are joined by aggregation first.  Distinct ones are sorted by Gray rank, which puts alike ones side by side, and cut into runs
of ``RUN``; runs are cut into leaves of ``LEAF``.  A node of the index holds the bits that all its members share, ones and zeros; nodes
of runs are factored into upper nodes, ``FANOUT`` at a time, level by level up to a few roots.  The search goes down pairs of nodes from the roots.  A pair
carries the shared bits it has compared and the differences found in them; one level down only the bits that are shared anew are
compared and their differences added.  A pair of whole groups is dropped once the sum exceeds its bound.  Down to the runs, the levels are joins
of node tables, in which no fingerprint moves; the runs of a pair that is left meet in a task, which goes down their leaves in the same way.

Two orders of the bits bound the differences further.  Of three differing bits at most one lies in one of the two halves, so there are
two indexes, sorted by either half first, and a pair of nodes is dropped once it differs in two bits of the first half.  A run then meets
about as many others as its leading bits are in number, times two, however many runs there are.

A dense group is not compared all with all.  Neighbouring runs are linked first; where two of them turn out to be one component, they
belong to one stretch, and pairs of runs in one stretch are dropped: all of its members are connected.  Found links are given as
spanning stars, never as all pairs.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer than three words make one shingle;
repeated rows are copies of one document; rows without an id are linked like others, but a component's id is the smallest that is there, null where
there is none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..session import small_batches, written
from .common import byte_values, slices
from .components import roots

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Differences that a linked pair has at most in one of the two halves.
HALF = DISTANCE // 2
RUN = 1024
LEAF = 32
FANOUT = 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text: a bit is set if it is set in over half the shingle hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A to Z only, and the white space of the contract
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, keys: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fp`` and the long columns ``keys``: ``fp`` is the fingerprint as a signed long with the same bits."""
    carried = ["doc_id", *(keys or {})]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                values = np.array([fingerprint(t, shingle, seed) for t in byte_values(rows.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carried), pa.array(values.view(np.int64))], names=[*carried, "fp"])

    selected = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[k.alias(name) for name, k in (keys or {}).items()])
    return selected.mapInArrow(scan, ", ".join(f"{c} long" for c in [*carried, "fp"]))


# --- inside a task: leaves of sorted patterns, compared in pairs


class _Forest:
    """Union-find whose roots are read in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


def leaves(values: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every leaf the bits that are one, and the bits that are zero, in all its members."""
    at = np.arange(0, len(values), leaf)
    return np.bitwise_and.reduceat(values, at), np.bitwise_and.reduceat(~values, at)


def leaf_pairs(values: np.ndarray, others: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the leaves of ``values`` and of ``others`` that may hold linked members.

    Patterns have the half that the order begins with in their high bits.
    """
    ones, zeros = leaves(values, leaf)
    other_ones, other_zeros = leaves(others, leaf)
    differ = (ones[:, None] & other_zeros[None]) | (zeros[:, None] & other_ones[None])
    return np.nonzero((np.bitwise_count(differ) <= DISTANCE) & (np.bitwise_count(differ >> np.uint64(32)) <= HALF))


def linked(first: np.ndarray, second: np.ndarray, inside: bool, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, bool]:
    """Star edges ``(member, smallest of its component)`` among the patterns of two sorted runs, and whether all are one component.

    ``inside`` also links the members of each run with each other; without it only links between the runs are looked for.
    """
    own = np.concatenate([first, second])
    n, cut, forest = len(own), len(first), _Forest(len(own))
    parts = [(0, first, cut, second)] if len(second) else []
    if inside:
        parts += [(0, first, 0, first), (cut, second, cut, second)] if len(second) else [(0, first, 0, first)]
    for left, x, right, y in parts:
        a, b = leaf_pairs(x, y, leaf)
        if left == right:
            a, b = a[a <= b], b[a <= b]
        for k in range(0, len(a), 64):
            i, j = a[k : k + 64] * leaf, b[k : k + 64] * leaf
            p, q = (i[:, None] + np.arange(leaf)), (j[:, None] + np.arange(leaf))
            near = np.bitwise_count(x[np.minimum(p, len(x) - 1)][:, :, None] ^ y[np.minimum(q, len(y) - 1)][:, None, :]) <= DISTANCE
            near &= (p < len(x))[:, :, None] & (q < len(y))[:, None, :]
            c, r, t = np.nonzero(near)
            u, v = forest.parent[p[c, r] + left], forest.parent[q[c, t] + right]
            if (differ := u != v).any():
                pairs = np.unique(np.stack([np.minimum(u, v)[differ], np.maximum(u, v)[differ]]), axis=1)
                forest.join(pairs[0], pairs[1])
                forest.flatten()
    root = forest.flatten()
    least = np.full(n, np.iinfo(np.int64).max)
    signed = own.view(np.int64)
    np.minimum.at(least, root, signed)
    target = least[root]
    moved = target != signed
    return signed[moved], target[moved], bool((root == root[0]).all())


# --- the index: runs in Gray order, their nodes, and pairs of nodes


def turned(fp: Column, order: int) -> Column:
    """The pattern with the half that the order begins with in its high bits."""
    return fp if order == 0 else F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def gray_rank(pattern: Column) -> Column:
    """Place of each 64-bit pattern in the Gray order, as a signed long that sorts alike."""
    rank = pattern
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def indexed(distinct: DataFrame, run: int = RUN) -> DataFrame:
    """The runs, a written table: ``ord``, ``id`` without gaps in Gray order, ``ones, zeros`` (bits that all members share) and ``members``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, order, number = np.zeros(0, np.int64), None, 0

        def made(values: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            row = [order, number, int(np.bitwise_and.reduce(values)), int(np.bitwise_and.reduce(~values)), values.tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["ord", "seq", "ones", "zeros", "members"])

        for batch in batches:
            orders = batch.column("ord").to_numpy(zero_copy_only=False)
            values = batch.column("pattern").to_numpy(zero_copy_only=False)
            for own in np.unique(orders).tolist():
                if own != order and len(held):
                    yield made(held)
                    held = held[:0]
                order, held = own, np.concatenate([held, values[orders == own]])
                while len(held) >= run:
                    yield made(held[:run])
                    held = held[run:]
        if len(held):
            yield made(held)

    both = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select("ord", F.when(F.col("ord") == 0, turned(F.col("fp"), 0)).otherwise(turned(F.col("fp"), 1)).alias("pattern"))
    ranked = both.withColumn("rank", gray_rank(F.col("pattern")))
    dealt = ranked.repartitionByRange("ord", "rank").sortWithinPartitions("ord", "rank").select("ord", "pattern")
    runs = dealt.mapInArrow(cut, "ord int, seq long, ones long, zeros long, members binary").withColumn("task", F.spark_partition_id())
    runs = written(runs, "runs")
    # two-pass numbering: one total for each task that cut runs, then the place in the task
    before = runs.groupBy("task").agg(F.count("*").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return written(runs.join(before, "task").select("ord", (F.col("before") + F.col("seq")).alias("id"), "ones", "zeros", "members"), "index")


def _differing(ones: str, zeros: str, other_ones: str, other_zeros: str) -> Column:
    return F.col(ones).bitwiseAND(F.col(other_zeros)).bitwiseOR(F.col(zeros).bitwiseAND(F.col(other_ones)))


def near_runs(runs: DataFrame) -> DataFrame:
    """``ord, a, b`` with ``a <= b``: the pairs of runs that may hold linked members, found from the upper nodes down."""
    levels = [runs.select("ord", "id", "ones", "zeros")]
    highest = runs.agg(F.max("id")).first()[0] or 0
    while highest >= FANOUT:
        highest //= FANOUT
        up = levels[-1].groupBy("ord", F.shiftright("id", 4).alias("id")).agg(F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros"))
        levels.append(written(up, "nodes"))

    def node(level: int, side: str) -> DataFrame:
        return levels[level].select("ord", F.col("id").alias(side), F.shiftright("id", 4).alias(f"up_{side}"), F.col("ones").alias(f"ones_{side}"), F.col("zeros").alias(f"zeros_{side}"))

    def added(pairs: DataFrame) -> DataFrame:
        """Compare the bits that are shared anew, add their differences, and drop pairs beyond the bounds."""
        shared = F.col("ones_a").bitwiseOR(F.col("zeros_a")).bitwiseAND(F.col("ones_b").bitwiseOR(F.col("zeros_b")))
        fresh = _differing("ones_a", "zeros_a", "ones_b", "zeros_b").bitwiseAND(F.bitwise_not("seen"))
        summed = pairs.select("ord", "a", "b", shared.alias("seen"), (F.col("differ") + F.bit_count(fresh)).alias("differ"), (F.col("differ_first") + F.bit_count(F.shiftrightunsigned(fresh, 32))).alias("differ_first"))
        return summed.filter((F.col("differ") <= DISTANCE) & (F.col("differ_first") <= HALF))

    top = len(levels) - 1
    left, right = node(top, "a").drop("up_a"), node(top, "b").drop("up_b")
    pairs = added(left.join(right, "ord").filter("a <= b").select("*", F.lit(0).cast("long").alias("seen"), F.lit(0).alias("differ"), F.lit(0).alias("differ_first")))
    for level in range(top - 1, -1, -1):
        above = pairs.withColumnsRenamed({"a": "up_a", "b": "up_b"})
        pairs = added(above.join(node(level, "a"), ["ord", "up_a"]).join(node(level, "b"), ["ord", "up_b"]).filter("a <= b"))
    return pairs.select("ord", "a", "b")


_STARS = "id long, joint boolean, u array<long>, v array<long>"


def _met(rows: DataFrame, inside: bool, leaf: int) -> DataFrame:
    """Links of the two runs in each row of ``id, ord, first, second`` (``second`` may be null), as :func:`linked` gives them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (own, order, first, second) in enumerate(zip(*(batch.column(c) for c in ("id", "ord", "first", "second")), strict=True)):
                x, y = (np.frombuffer(m.as_py() or b"", np.uint64) for m in (first, second))
                u, v, joint = linked(x, y, inside, leaf)
                if order.as_py():
                    u, v = ((z.view(np.uint64) << np.uint64(32) | z.view(np.uint64) >> np.uint64(32)).view(np.int64) for z in (u, v))
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()], pa.int64()), pa.array([joint]), pa.array([u], pa.list_(pa.int64())), pa.array([v], pa.list_(pa.int64()))], names=["id", "joint", "u", "v"])

    with small_batches(rows.sparkSession, 100):  # of two runs each, 64 KB
        return written(rows.mapInArrow(meet, _STARS), "stars")


def _stretches(met: DataFrame) -> DataFrame:
    """``id, stretch``: runs of one stretch are one component, each having been found joint with the next.

    A stretch's number is that of the breaks before it, summed in blocks of runs first, then over the blocks.
    """
    block = F.shiftright("id", 12)
    breaks = met.select("id", block.alias("block"), F.when(F.col("joint"), 0).otherwise(1).alias("broken"))
    before = breaks.groupBy("block").agg(F.sum("broken").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inner = F.sum("broken").over(Window.partitionBy("block").orderBy("id")) - F.col("broken")
    return breaks.select("id", "block", inner.alias("inner")).join(before, "block").select("id", (F.col("before") + F.col("inner")).alias("stretch"))


def links(distinct: DataFrame, run: int = RUN, leaf: int = LEAF) -> DataFrame:
    """Edges ``u, v`` that connect exactly the fingerprints (column ``fp``, distinct rows of a written table) linked within three bits."""
    spark = distinct.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = indexed(distinct, run)
    held = runs.select("ord", "id", "members")
    following = held.select("ord", (F.col("id") - 1).alias("id"), F.col("members").alias("second"))
    neighbours = held.withColumnRenamed("members", "first").repartition(parts, "ord", "id").join(following.repartition(parts, "ord", "id"), ["ord", "id"], "left")
    met = _met(neighbours.select("id", "ord", "first", "second"), True, leaf)
    stretch = written(_stretches(met), "stretches")
    apart = near_runs(runs).filter("b > a + 1")
    apart = apart.join(stretch.select(F.col("id").alias("a"), F.col("stretch").alias("sa")), "a").join(stretch.select(F.col("id").alias("b"), F.col("stretch").alias("sb")), "b").filter("sa <> sb")
    apart = written(apart.select("ord", "a", "b"), "run-pairs")
    first = apart.join(held.select("ord", F.col("id").alias("a"), F.col("members").alias("first")), ["ord", "a"])
    second = held.select("ord", F.col("id").alias("b"), F.col("members").alias("second"))
    pairs = first.repartition(parts, "ord", "b").join(second.repartition(parts, "ord", "b"), ["ord", "b"])
    crossed = _met(pairs.select(F.col("a").alias("id"), "ord", "first", "second"), False, leaf)
    return met.union(crossed).select(F.explode(F.arrays_zip("u", "v")).alias("e")).select("e.u", "e.v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, leaf: int = LEAF, keys: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``; ``component_id`` is the smallest id in the component.

    ``keys`` are long columns to carry along; with them comes ``first``, the least row ``(lost, doc_id, *keys)`` of the component, in which
    ``lost`` says that it has no id.
    """
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", *(keys or {}))
    marked = written(fingerprints(docs, id_col, text_col, keys=keys), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min(row).alias("first")), "distinct-fingerprints")
    found = roots(links(distinct.select("fp"), run, leaf))
    rooted = distinct.join(found.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("first")), "least")
    placed = rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), *(["first"] if keys else []))
    return marked.join(placed, "fp").select("doc_id", "fp", "component_id", *(["first"] if keys else []), *(keys or {}))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, columns unchanged: the one with the smallest id (null is the greatest), of equals any with the smallest hash.

    A row is known by its id, a hash of its text and one of all its columns, never by its id alone: rows that share an id and belong to
    different components are different documents.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    used, tail = {c.lower() for c in docs.columns}, ""
    while used & {f"_{n}{tail}" for n in ("k1", "k2", "k1r", "k2r", "id")}:
        tail += "_"
    names, others, own = [f"_k1{tail}", f"_k2{tail}"], [f"_k1r{tail}", f"_k2r{tail}"], f"_id{tail}"
    keys = dict(zip(names, (F.xxhash64(text_col), F.xxhash64(*hashed)), strict=True))
    found = near_duplicates(docs, id_col, text_col, keys=keys)
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", *names)
    found = written(found.select("doc_id", *names, (row == F.col("first")).alias("stays")), "places")
    by_id = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    # what goes is far less than what stays; its size is known once it is written, and the planner broadcasts it or not
    odd = written(by_id.filter("n > 1 or doc_id is null or not stays").select(F.col("doc_id").alias(own), "n", "stays"), "odd-ids")
    own_id = F.col(id_col).cast("long")
    gone = odd.filter((F.col("n") == 1) & F.col(own).isNotNull()).select(own)
    several = odd.filter((F.col("n") > 1) | F.col(own).isNull()).select(own)
    rest = docs.join(gone, own_id == F.col(own), "left_anti")
    if several.isEmpty():
        return rest.select(*docs.columns)
    # ids that are shared or missing: the row decides
    rows = found.join(several, found["doc_id"].eqNullSafe(F.col(own)), "left_semi").groupBy("doc_id", *names).agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    listed = written(rows.filter("n > 1 or not stays").select(F.col("doc_id").alias(own), *[F.col(n).alias(o) for n, o in zip(names, others, strict=True)], "stays"), "odd-rows")
    keyed = rest.withColumns(keys)
    same = own_id.eqNullSafe(F.col(own)) & (F.col(names[0]) == F.col(others[0])) & (F.col(names[1]) == F.col(others[1]))
    once = keyed.join(listed.drop("stays"), same, "left_anti").select(*docs.columns)
    repeated = listed.filter("stays").drop("stays")
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(names).select(*docs.columns))
