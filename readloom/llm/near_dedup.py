"""Operator 10: near-duplicates by HyperMinHash.

Every distinct shingle set gets ``REGISTERS`` buckets.  A bucket keeps the least of the hashes that fall into it as 16
bits: the count of leading zeros and ten mantissa bits after the first one.  Buckets that stay empty (small sets) are
filled by further rounds of hashing, a later round counting as greater than any earlier one, so that two sets agree in
a bucket with a probability of their Jaccard similarity, plus that of two unequal hashes having the same 16 bits.

1. Sets that are equal are one class, kept by its least document; only these representatives go on.  Equal are sets of
   the same size and the same two sums, each of 64 bits, over hashes of all their shingles.
2. Bands of ``ROWS`` registers: in each band value the least representative is the root; each other member is paired
   with it.  Pairs whose sizes or whose collision-corrected estimate rule out the threshold are dropped; the rest are
   confirmed on the full sets.  So a group of n near copies costs n pairs, not n^2.
3. Where members of band values with one root are still in different components, those whose registers leave a link
   across components possible are compared on their full sets, by an inverted index.  A root's members are dealt to
   blocks of bounded size, and members of its largest component meet only blocks of others: with up to a block of
   others, a member of the largest component travels once.  More others than that travel once for each block of them.
   Only links that join components are put out.

Full sets are sets of 64-bit hashes of the shingles, not of their words: two different shingles with one hash count as
one, in a corpus of 10^12 distinct ones with a chance of about 3 % for a single pair of them.

With 42 bands of 6 registers a pair at similarity 0.8 shares no band value with a probability of 3e-6, and the estimate
(standard deviation 0.025) is held against a bound 0.12 below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.llm.common import arrow_map, broadcast_if_small, table, written, written_ids
from readloom.llm.components import components
from readloom.llm.wordhash import U, Words, blocks, mix, shingle_set

REGISTERS, ROWS, BANDS = 256, 6, 42
MANTISSA = 10
SLACK = 0.12
BROADCAST_ROWS = 300_000  # rows of at most three 64-bit numbers that may be broadcast; beyond, joins shuffle
BLOCK_ROWS = 8192  # members of a root whose registers (4 MB) are compared at once, with those of another block
BLOCK_BYTES = 8 << 20  # of a root's members' shingle hashes that are compared at once, with those of another block
SALT_PAIRS = 256  # partners of a root that are confirmed at once


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, REGISTERS) 16-bit registers of the sets given as (text, shingle hash); those of empty sets are 0."""
    out = np.zeros((n_docs, REGISTERS), np.uint16)
    full = np.zeros((n_docs, REGISTERS), bool)
    first, rounds = 0, 1
    while len(doc):
        # rounds first .. first + rounds - 1 at once; in a round every shingle falls into one bucket
        r = np.arange(first, first + rounds)
        x = np.concatenate([mix(h, int(i) + 1) for i in r]) if rounds > 1 else mix(h, first + 1)
        d = np.tile(doc, rounds)
        bucket = (x & U(REGISTERS - 1)).astype(np.int64)
        r = np.repeat(r, len(doc))
        sweep = r >= REGISTERS  # by then every bucket gets its turn
        if sweep.any():
            bucket[sweep] = r[sweep] % REGISTERS
        value = x >> U(8)
        cell = d * REGISTERS + bucket
        keep = ~full.ravel()[cell]
        cell, r, value = cell[keep], r[keep], value[keep]
        order = np.lexsort((value, r, cell))
        cell, r, value = cell[order], r[order], value[order]
        new = np.ones(len(cell), bool)
        new[1:] = np.diff(cell) != 0
        cell, r, value = cell[new], r[new], value[new]
        out.ravel()[cell] = code(value) + (r * 40503 & 0xFFFF).astype(np.uint16)
        full.ravel()[cell] = True
        left = ~full.all(axis=1)
        keep = left[doc]
        doc, h = doc[keep], h[keep]
        first, rounds = first + rounds, min(16, 2 * rounds)
    return out


def code(value: np.ndarray) -> np.ndarray:
    """The leading zeros of 56-bit hashes and the MANTISSA bits after the first one."""
    exponent = np.frexp(value.astype(np.float64))[1]  # the length in bits; rounding up to 2^k is harmless: same for all
    exponent = np.minimum(exponent, 56)
    zeros = 56 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(U)
    return ((zeros << MANTISSA).astype(np.uint16)) | ((value >> shift) & U((1 << MANTISSA) - 1)).astype(np.uint16)


def collisions(log_n: np.ndarray, log_m: np.ndarray) -> np.ndarray:
    """The probability that a register agrees though the hashes differ, for disjoint sets of 2^log_n and 2^log_m."""
    return _collisions[np.clip(log_n, 0, 31), np.clip(log_m, 0, 31)]


def _collision_table() -> np.ndarray:
    edge = np.unique(np.concatenate([2.0**-z * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA)) / 2 for z in range(40)]))
    p = []
    for k in range(32):
        n = max(2.0**k / REGISTERS, 1.0)  # of a bucket; small sets fill it in further rounds
        above = np.exp(n * np.log1p(-np.minimum(edge, 1 - 1e-16)))
        p.append(above[:-1] - above[1:])
    p = np.array(p)
    return p @ p.T


_collisions = _collision_table()


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of registers along the last axis."""
    agree = (a == b).mean(axis=-1)
    c = collisions(np.log2(np.maximum(n, 1)).astype(int), np.log2(np.maximum(m, 1)).astype(int))
    return np.maximum(0.0, (agree - c) / (1 - c))


def sketches(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n (set size), set_hash (128 bits in two), registers (binary); for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in blocks([t or "" for t in batch.column(1).to_pylist()], 1 << 19):
                doc, h = Words(run, lower=True).shingles(n_words)
                n = np.bincount(doc, minlength=len(run))
                sums = np.zeros((2, len(run)), U)
                for i in range(2):
                    _sum(sums[i], doc, mix(h, 1000 + i))
                regs = sketch(doc, h, len(run)).astype("<u2")
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, len(run)), "n": n, "s0": sums[0].view(np.int64), "s1": sums[1].view(np.int64), "registers": pa.array([r.tobytes() for r in regs], pa.binary())})

    return docs.transform(arrow_map, run, "doc_id long, n long, s0 long, s1 long, registers binary")


def _sum(out: np.ndarray, doc: np.ndarray, x: np.ndarray) -> None:
    """Adds up the x of each text, given in order."""
    if len(doc):
        first = np.flatnonzero(np.append(True, np.diff(doc) != 0))
        out[doc[first]] = np.add.reduceat(x, first)


def _bands(reps: DataFrame) -> DataFrame:
    """(band, id): the hash of each band's number and registers."""
    width = 2 * ROWS
    values = [F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(BANDS)]
    return reps.select(F.explode(F.array(*values)).alias("band"), "id")


def _size_ok(a: str, b: str, threshold: float):
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes and registers don't rule out the threshold."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    joined = pairs.join(right, "b").join(left, "a").filter(_size_ok("n_a", "n_b", threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (4, 5)]
                keep = estimate(r[0], r[1], batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= threshold - SLACK
                yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep))

    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").transform(arrow_map, run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sets of distinct hashes reach the threshold, held in hundredths."""
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= round(100 * threshold) * (len(x) + len(y) - both)


def _packed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, z): the texts of ``ids``, compressed before they are shuffled, if they are."""
    import zstandard

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "z": pa.array([c.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())})

    rows = texts.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.transform(arrow_map, press, "id long, z binary").join(ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, packed: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets reach the threshold.

    Texts travel compressed, each b once for each of its partners, next to a's text; an ``a`` with many partners is
    dealt over several salts.  A task reads its rows in order and holds one a at a time.
    """
    import zstandard

    many = pairs.groupBy("a").agg(F.count("*").alias("k")).filter(F.col("k") > SALT_PAIRS).select("a", F.ceil(F.col("k") / SALT_PAIRS).cast("int").alias("salts"))
    many = written_ids(many, "many")  # so that the join can deal the pairs of one root over tasks
    salted = pairs.join(broadcast_if_small(many, BROADCAST_ROWS), "a", "left")
    salted = salted.select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(1).alias("side"))
    roots = salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("id"), F.lit(0).alias("side"))
    need = salted.unionByName(roots)
    rows = need.join(packed, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        shingles = lambda z: shingle_set(d.decompress(z).decode("utf-8", "surrogatepass"), n_words)
        root, mine, last = None, [], 1  # more than one set if a doc_id is there with several texts
        for batch in batches:
            a, b = [], []
            for r, i, side, z in zip(*(batch.column(c).to_pylist() for c in range(4))):
                s = shingles(z)
                if side == 0:
                    mine = [*mine, s] if (root, last) == (r, 0) else [s]
                    root = r
                elif r == root and any(similar(m, s, threshold) for m in mine):
                    a.append(r)
                    b.append(i)
                last = side
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("a", "id", "side", "z").transform(arrow_map, run, "a long, b long")


def _block_groups(members: DataFrame, columns: list[str], weight, most: int) -> DataFrame:
    """``members`` (a, id, component, ...) dealt into groups (a, x, y, mine) of at most two blocks, in order.

    The largest component of ``a`` is dealt to blocks of about ``most`` of the weight, and so is all the rest; any two
    blocks of which one is of the rest are a group, and so is each block of the rest.  So every two members of different
    components meet, no task holds more than two blocks, and members of the largest component are sent once for each
    block of the rest.
    """
    sizes = members.groupBy("a", "component").agg(F.sum(weight).alias("w"), F.count("*").alias("k"))
    most_of = F.max(F.struct("k", "component", "w"))
    plan = sizes.groupBy("a").agg(most_of.alias("top"), F.sum("w").alias("all"))
    rest = F.col("all") - F.col("top.w")
    plan = plan.select("a", F.col("top.component").alias("top"), F.when(F.col("all") <= most, 0).otherwise(F.ceil(F.col("top.w") / most)).cast("int").alias("tops"), F.greatest(F.lit(1), F.ceil(rest / most)).cast("int").alias("rests"))
    plan = written_ids(plan, "plan")  # so that the join can deal the members of one root over tasks
    dealt = members.join(broadcast_if_small(plan, BROADCAST_ROWS), "a")
    of_top = (F.col("component") == F.col("top")) & (F.col("tops") > 0)
    h = F.xxhash64("id")
    dealt = dealt.withColumn("mine", F.when(of_top, F.pmod(h, F.greatest(F.col("tops"), F.lit(1)))).otherwise(F.col("tops") + F.pmod(h, F.col("rests"))).cast("int"))
    other = F.explode(F.sequence(F.when(of_top, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("rests") - 1)).alias("other")
    placed = dealt.select("a", "mine", other, *columns).select("a", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", *columns)
    return placed.repartition("a", "x", "y").sortWithinPartitions("a", "x", "y", "id")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(a, rows) of each group (a, x, y)."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[-1][:3] != row[:3]:
                yield group[0][0], group
                group = []
            group.append(row)
    if group:
        yield group[0][0], group


def _suspects(members: DataFrame, threshold: float) -> DataFrame:
    """The (a, id) that the registers let be similar to a member of ``a`` in another component.

    ``members``: a, id, n, component, registers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, group in _by_group(batches):
            block, ids, n, comp = (np.array([g[i] for g in group]) for i in (3, 4, 5, 6))
            regs = np.frombuffer(b"".join([g[7] for g in group]), "<u2").reshape(-1, REGISTERS)
            found = np.zeros(len(ids), bool)
            within = group[0][1] == group[0][2]
            for i in range(len(ids)):
                may = (comp[i + 1 :] != comp[i]) & (np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]) - 1e-9)
                if not within:
                    may &= block[i + 1 :] != block[i]
                j = np.flatnonzero(may) + i + 1
                if len(j):
                    j = j[estimate(regs[i], regs[j], n[i], n[j]) >= threshold - SLACK]
                if len(j):
                    found[i] = found[j] = True
            yield pa.RecordBatch.from_pydict({"a": np.full(int(found.sum()), a), "id": ids[found]})

    groups = _block_groups(members, ["id", "n", "component", "registers"], F.lit(1), BLOCK_ROWS)
    return groups.transform(arrow_map, run, "a long, id long").distinct()


def _links_across(members: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """(a, b) links on full sets between components, found by an inverted index of each group; not all, but as many as
    join the components.  ``members``: a, id, n, component, z (compressed text)."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for _, group in _by_group(batches):
            block, ids, comp = [g[3] for g in group], [g[4] for g in group], [g[5] for g in group]
            within = group[0][1] == group[0][2]
            sets = [shingle_set(d.decompress(g[6]).decode("utf-8", "surrogatepass"), n_words) for g in group]
            size = np.array([len(x) for x in sets])
            owner = np.repeat(np.arange(len(sets)), size)
            value, number = np.unique(np.concatenate(sets), return_inverse=True)
            order = np.argsort(number, kind="stable")
            owner, edge = owner[order], np.searchsorted(number[order], np.arange(len(value) + 1))
            own = np.split(number, np.cumsum(size)[:-1])
            joined = {c: c for c in comp}

            def of(c: int) -> int:
                while joined[c] != c:
                    c = joined[c]
                return c

            out: list[tuple[int, int]] = []
            for i in range(len(sets)):
                mine = of(comp[i])
                later = np.array([j > i and (within or block[j] != block[i]) and of(c) != mine for j, c in enumerate(comp)])
                if not later.any():
                    continue
                count = np.bincount(np.concatenate([owner[edge[k] : edge[k + 1]] for k in own[i].tolist()]), minlength=len(sets))
                near = np.flatnonzero(later & (100 * count >= round(100 * threshold) * (size[i] + size - count)))
                for j in near.tolist():
                    if of(comp[i]) != of(comp[j]):
                        joined[of(comp[i])] = of(comp[j])
                        out.append((ids[i], ids[j]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    groups = _block_groups(members, ["id", "component", "z"], 8 * F.col("n"), BLOCK_BYTES)
    return groups.transform(arrow_map, run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Words are lower-cased (A-Z).  A document without words, or with a null text, has no shingles and is its own
    component; one with fewer than ``n_words`` words has all of them as its one shingle.  Rows that repeat a doc_id
    are one document if their texts are equal; with different texts the id joins their components.  A null doc_id is
    linked with nothing and kept.  Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sk = written(sketches(docs, n_words), "sketches")
    real = sk.filter("n > 0 and doc_id is not null")
    # only sets that several rows have need looking up, from a table that a join can deal over many tasks
    keys = ["n", "s0", "s1"]
    shared = written(real.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.count("*").alias("k")).filter("k > 1").drop("k"), "classes")
    named = real.join(broadcast_if_small(shared, BROADCAST_ROWS), keys, "left").withColumn("id", F.coalesce("id", "doc_id"))
    same = written(named.filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")), "same")
    reps = written(named.filter("doc_id = id").dropDuplicates(["id", *keys]).select("id", "n", "registers"), "representatives")
    texts = docs.filter("doc_id is not null")

    bands = _bands(reps)
    roots = bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("k")).filter("k > 1").select("band", "a")
    roots = written(roots, "roots")
    members = written(bands.join(broadcast_if_small(roots, BROADCAST_ROWS), "band").select("a", "id").distinct(), "members")
    packed = written(_packed(texts, broadcast_if_small(members.select("id"), BROADCAST_ROWS)), "texts")
    starred = members.filter("id <> a").select("a", F.col("id").alias("b"))
    stars = written(_confirmed(written(_estimated(starred, reps, threshold), "candidates"), packed, n_words, threshold), "links")
    label = components(stars.union(same))

    # what is left: members of band values with one root, in different components
    listed = members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    listed = written(listed.select("a", "id", "component"), "listed")
    mixed = written_ids(listed.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("a"), "mixed")
    open_ = listed.join(broadcast_if_small(mixed, BROADCAST_ROWS), "a").join(reps, "id").select("a", "id", "n", "component", "registers")
    suspects = written(_suspects(open_, threshold), "suspects")
    full = suspects.join(listed, ["a", "id"]).join(reps.select("id", "n"), "id").join(packed, "id")
    more = _links_across(full.select("a", "id", "n", "component", "z"), n_words, threshold)
    # links between components join these
    named_by = lambda name: label.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
    more = written(more.join(named_by("a"), "a", "left").join(named_by("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), "links")
    found = sk.select("doc_id", "n").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    if not more.isEmpty():
        further = components(more).select(F.col("node").alias("component"), F.col("component").alias("further"))
        found = found.join(further, "component", "left").withColumn("component", F.coalesce("further", "component"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), "component")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the least id.

    All columns stay.  Of rows that repeat an id the one with the least hash of its text stays; rows without an id stay.
    """
    kept = near_duplicates(docs, key, text, n_words, threshold).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    chosen = docs.join(kept, docs[key].cast("long") == F.col("__kept"), "left_semi")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text)))
    return chosen.withColumn("__place", place).filter("__place = 1").drop("__place").union(docs.filter(F.col(key).isNull()))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``: 2-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=2)
