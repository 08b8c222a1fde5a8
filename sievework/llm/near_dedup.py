"""MinHash near-duplicate detection with HyperMinHash sketches.

1. A pass over the texts makes each document's set of word shingles (64-bit hashes), a 128-bit digest of the set and a
   HyperMinHash sketch: 512 buckets, in each the smallest hash as leading-zero count (4 bits) and mantissa (4 bits) in
   one byte. Empty buckets borrow from a nonempty one chosen by rendezvous hashing, so that sparse sketches keep the
   collision probability of full ones.
2. Documents with the same set fall to one representative, the smallest id; only representatives go on.
3. The compressed registers are banded (64 bands of 8): at a similarity of 0.8 a pair misses all bands with a
   probability of 8e-6, at 0.2 it meets in one with 2e-4.
4. In each band bucket the smallest id is paired with all others, never all pairs. Pairs pass the collision-corrected
   Jaccard estimate (with a margin of six standard errors, so that it drops no link), then the full sets decide.
5. Components come from large-star / small-star rounds. Buckets of one component need no more. Of the others, documents
   leave whose shingles occur too rarely in other components to make a link. Those left, cut into blocks of bounded
   size, are held against all members of other components, and only pairs that may be links leave their group: the
   exact way for the rest.

A hot bucket costs one pair a member. Keys that hold many rows (hubs, hot buckets, frequent shingles) are counted first
and joined by a broadcast of bounded size or salted; only ids, sketches of candidates and the texts of candidate pairs move.

Defined results: null and empty texts have the empty set and stand alone; with fewer words than a shingle the whole
sequence is the one shingle; a null doc_id stands alone with a null component; rows with the same doc_id are one
document (their sets are linked through it) and stay or go together, but for repeats of one text; a doc_id that is no integer is refused
by Spark's cast; an empty table gives an empty result; other columns are ignored. A very long text costs time and
memory in proportion to its words, for each pair that it is verified in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, durable, durable_path, hot_join, maybe_broadcast, salt_hot
from ._words import SPACES, chunks, mix, run_hashes

BUCKETS, ROWS = 512, 8
BANDS = BUCKETS // ROWS
#: Rows of a bucket that one block takes; columns of one slice of an incidence matrix.
BLOCK, SLICE = 256, 8192
_LZ_BITS = 4
_MANTISSA = 4
SKETCH_SCHEMA = "id bigint, n bigint, set_hi bigint, set_lo bigint, registers binary"

_state: dict[str, np.ndarray] = {}


def _borrow_table() -> np.ndarray:
    """Rendezvous weights: an empty bucket i borrows from the nonempty bucket j with the least weight [i, j]."""
    if "borrow" not in _state:
        i = np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)
        _state["borrow"] = (mix(i) >> np.uint64(32)).astype(np.uint32).reshape(BUCKETS, BUCKETS)
    return _state["borrow"]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text, A-Z lower-cased."""
    for c in chunks(texts, SPACES, lower=True):
        h, at = c.hashes, c.at
        starts, hashed = c.windows(size)
        first = np.searchsorted(starts, at)
        for i in range(c.n):
            n = at[i + 1] - at[i]
            if n == 0:
                yield c.lo + i, h[:0]
            elif n < size:
                yield c.lo + i, run_hashes(h, at[i : i + 1], at[i + 1 : i + 2])
            else:
                yield c.lo + i, np.unique(hashed[first[i] : first[i + 1]])


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (uint8) of a sorted, nonempty set."""
    h = mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))
    h.sort()
    bucket = (h >> np.uint64(55)).astype(np.int64)
    keep = np.ones(len(h), bool)
    keep[1:] = bucket[1:] != bucket[:-1]
    bucket, rest = bucket[keep], h[keep] & np.uint64((1 << 55) - 1)
    top = (rest >> np.uint64(5)).astype(np.float64)  # 50 bits, exact in a double
    exponent = np.frexp(top)[1]
    zeros = np.clip(50 - exponent, 0, (1 << _LZ_BITS) - 1)
    shift = np.clip(55 - (50 - exponent) - 1 - _MANTISSA, 0, 63).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << _MANTISSA) - 1)
    out = np.zeros(BUCKETS, np.uint8)
    out[bucket] = (zeros.astype(np.uint8) << _MANTISSA) | mantissa.astype(np.uint8)
    if len(bucket) < BUCKETS:
        empty = np.ones(BUCKETS, bool)
        empty[bucket] = False
        table = _borrow_table()[empty][:, bucket]
        out[empty] = out[bucket[table.argmin(axis=1)]]
    return out


#: Probability that the registers of two independent minima are equal: zeros j with 2**-(j+1), mantissas uniform.
COLLISION = (sum(4.0 ** -(j + 1) for j in range(15)) + 4.0**-15) / (1 << _MANTISSA)


def least_estimate(threshold: int, smaller: np.ndarray) -> np.ndarray:
    """The estimate below which a pair whose smaller set has so many shingles is ruled out: the threshold less six
    standard errors. A set of n shingles fills about m (1 - exp(-n / m)) of the m registers; the others are borrowed
    and say nothing new, and which ones two sets borrow varies as well, so that the variance is that of half as many."""
    t = threshold / 100.0
    own = BUCKETS * (1 - np.exp(-np.asarray(smaller, float) / BUCKETS))
    filled = np.where(own > 0.9 * BUCKETS, own, own / 2)
    return t - 6.0 * np.sqrt(t * (1 - t) / np.maximum(filled, 1e-9)) / (1 - COLLISION)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate from the share of equal registers, less the collisions that chance alone gives."""
    equal = float(np.count_nonzero(a == b)) / BUCKETS
    return max(0.0, (equal - COLLISION) / (1.0 - COLLISION))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, s in shingle_sets(batch.column("text"), size):
                digest = [int(x) for x in (np.bitwise_xor.reduce(mix(s)), np.sum(mix(s ^ np.uint64(0xA24BAED4963EE407))))] if len(s) else [0, 0]
                out[0].append(i)
                out[1].append(len(s))
                out[2].append(digest[0] - (1 << 64) * (digest[0] >> 63))
                out[3].append(digest[1] - (1 << 64) * (digest[1] >> 63))
                out[4].append(registers(s).tobytes() if len(s) else None)
            ids = batch.column("id").take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in out[1:4]], pa.array(out[4], pa.binary())], ["id", "n", "set_hi", "set_lo", "registers"])

    return run


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sketches(size), SKETCH_SCHEMA)


def _verify(size: int, threshold: int):
    """Keeps the pairs whose sets share at least ``threshold`` per cent of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            keep, right = [], dict(shingle_sets(batch.column("text_b"), size))
            left_texts = batch.column("text_a").to_pylist()
            for i, t in enumerate(left_texts):
                if t != last[0]:
                    last = (t, next(shingle_sets(pa.array([t], pa.string()), size))[1])
                a, b = last[1], right[i]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= threshold * (len(a) + len(b) - shared))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], ["a", "b"])

    return run


def _estimated(threshold: int):
    """Drops the pairs that sizes or sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            ok = 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
            ra, rb = batch.column("r_a").to_pylist(), batch.column("r_b").to_pylist()
            least = least_estimate(threshold, np.minimum(na, nb))
            for i in np.flatnonzero(ok & (least > 0)):
                ok[i] = estimate(np.frombuffer(ra[i], np.uint8), np.frombuffer(rb[i], np.uint8)) >= least[i]
            chosen = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], ["a", "b"])

    return run


def confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, threshold: int, repeated: bool) -> DataFrame:
    """The pairs (a, b) that are links: sketches first, then full sets from the texts. ``repeated``: some id has
    several rows; then a pair is a link if any two of their texts are."""
    s = sketches.select("id", "n", "registers")
    side = lambda x: s.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    degree = durable(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "near-degree")
    tagged, spread = salt_hot(pairs, degree, "a", F.col("b"))
    likely = tagged.join(side("b"), "b").join(spread(side("a")), ["a", "_salt"]).select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_estimated(threshold), "a bigint, b bigint")
    return verify(likely.distinct() if repeated else likely, texts, size, threshold, repeated)


def verify(pairs: DataFrame, texts: DataFrame, size: int, threshold: int, repeated: bool) -> DataFrame:
    """The pairs (a, b) that are links by the full sets of their texts."""
    likely = durable(pairs, "near-likely")
    one = texts_of(likely.select(F.explode(F.array("a", "b")).alias("id")), texts)
    if repeated:
        one = one.distinct()
    degree = durable(likely.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "near-degree")
    tagged, spread = salt_hot(likely, degree, "a", F.col("b"))
    first = one.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = tagged.join(one.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(spread(first), ["a", "_salt"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, threshold), "a bigint, b bigint")


def texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (id, text) of some ids."""
    wanted = durable(ids.distinct(), "near-wanted")
    return texts.select("id", "text").join(maybe_broadcast(wanted, 500_000), "id", "left_semi")


def _signatures(size: int, small: int):
    """(id, n, digest, shingles, hashes, registers) of each text: the set, up to ``small`` shingles their hashes cut to
    32 bits, registers from 256 shingles on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ns, digests, sets, hashes, regs = [], [], [], [], [], []
            for i, s in shingle_sets(batch.column("text"), size):
                rows.append(i)
                ns.append(len(s))
                digests.append(np.bitwise_xor.reduce(mix(s)) if len(s) else np.uint64(0))
                sets.append(s.view(np.int64))
                hashes.append((s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() if len(s) <= small else None)
                regs.append(registers(s).tobytes() if len(s) >= BUCKETS // 2 else None)
            ids = batch.column("id").take(pa.array(rows, pa.int64()))
            ends = np.concatenate([[0], np.cumsum(ns)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            digest = pa.array(np.array(digests, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), digest, shingles, pa.array(hashes, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "shingles", "hashes", "registers"])

    return run


SIGNATURE_SCHEMA = "id bigint, n bigint, digest bigint, shingles array<bigint>, hashes binary, registers binary"


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets at ``left`` with those at ``right``, by products of slices of the incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint32), return_inverse=True, return_counts=True)
    owner, token = owner[count[token] > 1], token[count[token] > 1]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, SLICE):
        f, t = np.searchsorted(token, [lo, lo + SLICE])
        m = np.zeros((len(sets), min(SLICE, int(token[-1]) + 1 - lo)), np.float32)
        m[owner[f:t], token[f:t] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _block_pairs(threshold: int, small: int):
    """The pairs of one (key, p, q) whose rows lie in different components and whose sizes and signatures allow a
    link. Rows come sorted by (key, p, q); a group has about two blocks of rows, whatever the bucket's size."""

    def pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, comp, n, at = (rows.column(c).to_numpy() for c in ("b", "c", "n", "at"))
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        left, right = np.flatnonzero(at == p), np.flatnonzero(at == q)
        nl, nr = n[left][:, None], n[right][None, :]
        ok = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(nl, nr) >= threshold * np.maximum(nl, nr))
        if p == q:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        both = (nl <= small) & (nr <= small)
        if (ok & both).any():
            sets = [np.frombuffer(x, np.uint32) if x is not None else np.zeros(0, np.uint32) for x in rows.column("hashes").to_pylist()]
            # one more than counted: two hashes of a set may agree in 32 bits; the full sets decide later
            shared = _shared(sets, left, right) + 1
            ok &= ~both | (100 * shared >= threshold * (nl + nr - shared))
        if (ok & ~both).any():
            regs = [np.frombuffer(x, np.uint8) if x is not None else np.zeros(BUCKETS, np.uint8) for x in rows.column("registers").to_pylist()]
            table = np.stack([regs[i] for i in right])
            for i in np.flatnonzero((ok & ~both).any(axis=1)):
                equal = np.count_nonzero(table == regs[left[i]], axis=1) / BUCKETS
                ok[i] &= both[i] | ((equal - COLLISION) / (1.0 - COLLISION) >= least_estimate(threshold, np.minimum(nl[i], nr[0])))
        x, y = np.nonzero(ok)
        return ids[left[x]], ids[right[y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            each = [pairs(rows.slice(f, e - f)) for f, e in zip(cuts[:-1], cuts[1:], strict=True)]
            x, y = (np.concatenate([np.zeros(0, np.int64), *[e[k] for e in each]]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if kept is None else pa.concat_tables([kept, rows])).combine_chunks()
            if not len(rows):
                continue
            key, p, q = (rows.column(c).to_numpy() for c in ("key", "p", "q"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            if len(cuts):
                yield found(rows, np.concatenate([[0], cuts]))
            kept = rows.slice(int(cuts[-1]) if len(cuts) else 0)
        if kept is not None and len(kept):
            yield found(kept, np.array([0, len(kept)]))

    return run


def able_to_link(docs: DataFrame, signatures: DataFrame, threshold: int) -> DataFrame:
    """Of documents (b, c) the b that may have a link to another component c: at least ``threshold`` per cent of the
    shingles occur in another component as well. Fewer can't make up that share of any union, so no link is lost."""
    each = signatures.join(docs, F.col("id") == F.col("b")).select("b", "c", "n", "digest", F.explode("shingles").alias("shingle"))
    spanning = each.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo <> hi").select("shingle", "_n")
    met = hot_join(each, durable(spanning, "near-spanning"), ["shingle"]).groupBy("b", "n", "digest").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.lit(100) * F.col("met") >= F.lit(threshold) * F.col("n")).select("b").distinct()


def cross_pairs(members: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Of (key, b, c): likely pairs (a, b) of rows that share a key and not the component c.
    Documents that can link to no other component leave first. A bucket's largest component (major) is never held
    against itself: its rows and the others (minor) are cut into hashed blocks of about ``BLOCK`` rows, each minor block
    meets each block of its bucket in one group of bounded size, and only pairs that pass the signatures leave it."""
    small = -(-100 * (BUCKETS // 2) // max(1, threshold))
    docs = durable(members.select("b", "c").distinct(), "near-docs")
    sig = durable(texts_of(docs.select(F.col("b").alias("id")), texts).mapInArrow(_signatures(size, small), SIGNATURE_SCHEMA), "near-signatures")
    able = durable(able_to_link(docs, sig, threshold), "near-able")
    left = durable(members.join(maybe_broadcast(able, 500_000), "b", "left_semi").select("key", "b", "c"), "near-left")
    per = left.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    tops = per.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m")).where("m > top.k")
    cuts = lambda rows: F.ceil(rows / F.lit(BLOCK)).cast("int")
    tops = tops.select("key", F.col("m").alias("_n"), F.col("top.c").alias("major"), cuts(F.col("top.k")).alias("n_major"), cuts(F.col("m") - F.col("top.k")).alias("n_minor"))
    is_major, place = F.col("c") == F.col("major"), F.xxhash64("b", F.lit(7))
    at = F.when(is_major, F.col("n_minor") + F.pmod(place, F.col("n_major"))).otherwise(F.pmod(place, F.col("n_minor"))).cast("int")
    others = F.when(is_major, F.col("n_minor")).otherwise(F.col("n_minor") + F.col("n_major"))
    met = hot_join(left, durable(tops, "near-tops"), ["key"]).select("key", "b", "c", at.alias("at"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    met = met.select("key", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), "at", "b", "c")
    rows = met.join(sig.drop("digest", "shingles"), met["b"] == sig["id"]).drop("id")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return rows.mapInArrow(_block_pairs(threshold, small), "a bigint, b bigint").distinct()


def is_settled(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v has an edge of its own: then each v is its component's smallest id."""
    end = lambda c, out: F.struct(F.col(c).alias("id"), F.lit(out).alias("out"), F.lit(1 - out).alias("hit"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).where("out > 1 OR (out > 0 AND hit > 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge, by alternating large-star and small-star
    steps on tables in the shared folder. A step hooks all neighbours of an id to the smallest one; its minimum is a
    pre-aggregated sum-like aggregate, so hubs don't gather."""
    spark = edges.sparkSession
    at, now = None, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    for _ in range(max_rounds):
        for large in (True, False):
            least_at = durable_path(spark, "near-least")
            if large:
                both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
                least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")), path=least_at)
                step = hot_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                least = durable(now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), path=least_at)
                step = hot_join(now, least, ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
            new_at = durable_path(spark, "near-edges")
            now = durable(step.where("u <> v").distinct(), path=new_at)
            discard(spark, least_at)
            if at:
                discard(spark, at)
            at = new_at
        if is_settled(now):
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = durable(sketch(docs, id_col, text_col, size), "near-sketch")
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    repeated = not filled.groupBy("id").count().where("count > 1").isEmpty()
    digest = ["set_hi", "set_lo", "n"]
    # rows of one set have one sketch, so any of them gives it: no join back to the sketches
    sets = filled.groupBy(*digest).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n"), F.first("registers").alias("registers"))
    sets = durable(sets, "near-sets")
    # every row of a class hangs on its representative; classes of one row need no link
    classes = durable(sets.where("_n > 1").select(*digest, "rep", "_n"), "near-classes")
    copies = hot_join(filled.select("id", *digest), classes, digest).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    reps = durable(sets.select(F.col("rep").alias("id"), "n", "registers"), "near-reps")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * ROWS + 1, F.lit(ROWS))))).alias("key")
    members = reps.select("id", band)
    buckets = members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("_n")).where("a <> z").select("key", "a", "_n")
    shared = durable(hot_join(members, durable(buckets, "near-keys"), ["key"]).select("key", "a", F.col("id").alias("b")), "near-buckets")
    pairs = durable(shared.where("a <> b").select("a", "b").distinct(), "near-pairs")
    links = confirm(pairs, reps, texts, size, threshold, repeated)
    edges = durable(copies.unionByName(links), "near-links")
    parts = durable(components(edges), "near-parts")
    # the rest: buckets whose members are in several components; pairs with the smallest id are settled already
    tagged = shared.join(parts.select(F.col("id").alias("b"), F.col("component")), "b", "left").select("key", "a", "b", F.coalesce("component", "b").alias("c"))
    several = tagged.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo <> hi AND _n > 2").select("key", "_n")
    open_ = durable(hot_join(tagged.where("a <> b"), durable(several, "near-several"), ["key"]).select("key", "b", "c"), "near-open")
    if not open_.isEmpty():
        rest = cross_pairs(open_, texts, size, threshold).join(pairs, ["a", "b"], "left_anti")
        more = durable(verify(rest, texts, size, threshold, repeated), "near-links")
        if not more.isEmpty():
            known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
            parts = durable(components(known.unionByName(more)), "near-parts")
    parts = parts.withColumnRenamed("id", "_part")
    out = sketches.select("id", "n").join(parts, F.col("id") == F.col("_part"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """The document of each group with the smallest id; the columns of ``docs`` unchanged. Rows with one doc_id stay or
    go together, since they may hold different texts; of those that also share their text one stays."""
    judged = durable(near_duplicates(docs, id_col, text_col, size, threshold).select("doc_id", "kept"), "near-kept")
    gone = durable(judged.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    out = docs.join(maybe_broadcast(gone, 1_000_000), F.col(id_col).cast("long") == F.col("_gone"), "left_anti").select(*docs.columns)
    if judged.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionByName(out.where(F.col(id_col).isNull()))
