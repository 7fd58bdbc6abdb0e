"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

A document is its set of distinct word shingles.  Documents with the same set are one
class, and everything after works on classes.  The shingles of a class are dealt over
buckets; a bucket keeps the least hash as its count of leading zeros and ten bits of
mantissa.  Bands of six compressed registers are the candidate keys of sets of ``SMALL``
shingles and more, made per size class, and also for the next class where a set a fourth
larger would be in it.  There are as many bands as the largest number of differing shingles
and one more, up to ``BANDS``.  A similar pair misses all only if the bands without a
difference hold no shingle, or at ``BANDS`` if none is without a difference: a chance of
about 1e-8 (1e-5 at most, below 200 shingles).  Bands of smaller sets would often be empty;
their keys are the pairs of the first shingles in the order of the hashes, as many that two
similar sets always have a pair in common (a prefix filter).  Sets that may be similar to a
smaller one have both kinds.

In a key's bucket every member is compared with one leader, not with all.  Pairs first
pass a collision-corrected estimate that allows six deviations, then the
full sets are compared.  Members that share a component need no comparison any
more.  Large buckets that still hold several components are met with another leader; then
what is left is compared in blocks of bounded size, across components, by the registers of
65,536 buckets that are not empty, made from the texts once more.  Only pairs that may still
be similar are made, so no link that joins components is lost.  Shingles are compared as
64-bit hashes.

Defined results: null, empty and blank texts have the empty set and are linked with
nothing; fewer words than a shingle are one shingle.  Rows with the same set, repeated
rows among them, are of one component.  ``component_id`` is the least id reachable, null
ids being passed over unless there is no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiloom.llm.common import BLOOM, CLEAN, LOWER_BYTES, blocks, settings, stored, work_folder
from piiloom.llm.graph import components

BANDS = 60
ROWS = 6
REGISTERS = 256
EMPTY = np.uint16(0xFFFF)
#: Buckets with more members get another leader before their rest is compared in blocks.
LARGE = 16
#: Buckets of the registers that blocks are compared by, and how many registers a block has.
FINE = 1 << 16
BLOCK = 1 << 17
#: From so many registers on, the estimate narrows what the bound by lost shingles leaves.
_MANY = 4096
#: Blocks are compared in so many jobs, one after the other: the sets that are exchanged lie on disk for one of them.
JOBS = 2
#: Cells of a matrix made at a time.
_CELLS = 1 << 20
#: Size classes are three such steps wide; similar sets are at most one step apart.
_STEP = 1.2501
_WIDE = 3
#: Sets with fewer shingles have keys of pairs of shingles in place of bands.
SMALL = 32
#: From this size on, a band of one shingle is no key: bands enough are left, and a frequent
#: shingle alone would gather all texts that have it.
_LONE = 120
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has."""
    joined = b" ".join(texts) + b" "
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    data = np.frombuffer(joined.translate(LOWER_BYTES), dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    count = np.bincount(owner, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.uint64), count
    letters = data[inside].astype(np.uint64) + np.uint64(1)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(first, length)
    factor = _PLACE[place % len(_PLACE)]
    far = place >= len(_PLACE)
    if far.any():
        factor[far] = mix(place[far].astype(np.uint64)) | np.uint64(1)
    total = np.add.reduceat(mix(letters * np.uint64(0x9E3779B97F4A7C15)) * factor, first)
    return mix(total + length.astype(np.uint64)), count


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for first, last in blocks(texts, 1_000_000):
        hashes, count = word_hashes(texts[first:last])
        at = 0
        for n in count.tolist():
            h = hashes[at:at + n]
            at += n
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            width = min(n, words)
            total = np.full(n - width + 1, width, dtype=np.uint64)
            for k in range(width):
                total = mix(total * np.uint64(0xD6E8FEB86659FD93) + h[k:n - width + 1 + k])
            out.append(np.unique(total))
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and ten bits of mantissa of 64-bit values, in 16 bits."""
    fraction, power = np.frexp(least.astype(np.float64))
    packed = ((64 - power).astype(np.int64) << 10) | ((fraction - 0.5) * 2048).astype(np.int64)
    return packed.astype(np.uint16)


def registers(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The compressed least hash of each bucket."""
    value = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    least = np.full(buckets, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, (hashes % np.uint64(buckets)).astype(np.int64), value)
    return np.where(least == np.iinfo(np.uint64).max, EMPTY, compress(least))


def fine_registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of ``FINE`` buckets that are not empty: bucket and compressed hash in 32 bits.

    A set far smaller than ``FINE`` has hardly two shingles in one bucket, so nothing of it is lost.
    """
    place = hashes >> np.uint64(48)  # sorted, as the hashes are
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    least = np.minimum.reduceat(mix(hashes + np.uint64(0x9E3779B97F4A7C15)), first)
    return (place[first].astype(np.uint32) << np.uint32(16)) | compress(least)


def bands_of(level: int) -> int:
    """One band more than shingles may differ between similar sets of this level."""
    return min(BANDS, int(0.25 * _STEP ** (_WIDE * (level + 1))) + 1)


def pair_keys(hashes: np.ndarray, levels: range) -> list[np.ndarray]:
    """Candidate keys of a small set under its size levels: every pair of its first shingles.

    Sets at 80 per cent share four fifths of the larger one, so all but ``n // 5`` of the
    shingles of either.  The first two that they share, in the one order of the hashes, are
    then among the first ``n // 5 + 2`` of both.  One shingle alone is similar to itself only.
    """
    first = hashes[:len(hashes) // 5 + 2]  # sorted, as the hashes are
    i, j = np.triu_indices(len(first), 1) if len(first) > 1 else (np.zeros(1, int), np.zeros(1, int))
    both = mix(mix(first[i]) * np.uint64(0xD6E8FEB86659FD93) + first[j])
    salts = np.arange(levels.start + 2, levels.stop + 2, dtype=np.uint64) * np.uint64(64) + np.uint64(63)
    return [mix(both + salt) for salt in mix(salts * np.uint64(0x9E3779B97F4A7C15))]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Candidate keys of a set under its size level, and the next where sets a step larger are there.

    Bands without a shingle have none.
    """
    step = np.log(len(hashes)) / np.log(_STEP)
    levels = range(int(step // _WIDE), int((step + 1) // _WIDE) + 1)
    keys = pair_keys(hashes, levels) if 4 * len(hashes) < 5 * SMALL else []
    for level in levels if len(hashes) >= SMALL else ():
        n = bands_of(level)
        regs = registers(hashes, n * ROWS).reshape(n, ROWS)
        packed = np.zeros(n, dtype=np.uint64)
        for r in range(ROWS):
            packed = mix(packed * np.uint64(0xD6E8FEB86659FD93) + regs[:, r])
        salt = np.uint64((level + 2) * 64) + np.arange(n, dtype=np.uint64)
        least = 2 if len(hashes) >= _LONE else 1
        full = np.bincount((hashes % np.uint64(n * ROWS) // np.uint64(ROWS)).astype(np.int64),
                           minlength=n) >= least
        keys.append(mix(packed + mix(salt * np.uint64(0x9E3779B97F4A7C15)))[full])
    return np.concatenate(keys).view(np.int64)


def possible(same: np.ndarray, used: np.ndarray, total: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates less chance collisions, and whether the threshold is within reach.

    ``same``: equal registers of ``used``, those not empty in both; ``total``: the sizes of
    both sets together.  Unlike minima collide when leading zeros and ten mantissa bits
    agree: a third of the mass of one mantissa cell.  Six deviations are allowed, of a
    sample of ``used`` from a union of the size it has at the threshold; of small sets the
    registers hold nearly all.
    """
    chance, least = 1 / (3 * 1024), percent / 100
    found = (same / np.maximum(used, 1) - chance) / (1 - chance)
    unseen = np.clip(1 - used * (1 + least) / np.maximum(total, 1), 0, 1)
    margin = 6 * np.sqrt(least * (1 - least) / np.maximum(used, 1) * unseen) + 0.02
    return found, found >= least - margin


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_key, n, digest, regs, keys`` of each row; ``text_key`` hashes the text itself."""
    source = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"),
                         F.xxhash64("text").alias("text_key"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                sets = shingle_sets([x or b"" for x in part.column(1).to_pylist()], words)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]),
                    pa.array([registers(x, REGISTERS).tobytes() if len(x) else None for x in sets],
                             pa.binary()),
                    pa.array([band_keys(x) if len(x) else None for x in sets],
                             pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n", "digest", "regs", "keys"])

    return source.mapInArrow(
        run, f"doc_id {kind}, text_key bigint, n bigint, digest binary, regs binary, keys array<bigint>")


class Matcher:
    """Confirms candidate pairs of classes and keeps the components found so far."""

    def __init__(self, docs: DataFrame, rows: DataFrame, classes: DataFrame, folder: str, words: int,
                 percent: int):
        self.docs, self.rows, self.classes, self.folder = docs, rows, classes, folder
        self.words, self.percent, self.round = words, percent, 0

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs of fitting sizes whose registers make the similarity possible."""
        side = self.rows.select(F.col("row").alias("node"), "n", "regs")
        a = side.select(*[F.col(c).alias(f"{c}_a") for c in side.columns])
        b = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
        joined = (pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b"))
                  .where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
                  .select("a", "b", "regs_a", "regs_b", (F.col("n_a") + F.col("n_b")).alias("total")))
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16)
                               .reshape(batch.num_rows, REGISTERS) for c in (2, 3))
                used = ((left != EMPTY) | (right != EMPTY)).sum(axis=1)
                same = ((left == right) & (left != EMPTY)).sum(axis=1)
                _, good = possible(same, used, batch.column(4).to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

        return joined.mapInArrow(run, "a bigint, b bigint")

    def sets(self, nodes: DataFrame, folder: str, fine: bool = False) -> DataFrame:
        """``node, set`` of the classes ``nodes``, from the whole text of a row of each.

        ``set`` holds the shingle hashes, or with ``fine`` the registers made of them.
        """
        nodes = nodes.distinct().join(self.classes.select("node", "n", "digest", "doc_id"), "node")
        nodes = stored(nodes.select("node", "n", "digest", F.struct("doc_id").alias("id")),
                       f"{folder}/nodes").where("n > 0")
        texts = self.docs.select(
            F.struct("doc_id").alias("id"),
            F.col("text").cast("string").cast("binary").alias("text"))
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 500):
                    part = batch.slice(s, 500)
                    sets = shingle_sets([x or b"" for x in part.column(2).to_pylist()], words)
                    data = [x.tobytes() for x in sets]
                    # an id may stand for several texts: only the class's own will do
                    good = [hashlib.blake2b(x, digest_size=16).digest() == d
                            for x, d in zip(data, part.column(1).to_pylist(), strict=True)]
                    if fine:
                        data = [fine_registers(x).tobytes() if ok else None
                                for x, ok in zip(sets, good, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(data, pa.binary())], ["node", "set"]
                    ).filter(pa.array(good))

        with settings(self.docs.sparkSession, BLOOM):
            return stored(texts.join(nodes, "id").select("node", "digest", "text")
                          .mapInArrow(run, "node bigint, set binary")
                          .dropDuplicates(["node"]), f"{folder}/sets")

    def confirm(self, likely: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        self.round += 1
        folder = f"{self.folder}/round{self.round}"
        likely = stored(likely, f"{folder}/likely")
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("node")), folder)
        percent = self.percent
        both = (likely.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
                .select("a", "b", "set_a", "set_b"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return stored(both.mapInArrow(run, "a bigint, b bigint"), f"{folder}/links")


def shared_counts(value: np.ndarray, size: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of ``rows`` at a time, and how many values each of them shares with each set.

    ``value`` holds the sets one after the other, each without repeats.  The values that most
    sets have are counted by a product of matrices, the others by the lists of the sets that
    have them.
    """
    sets = len(size)
    owner = np.repeat(np.arange(sets), size)
    _, value, count = np.unique(value, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    again = count[value] > 1
    value, owner = rank[value[again]], owner[again]
    wide = min(max(1, _CELLS // sets), int((count > 1).sum()))
    common = value < wide
    dense = np.zeros((sets, wide), np.float32)
    dense[owner[common], value[common]] = 1
    value, owner = value[~common] - wide, owner[~common]
    begin = np.searchsorted(owner, np.arange(sets + 1))
    length = np.bincount(value)
    start, having = np.cumsum(length) - length, owner[np.argsort(value, kind="stable")]
    step = max(1, _CELLS // sets)
    for s in range(0, len(rows), step):
        part = rows[s:s + step]
        same = (dense[part] @ dense.T).astype(np.int64)
        for k, x in enumerate(part.tolist() if len(value) else ()):
            v = value[begin[x]:begin[x + 1]]
            lists = length[v]
            at = np.arange(lists.sum()) + np.repeat(start[v] - (np.cumsum(lists) - lists), lists)
            same[k] += np.bincount(having[at], minlength=sets)
        yield part, same


def used_by_either(value: np.ndarray, size: np.ndarray, row: int) -> np.ndarray:
    """Registers that the set ``row`` or each other uses; values have their register in the upper half."""
    place, first = value >> np.uint32(16), np.cumsum(size) - size
    taken = np.zeros(FINE, np.int64)
    taken[place[first[row]:first[row] + size[row]]] = 1
    return size[row] + size - np.add.reduceat(taken[place], first)


def deal_blocks(members: DataFrame) -> DataFrame:
    """The blocks in which each member of a bucket is met: ``key, i, j, mains, own, node, component, n``.

    ``members``: ``key, node, component, n``.  The largest component of a bucket is met by the
    other members only, and these by one another.  Both are dealt over blocks of about ``BLOCK``
    registers and a task holds two at a time, however large the bucket is.
    """
    held = F.sum(F.least("n", F.lit(FINE))).alias("held")
    parts = (members.groupBy("key", "component").agg(held).groupBy("key")
             .agg(F.max_by("component", F.struct("held", "component")).alias("main"),
                  F.max("held").alias("most"), F.sum("held").alias("all"))
             .select("key", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"),
                     F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("others")))
    other = F.col("component") != F.col("main")

    def task(i, j):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))

    def each(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    own = F.col("own")  # tasks i, j: others of block i; mains of block j, or from there on others
    tasks = F.when(~other, F.transform(each("others"), lambda i: task(i, own))).otherwise(F.concat(
        F.transform(each("mains"), lambda j: task(own, j)),
        F.transform(F.filter(each("others"), lambda o: o != own),
                    lambda o: task(F.least(o, own), F.col("mains") + F.greatest(o, own)))))
    return (members.join(parts.where("others > 0"), "key")
            .withColumn("own", F.pmod(F.xxhash64("node"), F.when(other, F.col("others")).otherwise(
                F.col("mains"))).cast("int"))
            .withColumn("task", F.explode(tasks))
            .select("key", "task.i", "task.j", "mains", F.when(other, own).otherwise(-1).alias("own"),
                    "node", "component", "n"))


def matches_in_blocks(dealt: DataFrame, sets: DataFrame, folder: str, percent: int,
                      best: int | None = None) -> DataFrame:
    """Pairs ``a, b`` of a bucket's members of other components that may be similar.

    ``dealt`` as `deal_blocks` gives it, stored; ``sets``: ``node, set``, the latter being fine registers,
    which come to the members when these are dealt.  A shingle that two sets share and their registers do not
    show is lost in one of them, which bounds what they share; large sets must pass the estimate as well.
    ``best``: of each of the others only so many pairs in a task, those that may share most.
    """
    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, component, n, own = (t.column(c).to_numpy() for c in ("node", "component", "n", "own"))
        i, j, mains = (t.column(c)[0].as_py() for c in ("i", "j", "mains"))
        rows = own == i if j >= mains else own >= 0
        wanted = ~rows
        sets = t.column("set").to_pylist()
        size = np.fromiter(map(len, sets), np.int64, len(sets)) // 4
        value, lost = np.frombuffer(b"".join(sets), np.uint32), n - size
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, same in shared_counts(value, size, np.flatnonzero(rows)):
            few, total = np.minimum(n[part, None], n), n[part, None] + n
            most = np.minimum(same + lost[part, None] + lost, few)
            good = (component[part, None] != component) & (100 * most >= percent * (total - most))
            if j == 0:
                good &= wanted | (best is not None) | (node > node[part, None])
            else:
                good &= wanted
            for k in np.flatnonzero((size[part] >= _MANY) & good.any(axis=1)).tolist():
                used = used_by_either(value, size, part[k])
                good[k] &= possible(same[k], used, total[k], percent)[1]
            if best is not None and len(node) > best:
                guess = np.where(good, most / (total - most), -1.0)
                top = np.argpartition(-guess, best, axis=1)[:, :best]
                kept = np.zeros_like(good)
                np.put_along_axis(kept, top, True, axis=1)
                good &= kept
            x, y = np.nonzero(good)
            left.append(node[part[x]])
            right.append(node[y])
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(t: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            made = [pairs(t.slice(s, e - s)) for s, e in zip(edges[:-1], edges[1:], strict=True)
                    if e - s > 1]
            a, b = (np.concatenate(v) for v in zip(*made, strict=True)) if made else ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            group = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.zeros(t.num_rows, dtype=bool)
            new[0] = True
            for g in group:
                new[1:] |= g[1:] != g[:-1]
            starts = np.flatnonzero(new)
            yield done(t, starts)
            rest = t.slice(int(starts[-1]))
        if rest is not None:
            yield done(rest, np.array([0, rest.num_rows]))

    job = F.pmod(F.xxhash64("key", "i", "j"), F.lit(JOBS))
    made = [stored(dealt.where(job == k).join(sets, "node")
                   .select("key", "i", "j", "mains", "own", "node", "component", "n", "set")
                   .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                   .mapInArrow(run, "a bigint, b bigint"), f"{folder}/job{k}") for k in range(JOBS)]
    return reduce(DataFrame.unionByName, made)


def link_classes(docs: DataFrame, rows: DataFrame, classes: DataFrame, folder: str, words: int,
                 percent: int) -> DataFrame:
    """``node, component`` of all classes that are linked with another; ``rows`` have their registers and keys."""
    matcher = Matcher(docs, rows, classes, folder, words, percent)
    keyed = (rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
             .select(F.col("row").alias("node"), F.explode("keys").alias("key")))
    groups = (keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size"))
              .where("size > 1"))
    bucket = stored(keyed.join(groups, "key"), f"{folder}/buckets")
    links = matcher.confirm(matcher.likely(bucket.where("node <> leader").select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct()))

    def still_mixed(bucket: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """Members of the buckets that hold several components, with another leader."""
        named = stored(bucket.join(found, "node", "left").select(
            "key", "node", "size", F.coalesce("component", "node").alias("component")),
            f"{folder}/named-{name}")
        mixed = (named.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.min_by(F.struct("node", "component"), F.xxhash64("node", "key")).alias("leader"))
            .where("low <> high").select("key", "leader"))
        return stored(named.join(mixed, "key"), f"{folder}/mixed-{name}")

    found = components(links, f"{folder}/graph-first")
    bucket = still_mixed(bucket.where("size > 2"), found, "first")
    led = bucket.where((F.col("size") > LARGE) & (F.col("leader.component") != F.col("component")))
    more = matcher.confirm(matcher.likely(led.select(
        F.least("leader.node", "node").alias("a"), F.greatest("leader.node", "node").alias("b")).distinct()))
    links = links.unionByName(more)
    found = components(links, f"{folder}/graph-second")
    bucket = still_mixed(bucket.select("key", "node", "size"), found, "second")

    fine = matcher.sets(bucket.select("node"), f"{folder}/fine", fine=True)

    def in_blocks(bucket: DataFrame, best: int | None) -> DataFrame:
        members = bucket.select("key", "node", "component").join(classes.select("node", "n"), "node")
        blocks = f"{folder}/blocks-{best or 'all'}"
        dealt = stored(deal_blocks(members), f"{blocks}/dealt")
        return matcher.confirm(matches_in_blocks(dealt, fine, blocks, percent, best).distinct())

    # the likeliest links of each member first: most components close, and few pairs are left to all
    links = links.unionByName(in_blocks(bucket, 2))
    bucket = still_mixed(bucket.select("key", "node", "size"),
                         components(links, f"{folder}/graph-third"), "third")
    links = links.unionByName(in_blocks(bucket, None))
    return components(links, f"{folder}/graph")


def find_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Every row: ``doc_id, row, text_key, n_shingles, class_id, component_id, kept``.

    ``class_id`` names the set of shingles; of each component the rows with its least
    id are kept, and of these only one.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "neardup")
    docs = docs.select("doc_id", "text")
    with settings(spark, CLEAN):
        rows = stored(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()),
                      f"{folder}/signatures")
        classes = stored(
            rows.where("n > 0").groupBy("digest").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"),
                F.first("n").alias("n"))
            .select("digest", "n", F.col("least.row").alias("node"), F.col("least.doc_id").alias("doc_id")),
            f"{folder}/classes")
        linked = link_classes(docs, rows, classes, folder, words, percent)
        named = (classes.select("digest", "node", "doc_id").join(linked, "node", "left")
                 .withColumn("component", F.coalesce("component", "node")))
        least = named.groupBy("component").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
        named = stored(named.join(least, "component").select(
            "digest", F.col("node").alias("class_id"), F.col("first.doc_id").alias("component_id"),
            F.col("first.node").alias("first")), f"{folder}/components")
    alone = rows.where("n = 0").select(
        "doc_id", "row", "text_key", F.col("n").alias("n_shingles"), F.col("row").alias("class_id"),
        F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return (rows.where("n > 0").select("doc_id", "row", "text_key", "digest", F.col("n").alias("n_shingles"))
            .join(named, "digest")
            .select("doc_id", "row", "text_key", "n_shingles", "class_id", "component_id",
                    (F.col("row") == F.col("first")).alias("kept"))
            .unionByName(alone))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the one with its least id."""
    folder = work_folder(docs.sparkSession, "neardup-kept")

    def key(text_key):
        return F.struct(F.col("doc_id").alias("id"), text_key.alias("text")).alias("_key")

    kept = stored(find_near_copies(docs, words, percent).where("kept").select(key(F.col("text_key"))),
                  f"{folder}/kept")
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    rows = docs.select(key(F.xxhash64("text")),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return (rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"])
            .select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]))
