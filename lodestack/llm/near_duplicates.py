"""Near-duplicate records: byte-position inverted index with count filtering.

A record's set of word shingles is read as a sparse byte string: the 42-bit hash of a shingle
names a byte position (its upper 34 bits) and the byte that stands there (its lower 8 bits).
Two records share a positional byte when both have the same byte at the same position, so the
number of shared positional bytes is the size of the intersection of the shingle sets.

For sets of sizes a >= b a similarity (intersection by union) of t needs at least
``m = ceil(t / (1 + t) * (a + b))`` shared positional bytes.  With all positions in one global
order, rare ones first, the first ``a - m + l`` of one and ``b - m + l`` of the other share at
least ``l``; only those prefixes are posted in the index, the shared ones are tallied for each
pair, and pairs short of ``l`` are discarded.  What is left is verified on the whole sets.
No pair at or above the threshold is lost, whatever the order; the order only decides how many
postings meet.  It comes from counts of all positions in a sketch of bounded size.  The meetings of a
position that very many records hold are spread over pairs of groups of these records.

Meetings grow faster than the input.  They are packed before they move, and where there are more than
the disk should hold, they are tallied in passes over the same index, each for a share of the records.

Records with equal sets (copies) are one class everywhere: a class is posted and verified once.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import words
from lodestack.session import cut, keep, release, sweep

ID_BITS, OWNER_BITS, RANK_BITS = 42, 14, 8
LEAST_SKETCH, MOST_SKETCH, CHUNKS = 18, 24, 32  # bits of the sketch, by the size of the input; pieces it is merged in
LEAST_BLOOM, MOST_BLOOM = 18, 27  # bits of the filter of candidate classes, by their number
SHORT_BITS = 32  # of a class's signature, by which the index knows it
LEAST = 8  # shared positional bytes a pair needs inside the posted prefixes
FLUSH, MOST_FLUSH = 1 << 20, 1 << 23  # postings a task gathers before it sends them on
BUCKET = 1 << 19  # postings a bucket of the index is planned for
PARTITIONS = 1 << 14  # of the index at most; a partition then takes its buckets one after the other
HOT = 4096  # records with one positional byte above which its meetings are spread over tasks
MOST_GROUPS = 64  # groups the records of one positional byte are split into
SEEN = 1 << 20  # classes a task remembers having sent
MET = 1 << 21  # meetings a task gathers before it sends them on, and a task of the tally is planned for
PASS, SHARE = 1 << 25, 3  # meetings tallied in one pass: so many, or one for so many postings if that is more
MOST_PARITIES = 1 << 16  # bits a set is compared by before it is compared whole
SAMPLE = 16  # of so many parts of the index one is looked at to plan the passes


def _ids(texts: list[str], parts: list[str], n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle ids of a batch and the index of their text, with repeats; texts under min_words have none."""
    hashes, owner, _ = words.scan([t.lower() for t in texts])
    enough = np.bincount(owner, minlength=len(texts)) >= max(min_words, n)
    g, og = words.shingles(hashes, owner, n)
    keep = enough[og]
    g, og = g[keep], og[keep]
    seeds = {p: words.mix(np.array([sum((ord(c) + 1) * 31**i for i, c in enumerate(p)) % 2**63], np.uint64))[0] for p in set(parts)}
    if len(seeds) > 1:
        g = words.mix(g ^ np.array([seeds[p] for p in parts], np.uint64)[og])
    elif seeds:
        g = words.mix(g ^ next(iter(seeds.values())))
    return g >> np.uint64(64 - ID_BITS), og


def _sets(pdf: pd.DataFrame, n: int, min_words: int, ranks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch: (row index, rank, id) of the distinct positional bytes, in the index's order."""
    for at, end in words.slices(pdf["text"].tolist(), rows=1 << OWNER_BITS):
        piece = pdf.iloc[at:end]
        ids, owner = _ids(piece["text"].tolist(), piece["part"].tolist(), n, min_words)
        rank = ranks[_slot(ids, len(ranks))].astype(np.uint64) if ranks is not None else np.uint64(0)
        packed = (owner.astype(np.uint64) << np.uint64(ID_BITS + RANK_BITS)) | (rank << np.uint64(ID_BITS)) | ids
        packed.sort()
        if len(packed):
            packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
        yield (
            at + (packed >> np.uint64(ID_BITS + RANK_BITS)).astype(np.int64),
            ((packed >> np.uint64(ID_BITS)) & np.uint64(2**RANK_BITS - 1)).astype(np.uint8),
            packed & np.uint64(2**ID_BITS - 1),
        )


def _slot(ids: np.ndarray, size: int) -> np.ndarray:
    """Place of each id in a sketch of this size."""
    return (ids >> np.uint64(ID_BITS - size.bit_length() + 1)).astype(np.int64)


def _press(*columns: np.ndarray) -> bytes:
    """Columns packed by the place of their bytes, so that high bytes, mostly zero, cost nothing."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns), 1)


def _column(raw: bytes, place: int, width: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers of so many bytes from a packed column, and where the next one begins."""
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, width * n, place).reshape(width, n).T
    return wide.view("<u8").ravel(), place + width * n


def _short(signature: np.ndarray) -> np.ndarray:
    """The first bits of signatures, the names of classes in the index.

    Classes of one name share its candidates; each is verified by itself.  Only two similar classes that have one
    name, one size and the same places are taken for one, with a chance below 2^-SHORT_BITS for a pair.
    """
    return signature >> np.uint64(64 - SHORT_BITS)


def _signatures(owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, size, signature) of each record's set; equal sets have equal signatures."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(owner)))
    if not len(first):
        return owner, first, size, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        signature = words.mix(np.add.reduceat(words.mix(ids + np.uint64(1)), first) + size.astype(np.uint64))
    return owner[first], first, size, signature


def _estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _sketch(records: DataFrame, n: int, min_words: int) -> tuple[np.ndarray, int]:
    """Rank of each sketch bucket (0: held by one record only) and the number of all postings.

    The sketch has a place for 32 bytes of the input, as far as it may grow; a full one
    tells only the positions far above the mean from the rest, which costs meetings, no pair.
    """
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, math.ceil(math.log2(_estimated_bytes(records) / 32 + 1))))
    step = (1 << bits) // CHUNKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.uint32)
        for pdf in batches:
            for _, _, ids in _sets(pdf, n, min_words):
                if len(total) <= 16 * len(ids):
                    total += np.bincount(_slot(ids, len(total)), minlength=len(total)).astype(np.uint32)
                else:
                    places, times = np.unique(_slot(ids, len(total)), return_counts=True)
                    total[places] += times.astype(np.uint32)
        if total.any():
            for k in range(CHUNKS):
                chunk = total[k * step : (k + 1) * step]
                yield pd.DataFrame({"chunk": [k], "total": [int(chunk.sum(dtype=np.int64))], "counts": [zstandard.compress(chunk.astype("<u4").tobytes(), 1)]})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, total = np.zeros(step, np.int64), 0
        for pdf in parts:
            for b in pdf["counts"]:
                counts += np.frombuffer(zstandard.decompress(b), "<u4")
            total += int(pdf["total"].sum())
        ranks = np.where(counts < 2, 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 1) / 2)))).astype(np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "total": [total], "ranks": [ranks.tobytes()]})

    rows = records.mapInPandas(count, "chunk int, total long, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, total long, ranks binary").collect()
    ranks = np.zeros(1 << bits, np.uint8)
    for row in rows:  # at most CHUNKS rows, one byte a place
        ranks[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.ranks, np.uint8)
    return ranks, sum(row.total for row in rows)


def _groups(rank: np.ndarray) -> np.ndarray:
    """Groups the records of a positional byte are split into, by how many its place in the sketch has."""
    about = 2.0 ** (1 + (rank.astype(np.float64) - 1) / 8)
    return np.where(rank > 0, np.clip(np.ceil(about / HOT), 1, MOST_GROUPS), 1).astype(np.int64)


def _spread(ids: np.ndarray, sig: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the posting, id, side) with the postings of hot positional bytes once for each pair of groups they take part in.

    The records of a hot byte fall into g groups by their signature; each pair of groups is a cell with an
    id of its own, so that its meetings go to a bucket of their own.  In a cell of two groups only postings of
    different sides (0, 1) meet, in a cell of one group (side 2) all do: every two records meet in one cell.
    """
    groups = _groups(rank)
    at = np.repeat(np.arange(len(ids)), groups)
    g = groups[at]
    other = np.arange(len(at)) - np.repeat(np.cumsum(groups) - groups, groups)
    own = (words.mix(sig[at] ^ np.uint64(0x5BD1)) % g.astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(own, other), np.maximum(own, other)
    cell = words.mix(ids[at] ^ words.mix((low * MOST_GROUPS + high + 1).astype(np.uint64))) >> np.uint64(64 - ID_BITS)
    return at, np.where(g > 1, cell, ids[at]), np.where(low == high, 2, own == high).astype(np.uint8)


def _least(size: np.ndarray, threshold: float) -> np.ndarray:
    """Shared positional bytes demanded inside the prefixes of a record of this size."""
    return np.minimum(LEAST, np.ceil(threshold * size - 1e-9).astype(np.int64))


def _postings(records: DataFrame, ranks, n: int, min_words: int, threshold: float, buckets: int) -> DataFrame:
    """The index: rows (bucket, blob); a blob holds postings of one task packed by column."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held, count = [], 0
        enough = min(MOST_FLUSH, max(FLUSH, 16 * buckets))

        def flush() -> pd.DataFrame:
            ids, sig, size, at, side = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (words.mix(ids) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                mine = order[edges[b] : edges[b + 1]]
                fresh = np.concatenate(([True], sig[mine[1:]] != sig[mine[:-1]]))  # a record's postings stay together
                heads = mine[fresh]
                each = np.diff(np.append(np.flatnonzero(fresh), len(mine)))
                packed = _press(np.array([len(mine), len(heads)], "<u4").view(np.uint8), sig[heads].astype("<u4"), size[heads].astype("<u4"), each.astype("<u4"), ids[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], at[mine].astype("<u4"), side[mine])
                out.append((int(b), packed))
            return pd.DataFrame(out, columns=["bucket", "blob"])

        for pdf in batches:
            for owner, rank, ids in _sets(pdf, n, min_words, ranks.value):
                _, first, size, signature = _signatures(owner, ids)
                fresh = np.zeros(len(first), bool)
                if len(seen) > SEEN:
                    seen.clear()
                for i, s in enumerate(signature.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh[i] = True
                whole = np.repeat(size, size)
                at = np.arange(len(ids)) - np.repeat(first, size)
                prefix = whole - np.ceil(threshold * whole - 1e-9).astype(np.int64) + _least(whole, threshold)
                keep = (at < prefix) & (rank > 0) & np.repeat(fresh, size)
                sig, whole, at = np.repeat(_short(signature), size)[keep], whole[keep], at[keep]
                which, cells, side = _spread(ids[keep], sig, rank[keep])
                held.append((cells, sig[which], whole[which], at[which], side))
                count += len(which)
                if count >= enough:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return records.mapInPandas(post, "bucket int, blob binary")


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(bytes(blob))
    count, heads = map(int, np.frombuffer(raw, "<u4", 2))
    columns, place = [], 8
    for width, n in ((4, heads), (4, heads), (4, heads), (6, count), (4, count), (1, count)):
        column, place = _column(raw, place, width, n)
        columns.append(column)
    sig, size, each, ids, at, side = columns
    each = each.astype(np.int64)
    return ids, np.repeat(sig, each), np.repeat(size.astype(np.int64), each), at.astype(np.int64), side.astype(np.uint8)


def _meetings(ids: np.ndarray, sig: np.ndarray, size: np.ndarray, at: np.ndarray, side: np.ndarray, threshold: float, share: int = 0, shares: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller, larger, demanded) for postings of one bucket that meet and may still reach the minimum, of one share of the smaller ones."""
    order = np.lexsort((at, sig, size, ids))
    ids, sig, size, at, side = ids[order], sig[order], size[order], at[order], side[order]
    fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (sig[1:] != sig[:-1]) | (size[1:] != size[:-1]) | (at[1:] != at[:-1]))) if len(ids) else np.empty(0, bool)
    ids, sig, size, at, side = ids[fresh], sig[fresh], size[fresh], at[fresh], side[fresh]  # the same class posted by several tasks
    least = _least(size, threshold)
    index = at < size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + least
    if shares > 1:
        index &= words.mix(sig) % np.uint64(shares) == np.uint64(share)
    active, step = np.flatnonzero(index), 1
    while len(active):
        active = active[active + step < len(ids)]
        other = active + step
        going = (ids[active] == ids[other]) & (size[active] >= threshold * size[other] - 1e-9)
        active, other = active[going], other[going]
        if not len(active):
            return
        need = np.ceil(threshold / (1 + threshold) * (size[active] + size[other]) - 1e-9).astype(np.int64)
        demand = np.minimum(least[active], least[other])
        fits = np.minimum(size[active] - at[active], size[other] - at[other]) >= need - demand + 1
        fits &= (side[active] != side[other]) | (side[active] == 2)
        yield sig[active[fits]], sig[other[fits]], demand[fits]
        step += 1


def _pack(held: list, parts: int) -> Iterator[tuple[int, bytes]]:
    """Meetings as (part, blob): how often each pair met and how often it must, by a key whose first bits name the part."""
    a, b, demand = (np.concatenate(x) for x in zip(*held, strict=True))
    key = (a ^ _short(words.mix(b))) << np.uint64(SHORT_BITS) | b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    shared = np.minimum(np.diff(np.append(first, len(key))), 255).astype(np.uint8)
    demand = np.minimum.reduceat(demand[order], first).astype(np.uint8)
    key = key[first]
    high, low = key >> np.uint64(SHORT_BITS), key.astype("<u4")
    edges = np.searchsorted(high * np.uint64(parts) >> np.uint64(SHORT_BITS), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        mine = slice(edges[p], edges[p + 1])
        steps = np.diff(high[mine], prepend=np.uint64(0)).astype("<u4")
        yield int(p), _press(np.array([len(steps)], "<u4").view(np.uint8), steps, low[mine], shared[mine], demand[mine])


def _summed(blobs: list[bytes]) -> pd.DataFrame:
    """The pairs of one part that met as often as they must."""
    keys, times, musts = [], [], []
    for blob in blobs:
        raw = zstandard.decompress(bytes(blob))
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        steps, place = _column(raw, 4, 4, n)
        low, place = _column(raw, place, 4, n)
        keys.append(np.cumsum(steps, dtype=np.uint64) << np.uint64(SHORT_BITS) | low)
        times.append(np.frombuffer(raw, np.uint8, n, place))
        musts.append(np.frombuffer(raw, np.uint8, n, place + n))
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    enough = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), first) >= np.minimum.reduceat(np.concatenate(musts)[order], first)
    key = key[first[enough]]
    b = key & np.uint64(2**SHORT_BITS - 1)
    a = (key >> np.uint64(SHORT_BITS)) ^ _short(words.mix(b))
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _passes(met: int, total: int) -> int:
    """Passes in which so many meetings are tallied."""
    return max(1, math.ceil(met / max(PASS, total // SHARE)))


def _tally(postings: DataFrame, threshold: float, buckets: int, total: int) -> DataFrame:
    """Candidate pairs of classes: those whose shared positional bytes reach the demanded number."""
    spark = postings.sparkSession
    # as an RDD, whose exchange is written once and read by every pass
    index = postings.repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket").rdd

    def meetings(rows: Iterator[tuple[int, bytes]], share: int = 0, shares: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, bucket in itertools.groupby(rows, lambda row: row[0]):
            columns = [np.concatenate(x) for x in zip(*(_unpack(row[1]) for row in bucket), strict=True)]
            yield from (met for met in _meetings(*columns, threshold, share, shares) if len(met[0]))

    def sent(rows: Iterator[tuple[int, bytes]], share: int, shares: int, parts: int) -> Iterator[tuple[int, bytes]]:
        held, size = [], 0
        for met in meetings(rows, share, shares):
            held.append(met)
            size += len(met[0])
            if size > MET:
                yield from _pack(held, parts)
                held, size = [], 0
        if held:
            yield from _pack(held, parts)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in zip(pdf["part"], pdf["blob"], strict=True))
        for _, part in itertools.groupby(rows, lambda row: row[0]):
            yield _summed([blob for _, blob in part])

    some = range(0, index.getNumPartitions(), SAMPLE)
    met = sum(spark.sparkContext.runJob(index, lambda rows: [sum(len(m[0]) for m in meetings(rows))], some)) * index.getNumPartitions() // len(some)
    shares = _passes(met, total)
    parts = max(12, math.ceil(met / shares / MET))
    found = []
    for share in range(shares):
        blobs = spark.createDataFrame(index.mapPartitions(lambda rows, share=share: sent(rows, share, shares, parts)), "part int, blob binary", verifySchema=False)
        found.append(cut(blobs.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(reach, "a long, b long")))
        del blobs
        sweep(spark, index if share == shares - 1 else None)
    # classes of one short name may meet those of another in both orders
    return functools.reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bloom(pairs: DataFrame) -> np.ndarray:
    """Packed bit array that holds the short names of all candidate classes, sized by their number."""
    bits = min(MOST_BLOOM, max(LEAST_BLOOM, math.ceil(math.log2(32 * pairs.count() + 1))))
    step = (1 << bits) // 8 // CHUNKS

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = np.zeros(1 << bits, bool)
        for pdf in batches:
            for c in ("a", "b"):
                h = pdf[c].to_numpy().view(np.uint64)
                for k in (0, 1):
                    some[(words.mix(h + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(some)
        for k in range(CHUNKS):
            if packed[k * step : (k + 1) * step].any():
                yield pd.DataFrame({"chunk": [k], "bits": [packed[k * step : (k + 1) * step].tobytes()]})

    def either(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merged = np.zeros(step, np.uint8)
        for pdf in parts:
            for b in pdf["bits"]:
                merged |= np.frombuffer(b, np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "bits": [merged.tobytes()]})

    packed = np.zeros((1 << bits) // 8, np.uint8)
    for row in pairs.mapInPandas(mark, "chunk int, bits binary").groupBy("chunk").applyInPandas(either, "chunk int, bits binary").collect():  # at most CHUNKS rows
        packed[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return packed


def _holds(packed: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Which short names may be in the filter."""
    bits = (8 * len(packed)).bit_length() - 1
    hit = np.ones(len(short), bool)
    for k in (0, 1):
        bit = (words.mix(short + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)
        hit &= (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _parities(ids: np.ndarray) -> bytes:
    """A set as bits, each the parity of the members whose hash falls on it: four places or more for a member, up to MOST_PARITIES.

    A member that only one of two sets has turns one bit, so sets differ in at least as many members as bits.
    """
    places = min(MOST_PARITIES, max(64, 1 << (4 * len(ids) - 1).bit_length()))
    return np.packbits(np.bincount((words.mix(ids) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Members at least that only one of two sets has, from their parities; more places fold onto fewer."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _may_be_similar(threshold: float):
    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series, size: pd.Series, other: pd.Series) -> pd.Series:
        both = (size + other).to_numpy().astype(np.int64)
        most = both - 2 * np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
        return pd.Series([_differ(x, y) <= m for x, y, m in zip(left, right, most.tolist(), strict=True)], dtype=bool)

    return similar


def _members(records: DataFrame, bloom, n: int, min_words: int) -> DataFrame:
    """Rows (sig, key, null) for every record and (sig, null, set, its size and parities) once a task for every candidate class."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            keys, parts = pdf["key"].to_numpy(), pdf["part"].to_numpy()
            for owner, _, ids in _sets(pdf, n, min_words):
                row, first, size, signature = _signatures(owner, ids)
                if not len(row):
                    continue
                sig = signature.view(np.int64)
                yield pd.DataFrame({"sig": sig, "part": parts[row], "key": keys[row], "ids": None, "size": 0, "bits": None})
                hit = _holds(bloom.value, _short(signature))
                if len(seen) > SEEN:
                    seen.clear()
                fresh = [i for i in np.flatnonzero(hit) if sig[i] not in seen and not seen.add(sig[i])]
                if fresh:
                    sets = [(ids[first[i] : first[i] + size[i]]).astype("<u8").view("u1").reshape(-1, 8)[:, :6].tobytes() for i in fresh]
                    yield pd.DataFrame({"sig": sig[fresh], "part": None, "key": None, "ids": sets, "size": size[fresh], "bits": [_parities(ids[first[i] : first[i] + size[i]]) for i in fresh]})

    return records.mapInPandas(emit, "sig long, part string, key string, ids binary, size int, bits binary")


def _similar(threshold: float):
    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> float:
            both = []
            for raw in (x, y):
                wide = np.zeros((len(raw) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
                both.append(wide.view("<u8").ravel())
            shared = len(np.intersect1d(*both, assume_unique=True))
            return shared / (len(both[0]) + len(both[1]) - shared)

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return similarity


def near_classes(df: DataFrame, key: str, text: str, part: str | None = None, n: int = 3, threshold: float = 0.5, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the records of ``df``.

    links (a long, b long, similarity double): each pair of different classes at or above the
    threshold, once.  members (sig long, part string, key string): the class of every record with
    at least ``min_words`` words.  Records of different ``part`` are never linked.

    Null texts and null keys have no row; a repeated (part, key, text) counts once, and a key with
    several texts is a member of several classes.  Other columns are ignored, whatever their names.
    """
    records = df.select(
        (F.col(part) if part else F.lit("")).cast("string").alias("part"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")
    ).filter("key is not null and text is not null and part is not null")
    context = df.sparkSession.sparkContext
    ranks, total = _sketch(records, n, min_words)
    sweep(df.sparkSession)
    buckets = max(24, math.ceil(total / BUCKET))
    pairs = cut(_tally(_postings(records, context.broadcast(ranks), n, min_words, threshold, buckets), threshold, buckets, total))
    emitted = cut(_members(records, context.broadcast(_bloom(pairs)), n, min_words))
    classes = emitted.filter("ids is not null")
    marks = classes.select(F.shiftrightunsigned("sig", 64 - SHORT_BITS).alias("short"), "sig", "size", "bits").repartition("short").dropDuplicates(["short", "sig"])
    # parities first: they are a tenth of the sets, and few pairs that are not similar pass
    near = (
        pairs.withColumnsRenamed({"a": "short_a", "b": "short_b"})
        .join(marks.toDF("short_b", "b", "size_b", "right"), "short_b")
        .join(marks.toDF("short_a", "a", "size_a", "left"), "short_a")
        .filter("short_a < short_b or a < b")
        .filter(_may_be_similar(threshold)("left", "right", "size_a", "size_b"))
        .select("a", "b")
    )
    sets = classes.select("sig", "ids").dropDuplicates(["sig"])
    links = (
        near.join(sets.select(F.col("sig").alias("b"), F.col("ids").alias("right")), "b")
        .join(sets.select(F.col("sig").alias("a"), F.col("ids").alias("left")), "a")
        .select("a", "b", _similar(threshold)("left", "right").alias("similarity"))
        .filter(F.col("similarity") >= threshold - 1e-12)
    )
    return links, emitted.filter("key is not null").select("sig", "part", "key").distinct()


def near_pairs(df: DataFrame, key: str, text: str, part: str | None = None, n: int = 3, threshold: float = 0.5, min_words: int = 20) -> DataFrame:
    """Every pair of records at or above the threshold: (part, first_key, second_key, similarity), first_key < second_key as text.

    Copies are listed too, so the result can be quadratic in the size of a group of copies;
    :func:`near_classes` gives the same facts in linear size.
    """
    links, members = near_classes(df, key, text, part, n, threshold, min_words)
    between = links.join(members.select(F.col("sig").alias("a"), "part", F.col("key").alias("x")), "a").join(
        members.select(F.col("sig").alias("b"), F.col("key").alias("y")), "b"
    )
    left = members.select("sig", "part", F.col("key").alias("x"))
    within = left.join(members.select("sig", F.col("key").alias("y")), "sig").filter("x < y").withColumn("similarity", F.lit(1.0))
    columns = ("part", "x", "y", "similarity")
    return (
        between.select(*columns)
        .unionByName(within.select(*columns))
        .filter("x <> y")
        .select("part", F.least("x", "y").alias("first_key"), F.greatest("x", "y").alias("second_key"), "similarity")
        .groupBy("part", "first_key", "second_key")
        .agg(F.max("similarity").alias("similarity"))
    )


def near_groups(df: DataFrame, key: str, text: str, part: str | None = None, n: int = 3, threshold: float = 0.5, min_words: int = 20) -> DataFrame:
    """One row per record that has a near-duplicate: (part, key, group_id, links), group_id the least key of its group.

    Groups are the connected components of the links between classes, found by alternating
    large-star and small-star steps; links counts a record's linked classes and copies.
    """
    links, members = near_classes(df, key, text, part, n, threshold, min_words)
    links = cut(links)
    sweep(df.sparkSession)
    roots = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("linked"))
    sizes = members.groupBy("sig").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    classes = (
        sizes.join(degree, "sig", "left").join(roots, "sig", "left")
        .filter("linked is not null or copies > 1")
        .select("sig", F.coalesce("root", "sig").alias("root"), "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    names = classes.groupBy("root").agg(F.min("least").alias("group_id"))
    return members.join(classes.join(names, "root").select("sig", "group_id", "links"), "sig").select("part", "key", "group_id", "links")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (sig, root), root the least node; lineage is cut each round, and the table of the round before is deleted."""
    pairs = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = keep(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        changed = after.exceptAll(pairs).limit(1).count() or pairs.exceptAll(after).limit(1).count()
        release(pairs)
        pairs = after
        if not changed:
            return pairs.select(F.col("u").alias("sig"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("sig"), F.col("v").alias("root")).distinct())
