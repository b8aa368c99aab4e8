"""Filling fixed-capacity containers: minimum bin slack over token lengths.

Each container begins with the longest item left; a subset-sum dynamic programme over the lengths
still available, one bit for each sum in an integer, finds the combination that leaves the least
slack, and that combination is removed.  It stops as soon as a container can be filled exactly.

Items are spread over groups by a hash of their key, and each group fills its containers on its
own, so a task holds GROUP items at most about; only a group's last containers can be left part
empty.  Only lengths are moved, never texts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import tokens
from lodestack.session import cut

GROUP = 20_000  # items a group is planned for
VOCABULARY = tokens.VOCABULARY


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, mark, tokens) of every text, each delivered text once; null texts have no row.

    The driver alone reads the rank file and sends it to the executors.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoding(shared.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "mark": pdf["mark"], "tokens": [len(encode(t)) for t in pdf["text"]]})

    source = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).filter("text is not null")
    return source.mapInPandas(count, f"key {kind}, mark long, tokens long").distinct()


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each no oftener than counted, with the greatest sum of at most ``room``; ``lengths`` ascends."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        for _ in range(min(counts[length], room // length)):
            wider = (reach | (reach << length)) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
            if reach >> room:
                break
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if total >= length and not (before >> total) & 1:
            chosen.append(length)
            total -= length
    return chosen


def fill(items: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Containers of (size, item) with little slack; every size must be from 1 to ``capacity``."""
    stacks: dict[int, list] = {}
    for size, item in reversed(items):
        stacks.setdefault(size, []).append(item)
    lengths = sorted(stacks)
    counts = {length: len(stacks[length]) for length in lengths}
    out = []

    def take(length: int) -> tuple[int, object]:
        counts[length] -= 1
        item = stacks[length].pop()
        if not counts[length]:
            del lengths[bisect_right(lengths, length) - 1]
        return length, item

    while lengths:
        box = [take(lengths[-1])]
        room = capacity - box[0][0]
        if room:
            box.extend(take(length) for length in fullest(lengths, counts, room))
        out.append(box)
    return out


def containers(counted: DataFrame, capacity: int) -> DataFrame:
    """(container, key, mark, piece, token_start, tokens): items of ``token_counts`` in containers of ``capacity`` tokens.

    Only an item over the capacity is split: into pieces of the capacity, which fill a container
    each, and a rest that is packed like any item.  Items without tokens have no row.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = counted.schema["key"].dataType.simpleString()
    groups = max(1, math.ceil(counted.count() / GROUP))
    spread = counted.filter("tokens > 0").withColumn("group", F.pmod(F.xxhash64("key", "mark"), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        base, rows, rest = int(pdf["group"].iloc[0]) << 32, [], []
        pdf = pdf.sort_values(["key", "mark"], kind="stable")
        number = 0
        for key, mark, tokens in zip(pdf["key"], pdf["mark"], pdf["tokens"], strict=True):
            whole, left = divmod(int(tokens), capacity)
            for piece in range(whole):
                rows.append((base + number, key, mark, piece, piece * capacity, capacity))
                number += 1
            if left:
                rest.append((left, (key, mark, whole, whole * capacity)))
        for box in fill(rest, capacity):
            rows.extend((base + number, *item, size) for size, item in box)
            number += 1
        return pd.DataFrame(rows, columns=["container", "key", "mark", "piece", "token_start", "tokens"])

    return spread.groupBy("group").applyInPandas(pack, f"container long, key {kind}, mark long, piece int, token_start long, tokens long")


def pack_profiles(df: DataFrame, key: str, text: str, limits: DataFrame, profiles: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``containers`` for each of the profiles of ``limits`` (profile, max_size), with a column profile."""
    counted = cut(token_counts(df, key, text, vocabulary))
    sizes = {r.profile: r.max_size for r in limits.filter(F.col("profile").isin(profiles)).select("profile", "max_size").collect()}
    packed = [containers(counted, sizes[p]).withColumn("profile", F.lit(p)) for p in profiles if p in sizes]
    if not packed:
        raise ValueError(f"no limits for {profiles}")
    out = packed[0]
    for more in packed[1:]:
        out = out.unionByName(more)
    return out


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(profile, containers, tokens, unused share) of packed containers."""
    per = packed.groupBy("profile").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(limits.select("profile", "max_size"), "profile").select(
        "profile", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("max_size")), 6).alias("unused_share")
    )
