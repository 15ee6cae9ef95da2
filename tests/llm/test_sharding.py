"""Shards stay even and gapless, and equal texts come together."""

import zlib
from collections import Counter, defaultdict

from roleweave.llm import sharding


def check(df, rows, shards):
    got = df.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(shards))
    sizes = [counts.get(j, 0) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("rows", None)}
    return got


def test_groups_come_together(documents, prose):
    rows = [(i, prose(i % 100, 5)) if i < 300 else (i, prose(i, 5)) for i in range(600)]  # 100 texts three times
    got = check(sharding.shard(documents(rows, extra=True), 8), rows, 8)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_a_group_larger_than_a_shard_fills_whole_shards(documents, prose):
    rows = [(i, "same text") for i in range(200)] + [(1000 + i, prose(i, 4)) for i in range(400)]
    got = check(sharding.shard(documents(rows), 10), rows, 10)  # 60 rows a shard
    held = Counter(r["shard"] for r in got if r["doc_id"] < 200)
    assert len(held) <= 5 and sum(n == 60 for n in held.values()) >= 3


def test_all_rows_linked_still_even(documents, prose):
    rows = [(i, prose(i // 2, 4)) for i in range(120)]
    check(sharding.shard(documents(rows), 7), rows, 7)


def test_nulls_repeats_and_few_rows(documents):
    rows = [(None, None), (None, None), (1, ""), (2, ""), (3, None), (3, None), (4, "é" * 2000)]
    check(sharding.shard(documents(rows), 40), rows, 40)
    check(sharding.shard(documents([]), 40), [], 40)


def test_grants_never_overfill():
    wanted = {(0, 1): 5, (1, 0): 3, (2, 1): 4, (3, 1): 2}
    room = [0, 2, 0, 0]
    grants = {(i, j): n for i, j, n in sharding._grants(wanted, room)}
    into, out = Counter(), Counter()
    for (i, j), n in grants.items():
        assert n <= wanted[i, j]
        into[j] += n
        out[i] += n
    assert all(into[j] - out[j] <= room[j] for j in range(4))
    assert grants[0, 1] >= 3 and grants[1, 0] == 3


def test_a_group_over_many_shards_is_mended_to_the_end(documents, prose):
    rows = [(i, "same text") for i in range(600)] + [(1000 + i, prose(i, 4)) for i in range(600)]
    got = check(sharding.shard(documents(rows), 40), rows, 40)  # 30 rows a shard
    held = Counter(r["shard"] for r in got if r["doc_id"] < 1000)
    assert len(held) <= 21, held
