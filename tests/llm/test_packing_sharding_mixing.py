"""Operators 1, 2 and 9 against brute force and on odd rows."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from llm_helpers import as_list, documents, edge_rows, prose

from lamina.llm import mixing, packing, sharding

# ---- packing


def padding_of(lengths, counts, bounds):
    return sum(n * (next(b for b in bounds if b >= size) - size) for size, n in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 30) for _ in lengths]
        k = rng.randint(1, 5)
        found = packing.optimal_bounds(lengths, counts, k)
        assert len(found) <= k and found == sorted(found) and found[-1] == lengths[-1]
        least = min(padding_of(lengths, counts, [*some, lengths[-1]]) for m in range(min(k, len(lengths))) for some in itertools.combinations(lengths[:-1], m))
        assert padding_of(lengths, counts, found) == least
    assert packing.optimal_bounds([], [], 4) == []


def packed(spark, rows, **options):
    return [r.asDict() for r in packing.pack(documents(spark, rows), **options).collect()]


def test_pack_keeps_every_token_and_fills_batches(spark):
    rows = [(i, prose(i, 1 + i * 7 % 90), "en", "a", 0) for i in range(300)]
    out = packed(spark, rows, max_length=40, buckets=4, token_budget=160)
    total = defaultdict(int)
    for r in out:
        total[r["doc_id"]] += r["length"]
        assert 1 <= r["length"] <= r["bucket_length"] and r["padding"] == r["bucket_length"] - r["length"]
    assert total == {i: len(t.split()) + 1 for i, t, *_ in rows}
    seen = defaultdict(list)
    for r in out:
        seen[r["bucket"], r["batch"]].append(r["place"])
    for bucket in {b for b, _ in seen}:
        cap = max(1, 160 // next(r["bucket_length"] for r in out if r["bucket"] == bucket))
        batches = sorted(k for b, k in seen if b == bucket)
        assert batches == list(range(len(batches)))
        for k in batches:
            assert sorted(seen[bucket, k]) == list(range(len(seen[bucket, k])))
            assert len(seen[bucket, k]) == cap or k == batches[-1] and len(seen[bucket, k]) < cap
    lengths = sorted({r["length"] for r in out})
    counts = [sum(r["length"] == n for r in out) for n in lengths]
    assert sum(r["padding"] for r in out) == padding_of(lengths, counts, packing.optimal_bounds(lengths, counts, 4))
    assert sorted(map(str, packed(spark, rows, max_length=40, buckets=4, token_budget=160))) == sorted(map(str, out))


def test_pack_odd_rows(spark):
    plain = as_list(packing.pack(documents(spark)).select("doc_id", "chunk", "start", "length"))
    assert len([r for r in plain if r[0] == 5]) == -(-30_001 // packing.MAX_LENGTH)
    assert [r for r in plain if r[0] == 2] == [(2, 0, 0, 1)] and len([r for r in plain if r[0] is None]) == 3
    assert as_list(packing.pack(documents(spark, clash=True)).select("doc_id", "chunk", "start", "length")) == plain
    assert packing.pack(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(documents(spark), buckets=0)


def test_bounds_of_many_lengths_are_optimal():
    rng = random.Random(8)
    lengths = sorted(rng.sample(range(1, 900), 200))
    counts = [rng.randint(1, 9) ** 3 for _ in lengths]
    best = {0: 0}
    for _ in range(6):  # bucket by bucket, all splits
        best = {j: min(c + sum(n * (lengths[j - 1] - s) for s, n in zip(lengths[i:j], counts[i:j])) for i, c in best.items() if i <= j) for j in range(201) if j == 0 or best}
    assert padding_of(lengths, counts, packing.optimal_bounds(lengths, counts, 6)) == best[200]


# ---- sharding


def test_shards_are_even_gapless_and_right(spark):
    rows = [(i, prose(i, 1 + i % 50), "en", "a", 0) for i in range(4000)] + edge_rows()[:5]
    out = sharding.shard(documents(spark, rows), shards=8).collect()
    assert len(out) == len(rows)
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, set()).add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    load, places = defaultdict(int), defaultdict(list)
    for r in out:
        assert (r.size, r.text_crc32) in text[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert max(load.values()) - min(load.values()) <= largest + 4096


def test_one_virtual_slot_lies_in_one_shard(spark):
    rows = sharding.shard(documents(spark, [(i, "x y", None, None, 0) for i in range(900)]), shards=5, slots=64).collect()
    homes = defaultdict(set)
    for r in rows:
        homes[r.virtual_slot].add((r.shard, r.rebalanced_shard))
    assert all(len(h) == 1 for h in homes.values())


def test_rebalance_moves_little_and_evens_out():
    rng = random.Random(5)
    sizes = [rng.randint(0, 1000) for _ in range(512)]
    old = sharding.balanced_map(sizes, 8)
    for shards in (9, 8, 7):
        new = sharding.rebalance(sizes, old, shards)
        load = [sum(s for s, b in zip(sizes, new) if b == k) for k in range(shards)]
        assert max(load) <= sum(sizes) / shards + 1000 and set(new) <= set(range(shards))
        moved = sum(s for s, a, b in zip(sizes, old, new) if a != b)
        assert moved <= sum(sizes) * 1.3 / max(shards, 8) if shards != 8 else moved == 0
    assert sharding.rebalance([], [], 3) == []


def test_map_versions_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.shard(documents(spark), shards=2, slots=16, path=path)
    one, two = (as_list(sharding.load_map(spark, path, v)) for v in (1, 2))
    assert [r[0] for r in sorted(one)] == list(range(16)) and {r[1] for r in one} <= {0, 1} and {r[1] for r in two} <= {0, 1, 2}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sharding.save_map(spark, path, 1, [0] * 16, [0] * 16)


def test_null_and_repeated_ids_spread(spark):
    rows = [(None if i % 2 else 7 if i % 4 else i, prose(i, 1 + i % 50), "en", "a", 0) for i in range(4000)]
    load = defaultdict(int)
    for r in sharding.shard(documents(spark, rows), shards=8).collect():
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= max(len(t) + 1 for _, t, *_ in rows) + 4096


def test_a_stored_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = documents(spark, [(i, prose(i, 1 + i % 40), None, None, 0) for i in range(1500)])
    first = {r.doc_id: r for r in sharding.shard(docs, shards=4, slots=256, path=path).collect()}
    again = {r.doc_id: r for r in sharding.shard(docs, shards=4, slots=256, path=path).collect()}
    assert {i: r.shard for i, r in again.items()} == {i: r.shard for i, r in first.items()}
    grown = {r.doc_id: r.shard for r in sharding.shard(docs, shards=5, slots=256, path=path).collect()}
    moved = sum(grown[i] != first[i].shard for i in grown)
    assert set(grown.values()) == set(range(5)) and moved <= 1500 * 1.3 / 5
    more = docs.unionByName(documents(spark, [(9000 + i, prose(i, 30), None, None, 0) for i in range(400)]))
    load = defaultdict(int)
    for r in sharding.shard(more, shards=4, slots=256, path=path).collect():
        load[r.shard] += r.size
    stored, following = sharding.versions(spark, path)
    assert stored == list(range(1, following)) and following > 3
    slots = sharding.slot_sizes(sharding.records(more, 256), 256)
    assert max(load.values()) <= sum(load.values()) / 4 + max(slots)
    with pytest.raises(ValueError):
        sharding.shard(docs, shards=4, slots=128, path=path)


def test_slots_are_dealt_as_the_map_says(spark):
    """Brute force: bytes of each slot, largest first, to the lightest shard."""
    rows = sharding.shard(documents(spark, [(i, prose(i, 1 + i % 30), None, None, 0) for i in range(800)]), shards=3, slots=32).collect()
    size = [0] * 32
    for r in rows:
        size[r.virtual_slot] += r.size
    load, home = [0] * 3, {}
    for s in sorted(range(32), key=lambda s: (-size[s], s)):
        home[s] = load.index(min(load))
        load[home[s]] += size[s]
    assert all(home[r.virtual_slot] == r.shard for r in rows)


def test_shard_odd_rows(spark):
    plain = as_list(sharding.shard(documents(spark), 3))
    assert len(plain) == len(edge_rows())
    assert as_list(sharding.shard(documents(spark, clash=True), 3)) == plain
    assert sharding.shard(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(documents(spark), 0)


# ---- mixing


def water_fill(sizes: dict, weights, budget, epochs) -> dict:
    """Rounds of clamping and resharing, exactly."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = Fraction(budget) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level >= epochs * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = Fraction(epochs * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def mix_rows(n=700, sources=("a", "b", "c", "d", None)):
    rng = random.Random(9)
    return [(1000 + i, prose(i, rng.randint(0, 60)), None, rng.choices(sources, [50, 5, 1, 20, 3])[0], 0) for i in range(n)]


def test_targets_and_takes(spark):
    rows = mix_rows() + edge_rows()
    out = mixing.takes(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, source = defaultdict(int), {}
    for i, t, _, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
        source[i] = s
    want = water_fill(sizes, (5, 2, 1), Fraction(3, 2), 2)
    by_source = defaultdict(int)
    for r in out:
        s = source[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 * max(1, r.target)
            by_source[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s in ("b", "c", "d"):
        assert abs(by_source[s] - float(want[s])) <= 1
    assert as_list(mixing.takes(documents(spark, rows, clash=True))) == as_list(mixing.takes(documents(spark, rows)))


def test_targets_without_room(spark):
    """All sources at their cap: the excess has nowhere to go."""
    out = mixing.takes(documents(spark, mix_rows(50)), budget=3).collect()
    assert all(r.taken == 2 * r.size and r.target == 2 * r.source_size for r in out)


def test_mix_repeats_whole_documents(spark):
    rows = mix_rows()
    docs = documents(spark, rows, clash=True)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert as_list(mixing.mix(docs)) == as_list(mixed)
    taken = {r.doc_id: r for r in mixing.takes(docs).collect()}
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
        assert r.size == "own size"
    for i, t, *_ in rows:
        whole, rest = taken[i].copies, taken[i].part_words
        if taken[i].size:
            assert times[i] == whole + (rest > 0 and 2 * rest >= taken[i].size)


def test_mix_of_rows_with_one_id(spark):
    """A third of all rows share an id and length: as many are taken as the target holds, and reruns agree."""
    rows = [(5 if i % 3 == 0 else i, f"a b c d{i}", None, "ab"[i % 2], 0) for i in range(600)]
    docs = documents(spark, rows)
    for budget in (0.4, 1.5, 1.7):
        mixed = as_list(mixing.mix(docs, budget=budget))
        want = sum(float(v) for v in water_fill({"a": 1200, "b": 1200}, (5, 2, 1), Fraction(budget), 2).values())
        assert abs(4 * len(mixed) - want) <= 8 and mixed == as_list(mixing.mix(docs, budget=budget))


def test_mix_without_broadcast(spark, monkeypatch):
    plain = as_list(mixing.mix(documents(spark, mix_rows())))
    monkeypatch.setattr(mixing, "BROADCAST", -1)
    assert as_list(mixing.mix(documents(spark, mix_rows()))) == plain


def test_mix_odd_rows(spark):
    assert mixing.mix(documents(spark, [])).collect() == [] and mixing.takes(documents(spark, [])).collect() == []
    assert {r.taken for r in mixing.takes(documents(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()} == {0}
    with pytest.raises(ValueError):
        mixing.takes(documents(spark), weights=(0,))
