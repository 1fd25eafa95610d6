import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from kerbline.llm.shard import shard_segments
from tests.llm.helpers import CLASHING, no_reports, odd_reports


def placed(spark, n, weights, **more):
    segments = spark.range(n).selectExpr("id AS segment_id", "concat('US-', id) AS segment_name")
    return {r.segment_id: r for r in shard_segments(segments, weights, **more).collect()}


def test_slots_have_no_gaps_and_sizes_are_exact(spark):
    rows = placed(spark, 3000, [1.0] * 8)
    slots = defaultdict(list)
    for k, r in rows.items():
        slots[r.shard].append(r.slot)
        name = f"US-{k}".encode()
        assert (r["size"], r.payload_crc32) == (len(name) + 1, zlib.crc32(name))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.25 * min(map(len, slots.values()))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = placed(spark, 3000, [1.0] * 8, grown_by=1.0), placed(spark, 3000, [1.0] * 9)
    moved = 0
    for k, r in before.items():
        assert r.grown_shard == after[k].shard
        assert after[k].shard in (r.shard, 8)
        moved += after[k].shard != r.shard
    assert 200 < moved < 480


def test_weights_share_the_rows(spark):
    counts = Counter(r.shard for r in placed(spark, 6000, [1.0, 2.0, 3.0]).values())
    assert [round(counts[s] / 1000) for s in range(3)] == [1, 2, 3]
    with pytest.raises(ValueError):
        placed(spark, 1, [1.0, 0.0])


def test_odd_rows(spark):
    given = odd_reports(spark)
    assert len(CLASHING) and given.count() == 9
    rows = shard_segments(given, [1.0, 1.0], key="event_id", payload="report").collect()
    assert len(rows) == 9
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.event_id == 2}) == 1
    assert {r["size"] for r in rows if r.event_id in (3, 4)} == {1}
    assert shard_segments(no_reports(spark), [1.0], key="event_id", payload="report").count() == 0


def test_placement_is_that_of_every_draw_taken_apart(spark):
    weights = [1.0, 2.5, 0.5, 1.0]

    def draw(key, shard):
        seed = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        bits = xxhash.xxh64(struct.pack("<i", shard), seed=seed).intdigest() >> 11
        return -math.log((bits + 0.5) / 2**53) / weights[shard]

    rows = placed(spark, 500, weights[:3], grown_by=weights[3])
    assert all(r.shard == min(range(3), key=lambda s: draw(k, s)) for k, r in rows.items())
    assert all(r.grown_shard == min(range(4), key=lambda s: draw(k, s)) for k, r in rows.items())
