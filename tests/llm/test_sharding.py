import hashlib
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same

from tidewater.llm.queries import ORACLES, SHARDS, op5_sharding
from tidewater.llm.sharding import SLOTS, filled, place, preference, write_shards


def slow(shards, slots):
    names, owner, at = sorted(shards), {}, [0] * len(shards)
    while len(owner) < slots:
        for k, name in enumerate(names):
            first, step = preference(name, slots)
            while (s := (first + step * at[k]) % slots) in owner:
                at[k] += 1
            owner[s] = k
            if len(owner) == slots:
                break
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns():
    assert filled(["c", "a", "b"], 307).tolist() == slow(["a", "b", "c"], 307)
    sizes = Counter(filled(SHARDS).tolist()).values()
    assert max(sizes) - min(sizes) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = sorted(SHARDS)
    a, b = filled(SHARDS), filled(SHARDS[:-1])
    kept = [names[x] == names[y] for x, y in zip(a, b, strict=True) if names[x] != SHARDS[-1]]
    assert sum(kept) / len(kept) > 0.9


def test_every_row_has_the_shard_of_its_key(spark, odd_docs):
    rows = place(odd_docs.withColumnRenamed("lang", "shard"), "doc_id", SHARDS).collect()
    table, names = filled(SHARDS), sorted(SHARDS)
    assert len(rows) == odd_docs.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % SLOTS and r.shard == names[table[r.slot]]
    assert place(odd_docs.limit(0), "doc_id", SHARDS).collect() == []


def test_shards_are_written_whole(spark, odd_docs, tmp_path):
    write_shards(odd_docs.drop("source"), "doc_id", SHARDS[:4], str(tmp_path / "out"), parts=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()


def test_bad_tables_are_refused():
    for shards, slots in (([], 307), (["a"], 306), (SHARDS, 307)):
        with pytest.raises(ValueError):
            filled(shards, slots)


def test_against_sql(spark):
    same(op5_sharding(spark, "/root/testdata/sf0.001"), ORACLES["op5_sharding"], "/root/testdata/sf0.001")


def test_columns_of_the_same_names_are_replaced(spark):
    rows = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "shard string, slot int, _key string")
    got = place(rows, "_key", SHARDS)
    assert sorted(got.columns) == ["_key", "shard", "slot"] and got.count() == 2
    assert place(rows, "slot", SHARDS).count() == 2
