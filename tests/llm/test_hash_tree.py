import math
import zlib
from collections import Counter
from hashlib import md5

from llm_cases import LONG, SF_SMALL
from pyspark.sql import functions as F

from panelkit.llm import hash_tree as H

ROWS = [(1, "a text"), (1, "a text"), (2, None), (3, ""), (None, "no id"), (None, "no id either"), (4, LONG), (5, "néé"), (1, "other")]


def descend(key, shards):
    """The rule of the module's docstring, one key at a time."""
    here = [s for s in shards if s.weight > 0]
    for depth in (1, 2, 3):
        kids = {}
        for s in here:
            kids.setdefault("/".join([s.region, s.rack, str(s.number)][:depth]), []).append(s)
        draw = {p: -math.log((int(md5(f"{p}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13) / sum(s.weight for s in v)
                for p, v in kids.items()}
        here = kids[min(draw, key=draw.get)]
    return here[0].number


def test_rows_match_brute_force(docs):
    got = H.placements(docs(ROWS), grown=H.tree(25)).collect()
    want = Counter()
    for i, t in ROWS:
        key, raw = "null" if i is None else str(i), (t or "").encode()
        want[i, len(raw) + 8, zlib.crc32(raw), "key", descend(key, H.tree()), descend(key, H.tree(25))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    assert_gapless(got)


def assert_gapless(got):
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_many_ranges_and_parts_change_nothing(spark, docs):
    rows = [(i % 500, f"text {i % 700}") for i in range(3000)] + [(None, "same")] * 1000 + [(None, f"x{i}") for i in range(500)]
    want = sorted(map(tuple, H.placements(docs(rows)).collect()), key=repr)
    assert len(want) == len(rows)
    got = H.placements(docs(rows), range_rows=3, chunk=7).collect()
    assert_gapless(got)
    assert sorted(map(tuple, got), key=repr) == want


def ids(spark, n=40_000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_growth_takes_rows_only_into_itself(spark):
    for n in (24, 25, 30):
        moved = {(r["from_shard"], r["to_shard"]): r["rows"] for r in H.moves(ids(spark), H.tree(n), H.tree(n + 1)).collect()}
        assert all(a == b or b == n for a, b in moved)
        took = sum(v for (a, b), v in moved.items() if a != b)
        assert abs(took - 40_000 / (n + 1)) < 5 * math.sqrt(40_000 / (n + 1))


def test_movement_is_confined_to_changed_subtrees(spark):
    now = H.tree()
    heavy = [s._replace(weight=3.0) if s.number == 5 else s for s in now]  # region r0, rack k1
    home = {s.number: (s.region, s.rack) for s in now}
    seen = set()
    for r in H.moves(ids(spark), now, heavy).collect():
        a, b = r["from_shard"], r["to_shard"]
        if a == b:
            continue
        seen.add(b)
        assert home[b][0] == "r0"
        if home[a][0] == "r0":  # inside the region only into the rack, inside the rack only into the shard
            assert home[b] == ("r0", "k1")
            if home[a] == home[b]:
                assert b == 5
    assert 5 in seen
    # a drained shard loses all its rows, and shards of other regions give none
    drained = [s._replace(weight=0.0) if s.number == 5 else s for s in now]
    for r in H.moves(ids(spark), now, drained).collect():
        a, b = r["from_shard"], r["to_shard"]
        assert b != 5 and (a == b or home[a][0] == "r0")


def test_weights_are_shares(spark):
    shards = [H.Shard("a", "x", 0, 1), H.Shard("a", "x", 1, 3), H.Shard("b", "y", 2, 4), H.Shard("b", "z", 3, 8)]
    got = {r["shard"]: r["count"] for r in H.placed(ids(spark), H.key_of(F.col("doc_id")), shards, "shard").groupBy("shard").count().collect()}
    for s in shards:
        want = 40_000 * s.weight / 16
        assert abs(got[s.number] - want) < 5 * math.sqrt(want)


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    df = docs(ROWS).withColumnsRenamed({"id": "shard", "hash": "region"})
    H.write_shards(df, str(tmp_path / "out"))
    back = [tuple(r) for s in range(24) for r in H.read_shard(spark, str(tmp_path / "out"), s).collect()]
    assert sorted(back, key=repr) == sorted(map(tuple, df.collect()), key=repr)
    one = descend("1", H.tree())
    assert {r["doc_id"] for r in H.read_shard(spark, str(tmp_path / "out"), one).collect()} >= {1}


def test_empty_and_unweighted(spark, docs):
    assert H.placements(docs([])).count() == 0
    none = H.placements(docs(ROWS[:3]), shards=[H.Shard("a", "b", 0, 0.0)]).collect()
    assert [r["shard"] for r in none] == [None] * 3 and sorted(r["slot"] for r in none) == [0, 1, 2]


def test_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    got = H.op11_hash_tree(spark, SF_SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({H.ORACLE})").fetchall()
    assert sorted(want) == sorted(tuple(r[c] for c in cols) for r in got.collect())
