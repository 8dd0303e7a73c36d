import zlib
from collections import Counter, defaultdict

import xxhash

from docloom.llm import shards as S


def check(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ids = defaultdict(set)
    for r in rows:
        ids[r.doc_id].add(r.shard)
    assert all(len(v) == 1 for v in ids.values())


def test_query(spark, sf):
    rows = S.op9(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(rows, 40)
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want and {r.law for r in rows} == {"key"}
    assert [(r.doc_id, r.shard) for r in sorted(rows)] == [(r.doc_id, r.shard) for r in sorted(S.op9(spark, sf).collect())]


def test_query_moves_whole_texts(spark, sf, monkeypatch):
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    real = S.shuffle_into_shards

    def spy(df, *args, **kw):
        assert {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()} == docs
        return real(df, *args, **kw).withColumn("text", S.F.concat(S.F.coalesce("text", S.F.lit("")), S.F.lit("!")))

    monkeypatch.setattr(S, "shuffle_into_shards", spy)
    assert all((r.size, r.text_crc32) == (len(t := (docs[r.doc_id] + "!").encode()) + 16, zlib.crc32(t)) for r in S.op9(spark, sf).collect())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20_000).select("id", S.shard_of(S.F.col("id"), 7).alias("a"), S.shard_of(S.F.col("id"), 8).alias("b"))
    rows = df.collect()
    assert all(r.b in (r.a, 7) for r in rows)
    for col in "ab":
        n = Counter(r[col] for r in rows)
        assert max(n.values()) < 1.15 * min(n.values())


def test_order_is_shuffled_and_text_kept(spark):
    df = spark.createDataFrame([(k, f"text {k}", "old") for k in range(3000)], "doc_id long, text string, slot string").repartition(3)
    rows = S.shuffle_into_shards(df, shards=3, bucket_bytes=2000).collect()
    check(rows, 3)
    assert all(r.text == f"text {r.doc_id}" for r in rows)
    mine = [r.doc_id for r in sorted((r for r in rows if r.shard == 0), key=lambda r: r.slot)]
    ascents = sum(a < b for a, b in zip(mine, mine[1:])) / len(mine)
    assert 0.4 < ascents < 0.6


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    rows = S.shuffle_into_shards(odd_docs, shards=4).collect()
    check(rows, 4)
    assert len(rows) == odd_docs.count()
    assert S.shuffle_into_shards(no_docs).count() == 0


def test_plan_is_native(spark, sf):
    plan = S.op9(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_order_needs_no_session_setting_and_maps_are_carried(spark):
    rows = [(k, f"text {k}", {"a": k}) for k in range(500)] + [(1, "text 1", {"a": 1})] * 3 + [(2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    before, orders = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, parts in ((4, 3), (7, 5), (400, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = S.shuffle_into_shards(df.repartition(parts), shards=3, bucket_bytes=900).collect()
            check(out, 3)
            orders.append(sorted((r.shard, r.slot, r.doc_id, r.text or "") for r in out))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert orders[0] == orders[1] == orders[2] and len(orders[0]) == len(rows)


def test_shards_recomputed_outside_spark(spark, sf):
    def draw(doc_id, k):
        h = 42
        for part in (("" if doc_id is None else str(doc_id)).encode(), k.to_bytes(4, "little"), S.SEED.to_bytes(4, "little")):
            h = xxhash.xxh64_intdigest(part, h)
        return (h - (1 << 64) if h >> 63 else h), k

    rows = S.op9(spark, sf).collect()
    assert all(r.shard == max(draw(r.doc_id, k) for k in range(40))[1] and r.grown_shard == max(draw(r.doc_id, k) for k in range(41))[1] for r in rows)
