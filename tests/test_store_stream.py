"""Persistent store (idempotent loads) and incremental stream = batch."""

import tempfile

from pyspark.sql import functions as F

from revq.operators.dedup import first_per_key
from revq.sources.store import ReviewStore
from revq.streaming.ingest import ReviewStream

SCHEMA = "review_id string, arrival_seq long, product_id string, text string, title string, rating int, processed int"


def _rows(spark):
    rows = [
        ("a", 1, "p1", "great sound", "", 5, 1),
        ("b", 2, "p1", "bad battery", "", 1, 1),
        ("a", 3, "p1", "dup of a", "", 2, 1),
        ("c", 4, "p2", "comfortable fit", "", 4, 0),
        ("b", 5, "p1", "dup of b", "", 3, 1),
        ("d", 6, "p2", "mic is fine", "", 3, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_store_loads_are_idempotent(spark):
    st = ReviewStore(spark, tempfile.mkdtemp(prefix="revq-store-"))
    b = _rows(spark)
    st.append(b.filter("arrival_seq <= 3"), 1, "2024-01-01 00:00:00")
    log = st.append(b.filter("arrival_seq > 3"), 2, "2024-01-08 00:00:00")
    st.append(b.filter("arrival_seq > 3"), 2, "2024-01-08 00:00:00")  # rerun of a failed load
    got = sorted((r.review_id, r.arrival_seq) for r in st.raw().collect())
    assert got == [("a", 1), ("b", 2), ("c", 4), ("d", 6)]
    assert {(r.product_id, r.new_reviews, r.total_reviews) for r in log.collect()} == {("p1", 0, 2), ("p2", 2, 2)}
    st.analyse(1, predicate="processed = 1")
    v = {r.review_id: r for r in st.reviews().collect()}
    assert v["a"].sentiment == "Positive" and v["a"].themes == ["Sound Quality"]
    assert v["c"].processed == 0 and v["c"].sentiment is None


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="revq-stream-")
    b = _rows(spark)
    rs = ReviewStream(f"{base}/landing", f"{base}/store", f"{base}/ckpt", b.schema, analysis=f"{base}/analysis", classify_filter="processed = 1")
    for lo, hi in [(1, 3), (4, 6)]:  # two deliveries in arrival order
        b.filter(F.col("arrival_seq").between(lo, hi)).write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
    got = sorted((r.review_id, r.arrival_seq) for r in rs.stored(spark).collect())
    want = sorted((r.review_id, r.arrival_seq) for r in first_per_key(b).collect())
    assert got == want
    assert sorted(r.review_id for r in rs.analysed(spark).collect()) == ["a", "b", "d"]


def test_bucketed_keys_avoid_store_shuffle(spark):
    from revq.operators.dedup import dedup_append

    st = ReviewStore(spark, tempfile.mkdtemp(prefix="revq-bstore-"), key_buckets=8)
    b = _rows(spark)
    st.append(b.filter("arrival_seq <= 3"), 1, "2024-01-01 00:00:00")
    st.append(b.filter("arrival_seq > 3"), 2, "2024-01-08 00:00:00")
    assert sorted((r.review_id, r.arrival_seq) for r in st.raw().collect()) == [("a", 1), ("b", 2), ("c", 4), ("d", 6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = dedup_append(b, st.keys())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [l for l in plan.split("\n") if l.strip()]
    i = next(k for k, l in enumerate(lines) if st.runs.table in l and "FileScan" in l)
    assert "Bucketed: true" in lines[i]
    assert "Exchange" not in lines[i - 1]  # the key side is not shuffled


def test_bounded_state_dedup_stream(spark):
    import datetime as dt

    from revq.streaming.ingest import bounded_dedup_stream

    base = tempfile.mkdtemp(prefix="revq-wm-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 1, t0), ("a", 2, t0 + dt.timedelta(hours=1)), ("b", 3, t0 + dt.timedelta(hours=2)), ("b", 4, t0 + dt.timedelta(days=1))]
    schema = "review_id string, arrival_seq long, ingested_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/landing")
    src = spark.readStream.schema(schema).parquet(f"{base}/landing")
    q = (
        bounded_dedup_stream(src, "7 days")
        .writeStream.format("memory")
        .queryName("revq_wm_test")
        .option("checkpointLocation", f"{base}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = sorted(r.review_id for r in spark.sql("SELECT review_id FROM revq_wm_test").collect())
    assert got == ["a", "b"]  # one row per key within the watermark delay


def test_keys_follow_committed_loads(spark):
    """Key buckets turned on later, or a run that ended before its keys were written: no stored key is taken again."""
    root = tempfile.mkdtemp(prefix="revq-late-keys-")
    b = _rows(spark)
    ReviewStore(spark, root).append(b.filter("arrival_seq <= 3"), 1, "2024-01-01 00:00:00")
    st = ReviewStore(spark, root, key_buckets=4)
    st.append(b.filter("arrival_seq > 2"), 2, "2024-01-08 00:00:00")
    st.append(b, 3, "2024-01-15 00:00:00")  # nothing new: an empty load
    st.append(b, 4, "2024-01-22 00:00:00")
    assert sorted((r.review_id, r.arrival_seq) for r in st.raw().collect()) == [("a", 1), ("b", 2), ("c", 4), ("d", 6)]
    assert sorted(r.review_id for r in st.keys().collect()) == ["a", "b", "c", "d"]


def test_half_written_load_is_not_read(spark):
    root = tempfile.mkdtemp(prefix="revq-half-")
    st, b = ReviewStore(spark, root), _rows(spark)
    st.append(b.filter("arrival_seq <= 2"), 1, "2024-01-01 00:00:00")
    b.filter("arrival_seq = 4").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{st.raw_path}/load=2")
    assert sorted(r.review_id for r in st.raw().collect()) == ["a", "b"]
    st.append(b.filter("arrival_seq > 2"), 3, "2024-01-08 00:00:00")
    st.append(b.filter("arrival_seq > 2"), 2, "2024-01-09 00:00:00")  # the retry
    assert sorted((r.review_id, r.arrival_seq) for r in st.raw().collect()) == [("a", 1), ("b", 2), ("c", 4), ("d", 6)]


def test_product_codes_keep_their_type(spark):
    st = ReviewStore(spark, tempfile.mkdtemp(prefix="revq-codes-"))
    st.append(_rows(spark).withColumn("product_id", F.lit("0000000042")), 1, "2024-01-01 00:00:00")
    assert dict(st.raw().dtypes)["product_id"] == "string"
    assert {r.product_id for r in st.raw().collect()} == {"0000000042"}
    assert {(r.product_id, r.new_reviews) for r in st.ingestion_log().collect()} == {("0000000042", 4)}


def test_page_cutoff_per_listing(spark):
    from revq.sources.html import page_cutoff

    rows = [("l", 1, True, 3), ("l", 2, False, 0), ("l", 3, True, 2), ("l", 4, True, 0), ("l", 5, True, 7), ("m", 1, True, 0), (None, 1, True, 1), (None, 2, True, 0)]
    kept = page_cutoff(spark.createDataFrame(rows, "listing string, page_no int, fetched boolean, n_reviews int")).collect()
    assert sorted(((r.listing, r.page_no) for r in kept), key=repr) == [("l", 1), ("l", 3), (None, 1)]


def _runs(spark, fan=3):
    from revq.sources.keyruns import KeyRuns

    return KeyRuns(spark, tempfile.mkdtemp(prefix="revq-runs-"), buckets=4, fan=fan)


def _keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "review_id string")


def test_key_runs_merge_level_by_level(spark):
    runs = _runs(spark)
    for e in range(10):
        runs.add(e, _keys(spark, f"k{e}", f"x{e}"))
        runs.add(e, _keys(spark, "never"))  # a load that is held already
        runs.compact()
        assert runs.loads() == set(range(e + 1))
        assert sorted(r.review_id for r in runs.keys().collect()) == sorted([f"{c}{i}" for c in "kx" for i in range(e + 1)])
    assert sorted((r.level, len(r.loads)) for r in runs.live()) == [(0, 1), (2, 9)]
    assert len(runs.committed()) == 2  # inputs of merged runs are gone


def test_key_run_merge_interrupted(spark, monkeypatch):
    from revq.sources.keyruns import KeyRuns

    runs = _runs(spark)
    for e in range(3):
        runs.add(e, _keys(spark, f"k{e}"))
    want = ["k0", "k1", "k2"]

    def stop(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # the merged files are there, their mark is not
        m.setattr(KeyRuns, "_mark", stop)
        try:
            runs.compact()
        except RuntimeError:
            pass
    assert sorted(r.review_id for r in runs.keys().collect()) == want and {r.level for r in runs.live()} == {0}
    with monkeypatch.context() as m:  # the mark is there, the inputs are too
        m.setattr(KeyRuns, "sweep", stop)
        try:
            runs.compact()
        except RuntimeError:
            pass
    assert len(runs.committed()) == 4 and {r.level for r in runs.live()} == {1}
    assert sorted(r.review_id for r in runs.keys().collect()) == want
    again = KeyRuns(spark, runs.root, 4, 3, table=runs.table + "_b")  # another program over the same files
    again.compact()
    assert sorted(r.review_id for r in again.keys().collect()) == want and len(again.committed()) == 1


def test_bucket_number_stays(spark):
    """A later program that asks for another number of buckets reads the files by the number they were written with."""
    from revq.sources.keyruns import KeyRuns

    runs = _runs(spark)
    runs.add(0, _keys(spark, *(f"k{i}" for i in range(50))))
    again = KeyRuns(spark, runs.root, 9, table=runs.table + "_c")
    assert again.buckets == 4
    batch = _keys(spark, *(f"k{i}" for i in range(60)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert batch.join(again.keys(), "review_id", "left_anti").count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mark_cut_short_does_not_count(spark):
    runs = _runs(spark)
    runs.add(1, _keys(spark, "a"))
    from revq.sources.files import file_system

    fs, p = file_system(spark, f"{runs.root}/done/L0-2")
    out = fs.create(p, True)
    out.write(bytearray(b"2"))
    out.close()
    assert runs.loads() == {1}


def _stream(spark, **more):
    base = tempfile.mkdtemp(prefix="revq-stream-")
    return ReviewStream(
        f"{base}/landing", f"{base}/store", f"{base}/ckpt", _rows(spark).schema, analysis=f"{base}/analysis", key_buckets=8, **more
    )


def test_epoch_join_reads_stored_keys_without_exchange(spark):
    rs, b = _stream(spark), _rows(spark)
    for lo, hi in [(1, 2), (3, 4), (5, 6)]:
        b.filter(F.col("arrival_seq").between(lo, hi)).write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
    from revq.operators.dedup import dedup_append

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = dedup_append(b, rs.stored_keys(spark, 3))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [x for x in plan.split("\n") if x.strip()]
    i = next(k for k, x in enumerate(lines) if rs.runs(spark).table in x and "FileScan" in x)
    assert "Bucketed: true" in lines[i]
    between = []  # the scan's ancestors up to the join
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-*"))
    for x in reversed(lines[:i]):
        own = len(x) - len(x.lstrip(" :+-*"))
        if own < depth:
            between.append(x.lstrip(" :+-*"))
            depth = own
            if "Join" in x:
                break
    assert "Join" in between[-1] and not any("Exchange" in x for x in between)


def test_rows_left_out_are_analysed_later(spark):
    rs, b = _stream(spark, classify_filter=lambda e: "processed = 1" if e < 2 else None), _rows(spark)
    seen = []
    for lo, hi in [(1, 3), (4, 5), (6, 6)]:
        b.filter(F.col("arrival_seq").between(lo, hi)).write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
        seen.append((sorted(r.review_id for r in rs.analysed(spark).collect()), sorted(r.review_id for r in rs.backlog(spark).collect())))
    assert seen == [(["a", "b"], []), (["a", "b"], ["c"]), (["a", "b", "c", "d"], [])]
    assert {r.review_id: r.epoch for r in rs.analysed(spark).collect()} == {"a": 0, "b": 0, "c": 2, "d": 2}


def test_work_cap_drains_by_arrival(spark):
    rs, b = _stream(spark, classify_cap=1), _rows(spark)
    for lo, hi in [(1, 4), (5, 5), (6, 6)]:
        b.filter(F.col("arrival_seq").between(lo, hi)).write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
    assert {r.review_id: r.epoch for r in rs.analysed(spark).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r.review_id for r in rs.backlog(spark).collect()] == ["d"]


def test_replayed_epoch_changes_nothing(spark):
    rs, b = _stream(spark, classify_filter="processed = 1"), _rows(spark)
    for lo, hi in [(1, 3), (4, 6)]:
        b.filter(F.col("arrival_seq").between(lo, hi)).write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
    before = [sorted(map(str, d.select("review_id").collect())) for d in (rs.stored(spark), rs.analysed(spark), rs.backlog(spark))]
    rs._batch(b.filter("arrival_seq > 3"), 1)
    assert [sorted(map(str, d.select("review_id").collect())) for d in (rs.stored(spark), rs.analysed(spark), rs.backlog(spark))] == before


def test_kept_theme_counts_equal_a_rescan(spark):
    from revq.operators.classify import classify_rules
    from revq.operators.mentions import theme_mentions, theme_trends

    base = tempfile.mkdtemp(prefix="revq-counts-")
    b = _rows(spark).withColumn("source", F.lit("s")).withColumn("date", F.lit("2024-01-01")).withColumn("ingested_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    rs = ReviewStream(f"{base}/landing", f"{base}/store", f"{base}/ckpt", b.schema, analysis=f"{base}/analysis", counts=f"{base}/counts", key_buckets=4, fold=2)
    for k, (lo, hi) in enumerate([(1, 1), (2, 3), (4, 4), (5, 6)]):
        b.filter(F.col("arrival_seq").between(lo, hi)).write.mode("append").parquet(rs.landing)
        rs.run_available(spark)
        batch = classify_rules(first_per_key(b.filter(F.col("arrival_seq") <= hi))).withColumn("processed", F.lit(1))
        want = sorted(map(str, theme_trends(theme_mentions(batch)).collect()))
        assert sorted(map(str, rs.theme_trends(spark).collect())) == want
        assert sorted(map(str, rs.theme_trends(spark, k).collect())) == want
    from revq.sources.files import committed_parts

    assert committed_parts(spark, f"{rs.counts}_total", "upto") == [1, 3]
