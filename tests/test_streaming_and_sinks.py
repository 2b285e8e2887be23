"""Structured Streaming jobs and writing sinks, on scratch folders."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from meshlens.plans.catalog import queries
from meshlens.sources import probes, sinks
from meshlens.sources.tables import load_tables, scan_corpus
from meshlens.streaming import incremental as I


def scratch():
    return tempfile.mkdtemp(prefix="meshlens-test-")


def published(events):
    """The events table as published messages, as the probe view has them."""
    return events.select("ts", "event_type", (F.col("user_id") % 10).alias("repo"),
                         F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("topic"),
                         F.concat(F.col("event_type"), F.lit("."), (F.col("user_id") % 2).cast("string")).alias("routing_key"))


def test_stream_link_events_matches_batch_twin(spark, sf_dir):
    t = load_tables(spark, sf_dir)
    schema = t.events.schema
    src = f"{scratch()}/events"  # a file source reads a directory of arriving files
    t.events.repartition(4).write.parquet(src)
    # one micro-batch: with several, files of older events would arrive after the
    # watermark moved on and be dropped as late (correct streaming semantics,
    # but then the stream is not comparable with its batch twin)
    stream = spark.readStream.schema(schema).parquet(src)
    links = I.stream_link_events(published(stream), probes.v_sub(t))
    name = "links_" + os.path.basename(scratch()).replace("-", "_")
    q = links.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"SELECT DISTINCT event_type, pub_repo, sub_id, match_confidence FROM {name}")
    batch = queries()["j15_link_events"](spark, sf_dir)
    pubs = probes.v_pub(t).select(F.col("id").alias("pub_id"), "event_type")
    want = (batch.join(pubs, "pub_id").select("event_type", F.col("pub_repo"), "sub_id", "match_confidence")
            .distinct())
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_apply_changes(spark):
    root = scratch()
    changes, target, ckpt = f"{root}/changes", f"{root}/target", f"{root}/ckpt"
    schema = "change string, path string, content_hash string, seq long"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(changes)
        I.stream_apply_changes(spark, changes, schema, target, ckpt).awaitTermination()
        return {r["path"]: r["content_hash"] for r in I.read_table(spark, target).collect()}

    assert I.read_table(spark, target) is None
    assert run([("A", "a.py", "h1", 1), ("A", "b.py", "h2", 2), ("A", "n.py", None, 3)]) == {
        "a.py": "h1", "b.py": "h2", "n.py": None}
    # A and D of one key in one batch: the later one counts, in both orders
    assert run([("D", "a.py", None, 4), ("M", "b.py", "h3", 5), ("A", "c.py", "h", 7), ("D", "c.py", None, 6),
                ("A", "d.py", "h", 8), ("D", "d.py", None, 9)]) == {"b.py": "h3", "c.py": "h", "n.py": None}
    # a version without its mark (a crash while writing) is passed over
    os.makedirs(f"{target}/v=99")
    assert run([("A", "e.py", "h", 10)]) == {"b.py": "h3", "c.py": "h", "e.py": "h", "n.py": None}
    # a failing read of the target fails the batch and doesn't overwrite it
    last = max(I._versions(spark, target))
    for f in os.listdir(f"{target}/v={last}"):
        if f.endswith(".parquet"):
            with open(f"{target}/v={last}/{f}", "w") as out:
                out.write("broken")
    try:
        run([("A", "f.py", "h", 11)])
        raise AssertionError("the read error was swallowed")
    except Exception as e:
        assert "swallowed" not in str(e)
    assert max(I._versions(spark, target)) == last


def test_apply_changes_keeps_null_hashes_and_duplicates(spark):
    schema = "id long, path string, content_hash string"
    old = spark.createDataFrame([(1, "a", None), (2, "b", "h"), (3, "c", "x"), (4, "d", "x"), (5, "e", "g")], schema)
    new = spark.createDataFrame([(11, "a", None), (12, "b", None), (13, "c2", "x"), (14, "d2", "x"), (15, "d3", "x"),
                                 (16, "f", None)], schema)
    got = {(r.id, r.path, r.content_hash, r.change) for r in I.apply_changes(old, new).collect()}
    assert got == {(1, "a", None, "="), (12, "b", None, "M"), (3, "c2", "x", "R"), (4, "d2", "x", "R"),
                   (15, "d3", "x", "A"), (16, "f", None, "A")}
    assert {(r.path, r.id) for r in I.skip_unchanged(old, new).collect()} == {
        ("b", 12), ("c2", 13), ("d2", 14), ("d3", 15), ("f", 16)}


def test_carry_over_does_not_repeat_rows(spark):
    old = spark.createDataFrame([("x.f", "f", "one"), ("x.f", "f", "two"), ("y.g", "g", "three")],
                                "fqn string, name string, note string")
    new = spark.createDataFrame([(1, "x.f", "f"), (2, "y.g", "g"), (3, "z.g", "g")], "id long, fqn string, name string")
    got = sorted((r.id, r.note) for r in I.carry_over(old, new, ["note"], "fqn", "name").collect())
    assert got == [(1, None), (2, "three"), (3, "three")]


def test_enrichment_batches(spark, sf_dir):
    root = scratch()
    t = load_tables(spark, sf_dir)
    pending = t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")
    pending.repartition(5).write.parquet(f"{root}/pending")
    I.enrichment_batches(spark, f"{root}/pending", "doc_id long, source string", f"{root}/out",
                         f"{root}/ckpt", files_per_trigger=2).awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == pending.count()


def test_replace_by_key_only_touches_given_keys(spark):
    root = scratch()
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "repo string, v int")
    sinks.replace_by_key(df, root, "repo")
    sinks.replace_by_key(spark.createDataFrame([("r1", 10)], "repo string, v int"), root, "repo")
    got = {r["repo"]: r["v"] for r in spark.read.parquet(root).collect()}
    assert got == {"r1": 10, "r2": 2}


def test_export_docs_and_scan_corpus(spark):
    root = scratch()
    df = spark.createDataFrame([("svc.api/x y", "hello"), ('a<b>:c"d|e?f*g', "world")], "name string, text string")
    sinks.export_docs(df, root, "name", "text")
    names = sorted(d for d in os.listdir(root) if d.startswith("name="))
    assert names == ["name=abcdefg", "name=svc_api_x_y"]
    twins = spark.createDataFrame([("p" * 120 + c, c) for c in "abc"], "name string, text string")
    sinks.export_docs(twins, f"{root}-twins", "name", "text")
    assert len([d for d in os.listdir(f"{root}-twins") if d.startswith("name=")]) == 3
    listed = scan_corpus(spark, root, "*.txt")
    assert sorted(r["content"].strip() for r in listed.collect()) == ["hello", "world"]


def test_upsert_versions(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, version int")
    upd = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    got = {r["id"]: (r["v"], r["version"]) for r in sinks.upsert(target, upd, ["id"], "version").collect()}
    assert got == {1: ("a", 1), 2: ("B", 2), 3: ("c", 1)}
    wide = spark.createDataFrame([(1, "a", "kept"), (2, "b", "kept"), (None, "n", "kept")], "id long, v string, note string")
    rows = sinks.upsert(wide, spark.createDataFrame([(2, "B", 5), (None, "N", 6)], "id long, v string, extra int"), ["id"])
    assert {tuple(r) for r in rows.select("id", "v", "note", "extra").collect()} == {
        (1, "a", "kept", None), (2, "B", "kept", 5), (None, "N", "kept", 6)}


def test_stream_link_events_drops_late_and_repeated_events(spark):
    """ST-06 state: within the watermark a repeated publication links once;
    an event older than the watermark (after it advanced) is dropped."""
    import datetime as dt
    root = scratch()
    src = f"{root}/events"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    subs = spark.createDataFrame([(1, "click", 7, "t1", "click.*")],
                                 "id long, event_type string, repo long, queue string, pattern string")
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    first = [(1, t0, 1, "click", 1.0, "{}"), (2, t0 + dt.timedelta(minutes=5), 1, "click", 1.0, "{}")]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "late_" + os.path.basename(root).replace("-", "_")
    q = I.stream_link_events(published(stream), subs).writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    # the watermark is now t0 + 5 min - 1 hour; a later batch brings one late and one fresh event
    later = [(3, t0 + dt.timedelta(hours=3), 1, "click", 1.0, "{}"), (4, t0 - dt.timedelta(hours=2), 4, "click", 1.0, "{}")]
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    third = [(5, t0 - dt.timedelta(hours=1), 4, "click", 1.0, "{}")]   # older than the advanced watermark
    spark.createDataFrame(third, schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    rows = spark.sql(f"SELECT pub_repo, ts FROM {name}").collect()
    repos = sorted(r["pub_repo"] for r in rows)
    # user 1 (repo 1) links once despite two publications; user 4's events are both late
    assert repos == [1]
