"""Saved sources as a data source, batch and stream; the inbox's state in streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators import inbox
from quern.sources import files, saved, sinks
from quern.streaming import inbox as stream

ITEM = "<rss><channel><item><title>%s</title><link>https://a/%s</link><category>c</category></item></channel></rss>"


def test_a2_source_in_batch_and_stream(spark, tmp_path):
    saved.register(spark)
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    (folder / "a.xml").write_text(ITEM % ("One", 1))
    (folder / "b.xml").write_text("broken")
    batch = spark.read.format("saved_source").load(str(folder))
    assert {(r.title, r.error is None) for r in batch.collect()} == {("One", True), (None, False)}
    plain = files._scan(spark, str(folder), files._feed, files.STORY)
    cols = ["title", "url", "tags", "item_ord"]
    assert batch.where("error IS NULL").select(cols).collect() == plain.where("error IS NULL").select(cols).collect()

    def drained():
        q = spark.readStream.format("saved_source").load(str(folder)).writeStream.format("parquet").option("path", str(state / "rows")).option("checkpointLocation", str(state / "log")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(str(r.title) for r in spark.read.parquet(str(state / "rows")).collect())

    assert drained() == ["None", "One"]
    (folder / "c.xml").write_text(ITEM % ("Two", 2))
    assert drained() == ["None", "One", "Two"] == drained()
    (folder / "d.html").write_text('<div class="card"><a href="/x"><h3>Head</h3></a></div>')
    cards = spark.read.format("saved_source").options(kind="cards", cards="div.card", host="https://h").load(str(folder / "d.html")).head()
    assert (cards.title, cards.url, cards.item_ord) == ("Head", "https://h/x", 0)


def test_w8_state_with_time_to_live(spark, tmp_path):
    stream.store(spark)
    folder, out = str(tmp_path / "in"), tmp_path / "out"
    at = datetime(2026, 3, 3)
    frame = lambda rows: spark.createDataFrame([(i, k, at) for i, k in rows], stream.KIND).coalesce(1)

    def run(days):
        rows = spark.readStream.schema(stream.KIND).parquet(folder)
        q = stream.unprocessed(rows, days).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.msg_id for r in spark.read.parquet(str(out / "rows")).collect())

    try:
        frame([("a", "message"), ("b", "message"), ("c", "dismissed"), ("c", "message")]).write.mode("append").parquet(folder)
        assert run(7) == ["a", "b"]
        frame([("a", "message"), ("d", "message"), ("c", "message"), ("b", "dismissed")]).write.mode("append").parquet(folder)
        assert run(7) == ["a", "b", "d"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_t20_runs_prune_only_with_new_messages(spark, tmp_path):
    """Micro-batches equal runs one after another, of which only those with new messages prune."""
    start = datetime(2026, 3, 1)
    days = [(0, "ab"), (5, "ac"), (8, "c"), (9, "a"), (20, "abd")]
    kind = "ord long, msg_id string, subject string, sender string, sender_email string, `to` string, date timestamp, snippet string, body_plain string, headers map<string,string>, is_reply boolean, at timestamp"
    frame = lambda d, ids: spark.createDataFrame([(i, x, "s", "", "x@y", "", None, "", "b", {}, False, start + timedelta(days=d)) for i, x in enumerate(ids)], kind)
    empty = spark.createDataFrame([], "msg_id string, category string, subject string, processed_at timestamp")
    want, processed = [], empty
    for i, (d, ids) in enumerate(days):
        frame(d, ids).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        out = inbox.checked(frame(d, ids), processed, empty, start + timedelta(days=d))
        want.append(sorted(r.msg_id for r in out["new"].collect()))
        processed = spark.createDataFrame(out["processed"].collect(), processed.schema)
    # On day 9 no run with new messages has pruned since day 5: "a" is still known; the run of day 20 prunes all but its own.
    assert want == [["a", "b"], ["c"], [], [], ["d"]]
    root = str(tmp_path / "t")
    for i in range(len(days)):  # one folder more for each run of the stream
        rows = spark.readStream.schema(frame(0, "").schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / f"in/[0-{i}]"))
        stream.runs(rows, root).awaitTermination()
    got = spark.read.parquet(f"{root}/new").select("run", "msg_id").collect()
    assert [sorted(r.msg_id for r in got if r.run == i) for i in range(len(days))] == want
    assert sorted(map(tuple, sinks.load_snapshot(spark, f"{root}/processed").collect())) == sorted(map(tuple, processed.collect()))
