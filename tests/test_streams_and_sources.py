import pytest
from pyspark.sql import functions as F

from speechmill.sources import manifest
from speechmill.streaming import windows


@pytest.mark.parametrize("step", [1, 7, 100])
def test_chunks_do_not_depend_on_arrival(step):
    samples = [float(x) for x in range(45)]
    chunker, blocks = windows.Chunker(10, 3, 2), []
    for at in range(0, len(samples), step):
        blocks += chunker.feed(samples[at : at + step])
    blocks += chunker.finish()
    assert [(b[0], b[2]) for b in blocks] == [(0, 0), (10, 3), (20, 3), (30, 3), (40, 3)]
    assert [x for o, s, lead in blocks for x in s[lead : lead + 10]] == samples
    assert blocks[1][1] == samples[7:22]


def test_hourly_counts_as_stream_and_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    query = windows.hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("hours").collect()) == sorted(windows.hourly_counts(events).collect())


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in windows.sessions(rows).collect()) == [1, 2]


def test_lenient_and_collecting(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\nnot json\n{"id": "b", "x": 2}\n')
    assert sorted(r.id for r in manifest.read_lenient(spark, str(path), "id string, n int").collect()) == ["a", "b"]
    assert [r._broken for r in manifest.read_collecting(spark, str(path), "id string, n int").collect() if r._broken] == ["not json"]


def test_tasks(spark, tmp_path):
    lines = [
        (1, '{"text": "a", "output": "x.wav"}'), (2, ""), (3, "{bad"), (4, '{"text": "a", "extra": 1}'), (5, '{"text": "a", "text_file": "b"}'), (6, '{"text": "b", "output": "x.wav"}'),
        (7, '{"text": "b", "emotion_weight": 0.5}'), (8, '{"text": "b", "emotion_vector": "[0,0,0,0,0,0,0,0.9]"}'), (9, '{"text": "b", "silence_after_ms": true}'), (10, '{"text": "ok"}'),
    ]
    got = {r.line: r.error for r in manifest.check_tasks(spark.createDataFrame(lines, "line long, value string")).collect()}
    assert got[1] is None and got[10] is None and 2 not in got
    assert got[3] == "not a JSON object" and got[4] == "unknown fields: extra" and got[6] == "output of an earlier line"
    assert all(got[k] for k in (5, 7, 8, 9))
    path = tmp_path / "m.jsonl"
    path.write_text('{"text": "a"}\n\n{bad\n')
    with pytest.raises(manifest.ManifestError, match="line 3"):
        manifest.read_tasks(spark, str(path))


def test_replacing_write(spark, tmp_path):
    for n in (3, 2):
        manifest.write_replacing(spark.range(n), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
