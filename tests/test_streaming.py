import numpy as np
import pytest

from cadenza.operators import envelope as batch_envelope
from cadenza.operators import slices, tempo
from cadenza.streaming import stateful


def run(spark, tmp_path, rows, schema, make, cuts):
    """Feeds rows in as many files as there are cuts, one file a batch; gives what the query appends."""
    folder = str(tmp_path / "in")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder))
    q = out.writeStream.format("memory").queryName("stream_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.sql("SELECT * FROM stream_out").collect()))


@pytest.fixture
def samples():
    rng = np.random.default_rng(3)
    x = rng.integers(-200, 200, 3_000)
    x[[500, 1300, 1310, 2400]] = [20000, -25000, 22000, 30000]
    return [(1, k, int(v)) for k, v in enumerate(x)]


def test_onsets_equal_batch(spark, tmp_path, samples):
    schema = "stream_id long, n long, v long"
    got = run(spark, tmp_path, samples, schema, lambda s: stateful.onsets(s, 100), [0, 505, 1305, 3_000])
    want = slices.onsets(spark.createDataFrame(samples, schema), 100)
    assert got and got == sorted(map(tuple, want.collect()))


def test_steps_do_not_depend_on_batches(spark, samples):
    import pandas as pd

    f = pd.DataFrame(samples, columns=["stream_id", "n", "v"])
    for size in (1, 7, 64, 3_000):
        state, out = {}, []
        step = stateful.onset_step(100)
        for a in range(0, len(f), size):
            out += step(state, f[a : a + size])
        assert out == [(0, out[0][1]), *out[1:]] and len(out) >= 3
        if size == 1:
            first = out
        assert out == first


def test_novelty_and_beats_equal_batch(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    rows = [(1, k, rng.integers(0, 256, 64).tolist()) for k in range(120)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_no long, bands array<int>")
    want = tempo.novelty(frames).orderBy("frame_no").collect()
    state, got = {}, []
    f = pd.DataFrame(rows, columns=["stream_id", "frame_no", "bands"])
    for a in range(0, 120, 17):
        got += stateful.novelty_step(state, f[a : a + 17])
    assert np.allclose([r["novelty"] for r in want], [g[-1] for g in got])
    nov = pd.DataFrame([(g[0], g[-1]) for g in got], columns=["frame_no", "novelty"])
    beats, state = [], {}
    for a in range(0, 120, 13):
        beats += stateful.beat_step(6.0)(state, nov[a : a + 13])
    grid = tempo.beat_grid(tempo.novelty(frames), 6.0).orderBy("beat").collect()
    assert [(b["beat"], b["frame_no"], b["interpolated"]) for b in grid] == beats


def test_envelope_equals_batch(spark, tmp_path, samples):
    schema = "stream_id long, n long, v long"
    got = run(spark, tmp_path, samples, schema, stateful.envelope, [0, 100, 1_000, 3_000])
    want = batch_envelope.level0(spark.createDataFrame(samples, schema)).where("chunk_no < 23")
    assert got == sorted(map(tuple, want.collect()))
