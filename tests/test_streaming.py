"""Streams of call files against the same files read at once."""

import random

from methylake.operators.coverage import coverage
from methylake.sources.text import calls as call_files
from methylake.streaming.coverage import batch_coverage, call_stream, coverage_of, running_coverage


def lines(seed):
    r = random.Random(seed)
    return "a header line\n" + "".join(f"r{i}\t{r.choice('+-')}\tchr{r.randrange(2)}\t{r.randrange(1, 30)}\t{r.choice('zZxXhH')}\n" for i in range(200))


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "CpG_OT_a.txt").write_text(lines(1))
    (folder / "CpG_OT_b.txt").write_text(lines(2))
    run = lambda: batch_coverage(call_stream(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (folder / "CpG_OT_c.txt").write_text(lines(3))
    run()
    names = ["chr", "pos", "m", "u", "pct"]
    want = sorted(tuple(r) for r in coverage(call_files(spark, str(folder))).select(*names).collect())
    assert want and sorted(tuple(r) for r in coverage_of(spark, str(tmp_path / "out")).select(*names).collect()) == want
    q = running_coverage(call_stream(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("running").select(*names).collect()) == want
