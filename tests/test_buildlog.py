"""A log read in pieces against the whole log, whatever the cut, the order and the repeats."""

import random
import tempfile

from pyspark.sql import functions as F

from ledgerline.operators import logs
from ledgerline.streaming import buildlog

SAID = [
    "plain start", "✓ [1/400] Built A", "error: A/B.lean:12:4: bad — tèrm", "  more of it", "", "  and more", "✖ [2/400] Built B", "after a mark", "[21/400] x", "[21/400] x", "[40/400] x", "[41/400] x", "[500/400] x", "[400/400] done",
    "C.lean:1:2: warning: unused\x1b[0m", "- an item of its own", "Some required targets logged failures:", "- A", "- B", "not listed", "- C", "info: plain note", "error: build failed", "trace: x.lean:3:1: deep", "last words",
]


def text_of(r):
    return "".join(r.choice(SAID) + r.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(r.randint(0, 60))) + r.choice(["", "no line break", "error: open end"])


def pieces_of(r, run, text):
    data, out, at = text.encode(), [], 0
    while at < len(data) or not out:
        size = r.choice([1, 2, 3, 17, 90])
        out.append((run, len(out), data[at : at + size], at + size >= len(data)))
        at += size
    return out


def split(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def test_any_cut_equals_the_whole_log(spark):
    r = random.Random(8)
    texts = {f"run{i}": text_of(r) for i in range(12)}
    pieces = [p for run, text in texts.items() for p in pieces_of(r, run, text)]
    repeated = [*pieces, *r.sample(pieces, len(pieces) // 3)]
    r.shuffle(repeated)
    base = tempfile.mkdtemp(prefix="ledgerline-test-")
    third = len(repeated) // 3 + 1
    for i in range(3):  # three runs of the stream that go on from the state
        spark.createDataFrame([(*p,) for p in repeated[i * third : (i + 1) * third]] + [(None, 0, b"x", False), ("run0", None, b"x", False), ("run1", 0, None, None)], buildlog.PIECE).repartition(2).write.mode("append").parquet(f"{base}/in")
        got = buildlog.keep_lines(spark.readStream.schema(buildlog.PIECE).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/out")
    whole = spark.createDataFrame([(run, n, x) for run, text in texts.items() for n, x in enumerate(split(text))], "run string, n long, line string")
    found, roles = logs.parse_output(whole)
    assert sorted((x.run, x.n, x.role) for x in got.collect()) == sorted((x.run, x.n, x.role) for x in roles.collect())
    assert sorted(map(str, logs.diagnostics(got).collect())) == sorted(map(str, found.collect()))


def test_progress_is_throttled(spark):
    base = tempfile.mkdtemp(prefix="ledgerline-test-")
    spark.createDataFrame([("r", "\n".join(f"[{i}/100] step" for i in [*range(1, 101), 100, 7, 120]))], "run string, text string").select("*").createOrReplaceTempView("told")
    buildlog.cut(spark.table("told"), 13).write.parquet(f"{base}/in")
    got = buildlog.keep_lines(spark.readStream.schema(buildlog.PIECE).parquet(f"{base}/in"), f"{base}/out")
    assert [x.done for x in got.where("shown").orderBy("n").collect()] == [*range(1, 100, 5), 100]
    assert got.where(F.col("done").isNotNull()).count() == 102 and got.count() == 103


def test_cut_joins_up(spark):
    rows = [("a", "héllo\nwörld " * 20), ("b", "")]
    got = {}
    for x in sorted(buildlog.cut(spark.createDataFrame(rows, "run string, text string"), 7).collect(), key=lambda x: x.seq):
        got[x.run] = got.get(x.run, b"") + bytes(x.data)
        ends = x.last
    assert ends and {k: v.decode() for k, v in got.items()} == dict(rows)
