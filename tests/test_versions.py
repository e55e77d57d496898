"""Versions, edits, baselines and pins on small tables, against plain loops."""

import random
import uuid

import pytest

from ledgerline.functions.session import scratch_dir
from ledgerline.operators import pins, versions


def test_versions_and_lost_writers(spark):
    folder = f"{scratch_dir(spark)}/versions-{uuid.uuid4().hex}"
    first = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    assert versions.head(spark, folder) == 0 and versions.journal(spark, folder).count() == 0
    with pytest.raises(LookupError):
        versions.read(spark, folder)
    assert versions.commit(first, folder, 0, "ann", "begin") == 1
    second = versions.read(spark, folder).where("id = 1")
    assert versions.commit(second, folder, 1, "bob") == 2
    with pytest.raises(versions.LostWriter):
        versions.commit(first, folder, 1, "late")
    assert sorted(map(tuple, versions.read(spark, folder, 1).collect())) == [(1, "a"), (2, None)]
    assert [tuple(r) for r in versions.read(spark, folder).collect()] == [(1, "a")]
    assert versions.commit(first.where("id > 5"), folder, 2) == 3 and versions.read(spark, folder).count() == 0
    told = versions.journal(spark, folder).orderBy("version").collect()
    assert [(r.version, r.base, r.author, r.note, r.rows_before, r.rows) for r in told] == [(1, 0, "ann", "begin", None, 2), (2, 1, "bob", "", 2, 1), (3, 2, "", "", 1, 0)]
    assert told[1].digest_before == told[0].digest != told[1].digest


def test_a_writer_that_loses_at_the_last_moment_leaves_nothing(spark, monkeypatch):
    folder = f"{scratch_dir(spark)}/versions-{uuid.uuid4().hex}"
    df, place = spark.createDataFrame([(1,)], "id int"), versions._place

    def overtaken(*args):
        monkeypatch.setattr(versions, "_place", place)
        versions.commit(df.selectExpr("id + 1 as id"), folder, 0, "quick")
        return place(*args)

    monkeypatch.setattr(versions, "_place", overtaken)
    with pytest.raises(versions.LostWriter):
        versions.commit(df, folder, 0, "slow")
    assert [r.author for r in versions.journal(spark, folder).collect()] == ["quick"] and versions.read(spark, folder).first().id == 2


def test_edits(spark):
    r = random.Random(5)
    rows = [(k, r.randint(0, 9), r.choice("xyz") if k % 3 else None, k * 2) for k in range(8)] + [(3, 1, "again", 0), (None, 1, "none", 0)]
    fields, values = ["n", "text", "locked", "gone"], ["4", "q", None, "7"]
    edits = [(r.choice([*range(10), None]), r.choice(fields), r.choice(values), i) for i in range(60)]
    want = [list(x) for x in rows]
    told = []
    for k, field, value, nth in edits:
        hits = [x for x in want if x[0] is not None and x[0] == k]
        bad = "not-writable" if field not in ("n", "text") else "wrong-type" if field == "n" and value == "q" else None
        for x in hits or [None]:
            state = bad or ("written" if x else "no-row")
            before = None
            if state == "written":
                at = 1 if field == "n" else 2
                before, x[at] = x[at], (int(value) if field == "n" and value else value)
                told = [(*t[:5], "replaced", t[6]) if t[6] == (id(x), field) else t for t in told]
            told.append((k, field, nth, None if before is None else str(before), value, state, (id(x), field) if state == "written" else None))
    df = spark.createDataFrame(rows, "id int, n int, text string, key int")
    asked = spark.createDataFrame(edits, "key int, field string, value string, nth int")
    changed, report = versions.edited(df, asked, "id", ["n", "text"])
    order = lambda xs: sorted(map(tuple, xs), key=repr)
    assert changed.columns == df.columns and changed.dtypes == df.dtypes
    assert order(changed.collect()) == order(want)
    assert order(report.collect()) == order(t[:6] for t in told)
    with pytest.raises(ValueError):
        versions.edited(df, asked, "id", ["id"])
    assert order(versions.edited(df, asked.where("false"), "id", ["n"])[0].collect()) == order(rows)


def test_baseline_keeps_reasons(spark):
    found = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "key string")
    before = spark.createDataFrame([("a", "known"), ("c", "old"), (None, "x")], "key string, reason string")
    assert sorted(map(tuple, versions.accepted(found, before).collect())) == [("a", "known"), ("b", "")]


PIN = "target string, nth int, declaration string, type_expr_hash string, type_text_sha256 string, toolchain string, pinned_on string, note string"


def test_pins(spark):
    targets = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b"), ("t", 2, "lost"), ("t", 3, "a"), ("u", 0, None), ("v", 0, "c"), ("v", 1, "d"), ("v", 2, "e")], "target string, nth int, declaration string")
    records = spark.createDataFrame([("a", "1", "x", False), ("b", "2", "y", None), ("lost", "3", "z", True), ("c", "4", "w", False), ("d", "5", "v", False), ("e", None, "u", False)], "name string, type_expr_hash string, type_text_sha256 string, missing boolean")
    old = spark.createDataFrame(
        [("t", 0, "a", "1", "x", "", "d0", "mine"), ("t", 1, "a", "9", "x", "", "d1", "later"), ("t", 2, "stray", "1", "x", "", "d0", ""), ("u", 0, "b", "2", "y", "", "d0", "kept?"),
         ("w", 0, "b", "2", "y", "", "d0", "elsewhere"), ("v", 0, "c", "4", "other", "", "d0", ""), ("v", 1, "d", "5", "v", "", "d0", ""), ("v", 2, "e", None, "u", "", "d0", "")], PIN)
    states = {(r.target, r.declaration): (r.claimed, r.state) for r in pins.judged(targets, old, records).collect()}
    assert states == {
        ("t", "a"): (True, "drift"), ("t", "b"): (True, "unpinned"), ("t", "lost"): (True, "unpinned"), ("t", "stray"): (False, "gone"),
        ("u", "b"): (False, "current"), ("v", "c"): (True, "text-drift"), ("v", "d"): (True, "current"), ("v", "e"): (True, "drift"),
    }
    codes = {(r.code, r.severity, r.declaration) for r in pins.findings(targets, old, records).where("target = 't'").collect()}
    assert codes == {("statement-drift", "error", "a"), ("statement-unpinned", "warning", "b"), ("statement-unpinned", "warning", "lost"), ("statement-pin-gone", "error", "stray")}
    new, lost = pins.renew(targets, old, records, "today", "tool")
    got = {(r.target, r.declaration): (r.nth, r.type_expr_hash, r.pinned_on, r.note) for r in new.collect()}
    assert got == {
        ("t", "a"): (0, "1", "today", "mine"), ("t", "b"): (1, "2", "today", None), ("w", "b"): (0, "2", "d0", "elsewhere"),
        ("v", "c"): (0, "4", "today", None), ("v", "d"): (1, "5", "today", None), ("v", "e"): (2, None, "today", None),
    }
    assert [tuple(r) for r in lost.collect()] == [("error", "statement-pin-missing", "t", "lost")]
    assert {r.note for r in pins.renew(targets, old, records, "today", note="new")[0].where("target = 't'").collect()} == {"new"}
    assert pins.findings(targets.where("false"), old, records).count() == 0
