"""Checklists against a plain loop over paths."""

import fnmatch
from pathlib import PurePosixPath as Path

from ledgerline.operators import checklist

FILES = {
    "Lib/A/x.lean": 9, "Lib/A/y.lean": 30, "Lib/A/n.md": 4, "Lib/top.lean": 2, "README.md": 7, "Makefile": 3, "build/out/z.lean": 5, "buildings/k.py": 6, ".bashrc": 1,
    "Lib/A/data.JSON": 8, "a/b/c/d.tex": 2, "a/b/e.": 1, "vendor": 4, "Lib/é/Ω.lean": 12, "Lib/new.lean": 3,
}


def plain_group(path, depth=2, by_kind=True):
    parts = Path(path).parts
    prefix = "/".join(parts[:depth]) if len(parts) > 1 else checklist.LOOSE
    suffix = Path(path).suffix if not path.endswith(".") else ""
    return prefix if suffix == ".lean" or not by_kind else f"{prefix} :: {checklist.KINDS.get(suffix.lower(), 'other')}"


def files(spark, rows=FILES):
    return spark.createDataFrame([*rows.items(), (None, 4)], "path string, lines int")


def test_selection(spark):
    for include, exclude in ((("*",), checklist.EXCLUDED), (("*.lean", "a/*"), ("Lib/A/*",)), ((), ("[a-z]*.md", "Lib/?.lean")), (("?????*[!n]",), ())):
        want = {p for p in FILES if not include or any(fnmatch.fnmatchcase(p, x) for x in include)}
        want -= {p for p in FILES if any(fnmatch.fnmatchcase(p, x) or p.startswith(x.rstrip("*").rstrip("/")) for x in exclude)}
        assert {r.path for r in checklist.select(files(spark), include, exclude).collect()} == want, (include, exclude)


def test_marks_and_progress(spark):
    lines = spark.createDataFrame([(x,) for x in ["- [x] `Lib/A/x.lean` — 9 lines", "  - [X]  `Lib/old.lean`", "- [ ] `Lib/A/y.lean`", "[x] `Makefile`", None, "- [x] `Lib/é`", "- [x] `gone.py`"]], "line string")
    marked = checklist.marks(lines)
    assert {r.path for r in marked.collect()} == {"Lib/A/x.lean", "Lib/old.lean", "Lib/é", "gone.py"}
    carried = checklist.renamed(marked, spark.createDataFrame([("Lib/old.lean", "Lib/new.lean"), ("other", "Makefile"), (None, "q"), ("gone.py", None)], "old string, new string"))
    done = {"Lib/A/x.lean", "Lib/old.lean", "Lib/new.lean", "Lib/é", "gone.py"}
    assert {r.path for r in carried.collect()} == done
    kept, rows = checklist.select(files(spark), exclude=()), {}
    for p, n in FILES.items():
        rows.setdefault(plain_group(p), []).append((-n, p))
    listed = {(r.group, r.nth): (r.path, r.lines, r.done) for r in checklist.listing(kept, carried).collect()}
    assert listed == {(g, i): (p, -n, p in done) for g, m in rows.items() for i, (n, p) in enumerate(sorted(m), 1)}
    summed = checklist.groups(kept, carried, carried)
    got = {r.group: (r.files, r.lines, r.files_done, r.lines_done, r.ready, r.done) for r in summed.collect()}
    assert got == {
        g: (len(m), -sum(n for n, _ in m), sum(p in done for _, p in m), -sum(n for n, p in m if p in done), all(p in done for _, p in m), g in done) for g, m in rows.items()
    }
    ready = sum(all(p in done for _, p in m) and g not in done for g, m in rows.items())
    assert tuple(checklist.progress(summed).first()) == (2, len(FILES), 12, sum(FILES.values()), sum(g in done for g in rows), len(rows), ready)
    assert {r.group for r in checklist.groups(kept, carried, carried, depth=1, by_kind=False).collect()} == {plain_group(p, 1, False) for p in FILES}


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "path string")
    again = spark.createDataFrame([("a/b.lean", 3), ("a/b.lean", 5), ("a/c.lean", None)], "path string, lines int")
    kept = checklist.select(again)
    assert sorted(map(tuple, kept.collect())) == [("a/b.lean", 5), ("a/c.lean", 0)]
    assert tuple(checklist.progress(checklist.groups(kept.where("false"), none, none)).first()) == (0,) * 7
