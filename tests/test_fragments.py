"""Passages, blocks and correspondence: locators against plain line slicing, blocks against written-out ones, every finding once."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from ledgerline.operators import correspondence, fragments

SOURCE = "document string, format string, prefix string, text string"
LOCATOR = "id string, document string, marker string, first int, last int"


def plain_markers(text, prefix):
    """{marker: (first, last)} by reading the lines one after the other."""
    found, name, since, inner = {}, None, 0, 0

    def word(line, mark):
        rest = line.split(prefix + mark, 1)
        return rest[1].split()[0] if len(rest) == 2 and rest[1][:1].isspace() and rest[1].split() else None

    for n, line in enumerate(text.split("\n"), 1):
        if word(line, "-CLAIM-BEGIN"):
            name, since, inner = word(line, "-CLAIM-BEGIN"), n, 0
        elif name and prefix + "-SOURCE-BEGIN" in line:
            inner = n
        elif name and prefix + "-SOURCE-END" in line and inner:
            found[name], inner = (inner + 1, n - 1), 0
        elif word(line, "-CLAIM-END") and name:
            found.setdefault(name, (since + 1, n - 1))
            name = None
    return found


def sha(text):
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    return hashlib.sha256("\n".join(lines).strip().encode()).hexdigest()


def test_locators_against_plain_slices(spark):
    r = random.Random(6)
    texts, wanted = {}, []
    for d in range(6):
        lines = []
        for _ in range(r.choice([0, 3, 40, 300])):
            mark = r.choice(["-CLAIM-BEGIN m%d", "-CLAIM-END m%d", "-SOURCE-BEGIN", "-SOURCE-END", None, None, None])
            lines.append(r.choice(["", "words  ", "two words\t", "tail "]) if mark is None else "% P" + (mark % r.randint(0, 4) if "%d" in mark else mark))
        texts[str(d)] = "\n".join(lines)
    texts["6"] = "a\r\nb \r\n% P-CLAIM-BEGIN\n% P-CLAIM-BEGIN m0 more\n% P-SOURCE-BEGIN\nin\n% P-CLAIM-END m0"
    for d in [*texts, "none"]:
        wanted += [(f"{d}/m{i}", d, f"m{i}", None, None) for i in range(6)]
        wanted += [(f"{d}/{i}", d, None, *x) for i, x in enumerate([(1, 1), (2, 150), (5, 3), (0, 1), (-4, 2), (1, 10**6), (None, 3), (None, None)])]
    sources = spark.createDataFrame([(d, "markdown", "% P", t) for d, t in texts.items()] + [("null", None, "% P", None)], SOURCE)
    want = {}
    for id_, d, marker, first, last in wanted:
        if d in texts:
            lines = texts[d].split("\n")
            at = plain_markers(texts[d], "% P").get(marker) if marker else (first, last) if first is not None and last is not None and last <= len(lines) else None
            if at:
                text = "\n".join(lines[max(0, at[0] - 1) : at[1]]) if at[1] > 0 else ""
                want[id_] = (*at, text, sha(text))
    got = {x.id: (x.first, x.last, x.text, x.sha256) for x in fragments.resolve(spark.createDataFrame(wanted, LOCATOR), sources).collect()}
    assert got == want
    assert fragments.resolve(spark.createDataFrame([], LOCATOR), sources).collect() == []


def test_a_passage_over_many_runs(spark):
    text = "\n".join(f"line {i}" for i in range(1000))
    sources = spark.createDataFrame([("d", "text", "", text)], SOURCE)
    [r] = fragments.resolve(spark.createDataFrame([("x", "d", None, 60, 700)], LOCATOR), sources).collect()
    assert r.text == "\n".join(f"line {i}" for i in range(59, 700))


def shown(spark, format, text):
    [r] = spark.createDataFrame([(format, text)], "format string, text string").select(fragments.blocks(F.col("text"), F.col("format")).alias("b"), fragments.plain(fragments.blocks(F.col("text"), F.col("format"))).alias("p")).collect()
    return [(b.kind, *([(b.text, b.tag)] if b.kind == "display" else [(s.kind, s.text) for s in b.spans])) for b in r.b], r.p


def test_markdown_blocks(spark):
    text = "## A **bold** head\n\nPlain  *one* with $a+b$ and `code`,\nnext -- line~here ``so''.\n\n- one\n* two $y$\n+  \n\n$$ E = m \\tag{3} $$ tail\n\n\n**All** marked\n\n\\[ q \\]"
    blocks, plain = shown(spark, "markdown", text)
    assert blocks == [
        ("heading", ("text", "A "), ("strong", "bold"), ("text", " head")),
        ("paragraph", ("text", "Plain *one* with "), ("math", "a+b"), ("text", " and "), ("code", "code"), ("text", ", next – line here “so”.")),
        ("item", ("text", "one")),
        ("item", ("text", "two "), ("math", "y")),
        ("item", ("text", "+")),
        ("display", ("E = m", "3")),
        ("paragraph", ("text", "tail")),
        ("paragraph", ("strong", "All"), ("text", " marked")),
        ("display", ("q", "")),
    ]
    assert plain.split("\n")[0] == "A bold head" and plain.split("\n")[5] == "E = m"
    assert shown(spark, "markdown", "") == ([], "") and shown(spark, "text", " \n\n ") == ([], "")
    assert shown(spark, "markdown", "cost \\$5 and \\$6")[0] == [("paragraph", ("text", "cost $5 and $6"))]


def test_tex_blocks(spark):
    text = "\\subsection*{Title $k$}\n% a comment $\nText \\emph{hey} there \\% ok. % more\n\n\\sourceanchor{Thm 1} body\n\n\\begin{itemize}\n\n\\item[Lab] first $z$\n\n\\end{itemize}\n\\begin{align*} a &= b \\tag{7}\\end{align*} after \\[ q \\] \\href{u}{shown}"
    assert shown(spark, "tex", text)[0] == [
        ("heading", ("text", "Title "), ("math", "k")),  # the comment leaves a blank line
        ("paragraph", ("text", "Text "), ("emph", "hey"), ("text", " there % ok.")),
        ("anchor", ("text", "Thm 1")),
        ("paragraph", ("text", "body")),
        ("item", ("strong", "Lab"), ("text", "first "), ("math", "z")),
        ("display", ("a &= b", "7")),
        ("paragraph", ("text", "after")),
        ("display", ("q", "")),
        ("paragraph", ("text", "shown")),
    ]
    assert shown(spark, "tex", "\\section{Title $k$}\n\n\\begin{equation}x\\end{align}")[0] == [("heading", ("text", "Title "), ("math", "k")), ("paragraph", ("text", "x"))]


def test_every_correspondence_finding(spark):
    """One review for each code, and one review with nothing to find."""
    good = {"id": "f", "locator": {"marker": "m"}}
    clause = lambda **more: {"relation": "literal", "source_fragment": "f", **more}
    body = lambda *clauses, fragments=(good,), **more: {"source_fragments": list(fragments), "clause_map": list(clauses), **more}
    cases = {
        "source-fragment-id": body(fragments=[{"locator": "m"}]),
        "source-fragment-locator": body(fragments=[{"id": "f", "locator": {}}]),
        "source-fragment-role": body(fragments=[good, {"id": "g", "locator": "m", "role": "odd"}]),
        "source-fragment-primary": body(fragments=[good, {"id": "g", "locator": "m"}]),
        "source-interpretation": body(source_interpretation="odd"),
        "semantic-clause-status": body(clause(status="odd")),
        "clause-relation": body(clause(relation="odd")),
        "clause-kind": body(clause(kind="odd")),
        "clause-fragment": body({"source_fragment": "elsewhere"}),
        "clause-excerpt-required": body(clause(status="open")),
        "clause-excerpt-fragment": body({"source_excerpt": "words"}),
        "clause-evidence": body(clause(relation="refutation", source_excerpt="Are The")),
        "source-target-kind": body(clause(source_targets=[{"kind": "odd"}])),
        "source-target-fragment": body({"source_targets": [{"kind": "fragment", "fragment": "elsewhere"}]}),
        "source-target-text": body(clause(source_targets=[{"kind": "math"}])),
        "source-target-occurrence": body(clause(source_targets=[{"kind": "math", "text": "x", "occurrence": "no"}])),
        "lean-target-kind": body(clause(lean_targets=[{"kind": "odd"}])),
        "lean-target-name": body(clause(lean_targets=[{"kind": "binder"}])),
        "lean-target-constant": body(clause(lean_targets=[{"kind": "binder_type_dep"}])),
        "lean-target-excerpt": body(clause(lean_targets=[{"kind": "text"}])),
        "lean-target-declaration": body(clause(lean_targets=[{"kind": "result", "declaration": "not.there"}])),
        "clause-declaration": body(clause(lean_declarations=["not.there"])),
        "clause-evidence-unregistered": body(clause(correspondence_declarations="not.there")),
        "clause-excerpt": body(clause(source_excerpt="other words")),
        "source-interpretation-local": body({"relation": "inherited_standing_assumption", "source_fragment": "f", "source_excerpt": "are the"}, source_interpretation="local"),
        "source-interpretation-missing": body({"source_fragment": "g"}, fragments=[good, {"id": "g", "locator": "m", "role": "convention"}]),
        "source-interpretation-rationale": body({"source_fragment": "g"}, fragments=[good, {"id": "g", "locator": "m", "role": "standing_assumption"}], source_interpretation="nonlocal"),
        "source-interpretation-nonlocal": body(clause(), source_interpretation="nonlocal"),
        "": body(clause(status="derived", kind="scope", lean_declarations=["a.b"], source_excerpt="the -- WORDS ", lean_binder="h", lean_targets=["h", {"kind": "declaration"}]), source_interpretation="local"),
        " nothing": {},
        " clauses under the other name": {"clause_map": [], "clauses": [5, clause(source_fragment="", status="")]},
    }
    rows = [(k, f"row[{i}]", json.dumps(b), ["a.b"]) for i, (k, b) in enumerate(cases.items())] + [(" no object", "x", "[1]", None), (" null", "x", None, ["a.b"]), (" bad", "x", "{", [])]
    texts = spark.createDataFrame([(k, "f", "Here are the – words.") for k in cases], "review string, fragment string, text string")
    reviews = spark.createDataFrame(rows, "review string, location string, body string, declarations array<string>")
    got = {}
    for x in correspondence.validate(reviews, texts).collect():
        got[x.review] = sorted([*got.get(x.review, []), x.code])
    assert got.pop("clause-excerpt-fragment") == ["clause-excerpt-fragment", "source-target-fragment"]  # the quote is a target that has no fragment
    assert got == {k: [k] for k in cases if k.strip() and " " not in k and k != "clause-excerpt-fragment"}
    level = {x.code: (x.level, x.location) for x in correspondence.validate(reviews, texts).collect()}
    assert level["clause-excerpt-fragment"][0] == "warning" and level["clause-evidence"][0] == "error"
    assert level["lean-target-name"][1].endswith(".clause_map[0].lean_targets[0]") and level["source-fragment-id"][1].endswith(".source_fragments[0]")
    # Without texts quotes aren't judged; a vocabulary can be extended.
    assert "clause-excerpt" not in {x.code for x in correspondence.validate(reviews).collect()}
    assert {x.review: x.code for x in correspondence.validate(reviews, texts, {"odd": (True, False)}).collect()}["clause-relation"] == "clause-evidence"


def test_rows_of_a_review_document(spark):
    """A row is judged under its id, with its own names and its document's relations."""
    doc = {"relation_definitions": {"own": ""}, "rows": [{"id": "a", "lean_declarations": ["x.y"], "clauses": [{"relation": "own", "status": "odd", "lean_declarations": ["z.w"]}]}, {"id": "b", "clauses": [{"relation": "odd"}]}, {"clauses": [{"relation": "odd"}]}, 5]}
    docs = spark.createDataFrame([("d", json.dumps(doc)), ("e", "{}"), ("f", None)], "document string, body string")
    assert sorted((x.document, x.code, x.location) for x in correspondence.of_rows(docs).collect()) == [("d", "clause-declaration", "a.clause_map[0]"), ("d", "clause-relation", "b.clause_map[0]")]
