"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression over whole names; ``*`` crosses separators."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += "\\" + c if c in "\\.^$+{}()|[]" else c
        i += 1
    return f"(?s)^{out}$"


def matches(name: Column, pattern: str) -> Column:
    """Glob if it has glob characters, dotted prefix otherwise."""
    if any(c in pattern for c in "*?["):
        return name.rlike(glob_pattern(pattern))
    return (name == pattern) | name.startswith(pattern + ".")


def prose(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    """The form in which excerpts are compared: en and em dashes and double hyphens as one hyphen, tildes and no-break spaces as blanks, curly quotes (but the left single one) straight, white space collapsed, lower case."""
    plain = F.translate(text, "\u2013\u2014\u00a0~\u201c\u201d\u2019", "--  \"\"'")
    return F.lower(prose(F.replace(plain, F.lit("--"), F.lit("-"))))


def without_control(text: Column) -> Column:
    """Terminal escape sequences and carriage returns dropped."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|\r", "")


def excerpt(text: Column, needle: Column, width: int = 40) -> Column:
    """The needle with up to ``width`` characters on either side, with ellipses where text is left out."""
    at = F.call_function("instr", text, needle)
    start = F.greatest(at - width, F.lit(1))
    end = at + F.length(needle) + width
    body = F.substring(text, start, end - start)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise("")))


def identifiers(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct identifiers in order of first appearance, without stop words and single characters."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}_][\p{L}\p{N}_'.]*"), F.lit(0)))
    return F.filter(F.array_except(found, F.array(*[F.lit(s) for s in stop]).cast("array<string>")), lambda x: F.length(x) > 1)


def imports(text: Column) -> Column:
    """Imported modules of a source text, in order, once each; modifiers before ``import`` are allowed."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:(?:public|private|meta)[ \t]+)*import[ \t]+(?:all[ \t]+)?([^\n]+)$"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))))


def suffixes(path: Column) -> Column:
    """Every suffix of a path, with its depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.concat_ws("/", F.slice(parts, -i, i)).alias("suffix")))
