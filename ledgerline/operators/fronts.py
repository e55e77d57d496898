"""Whether a presentation delegates to what it fronts, shares a core with it, or stands alone.

Both sides are searched to a fixed depth. That a search was cut is a value of its own (``cut``): without a relation
found, a cut search has not shown that there is none, and the verdict is unknown.

Defined cases: a name that is not in the graph, nor by its last part the only one, is unknown on either side; null names are unknown; pairs that repeat are told
once each; a front that is the declaration itself does not delegate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.session import materialise
from ledgerline.operators import graph

#: Levels that a search goes down.
DEPTH = 4
#: Kinds whose parts are vocabulary and no proved core.
VOCABULARY = ("inductive", "structure")


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def resolved(names: DataFrame, decls: DataFrame) -> DataFrame:
    """(raw, name) of names (column ``raw``) that stand in the graph as they are, or alone with their last part."""
    exact = decls.select(F.col("name").alias("raw"), F.col("name").alias("exact"))
    tail = decls.where(F.col("name").contains(".")).groupBy(last_part(F.col("name")).alias("tail")).agg(F.count(F.lit(1)).alias("hits"), F.min("name").alias("only")).where("hits = 1")
    found = names.select("raw").distinct().join(exact, "raw", "left").withColumn("tail", last_part(F.col("raw"))).join(tail, "tail", "left")
    return found.select("raw", F.coalesce("exact", "only").alias("name")).where("name is not null")


def proof_cores(decls: DataFrame) -> DataFrame:
    """Names of public theorems that are no part of a structure or inductive type; decls are (name, kind, internal)."""
    above = F.when(F.col("name").contains("."), F.expr("substring(name, 1, length(name) - length(element_at(split(name, '[.]'), -1)) - 1)")).otherwise(F.col("name"))
    types = decls.where(F.col("kind").isin(*VOCABULARY)).select(F.col("name").alias("above"))
    return decls.where("kind = 'theorem' and not internal").select("name", above.alias("above")).join(types, "above", "left_anti").select("name")


def verdicts(claims: DataFrame, deps: DataFrame, decls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(name, front, state, via, depth) for claims (name, front); deps are (src, dst): a declaration and what it uses.

    delegates: the declaration reaches the front, at ``depth``. shared-core: both reach the theorem ``via``, the nearest
    to both together. independent: neither, and both searches came to their end. unknown: otherwise.
    """
    claims = claims.select("name", "front").distinct()
    names = claims.select(F.col("name").alias("raw")).unionByName(claims.select(F.col("front").alias("raw")))
    known = materialise(resolved(names, decls), "fronts")
    own = known.select(F.col("raw").alias("name"), F.col("name").alias("own"))
    other = known.select(F.col("raw").alias("front"), F.col("name").alias("other"))
    pairs = materialise(claims.join(own, "name", "left").join(other, "front", "left"), "fronts")
    among = deps.join(decls.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
    walked = materialise(graph.walk(among, known.select(F.col("name").alias("node")).distinct(), depth), "fronts")
    cut = walked.groupBy("seed").agg((F.max("distance") >= depth).alias("cut"))
    near = walked.select(F.col("seed").alias("own"), F.col("node").alias("other"), F.col("distance").alias("direct")).where("direct > 0")
    # What both sides reach: only theorems that can be a core, only for the pairs in question.
    core = materialise(walked.join(proof_cores(decls).withColumnRenamed("name", "node"), "node"), "fronts")
    left = core.select(F.col("seed").alias("own"), "node", F.col("distance").alias("n"))
    right = core.select(F.col("seed").alias("other"), "node", F.col("distance").alias("m"))
    met = pairs.select("own", "other").distinct().join(left, "own").join(right, ["other", "node"])
    shared = met.groupBy("own", "other").agg(F.min(F.struct((F.col("n") + F.col("m")).alias("total"), "n", F.col("node").alias("via"))).alias("best"))
    whole = pairs.join(near, ["own", "other"], "left").join(shared, ["own", "other"], "left")
    whole = whole.join(cut.withColumnsRenamed({"seed": "own", "cut": "own_cut"}), "own", "left").join(cut.withColumnsRenamed({"seed": "other", "cut": "other_cut"}), "other", "left")
    lost, direct, best = F.col("own").isNull() | F.col("other").isNull(), F.col("direct"), F.col("best")
    state = F.when(lost, "unknown").when(direct.isNotNull(), "delegates").when(best.isNotNull(), "shared-core").when(F.col("own_cut") | F.col("other_cut"), "unknown").otherwise("independent")
    told = F.when(state == "delegates", direct).when(state == "shared-core", F.col("best.n"))
    return whole.select("name", "front", state.alias("state"), F.when(state == "shared-core", F.col("best.via")).alias("via"), told.alias("depth"))
