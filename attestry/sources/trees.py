"""Changed files of a commit from hash trees: a subtree whose hash a parent shares is not read.

A tree object is rows (tree_id, name, mode, object_id), one for each entry; entries of mode TREE are trees themselves.  All
directories of one depth are walked at once, so there are as many rounds as the changed paths are deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

TREE = 0o040000


def changed_in_trees(objects: DataFrame, tree: str | None, parents: list[str]) -> DataFrame:
    """path, mode, blob_id, status: as files.changed_files on the flat trees.

    tree: the commit's root tree (None: nothing is left); parents: those of its parents.  A directory is read where its hash differs from
    that of some parent that has it; where another parent has the same, only its deletions are left to find.
    Entries with a null name or object are taken as missing.
    """
    spark = objects.sparkSession
    own, others = tree, sorted({p for p in parents if p != tree})
    todo = spark.createDataFrame([("", own, own is not None and tree in parents, others)], "dir string, own string, same boolean, others array<string>")
    # without parents every file is new; else a directory without other parents holds no difference
    todo = todo if not parents else todo.filter(F.size("others") > 0)
    entry = objects.select("tree_id", "name", "mode", "object_id").filter("name IS NOT NULL AND object_id IS NOT NULL")
    found = []
    while not todo.isEmpty():
        mine = todo.select("dir", "same", F.col("own").alias("tree_id")).join(entry, "tree_id").select("dir", "same", "name", F.struct("mode", "object_id").alias("e"), F.lit(True).alias("mine"))
        theirs = todo.select("dir", "same", F.explode("others").alias("tree_id")).join(entry, "tree_id").select("dir", "same", "name", F.struct("mode", "object_id").alias("e"), F.lit(False).alias("mine"))
        # at most one row for each parent, and one for the tree, share a name
        at = mine.unionByName(theirs).groupBy("dir", "same", "name").agg(F.max(F.when(F.col("mine"), F.col("e"))).alias("e"), F.collect_set(F.when(~F.col("mine"), F.col("e"))).alias("p"))
        is_tree = lambda x: x["mode"] == TREE
        e, trees, blobs = F.col("e"), F.filter("p", is_tree), F.filter("p", lambda x: ~is_tree(x))
        held = F.array_contains(F.col("p"), e)
        level = store.cut(at.select(
            F.concat("dir", "name").alias("path"), (F.col("same") | F.coalesce(held, F.lit(False))).alias("same"), F.when(e.isNotNull() & (e["mode"] != TREE), e).alias("blob"),
            F.when(e["mode"] == TREE, e["object_id"]).alias("own"), blobs.alias("blobs"), F.transform(trees, lambda x: x["object_id"]).alias("trees"),
        ), "trees")
        new = level.filter("blob IS NOT NULL AND NOT same").select("path", "blob.mode", F.col("blob.object_id").alias("blob_id"), F.when(F.size("blobs") > 0, "modified").otherwise("added").alias("status"))
        most = lambda c: F.array_max(F.transform("blobs", lambda x: x[c]))
        gone = level.filter("blob IS NULL AND size(blobs) > 0").select("path", most("mode").alias("mode"), most("object_id").alias("blob_id"), F.lit("deleted").alias("status"))
        found.append(new.unionByName(gone))
        below = level.select(F.concat("path", F.lit("/")).alias("dir"), "own", "same", F.filter("trees", lambda x: ~x.eqNullSafe(F.col("own"))).alias("others"))
        todo = below.filter((F.size("others") > 0) | (F.col("own").isNotNull() & ~F.col("same")))
    if not found:
        return spark.createDataFrame([], "path string, mode int, blob_id string, status string")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
