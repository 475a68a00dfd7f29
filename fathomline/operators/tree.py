"""Trees: paths of bounded depth without recursion, cycle checks, heading trees with chunk references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.sources.shared import stored


def paths(nodes: DataFrame) -> DataFrame:
    """node, path (root first) and cyclic, for an adjacency list (node, parent); a chain of n hops takes log2(n) joins.

    Pointers double until no node that is still below another gets any further: what is left then leads into a cycle, and
    its path is what lies between. Each step is stored, so that the plan doesn't grow; a node whose parent isn't there is a root.
    """
    known = nodes.select(F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    sound = nodes.join(known, "parent", "left").withColumn("parent", F.when(F.col("_known"), F.col("parent")))
    hop = stored(sound.select("node", F.col("parent").alias("up"), F.array("node").alias("path")))
    count = nodes.count()
    reach = 1
    while reach < count and not hop.where("up is not null").isEmpty():
        above = hop.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        joined = F.concat(F.coalesce("path2", F.array().cast(hop.schema["path"].dataType)), "path")
        # a path that meets itself is a cycle's: it stays as it is, and its pointer too
        closed = F.size(F.array_intersect(F.coalesce("path2", F.array().cast(hop.schema["path"].dataType)), F.col("path"))) > 0
        hop = stored(hop.join(above, "up", "left").select("node", F.when(closed, F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(closed, F.col("path")).otherwise(joined).alias("path"), closed.alias("closed")))
        if hop.where("up is not null and not closed").isEmpty():
            break
        hop = hop.drop("closed")
        reach *= 2
    return hop.select("node", "path", F.col("up").isNotNull().alias("cyclic"))


def attach(headings: DataFrame, chunks: DataFrame) -> DataFrame:
    """References of chunks to the headings whose line range they overlap, numbered in each heading."""
    from pyspark.sql import Window

    both = headings.join(chunks, "doc_id").where("first_line <= chunk_last and last_line >= chunk_first")
    place = F.row_number().over(Window.partitionBy("doc_id", "heading").orderBy("chunk_first", "chunk"))
    return both.select("doc_id", "heading", "chunk", (place - 1).alias("sort_order"))


def parent_problems(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (move, dataset, owner, folder, parent) with ``problem``: null where the folder may go under that parent.

    ``folders`` are rows (dataset, owner, folder, parent) with unique folders; ``folder`` of a move is null for a new one. A parent
    must be a folder of the move's dataset and owner (``not_found``), not the folder itself (``self``) nor below it (``cycle``, also
    where the parent's own line runs in a circle), and its line must end at the top (``dangling``). No parent is always right.
    """
    scope = ["dataset", "owner"]
    here = folders.select(*scope, F.col("folder").alias("parent"), F.lit(True).alias("_known"))
    sound = folders.join(here, [*scope, "parent"], "left")
    lost = sound.where("parent is not null and _known is null").select(F.col("folder").alias("top"), F.lit(True).alias("_lost"))
    lines = paths(sound.select(F.col("folder").alias("node"), F.when(F.col("_known"), F.col("parent")).alias("parent")))
    lines = lines.withColumn("top", F.col("path")[0]).join(lost, "top", "left").select(F.col("node").alias("folder"), "path", "cyclic", F.coalesce("_lost", F.lit(False)).alias("lost"))
    parents = folders.join(lines, "folder").select(*scope, F.col("folder").alias("parent"), "path", "cyclic", "lost")
    asked = moves.join(parents, [*scope, "parent"], "left")
    below = F.coalesce(F.array_contains("path", F.col("folder")), F.lit(False))
    problem = (
        F.when(F.col("parent").isNull(), None).when(F.col("parent").eqNullSafe(F.col("folder")), "self").when(F.col("path").isNull(), "not_found")
        .when(below | F.col("cyclic"), "cycle").when(F.col("lost"), "dangling")
    )
    return asked.select("move", *scope, "folder", "parent", problem.alias("problem"))
