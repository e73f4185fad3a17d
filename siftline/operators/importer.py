"""Imported text: lines to bullets, mutual-nearest clusters, merged facts, review sessions."""

from __future__ import annotations

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.folds import scanned

from .lineage import cut
from .nearest import similar_pairs
from .places import placed

SHORTEST, LONGEST, THRESHOLD, TIE = 8, 300, 0.78, 1e-9


def bullets(text: Column) -> Column:
    """Lines to bullets: marks stripped, a line without a mark continues the bullet before it while that stays within bounds."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), "\x88\x15", "•–"), r"\R")

    def read(line: Column) -> Column:
        own = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)^[\s\-•·*–—>]+", ""), r"(?U)\s+", " "))
        return F.struct(own.alias("own"), line.rlike(r"(?U)^\s*[-•·*–—>]").alias("marked"))

    # the state is the bullet that is still open; an end without text closes the last one
    goes_on = lambda last, x: ~x["marked"] & last.isNotNull() & (F.length(x["own"]) >= SHORTEST) & (F.length(last) + 1 + F.length(x["own"]) <= LONGEST)
    fits = lambda x: F.length(x["own"]).between(SHORTEST, LONGEST)

    def step(last: Column, x: Column) -> Column:
        return F.when(x["own"].isNull(), F.lit(None)).when(goes_on(last, x), F.concat_ws(" ", last, x["own"])).when(fits(x), x["own"]).otherwise(last)

    def closed(last: Column, x: Column) -> Column:
        return F.when(x["own"].isNull() | (~goes_on(last, x) & fits(x)), last)

    end = F.expr("array(named_struct('own', cast(null as string), 'marked', true))")
    return F.array_compact(scanned(F.concat(F.transform(lines, read), end), F.lit(None).cast("string"), step, closed, "string"))


def nearest_edges(vectors: DataFrame, block: str, threshold: float = THRESHOLD, count: Accumulator | None = None) -> DataFrame:
    """(block, a, b, sim) of the pairs a < b of vectors (block, id, embedding) that are each other's nearest and at least as similar as the threshold, without all pairs of a block."""
    # pairs below the threshold make no edge, and no row's maximum that matters is among them
    pairs = cut(similar_pairs(vectors, block, threshold, count))
    return mutual_edges(pairs.unionByName(pairs.select(block, F.col("b").alias("a"), F.col("a").alias("b"), "sim")), block, threshold)


def mutual_edges(sims: DataFrame, block: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b that are each other's nearest, up to ties, and at least as similar as the threshold; a row's maximum is never under 0."""
    top = sims.groupBy(block, "a").agg(F.greatest(F.max("sim"), F.lit(0.0)).alias("top"))
    held = sims.join(top, [block, "a"]).where((F.col("sim") >= F.col("top") - TIE) & (F.col("sim") >= threshold))
    back = held.select(block, F.col("a").alias("b"), F.col("b").alias("a"))
    return held.where("a < b").join(back, [block, "a", "b"], "left_semi").select(block, "a", "b", "sim")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): the least id reachable over edges (a, b); labels spread until nothing changes, each round also to the label of the label, so that chains take few rounds; lineage cut by checkpoints."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = nodes.select("id", F.col("id").alias("cluster"))
    moves = 1
    while moves:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("heard"))
        new = cut(labels.join(heard, F.col("id") == F.col("a"), "left").select("id", F.least("cluster", F.coalesce("heard", "cluster")).alias("cluster"), (F.coalesce("heard", "cluster") < F.col("cluster")).alias("moved")))
        moves = new.where("moved").limit(1).count()
        further = new.select(F.col("id").alias("_of"), F.col("cluster").alias("_further"))
        labels = cut(new.join(further, F.col("cluster") == F.col("_of")).select("id", F.col("_further").alias("cluster"))) if moves else new.select("id", "cluster")
    return labels


def consolidated(facts: DataFrame) -> DataFrame:
    """Per cluster, of (cluster, pos, text, action, scope, tools, outcomes): first action and scope and the distinct tools and outcomes, longest text first."""
    row = F.struct((-F.length("text")).alias("order"), "pos", "text", "action", "scope", "tools", "outcomes")
    listed = facts.groupBy("cluster").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min_by("text", "pos").alias("first_text"))
    first = lambda name: F.get(F.filter(F.transform("rows", lambda r: r[name]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    union = lambda name: F.array_distinct(F.flatten(F.transform("rows", lambda r: r[name])))
    return listed.select("cluster", F.coalesce(first("action"), "first_text").alias("action"), F.coalesce(first("scope"), F.lit("")).alias("scope"), union("tools").alias("tools"), union("outcomes").alias("outcomes"))


def candidate(texts: Column, key: Column) -> Column:
    """An importable record: every text an approved variant, ids made of the key so that reruns agree."""
    variants = F.transform(texts, lambda t, i: F.struct(F.concat(F.lit("var_imp_"), F.left(F.sha1(F.concat_ws(":", key, i.cast("string"))), F.lit(10))).alias("id"), t.alias("text"), F.lit("approved").alias("status"), F.lit("imported").alias("source"), F.lit(0).alias("used_count")))
    return F.struct(F.concat(F.lit("ach_imp_"), F.left(F.sha1(key), F.lit(10))).alias("id"), variants.alias("variants"))


def progress(resolutions: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """(session_id, reviewed, total) of (session_id, cluster_id, status); orphans: (session_id, done), whether the bullets alone were gone through.

    These make one more step, which leaves the total when it is done and counts as
    reviewed; a session that `orphans` lacks has it still before it.
    """
    groups = resolutions.groupBy("session_id").agg(F.count_if(F.col("status") == "done").alias("reviewed"), F.count("*").alias("total"))
    if orphans is None:
        return groups.withColumn("total", F.col("total") + 1)
    done = F.coalesce(F.col("done"), F.lit(False)).cast("int")
    both = groups.join(orphans.select("session_id", "done"), "session_id", "full")
    return both.select("session_id", (F.coalesce("reviewed", F.lit(0)) + done).alias("reviewed"), (F.coalesce("total", F.lit(0)) + 1 - done).alias("total"))


# States of a cluster under review, and from which of them each can be reached.
REACHED = {"awaiting": ("pending",), "done": ("pending", "awaiting")}


def moved(resolutions: DataFrame, which: Column, status: str) -> DataFrame:
    """The clusters that `which` names moved on to a state; those that can't reach it stay."""
    return resolutions.withColumn("status", F.when(which & F.col("status").isin(*REACHED[status]), status).otherwise(F.col("status")))


def resolve(resolutions: DataFrame, session_id: str, cluster_id: str, status: str) -> DataFrame:
    """One cluster's state moved on: pending to awaiting or done, awaiting to done."""
    return moved(resolutions, (F.col("session_id") == session_id) & (F.col("cluster_id") == cluster_id), status)


def session(labelled: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An import under review, of clustered bullets (id, cluster, text, file): bullets, clusters (cluster_id, bullet_ids, file) of two or more, and their resolutions; bullets alone are orphans."""
    bullets = labelled.select(F.lit(session_id).alias("session_id"), "id", "text", "file")
    groups = labelled.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("bullet_ids"), F.min_by("file", "id").alias("file"))
    groups = groups.select(F.lit(session_id).alias("session_id"), F.concat(F.lit("cl_"), F.col("cluster").cast("string")).alias("cluster_id"), "bullet_ids", "file")
    none = F.expr("cast(array() as array<struct<id:string,variants:array<struct<id:string,text:string,status:string,source:string,used_count:int>>>>)")
    states = groups.where(F.size("bullet_ids") > 1).select("session_id", "cluster_id", F.lit("pending").alias("status"), none.alias("candidates"))
    return bullets, groups, states


def orphans(groups: DataFrame) -> DataFrame:
    """(session_id, id) of the bullets that no other resembles."""
    return groups.where(F.size("bullet_ids") == 1).select("session_id", F.get("bullet_ids", F.lit(0)).alias("id"))


def reviewed(groups: DataFrame, bullets: DataFrame, states: DataFrame, cluster_id: str, action: str) -> DataFrame:
    """States after one decision: merge gives one candidate of all texts and split one a text, both awaiting; discard ends the review."""
    if action == "discard":
        return moved(states, F.col("cluster_id") == cluster_id, "done")
    if action not in ("merge", "split"):
        raise ValueError(f"no such action: {action}")
    mine = groups.where(F.col("cluster_id") == cluster_id).select("session_id", "cluster_id", F.posexplode("bullet_ids").alias("pos", "id")).join(bullets.select("session_id", "id", "text"), ["session_id", "id"])
    texts = mine.groupBy("session_id", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]).alias("texts"))
    key = F.concat_ws(":", "session_id", "cluster_id")
    made = F.array(candidate(F.col("texts"), key)) if action == "merge" else F.transform("texts", lambda t, i: candidate(F.array(t), F.concat_ws(":", key, i.cast("string"))))
    new = texts.select(F.col("session_id").alias("_s"), F.col("cluster_id").alias("_c"), made.alias("_made"))
    joined = states.join(new, (F.col("session_id") == F.col("_s")) & (F.col("cluster_id") == F.col("_c")), "left")
    opened = F.col("_made").isNotNull() & (F.col("status") == "pending")
    return joined.withColumns({"candidates": F.when(opened, F.col("_made")).otherwise(F.col("candidates")), "status": F.when(opened, "awaiting").otherwise(F.col("status"))}).drop("_s", "_c", "_made")


def common_tokens(members: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tokens that all members of a cluster share, sorted."""
    sets = F.collect_list(F.array_distinct(tokens))
    every = members.groupBy("cluster").agg(sets.alias("sets"))
    return every.select("cluster", F.array_sort(F.reduce("sets", F.get("sets", F.lit(0)), F.array_intersect)).alias("common"))


def by_size(labelled: DataFrame) -> DataFrame:
    """(cluster, members, place): larger clusters first, then by least id."""
    places = placed(labelled.groupBy("cluster").agg(F.count("*").alias("size")), [F.col("size").desc(), F.col("cluster")])
    members = labelled.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return members.join(places, "cluster").select("cluster", "members", "size", "place")
