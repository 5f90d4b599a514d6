"""URL filters: explicit host and path rules, and a tree of path templates per host.

Paths are cut into segments and runs of digits generalised; the distinct skeletons of a host are
a tree. From the root, a node's paths are counted by the segment at each level below it. Down to
the first level where labels set some segment apart, nothing tells the paths from each other and
every segment is a wildcard (a segment that all of them share stays). There the node splits: the
segments whose labelled share differs from the node's beyond chance are taken out; of these, in
order of their shares, neighbours that do not differ from each other merge into one branch; all
others are the wildcard branch. A template is rejected when its labelled bad share, smoothed towards its host's
and that towards the whole table's, reaches the limit.

All levels of all nodes are counted at once, so a round of jobs is a split and not a level: paths
of any depth cost their segments, and only nested evidence costs rounds. Every step is an
aggregation over distinct skeletons or a join on (host, prefix, ...); no host is ever held in one
task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import stored
from claimloom.operators.joins import spread_join


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    #: Deviations from the node's labelled share that set a branch apart.
    apart: float = 2.0
    #: Strength of the smoothing, in labelled pages.
    prior: float = 8.0
    #: A template with this smoothed bad share or more is rejected.
    reject: float = 0.5


#: Names of branches: all others, and the merged ones above and below the node's share, numbered.
OTHERS, ABOVE, BELOW = "*", "*+", "*-"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://`; null or no `://`: both empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; null without one. Rules are configuration."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        own = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, own) if out is None else out.when(fits, own)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def skeleton(path: Column) -> Column:
    """The segments of a path, with runs of digits as `#`."""
    return F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda s: s != "")


def _named(segment: Column) -> Column:
    """A segment as part of a template; one that starts like a wildcard gets a sign before it."""
    return F.when(segment.startswith("*") | segment.startswith("="), F.concat(F.lit("="), segment)).otherwise(segment)


def _apart(share: Column, settings: TreeSettings) -> Column:
    """Whether `bad` of `labelled` deviate from a share beyond chance."""
    gap = F.abs(F.col("bad") - F.col("labelled") * share)
    return (F.col("labelled") > 0) & (gap > settings.apart * F.sqrt(F.col("labelled") * share * (1 - share)))


def _share(bad: str, labelled: str) -> Column:
    return (F.col(bad) + 0.5) / (F.col(labelled) + 1.0)


def _splits(children: DataFrame, nodes: DataFrame, settings: TreeSettings) -> DataFrame:
    """(host, prefix, split, segment, branch): the segments taken out of a node at its first level with any."""
    met = spread_join(children.where("labelled > 0"), nodes.drop("kinds", "only"), ["host", "prefix", "level"], "segment")
    share = _share("node_b", "node_l")
    above = F.col("bad") > F.col("labelled") * share
    out = met.where(_apart(share, settings)).select("host", "prefix", "level", "segment", "labelled", "bad", above.alias("above"))
    out = stored(out, "url-outliers")
    first = out.groupBy("host", "prefix").agg(F.min("level").alias("split"))
    here = out.join(first, ["host", "prefix"]).where("level = split").drop("level")
    by_share = Window.partitionBy("host", "prefix", "above").orderBy(F.col("bad") / F.col("labelled"), "segment")
    before_l, before_b = (F.lag(c).over(by_share) for c in ("labelled", "bad"))
    gap = F.abs(F.col("bad") / F.col("labelled") - before_b / before_l)
    both = (F.col("bad") + before_b + 0.5) / (F.col("labelled") + before_l + 1.0)
    chance = F.sqrt(both * (1 - both) * (1.0 / F.col("labelled") + 1.0 / before_l))
    here = here.withColumn("new", F.coalesce(gap > settings.apart * chance, F.lit(True)))
    here = here.withColumn("group", F.sum(F.col("new").cast("int")).over(by_share))
    members = F.count("*").over(Window.partitionBy("host", "prefix", "above", "group"))
    merged = F.concat(F.when(F.col("above"), ABOVE).otherwise(BELOW), F.col("group").cast("string"))
    branch = F.when(members > 1, merged).otherwise(_named(F.col("segment")))
    return here.select("host", "prefix", "split", "segment", branch.alias("branch"))


def templates(skeletons: DataFrame, settings: TreeSettings) -> DataFrame:
    """(host, segments, n, labelled, bad, template) from the same without template, a row per skeleton."""
    columns = ["host", "segments", "n", "labelled", "bad"]
    state = stored(skeletons.select(*columns, F.lit("").alias("prefix"), F.lit(0).alias("place")), "url-tree")
    finished = None
    while True:
        rest = F.slice("segments", F.col("place") + 1, F.size("segments"))
        levels = state.select("host", "prefix", "place", "labelled", "bad", F.posexplode(rest).alias("k", "segment"))
        levels = levels.withColumn("level", F.col("place") + F.col("k"))
        children = levels.groupBy("host", "prefix", "level", "segment").agg(*(F.sum(c).alias(c) for c in ("labelled", "bad")))
        children = stored(children, "url-children")
        nodes = children.groupBy("host", "prefix", "level").agg(
            F.count("*").alias("kinds"), F.min("segment").alias("only"),
            F.sum("labelled").alias("node_l"), F.sum("bad").alias("node_b"),
        )
        splits = stored(_splits(children, nodes, settings), "url-splits")
        where = splits.select("host", "prefix", "split").distinct()
        piece = F.when(F.col("kinds") == 1, _named(F.col("only"))).otherwise(OTHERS)
        above = nodes.join(where, ["host", "prefix"], "left").where("split IS NULL OR level < split")
        pieces = above.groupBy("host", "prefix").agg(F.sort_array(F.collect_list(F.struct("level", piece.alias("piece")))).alias("pieces"))
        known = pieces.join(where, ["host", "prefix"], "full")  # a node may split at once, or have no segments left
        own = spread_join(state, known, ["host", "prefix"], "segments", "left")
        goes_on = F.coalesce(F.size("segments") > F.col("split"), F.lit(False))
        upto = F.when(goes_on, F.col("split")).otherwise(F.size("segments")) - F.col("place")
        taken = F.transform(F.slice(F.coalesce("pieces", F.array()), F.lit(1), upto), lambda p: F.concat(F.lit("/"), p["piece"]))
        own = own.withColumn("head", F.concat("prefix", F.array_join(taken, ""))).withColumn("goes_on", goes_on)
        own = own.withColumn("segment", F.when(F.col("goes_on"), F.get("segments", F.col("split"))))
        # keys are null for paths that end here, and meet nothing
        found = own.join(splits.drop("split"), ["host", "prefix", "segment"], "left")
        found = found.withColumn("branch", F.when(F.col("goes_on"), F.coalesce("branch", F.lit(OTHERS))))
        found = stored(found.select(*columns, "head", "branch", "split"), "url-tree")
        ended = found.where("branch IS NULL").select(*columns, F.col("head").alias("template"))
        finished = ended if finished is None else finished.unionByName(ended)
        state = found.where("branch IS NOT NULL").select(
            *columns, F.concat("head", F.lit("/"), "branch").alias("prefix"), (F.col("split") + 1).alias("place")
        )
        if splits.isEmpty():
            return finished


def judged(skeletons: DataFrame, settings: TreeSettings) -> DataFrame:
    """(host, segments, template, purity, rejected) of every skeleton."""
    own = templates(skeletons, settings)
    total = own.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 1.0)).first()[0]
    a = settings.prior
    hosts = own.groupBy("host").agg(((F.sum("bad") + a * total) / (F.sum("labelled") + a)).alias("host_share"))
    kinds = own.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    kinds = spread_join(kinds, hosts, ["host"], "template").withColumn("purity", (F.col("b") + a * F.col("host_share")) / (F.col("l") + a))
    kinds = kinds.select("host", "template", "purity", (F.col("purity") >= settings.reject).alias("rejected"))
    return spread_join(own.select("host", "segments", "template"), kinds, ["host", "template"], "segments")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[Rule],
    settings: TreeSettings = TreeSettings(),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row of pages.

    labels: (id, bad) with bad 0 or 1; of repeated ids the worst label counts, rows with a null
    id or label are left out. A null or malformed url has empty host and path and is judged as
    the template of that empty host. Paths of any depth are judged whole. Repeated rows each get a row. Empty tables: no rows, and
    without labels nothing is rejected. Other columns are not read, whatever their names.
    """
    host, path = parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", skeleton(F.col("path")))
    marks = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").cast("bigint").alias("bad"))
    marked = rows.join(marks.withColumnRenamed("id", "label_id"), F.col("id") == F.col("label_id"), "left")
    skeletons = marked.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    verdicts = stored(judged(skeletons, settings), "url-templates")
    found = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(verdicts, ["host", "segments"]).withColumn("found", found)
    return out.select(
        "id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        "template",
        "purity",
    )
