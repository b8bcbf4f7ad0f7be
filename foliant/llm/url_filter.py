"""URL verdicts by rules and by a tree of path templates, in DataFrame operations only.

Every path is walked segment by segment from its host, to its end.  At each level a segment that
is common among the paths below the same node stays as it is, all others become the wildcard
``*``.  Then, from the deepest level up, branches of one node that lead to the same rest are
merged to ``{}`` where their shares of bad labels do not differ from that of all of them, as far
as a test of proportions can tell.  A template is blocked when its smoothed share of bad labels
is over a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_since, mark
from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    #: A segment is kept if it leads to this many urls and to this share of those at its node.
    least: int = 5
    share: float = 0.02
    #: Standard deviations below which branches are alike.
    z: float = 1.96
    #: Labels that the prior weighs, and the prior share of bad ones.
    weight: float = 4.0
    prior: float = 0.1
    threshold: float = 0.5


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, params: Params = Params(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: ``page_id, host, path, rule, verdict, template``.

    ``labels`` (``url, bad``: 0 or 1) teaches the tree; without it the urls that rules decide
    do (block: bad), so that what the rules say of a host's branches carries over to branches
    like them.  Counts cover all rows.

    Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is
    judged like any host; repeated rows count as often as they occur; null labels are no
    labels; an empty table gives an empty result; other columns are ignored.

    Hot hosts: rows are first summed for each (host, path); each level sums before it
    shuffles, and joins read stored tables, so AQE can split a hot node.  Below a node with
    fewer urls than a common segment needs, all further segments are wildcards at once, so there
    are as many levels as ``least`` urls share, however long a single path is.  The branches of a
    node are 1 / ``share`` and one at most, so a window over them is bounded.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    rule, ruled = by_rules(rules, F.col("host"), F.col("path"))
    base = base.withColumn("rule", rule).withColumn("ruled", ruled)
    if labels is None:
        taught = base.select("host", "path", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("long")).alias("bad"), F.lit(1).alias("rows"))
    else:
        known = labels.where("bad IS NOT NULL AND url IS NOT NULL").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("long").alias("bad"), F.lit(0).alias("rows"))
        taught = base.select("host", "path", F.lit(None).cast("long").alias("bad"), F.lit(1).alias("rows")).unionByName(known)
    paths = taught.groupBy("host", "path").agg(F.sum("rows").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    walk = stored(paths.withColumn("segments", segments).withColumn("node", F.lit("")), "level")
    templates, walk = _merged(_walked(walk, params), params)
    bad, lab = F.sum("bad"), F.sum("labelled")
    purity = (bad + params.weight * params.prior) / (lab + params.weight)
    verdicts = templates.groupBy("host", "parts").agg(F.when(purity > params.threshold, "block").otherwise("allow").alias("learnt"))
    named = templates.select("host", "template", "parts").join(verdicts, ["host", "parts"])
    named = named.select("host", "template", F.when(F.size("parts") > 0, F.concat(F.lit("/"), F.array_join("parts", "/"))).otherwise("").alias("merged"), "learnt")
    judged = stored(walk.join(named, ["host", "template"]).select("host", "path", F.col("merged").alias("template"), "learnt"), "judged")
    out = base.join(judged, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "learnt").alias("verdict"), "template")


def _walked(walk: DataFrame, params: Params) -> DataFrame:
    """``host, path, labelled, bad, template``: segments kept or made wildcards, level by level."""
    done, k, point = [], 0, mark()
    while True:
        ended = walk.where(F.size("segments") <= k)
        done.append(ended.select("host", "path", "labelled", "bad", F.col("node").alias("template")))
        here = walk.where(F.size("segments") > k).withColumn("segment", F.col("segments")[k])
        children = stored(here.groupBy("host", "node", "segment").agg(F.sum("n").alias("m")), "children")
        if children.isEmpty():
            break
        nodes = children.groupBy("host", "node").agg(F.sum("m").alias("all"))
        known = children.join(nodes, ["host", "node"])
        known = stored(known.select("host", "node", "segment", "all", ((F.col("m") >= params.least) & (F.col("m") >= F.col("all") * params.share)).alias("common")), "common")
        joined = here.join(known, ["host", "node", "segment"])
        few = F.col("all") < params.least
        step = F.when(few, F.repeat(F.lit("/*"), F.size("segments") - k)).when(F.col("common"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        joined = stored(joined.withColumn("few", few).withColumn("node", F.concat("node", step)).select("host", "path", "n", "labelled", "bad", "segments", "node", "few"), "level")
        done.append(joined.where("few").select("host", "path", "labelled", "bad", F.col("node").alias("template")))
        walk, k = joined.where("NOT few").drop("few"), k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = stored(out, "walked")
    drop_since(out.sparkSession, point, out)
    return out


def _merged(walked: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Templates ``host, template, labelled, bad`` with the ``parts`` of what they are merged to,
    and the paths."""
    parts = F.filter(F.split("template", "/"), lambda s: s != "")
    now = walked.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    now = stored(now.withColumn("parts", parts), "templates")
    # levels at which templates of one host and depth differ at all: others have nothing to merge
    at = now.select("host", F.size("parts").alias("size"), F.posexplode("parts").alias("k", "part"))
    levels = at.groupBy("host", "size", "k").agg((F.min("part") < F.max("part")).alias("differ")).where("differ").select("k").distinct().collect()
    for k in sorted((r["k"] for r in levels), reverse=True):
        key = F.concat(F.slice("parts", 1, k), F.array(F.lit("{}")), F.slice("parts", k + 2, F.size("parts")))
        branches = now.where(F.size("parts") > k).groupBy("host", "parts").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).withColumn("key", key)
        siblings = Window.partitionBy("host", "key")
        pooled, wrong = F.sum("l").over(siblings), F.sum("b").over(siblings)
        rate = F.col("wrong") / F.greatest(F.col("pooled"), F.lit(1))
        gap = F.abs(F.col("b") - F.col("l") * rate)
        alike = (F.col("l") == 0) | (gap <= params.z * F.sqrt(F.col("l") * rate * (1 - rate)))
        tested = branches.withColumn("pooled", pooled).withColumn("wrong", wrong).withColumn("alike", alike)
        tested = tested.withColumn("several", F.sum(F.col("alike").cast("int")).over(siblings) > 1)
        merge = stored(tested.where("alike AND several").select("host", "parts", "key"), "merge")
        now = stored(now.join(merge, ["host", "parts"], "left").select("host", "template", "labelled", "bad", F.coalesce("key", "parts").alias("parts")), "templates")
    return now, walked


SQL = r"""
WITH RECURSIVE base AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fit AS (
  SELECT b.*, r.rule, r.verdict AS ruled FROM (SELECT *, row_number() OVER () AS rn FROM base) b LEFT JOIN LATERAL (
    SELECT v.h || v.p AS rule, v.verdict FROM (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')) v(verdict, h, p)
    WHERE (b.host = v.h OR ends_with(b.host, '.' || v.h)) AND starts_with(b.path, v.p) ORDER BY length(v.h || v.p) DESC LIMIT 1) r ON true),
paths AS (SELECT host, path, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs
  FROM fit GROUP BY host, path),
walk AS (SELECT host, path, n, labelled, bad, segs, 0 AS k, [] :: VARCHAR[] AS parts FROM paths
  UNION ALL
  SELECT host, path, n, labelled, bad, segs, k + 1, list_append(parts, CASE WHEN m >= {least} AND m >= total * {share} THEN segs[k + 1] ELSE '*' END)
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, parts, segs[k + 1]) AS m, sum(n) OVER (PARTITION BY host, parts) AS total FROM walk WHERE len(segs) > k)),
t AS (SELECT host, path, labelled, bad, parts FROM walk WHERE len(segs) = k),
merging AS (SELECT host, parts AS template, parts, sum(labelled) AS labelled, sum(bad) AS bad, max(max(len(parts))) OVER () AS k FROM t GROUP BY host, parts
  UNION ALL
  SELECT host, template, CASE WHEN alike AND least_alike < most_alike THEN key ELSE parts END, labelled, bad, k - 1
  FROM (SELECT *, min(parts[k]) FILTER (alike) OVER (PARTITION BY host, key) AS least_alike, max(parts[k]) FILTER (alike) OVER (PARTITION BY host, key) AS most_alike
    FROM (SELECT *, l = 0 OR abs(b - l * (wrong / greatest(pooled, 1))) <= {z} * sqrt(l * (wrong / greatest(pooled, 1)) * (1 - wrong / greatest(pooled, 1))) AS alike
      FROM (SELECT *, sum(labelled) OVER (PARTITION BY host, parts) AS l, sum(bad) OVER (PARTITION BY host, parts) AS b,
              sum(labelled) OVER (PARTITION BY host, key) AS pooled, sum(bad) OVER (PARTITION BY host, key) AS wrong
        FROM (SELECT *, CASE WHEN len(parts) >= k THEN list_concat(parts[1:k - 1], ['{{}}'], parts[k + 1:]) ELSE list_append(parts, '') END AS key FROM merging WHERE k > 0))))),
merged AS (SELECT host, template, parts, CASE WHEN (sum(bad) OVER own + {weight} * {prior}) / (sum(labelled) OVER own + {weight}) > {threshold} THEN 'block' ELSE 'allow' END AS learnt
  FROM merging WHERE k = 0 WINDOW own AS (PARTITION BY host, parts)),
judged AS (SELECT t.host, t.path, CASE WHEN len(m.parts) = 0 THEN '' ELSE '/' || array_to_string(m.parts, '/') END AS template, m.learnt FROM t JOIN merged m ON t.host = m.host AND t.parts = m.template)
SELECT page_id, host, path, rule, coalesce(ruled, learnt) AS verdict, template FROM fit LEFT JOIN judged USING (host, path)
"""


def sql(params: Params = Params()) -> str:
    """The judgement with :data:`RULES` and labels from them, in DuckDB's SQL."""
    return SQL.format(least=params.least, share=params.share, z=params.z, weight=params.weight, prior=params.prior, threshold=params.threshold)
