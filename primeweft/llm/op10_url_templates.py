"""URL filters by a path-template tree.

Stated rules decide first: a rule ``host/path`` fits its host and all subdomains
where the path starts with the rule's; the longest fitting rule wins.

The other URLs are judged by a tree for each host, grown level by level.  At each
node the children's counts decide: segments of one shape (digits, digits and an
extension, long mixed names) become a wildcard of that shape where there are at
least ``FEW`` of them, plain names seen fewer than ``FEW`` times
become ``*`` where there are over ``MANY``, most of them seen once.  The tree has the real depth of the
paths: past ``DEPTH`` levels the driver grows it on where few rows are left.

URLs with a label (the rules' verdicts, or given ones) count for all branches that
they lie in, from their template up to the host.  At every level a branch whose
labelled share doesn't differ from that of its siblings together (two-sided test
of a proportion) is merged with them, and so is a branch without a label.  A
branch apart has a share of its own, smoothed towards its parent's; merged
branches have one together where a sibling is apart, else they are their parent.
The host's share is smoothed towards the overall one.  A template is rejected if
its share of blocked labels is at least ``REJECT``.

A null URL, or one without "://", has an empty host and path and is allowed unless
its (host, path) template is rejected.  Repeated rows get equal results.  An empty
table gives no rows.
A very long URL is handled by expressions; its depth adds levels to the tree. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Past so many levels, up to LOCAL rows that go deeper get the rest of their templates on the driver.
DEPTH, LOCAL = 8, 10_000
FEW = 4
MANY = 24
#: Weight of the share above in a smoothed share, and the share that rejects.
WEIGHT, REJECT = 4.0, 0.6
#: Critical value of the test that keeps a branch apart.
CRITICAL = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), r"^[^?#]*", 0)
    return host, path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. rules: (verdict, host/path)."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "<n>")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("<n>"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]+)$", 1)))
        .when((F.length(segment) >= 16) & segment.rlike("[0-9]"), "<id>")
        .otherwise("")
    )


def deeper(rows: list[tuple[int, str, str, list[str], list[str]]], level: int) -> list[tuple[int, str]]:
    """(row, template) of rows (row, host, template, parts, shapes) grown from ``level`` to their ends; the rules are those of `templates`."""
    out = []
    while rows:
        seen = Counter((host, template, parts[level], shapes[level]) for _, host, template, parts, shapes in rows)
        kinds, once = Counter(), Counter()
        for (host, template, _, shape), n in seen.items():
            kinds[host, template, shape] += 1
            once[host, template, shape] += n == 1
        more = []
        for row, host, template, parts, shapes in rows:
            segment, shape = parts[level], shapes[level]
            k, one = kinds[host, template, shape], once[host, template, shape]
            wide = k >= FEW if shape else k > MANY and 2 * one > k and seen[host, template, segment, shape] < FEW
            grown = f"{template}/{(shape or '*') if wide else segment}"
            if len(parts) == level + 1:
                out.append((row, grown))
            else:
                more.append((row, host, grown, parts, shapes))
        rows, level = more, level + 1
    return out


def templates(rows: DataFrame) -> DataFrame:
    """``rows`` (row, host, path, label) with ``template``; ``row`` must be unique and written."""
    now = rows.withColumn("parts", F.filter(F.split(F.col("path"), "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    depths = {r["d"]: r["n"] for r in now.groupBy(F.size("parts").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each depth
    done = []
    for level in range(max(depths, default=0)):
        done.append(now.where(F.size("parts") <= level))
        now = now.where(F.size("parts") > level)
        if level >= DEPTH and sum(n for d, n in depths.items() if d > level) <= LOCAL:
            left = now.select("row", "host", "template", "parts", F.transform("parts", _shape).alias("shapes")).collect()  # LOCAL rows at most
            ends = rows.sparkSession.createDataFrame(deeper([tuple(x) for x in left], level), "row long, template string")
            now = now.drop("template").join(F.broadcast(ends), "row").select(*now.columns)
            break
        here = F.try_element_at("parts", F.lit(level + 1))
        step = now.select("host", "template", here.alias("segment")).groupBy("host", "template", "segment").agg(F.count(F.lit(1)).alias("n")).withColumn("shape", _shape(F.col("segment")))
        # for each shape below a node: distinct segments, and those seen once
        kinds = step.groupBy("host", "template", "shape").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"))
        wide = F.when(F.col("shape") == "", (F.col("kinds") > MANY) & (2 * F.col("once") > F.col("kinds")) & (F.col("n") < FEW)).otherwise(F.col("kinds") >= FEW)
        name = F.when(wide, F.when(F.col("shape") == "", "*").otherwise(F.col("shape"))).otherwise(F.col("segment"))
        named = step.join(kinds, ["host", "template", "shape"]).select("host", "template", "segment", name.alias("name"))
        grown = now.withColumn("segment", here).join(named, ["host", "template", "segment"]).withColumn("template", F.concat("template", F.lit("/"), "name"))
        now = materialize(grown.select(*now.columns), f"templates-{level}")
    return reduce(DataFrame.unionByName, done, now)


def judged(rows: DataFrame) -> DataFrame:
    """(host, template, share) of each template."""
    own = materialize(rows.groupBy("host", "template").agg(F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "template-labels")
    overall = own.agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    prior = (overall["b"] or 0) / overall["n"] if overall["n"] else 0.0
    # a template lies in the branches of all its beginnings, the host being the first
    names = F.split("template", "/")
    branch = F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(names, 1, i), "/").alias("branch"), F.when(i > 1, F.array_join(F.slice(names, 1, i - 1), "/")).alias("parent"))))
    inside = own.select("host", "template", "labelled", "blocked", branch.alias("x")).select("host", "template", "labelled", "blocked", "x.*")
    counts = inside.where("labelled > 0").groupBy("host", "level", "branch", "parent").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    below = counts.where("level > 1")
    pool = below.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    share = F.col("all_blocked") / F.col("all_labelled")
    distance = F.abs(F.col("blocked") / F.col("labelled") - share)
    apart = below.join(pool, ["host", "parent"]).where(distance > CRITICAL * F.sqrt(share * (1 - share) / F.col("labelled"))).select("host", "parent", "branch", "labelled", "blocked")
    # what is left of a parent's branches where some are apart
    gone = apart.groupBy("host", "parent").agg(F.sum("labelled").alias("gone"), F.sum("blocked").alias("gone_blocked"))
    rest = pool.join(gone, ["host", "parent"]).select("host", "parent", (F.col("all_labelled") - F.col("gone")).alias("rest"), (F.col("all_blocked") - F.col("gone_blocked")).alias("rest_blocked"))
    hosts = counts.where("level = 1").select("host", "branch", "labelled", "blocked")
    evidence = hosts.unionByName(apart.select("host", "branch", "labelled", "blocked"))
    found = inside.select("host", "template", "level", "branch", "parent").join(evidence, ["host", "branch"], "left").join(rest, ["host", "parent"], "left")
    step = F.struct("level", F.coalesce("labelled", "rest", F.lit(0)).alias("n"), F.coalesce("blocked", "rest_blocked", F.lit(0)).alias("b"))
    ways = found.groupBy("host", "template").agg(F.array_sort(F.collect_list(step)).alias("way"))
    smoothed = F.aggregate("way", F.lit(float(prior)), lambda above, x: (x["b"] + WEIGHT * above) / (x["n"] + WEIGHT))
    return ways.select("host", "template", smoothed.alias("share"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """Per row: key, host, path, rule, verdict, template, share.

    ``labels``: (key, blocked 0 or 1), at most one for each key, in addition to the rules' verdicts.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    stated = reduce(lambda c, r: c.when(F.col("rule") == r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit(""))) if rules else F.lit(None).cast("string")
    base = base.withColumn("stated", stated).withColumn("label", F.when(F.col("stated").isNotNull(), (F.col("stated") == "block").cast("int")))
    if labels is not None:
        given = labels.select(F.col(labels.columns[0]).alias("id"), F.col(labels.columns[1]).cast("int").alias("given"))
        base = base.join(given, "id", "left").withColumn("label", F.coalesce("label", "given")).drop("given")
    base = materialize(base, "urls")
    tree = templates(base)
    verdicts = judged(tree)
    rejected = F.when(F.col("share") >= REJECT, "block").otherwise("allow")
    return tree.join(verdicts, ["host", "template"]).select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("stated", rejected).alias("verdict"), "template", "share")
