"""URL filters: explicit host/path rules, and a per-host tree of path templates learned from labelled urls."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: The rules of the query contract, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Children of one parent that are seen more rarely than this are one branch.
RARE = 3
#: Chi-square bound at two degrees of freedom, 95 %: branches below it have the same label profile.
SIMILAR = 5.99
#: Smoothed share of bad urls among the labelled ones from which on a template is rejected, and the least labelled urls.
PURITY, SUPPORT = 0.9, 5
_SALTS = 16


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end; '' if there is none."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null. A rule fits its host and all subdomains."""
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    tests = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
        for v, h, p in ordered
    ]
    return F.coalesce(*tests)


def segments(path: Column) -> Column:
    """Path segments with plainly variable ones (numbers, hashes, dates, uuids) already written as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.regexp_replace(
            F.regexp_replace(s, r"^[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}", "<id>"),
            r"^([0-9]+([-_.][0-9]+)*|[0-9a-f]{12,})(?=\.[a-z]{2,5}$|$)",
            "<n>",
        ),
    )


def _profile_distance(bad: Column, good: Column, n: Column, all_bad: Column, all_good: Column, all_n: Column) -> Column:
    """Chi-square between a child's (bad, good, unlabelled) counts and those of its siblings."""
    child = (bad, good, n - bad - good)
    total = (all_bad, all_good, all_n - all_bad - all_good)

    def cell(seen: Column, row: Column, column: Column) -> Column:
        expected = row * column / all_n
        return F.when(expected > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)

    both = [cell(c, n, t) + cell(t - c, all_n - n, t) for c, t in zip(child, total)]
    return reduce(lambda a, b: a + b, both)


def path_templates(urls: DataFrame) -> DataFrame:
    """Template tree of ``urls(host, path, label)``: label 1 is bad, 0 good, null unknown.

    Returns one row per host and path shape: host, shape, template, n, labelled, bad, purity. From the root down,
    those of each parent's children become the wildcard ``*`` that are rare or whose label profile does not differ from
    their siblings', down to the last segment of every path. A shape that is alone below its parent has no siblings
    further down, and its template is its own rest. Counts are aggregated before every shuffle, so a host with a third
    of all urls costs a row per task and shape. Null hosts, paths and labels count as empty or unknown; an empty table
    gives no rows.
    """
    shaped = urls.select(
        F.coalesce("host", F.lit("")).alias("host"),
        segments(F.coalesce("path", F.lit(""))).alias("segs"),
        (F.col("label") == 1).cast("long").alias("bad"),
        (F.col("label") == 0).cast("long").alias("good"),
    )
    level = keep(
        shaped.groupBy("host", "segs").agg(
            F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
        ),
        "shapes",
    ).withColumn("template", F.lit(""))
    done, d = [], 0
    while True:
        level = level.withColumn("seg", F.get("segs", F.lit(d))).withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(_SALTS)))
        child = level.where("seg is not null").groupBy("host", "template", "salt", "seg").agg(
            F.count("*").alias("c_shapes"), F.sum("n").alias("c_n"), F.sum("bad").alias("c_bad"), F.sum("good").alias("c_good")
        )
        parent = child.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("c_n").alias("p_n"), F.sum("c_bad").alias("p_bad"), F.sum("c_good").alias("p_good"),
        )
        parent = parent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        chi = _profile_distance(F.col("c_bad"), F.col("c_good"), F.col("c_n"), F.col("p_bad"), F.col("p_good"), F.col("p_n"))
        wild = (F.col("children") > 1) & ((F.col("c_n") < RARE) | (chi < SIMILAR))
        branch = child.join(parent, ["host", "template", "salt"]).select("host", "template", "salt", "seg", "c_shapes", F.when(wild, "*").otherwise(F.col("seg")).alias("step"))
        alone = (F.col("c_shapes") == 1) & (F.col("step") != "*")
        rest = F.when(alone, F.array_join(F.slice("segs", d + 1, F.size("segs")), "/")).otherwise(F.col("step"))
        level = keep(level.join(branch, ["host", "template", "salt", "seg"], "left").select(
            "host", "segs", "n", "bad", "good",
            F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), rest)).alias("template"),
            (F.col("step").isNull() | alone | (F.size("segs") == d + 1)).alias("closed"),
        ), "templates")
        done.append(level.where("closed").drop("closed"))
        level, d = level.where("not closed").drop("closed"), d + 1
        if level.limit(1).count() == 0:
            break
    shapes = reduce(DataFrame.union, done)
    stats = shapes.groupBy("host", "template").agg(F.sum("n").alias("t_n"), F.sum("bad").alias("t_bad"), F.sum("good").alias("t_good"))
    return shapes.join(stats, ["host", "template"]).select(
        "host", F.array_join("segs", "/").alias("shape"), "template", F.col("t_n").alias("n"),
        (F.col("t_bad") + F.col("t_good")).alias("labelled"), F.col("t_bad").alias("bad"),
        ((F.col("t_bad") + 0.5) / (F.col("t_bad") + F.col("t_good") + 1.0)).alias("purity"),
    )


def judge_urls(urls: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None) -> DataFrame:
    """Add host, path, rule, verdict, template and purity to every row of ``urls``.

    The verdict is the longest fitting rule's; without one, the url's template decides: it blocks if at least
    SUPPORT of its urls are labelled and their smoothed bad share is PURITY or more. Labels are ``label`` (1 bad,
    0 good, null unknown) or, without such a column, the verdicts of the rules. A null url, or one without
    ``://``, has host and path ''. Columns of ``urls`` named like an added one are replaced. Repeated rows stay.
    """
    added = ("host", "path", "rule", "verdict", "template", "purity")
    kept = [c for c in urls.columns if c not in added]
    u = F.col(f"`{url}`")
    known = F.col(f"`{label}`").cast("int") if label else None
    base = urls.select(*[F.col(f"`{c}`") for c in kept], host_of(u).alias("host"), path_of(u).alias("path"), *([known.alias("__label")] if label else []))
    base = base.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    if not label:
        base = base.withColumn("__label", F.when(F.col("__rule.verdict") == "block", 1).when(F.col("__rule.verdict") == "allow", 0))
    tree = keep(path_templates(base.select("host", "path", F.col("__label").alias("label"))), "tree")
    joined = base.withColumn("__shape", F.array_join(segments(F.col("path")), "/")).join(
        tree.select(F.col("host").alias("__host"), F.col("shape").alias("__tree_shape"), "template", "purity", "labelled"),
        (F.col("host") == F.col("__host")) & (F.col("__shape") == F.col("__tree_shape")),
        "left",
    )
    own = F.when((F.col("labelled") >= SUPPORT) & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "template", "purity",
    )
