"""URL filter: rules by host and path, and link-graph propagation for what no rule fits.

Hosts with pages that the rules allow are trusted seeds, hosts with pages that they block are distrusted ones, each by the share
of its pages. Trust flows along host edges (personalised PageRank from the trusted seeds), distrust flows against them (from a
page to those that link to it, from the blocked seeds). A host is blocked where its distrust stands above the mean of all hosts
by a factor and above its trust; a url without a rule gets its host's verdict, and a url without a host is allowed.

Edges are absolute links in the html, counted per pair of hosts in partial steps before the shuffle. Ranks are tables by host:
each step is one join and one sum, written to the shared folder, until the ranks stand still. Null urls and html count as empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Shelf

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Distrust over the mean at which a host is blocked.
FACTOR = 2.0
STILL = 1e-6
#: The ranks change by at most 2 in the first step and by DAMPING times the last change in each one after: so many steps always do.
STEPS = math.ceil(math.log(STILL / 2) / math.log(DAMPING)) + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null if none does."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("text"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, weight as the share of the links of src."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    pairs = pages.select(F.col("_host").alias("src"), F.explode(links).alias("to")).select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("to", r"^[A-Za-z]+:", ""))).alias("dst"))
    count = pairs.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return count.join(count.groupBy(F.col("src").alias("s")).agg(F.sum("n").alias("all")), F.col("src") == F.col("s")).select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    total = edges.groupBy(F.col("dst").alias("d")).agg(F.sum("weight").alias("all"))
    return edges.join(total, F.col("dst") == F.col("d")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, shelf: Shelf, steps: int = STEPS) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, seed), whose seeds sum to one. Mass of hosts without edges returns to
    the seeds."""
    rank = seeds.select("host", F.col("seed").alias("rank"))
    for _ in range(steps):
        moved = edges.join(rank, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("weight")).alias("got"))
        seed = seeds.select(F.col("host").alias("s_host"), "seed")
        both = moved.join(seed, F.col("to") == F.col("s_host"), "full").select(F.coalesce("to", "s_host").alias("host"), (DAMPING * F.coalesce("got", F.lit(0.0))).alias("flow"), F.coalesce("seed", F.lit(0.0)).alias("seed"))
        both = shelf.put(both)
        flow = both.agg(F.sum("flow")).first()[0] or 0.0
        after = shelf.put(both.select("host", (F.col("flow") + (1 - flow) * F.col("seed")).alias("rank")))
        was = rank.select(F.col("host").alias("w_host"), F.col("rank").alias("w_rank"))
        change = after.join(was, F.col("host") == F.col("w_host"), "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("w_rank", F.lit(0.0))))).first()[0] or 0.0
        shelf.drop(both)
        rank = after
        if change < STILL:
            break
    return rank


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    shelf = Shelf(pages.sparkSession)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", "html", host.alias("_host"), path.alias("_path"))
    edges = shelf.put(host_edges(read))
    judged = shelf.put(read.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule_of(F.col("_host"), F.col("_path"), rules).alias("_rule")))
    hosts = shelf.put(judged.filter("host <> ''").groupBy("host").agg(*(F.avg((F.coalesce(F.col("_rule.verdict"), F.lit("")) == v).cast("double")).alias(v) for v in ("allow", "block"))))
    trust, distrust, mean = hosts.agg(F.sum("allow"), F.sum("block"), F.lit(1.0) / F.greatest(F.count(F.lit(1)), F.lit(1))).first()

    def from_seeds(column: str, total: float | None, along: DataFrame, name: str) -> DataFrame:
        seeds = hosts.filter(F.col(column) > 0).select("host", (F.col(column) / F.lit(total or 1.0)).alias("seed"))
        return propagate(seeds, along, shelf).select(F.col("host").alias(f"{name}_host"), F.col("rank").alias(name))

    good, bad = from_seeds("allow", trust, edges, "trust"), from_seeds("block", distrust, shelf.put(reversed_edges(edges)), "distrust")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    ranked = hosts.join(good, F.col("host") == F.col("trust_host"), "left").join(bad, F.col("host") == F.col("distrust_host"), "left")
    verdicts = ranked.select(F.col("host").alias("v_host"), F.when((d > FACTOR * F.lit(mean)) & (d > t), "block").otherwise("allow").alias("v"))
    out = judged.join(verdicts, F.col("host") == F.col("v_host"), "left")
    return out.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.col("v"), F.lit("allow")).alias("verdict"))
