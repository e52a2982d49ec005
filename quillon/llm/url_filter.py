"""URL filters by host rules, and by link-graph propagation where no rule fits.  DataFrame functions only.

Hosts that allow rules cover are trusted seeds and those that block rules cover are bad seeds,
each weighted by its pages that the rules decide.  Trust spreads along links and distrust
against them (who links to the bad is suspect), both as personalised PageRank over weighted
host edges.  A page that no rule fits is blocked if its host's distrust exceeds ``ratio`` times
its trust.  Edges and scores have one row per host pair and host, so iterations never touch
pages; the way back to pages is a salted join, since one host may hold a third of them.

Results in special cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is allowed unless the graph says otherwise.  Null or empty html has no links; links
to the own host don't count.  Repeated pages are judged alike and count each time.  An empty
table gives an empty result.  Only named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^"'\s>]+)"""
SALTS = 32

#: Rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; nulls where none does."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    found = none
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, every: int = 4, close: float = 1e-9) -> DataFrame:
    """Personalised PageRank for several kinds of score at once: (kind, host, score).

    seeds: (kind, host, weight), the weights of a kind adding up to 1.  edges: (kind, from, to,
    share), the shares of a (kind, from) adding up to 1.  Ends when scores move at most ``close`` in
    all between two cuts of the lineage; as what moves shrinks by ``damping`` a round, that takes
    a bounded number of rounds, and an error is raised where ``rounds`` are fewer than needed.
    """
    if rounds is None:
        kinds = seeds.select("kind").distinct().count()
        rounds = every * (math.ceil(math.log(close / (4 * max(1, kinds))) / (math.log(damping) if damping > 0 else -math.inf) / every) + 2)
    scores = seeds.select("kind", "host", F.col("weight").alias("score"))
    restart = seeds.select("kind", "host", ((1 - damping) * F.col("weight")).alias("score"))
    old = scores
    for step in range(1, rounds + 1):
        passed = edges.join(scores.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        scores = restart.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % every == 0:
            scores = cut(scores)
            both = scores.unionByName(old.select("kind", "host", (-F.col("score") if step > every else F.lit(0.0)).alias("score")))
            moved = both.groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).first()[0]
            if step > every and (moved or 0) <= close:
                return scores
            old = scores
    raise RuntimeError(f"scores still move by more than {close} after {rounds} rounds")


def host_scores(pages: DataFrame, judged: DataFrame, rules: tuple[tuple[str, str, str], ...], url_col: str, html_col: str, damping: float) -> DataFrame:
    """(host, trust, distrust) of hosts that seeds reach."""
    link = F.explode(F.regexp_extract_all(F.col("_html"), F.lit(LINK), 1))
    own, _ = host_and_path(F.col("_url"))
    to, _ = host_and_path(F.col("_link"))
    links = pages.select(F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html")).select(own.alias("from"), link.alias("_link")).select("from", to.alias("to"))
    counted = links.where("from <> to and from <> '' and to <> ''").groupBy("from", "to").agg(F.count("*").cast("double").alias("n"))
    both = counted.select(F.lit("trust").alias("kind"), "from", "to", "n").unionByName(counted.select(F.lit("distrust").alias("kind"), F.col("to").alias("from"), F.col("from").alias("to"), "n"))
    whole = both.groupBy("kind", "from").agg(F.sum("n").alias("_all"))
    edges = cut(both.join(whole, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("_all")).alias("share")))
    kind = F.when(F.col("_rule.verdict") == "allow", "trust").otherwise("distrust")
    # hosts that are only linked to have no pages to judge: a rule of the whole host makes them seeds of weight 1
    linked = counted.select(F.col("to").alias("host")).distinct().join(judged.select("host").distinct(), "host", "left_anti")
    linked = linked.withColumn("_rule", rule_of(F.col("host"), F.lit("/"), rules))
    every = judged.select("host", "_rule").unionByName(linked)
    seeds = every.where("_rule is not null and host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("_all"))
    seeds = cut(seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("_all")).alias("weight")))
    scores = propagate(seeds, edges, damping)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    return scores.groupBy("host").agg(pick("trust"), pick("distrust"))


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, ratio: float = 1.0, damping: float = 0.85, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, trust, distrust.

    trust and distrust are those of the host, 0 where no seed reaches it; null where a rule decides.
    """
    host, path = host_and_path(F.col("_url"))
    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(pages, judged, rules, url_col, html_col, damping)
    spread = scores.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    ruled = judged.where("_rule is not null").select("_id", "host", "path", "_rule.rule", "_rule.verdict", F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"))
    open_ = judged.where("_rule is null").withColumn("_salt", F.pmod(F.xxhash64("_id", "path"), F.lit(SALTS)).cast("int"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = open_.join(spread, ["host", "_salt"], "left").select(
        "_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(distrust > ratio * trust, "block").otherwise("allow").alias("verdict"), trust.alias("trust"), distrust.alias("distrust"),
    )
    return ruled.unionByName(by_graph).withColumnRenamed("_id", id_col)
