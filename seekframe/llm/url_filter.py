"""URL filtering: rules first, then the ratio of two character language models.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides. The URLs that rules
accept and reject train two interpolated Markov models of orders 0 to ``ORDER``; contexts that were never seen
fall back to shorter ones by themselves. The other URLs are allowed where the log-likelihood difference for each
character reaches a threshold. It is calibrated on rule-judged URLs that the models have not seen: a quarter of them, by hash, is held
out (where that leaves a side fewer than ``LEAST_HELD`` URLs, all serve for both).

DataFrame functions only. Counts are pre-aggregated by n-gram before any join, so a host with a third of all
URLs is a few n-grams with large counts. N-grams that very many URLs share, such as the first ones, are at most ``SHARED`` and are
joined by broadcast; of the others none has more than that share of the rows. Null URLs, and those without ``://``, have an empty host and path and
no rule; a null URL, an empty URL and every URL when there is nothing to learn from are blocked. Repeated rows
get equal verdicts, and columns other than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged

ORDER = 4
STRENGTH = 2.0
ALPHABET = 256.0
SHARED = 2000
LEAST_HELD = 20  # URLs of a side that a threshold needs
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for rule_host, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(url: Column, order: int = ORDER) -> Column:
    """Every character of the URL with the ``order`` characters before it; the URL begins with blanks."""
    padded = F.concat(F.lit(" " * order), F.lower(url))
    return F.transform(F.sequence(F.lit(1), F.char_length(url)), lambda i: F.substr(padded, i, F.lit(order + 1)))


def model(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n_a, n_b, c_a, c_b): counts of every n-gram of length 1 to ``order + 1`` in accepted and rejected URLs, and of its context."""
    counted = (
        labelled.select("accepted", F.explode(grams(F.col("url"), order)).alias("g"))
        .groupBy("g").agg(F.count_if("accepted").alias("n_a"), F.count_if(~F.col("accepted")).alias("n_b"))
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substr("g", F.lit(order + 2) - k, k))).alias("gram"), "n_a", "n_b")
        .groupBy("gram").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    )
    return counted


def ratios(wanted: DataFrame, counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, ratio) for the distinct n-grams ``wanted``: the log of P(character | context) accepted less rejected.

    P of order k is (n + S * P of order k-1) / (c + S), n and c being the counts of the n-gram and its context.
    """
    parts = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.struct(k.alias("k"), F.substr("g", F.lit(order + 2) - k, k).alias("gram")))
    steps = wanted.select("g", F.explode(parts).alias("p")).select("g", "p.k", "p.gram", F.expr("left(p.gram, p.k - 1)").alias("context"))
    # all single characters have the empty context: its counts are two numbers, and their keys are spread instead of joined
    total = counted.where(F.char_length("gram") == 1).agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b")).first()
    steps = steps.withColumn("context", F.when(F.col("k") == 1, F.concat(F.lit("\0"), "g")).otherwise(F.col("context")))
    contexts = counted.groupBy(F.expr("left(gram, char_length(gram) - 1)").alias("context"), F.char_length("gram").alias("k")).agg(F.sum("n_a").alias("c_a"), F.sum("n_b").alias("c_b"))
    filled = steps.join(counted, "gram", "left").join(contexts.where("k > 1"), ["context", "k"], "left")
    for c, n in (("c_a", total.a), ("c_b", total.b)):
        filled = filled.withColumn(c, F.when(F.col("k") == 1, F.lit(n or 0).cast("long")).otherwise(F.col(c)))
    filled = filled.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "c_a", "c_b")]))).alias("steps"))

    def p(n: str, c: str) -> Column:
        return F.aggregate("steps", F.lit(1.0 / ALPHABET), lambda acc, s: (s[n] + STRENGTH * acc) / (s[c] + STRENGTH))

    return filled.select("g", (F.log(p("n_a", "c_a")) - F.log(p("n_b", "c_b"))).alias("ratio"))


def scored(urls: DataFrame, labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score) for the distinct ``urls``: the log-likelihood difference divided by the length."""
    # a few MB of URLs are many n-grams: they are dealt out by URL before, which the counting of each URL's n-grams then needs no more
    urls = staged(urls, "urls").repartition(partitions(urls.sparkSession), "url")
    pieces = urls.select("url", F.explode(grams(F.col("url"), order)).alias("g")).groupBy("url", "g").agg(F.count("*").alias("n"))
    wanted = staged(pieces.groupBy("g").agg(F.count("*").alias("urls")), "url-grams")
    table = staged(ratios(wanted.select("g"), staged(model(labelled, order), "url-model"), order).join(wanted, "g"), "url-ratios")
    total = table.agg(F.sum("urls")).first()[0] or 0
    # more than a SHARED-th of all rows each, so fewer than SHARED of them
    hot = F.broadcast(table.where(F.col("urls") > total / SHARED).select("g", F.col("ratio").alias("known")))
    spread = F.when(F.col("known").isNull(), F.col("g")).otherwise(F.concat("g", F.lit("\0"), "url"))  # meets nothing
    rows = pieces.join(hot, "g", "left").withColumn("g", spread).join(table.where(F.col("urls") <= total / SHARED).select("g", "ratio"), "g", "left")
    return rows.groupBy("url").agg((F.sum(F.col("n") * F.coalesce("known", "ratio")) / F.sum("n")).alias("score"))


def held(url: Column) -> Column:
    """A quarter of the rule-judged URLs, kept from the models."""
    return F.crc32(url.cast("binary")) % 4 == 2


def threshold(scores: DataFrame) -> float:
    """The score that parts accepted from rejected URLs with the fewest weighted errors, in the middle of its gap; (score, accepted) rows are counted in bins first.

    One row of at most a few thousand bins is brought to the driver.
    """
    bins = (
        scores.groupBy(F.round("score", 2).alias("bin"))
        .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("b")).orderBy("bin").collect()
    )
    all_a, all_b = max(1, sum(r.a for r in bins)), max(1, sum(r.b for r in bins))
    best, at, missed, let_in, last = 2.0, 0.0, 0.0, 1.0, None
    for r in bins:
        if missed + let_in < best:
            best, at = missed + let_in, r.bin - 0.005 if last is None else (last + r.bin) / 2
        last = r.bin
        missed, let_in = missed + r.a / all_a, let_in - r.b / all_b
    return float(at)


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    seen = pages.select("page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("by", rule(F.col("host"), F.col("path"), rules))
    labelled = staged(seen.where("by is not null").select("url", (F.col("by.verdict") == "allow").alias("accepted")).distinct().withColumn("held", held(F.col("url"))), "url-labelled")
    sides = {(r.held, r.accepted): r["count"] for r in labelled.groupBy("held", "accepted").count().collect()}
    split = all(sides.get((side, accepted), 0) >= LEAST_HELD for side in (True, False) for accepted in (True, False))
    scores = staged(scored(seen.where("url is not null and url <> ''").select("url").distinct(), labelled.where("not held") if split else labelled, order), "url-scores")
    cut = threshold((labelled.where("held") if split else labelled).join(scores, "url").select("score", "accepted"))
    learnt = F.when(F.coalesce(F.col("score") >= cut, F.lit(False)), "allow").otherwise("block")
    return seen.join(scores, "url", "left").select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", learnt).alias("verdict"), "score")


def op3(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages"))
