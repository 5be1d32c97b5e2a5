"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's bad rate is a beta-binomial whose
prior comes from the level above: the host's mean is drawn towards its registered domain's, that towards its suffix's,
that towards the rate of all pages, by a strength fitted to how much rates differ within the level. A host is blocked if
the lower bound of its posterior bad rate is over a threshold. Rules go before. All is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lower_ascii, written

#: (host, path, verdict) of the fixed rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Labels under a country's that domains are registered below, and suffixes that many owners share (fixed values).
SECOND = "ac asn co com edu firm gen go gob gouv gov gv id ind info ltd me mil ne net nhs nom or org plc police res sch school tm web".split()
SHARED = "blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev vercel.app web.app wordpress.com".split()
#: User, port and final dots, which go from a host; an address of numbers; and hosts whose suffix has two labels.
STRIPPED = ("^.*@", ":[0-9]*$", "[.]+$")
ADDRESS = r"^([0-9.]+|\[.*\])$"
TWO_LABELS = f"(^|[.])(({'|'.join(SECOND)})[.][a-z][a-z]|{'|'.join(x.replace('.', '[.]') for x in SHARED)})$"
#: Blocked if the mean less so many standard deviations of the posterior is over the threshold.
DEVIATIONS, THRESHOLD = 1.645, 0.5
#: Bounds of the fitted prior strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path joined) and its verdict; both null if none fits. Of rules as long, the first by text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), tuple(-ord(c) for c in r[0] + r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> tuple[Column, Column]:
    """A host's registered domain and its suffix, without user, port and final dots.

    The suffix is the last label, or the last two if they are a SECOND one under a country's two letters, or one of SHARED;
    the registered domain has one label more. An address of numbers is its own domain and suffix.
    """
    name = host
    for pattern in STRIPPED:
        name = F.regexp_replace(name, pattern, "")
    number, two = name.rlike(ADDRESS), name.rlike(TWO_LABELS)
    last = lambda n: F.substring_index(name, ".", -n)
    return F.when(number, name).when(two, last(3)).otherwise(last(2)), F.when(number, name).when(two, last(2)).otherwise(last(1))


def strength(level: DataFrame) -> Column:
    """The number of pages that a level's prior weighs, by moments: rates that differ no more than chance would have them give a strong prior.

    ``level``: n, bad, mean (the prior's mean for that row).
    """
    n, p = F.col("n"), F.col("mean")
    spread = F.sum(n * F.pow(F.col("bad") / n - p, 2))  # expected: sum of p(1-p) * (1 + (n-1) * rho)
    base, more = F.sum(p * (1 - p)), F.sum(p * (1 - p) * (n - 1))
    rho = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(spread - base, more), F.lit(0.0)))
    return F.coalesce(F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.try_divide(1 - rho, rho))), F.lit(MOST_STRENGTH))


def reputation(hosts: DataFrame, tables: list[DataFrame] | None = None) -> DataFrame:
    """host, n, bad, mean, low (the posterior's) of every host. ``hosts``: host, domain, suffix, n and bad (labelled pages, of them bad). Tables written on the way are added to ``tables``."""
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean"))
    above = None
    for level in ("suffix", "domain", "host"):
        parent = {"suffix": None, "domain": "suffix", "host": "domain"}[level]
        keys = [level, *[parent] * bool(parent)]
        counts = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        counts = counts.crossJoin(F.broadcast(whole)) if above is None else counts.join(above, parent)  # one row
        weight = counts.where("n > 0").agg(strength(counts).alias("s"))  # one row
        post = counts.crossJoin(F.broadcast(weight))
        a, b = F.col("mean") * F.col("s") + F.col("bad"), (1 - F.col("mean")) * F.col("s") + F.col("n") - F.col("bad")
        post = post.select(level, "n", "bad", a.alias("a"), b.alias("b"))
        post = written(post, f"{level}-reputation")
        if tables is not None:
            tables.append(post)
        above = post.select(level, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    low = mean - DEVIATIONS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return post.select("host", "n", "bad", mean.alias("mean"), F.greatest(F.lit(0.0), low).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled, bad, bad_rate and bad_low of every row of page_id and url.

    ``labels``: page_id and bad (0 or 1); labels of one page count once, as bad if any is. A page without a rule is
    blocked if its host's bad_low is over ``threshold``. Null urls and urls without :// have an empty host, which is a
    host like any other. Only counts are joined to pages; the join's other side is one row a host.
    """
    rules = RULES if rules is None else rules
    known = labels.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    domain, suffix = domains(F.col("host"))
    hosts = (
        parts.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    )
    tables = [written(hosts, "hosts")]  # pages are read once for this, however often levels look at the counts
    known_hosts = written(reputation(tables[0], tables), "reputation")
    for table in tables:
        forget(table)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return parts.join(known_hosts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("n").alias("labelled"), "bad", F.round("mean", 9).alias("bad_rate"), F.round("low", 9).alias("bad_low"),
    )
