"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled pages are outcomes (1: bad). Each host, registered domain and suffix has counts;
the prior of a host is a beta distribution around the posterior mean of its registered
domain, whose prior lies around that of its suffix, whose prior lies around the mean of
all pages. How strongly a level's groups gather around their parents' means is estimated
from all of its groups by the method of moments. A page is blocked if the lower bound of
its host's posterior exceeds ``limit``; so hosts with few outcomes follow their domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: (host and path prefix, verdict); a rule fits its host and all hosts below it.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Second labels that are part of the public suffix where the first level is a country's
# (two letters), and hosts of users' own sites, which are suffixes too.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "govt", "go", "id", "info", "ltd", "me", "mil", "name", "ne", "net", "nom", "or", "org", "plc", "sch")
SITE_SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app")
#: What a host that is an IP address has for a suffix.
IP = "ip"
IPV4, IPV6 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", r"^\[[0-9a-f:.]+\]$"
LEVELS = ("suffix", "domain", "host")
STRENGTH = (1.0, 1000.0)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.find("/")
        site, start = (text, "") if at < 0 else (text[:at], text[at:])
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def site(host: Column) -> Column:
    """host without user info, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def levels(host: Column) -> dict[str, Column]:
    """suffix, domain and host. An IP address is its own domain; a suffix by itself is, too."""
    name = site(host)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    tail = lambda k: F.concat_ws(".", F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k))
    long = tail(2).isin(*SITE_SUFFIXES) | tail(2).rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$")
    address = name.rlike(IPV4) | name.rlike(IPV6)
    suffix = F.when(address, F.lit(IP)).when(long, tail(2)).otherwise(tail(1))
    return {"suffix": suffix, "domain": F.when(address, name).when(long, tail(3)).otherwise(tail(2)), "host": name}


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, deviation) of outcomes (host, bad 0, 1 or null): counts, and the posterior of the bad share.

    Hosts that differ in user info or port only are one, named without these.

    Counts are summed before every shuffle, so a host with most of the pages is one row
    a task. The driver gets one row for each level.
    """
    counts = outcomes.groupBy(site(F.col("host")).alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    names = levels(F.col("host"))
    hosts = stored(counts.select(names["suffix"].alias("suffix"), names["domain"].alias("domain"), "host", "n", "bad"), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    above, key = None, []
    for level in LEVELS:
        path = LEVELS[: LEVELS.index(level) + 1]
        groups = hosts.groupBy(*path).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.join(above, key) if key else groups.withColumn("prior", F.lit((total["bad"] + 1) / (total["n"] + 2)))
        # moments: E[(bad - n m)^2] = n m (1 - m) (1 + (n - 1) / (strength + 1))
        m, n = F.col("prior"), F.col("n").cast("double")
        due = n * m * (1 - m)
        moments = groups.agg(F.sum(F.pow(F.col("bad") - n * m, F.lit(2.0)) - due).alias("over"), F.sum(F.when(n > 0, due * (n - 1))).alias("scale")).first()
        rho = (moments["over"] or 0.0) / moments["scale"] if moments["scale"] else 0.0
        strength = min(max(1 / max(rho, 1e-9) - 1, STRENGTH[0]), min(STRENGTH[1], total["n"] + 2))  # no surer than all outcomes together
        a = F.col("bad") + m * strength
        b = F.col("n") - F.col("bad") + (1 - m) * strength
        mean = a / (a + b)
        groups = groups.select(*path, "n", "bad", mean.alias("prior"), F.sqrt(mean * (1 - mean) / (a + b + 1)).alias("deviation"))
        above, key = groups.select(*path, "prior"), list(path)
    return groups.select("host", "n", "bad", F.col("prior").alias("mean"), "deviation")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5, bound: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict and reputation of every row of pages (page_id, url).

    labels (doc_id, quality, toxic) carries the outcome of the page of the same id: bad
    if its quality is 0 or it is toxic; rows with both null count for nothing. A host
    without outcomes has the reputation of its registered domain; user info and ports make
    no other host, and IP addresses are domains of their own. Long URLs are read whole. Null and
    unreadable URLs have a null reputation and are allowed. Repeated labels count once, the worst.
    Repeated pages get a row each. No rows: no rows. Other columns are not read.
    """
    url = F.col("url")
    host, path = url_host(url), url_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    worst = F.greatest(F.max(1 - F.col("quality")), F.max("toxic"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(worst.alias("bad")).where("bad in (0, 1)").select(F.col("doc_id").alias("page_id"), "bad")
    outcomes = rows.where("host <> ''").join(known, "page_id", "left").select("host", "bad")
    score = (F.col("mean") - F.lit(bound) * F.col("deviation")).alias("reputation")
    found = rows.join(host_reputation(outcomes).select(F.col("host").alias("of"), score), site(F.col("host")) == F.col("of"), "left")
    rule, verdict = url_rule(F.col("host"), F.col("path"), rules)
    said = F.coalesce(verdict, F.when(F.col("reputation") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict"), "reputation")
