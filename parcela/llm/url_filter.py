"""URL filters: rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes of pages (1: bad) are counted for each host. Going down from
all pages to suffix, registered domain and host, each level's rates are drawn
from a beta prior whose mean is the posterior mean one level up (without the
unit's own outcomes) and whose strength is fitted to the level's own
over-dispersion by moments (at least the weight of one page). A host is blocked
when the lower posterior bound of its bad rate, the ``tail`` quantile of its
beta posterior, is over ``threshold``: few or mixed outcomes never block. The
quantile is read off the density of the log odds, on a grid of ``2 * GRID + 1``
points as wide as that posterior.

Suffix means the last label of the host, or the last two where they are in
``suffixes`` (a bounded table of public suffixes); the registered domain has one
label more. A port belongs to neither.

Defined results: a null url or one without ``://`` has empty host and path and
belongs to no host (allowed, unless labelled pages without a host are bad
enough); hosts without labelled pages get their domain's prior; repeated rows
are judged alike; with no labels at all nothing is blocked; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
THRESHOLD, TAIL = 0.5, 0.05
#: Points on either side of the middle of the grid, STEPS of them a scale of the posterior.
GRID, STEPS = 1536, 128
#: Public suffixes of two labels: registries under which owners register the third.
SUFFIXES = tuple(
    f"{second}.{country}"
    for country, seconds in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi maori net org school",
        "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "cn": "ac com edu gov net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org",
        "sg": "com edu gov net org per", "my": "com edu gov net org", "th": "ac co go in net or", "id": "ac co go or sch web", "ph": "com edu gov net org", "vn": "com edu gov net org",
        "in": "ac co edu firm gen gov ind net nic org res", "pk": "com edu gov net org", "bd": "com edu gov net org", "il": "ac co gov muni net org", "tr": "av bel com edu gen gov info net org web",
        "za": "ac co edu gov net org web", "ke": "ac co go ne or", "ng": "com edu gov net org", "eg": "com edu gov net org", "br": "com edu gov net org", "ar": "com edu gob gov net org",
        "mx": "com edu gob net org", "co": "com edu gov net org", "pe": "com edu gob net org", "ve": "co com edu gob net org", "ua": "com edu gov net org", "pl": "com edu gov net org",
    }.items()
    for second in seconds.split()
)
#: Host tables up to this many rows (some 100 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_HOSTS = 50_000
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES, value=lambda h, p, v: h + p) -> Column:
    """The longest rule that fits (or what ``value`` makes of it), else null."""
    out = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(value(h, p, v))).otherwise(out)
    return out


def _strength(units: DataFrame) -> float:
    """Of the beta prior, by moments, from rows (n, bad, prior)."""
    v, p = F.col("prior") * (1 - F.col("prior")), F.col("bad") / F.col("n")
    a, e, d = units.filter("n > 0").agg(F.sum(F.col("n") * (p - F.col("prior")) ** 2), F.sum(v), F.sum(v * (F.col("n") - 1))).first()
    rho = (a - e) / d if d else 0.0
    return 1 / min(max(rho, 1e-4), 0.5) - 1


def _priors(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children`` with prior: the posterior mean of their parent without the child's own outcomes, which would count twice."""
    s = _strength(parents)
    up = parents.select(key, *[F.col(c).alias(f"up_{c}") for c in ("n", "bad", "prior")])
    prior = (s * F.col("up_prior") + F.col("up_bad") - F.col("bad")) / (s + F.col("up_n") - F.col("n"))
    return children.join(up, key).withColumn("prior", prior).drop("up_n", "up_bad", "up_prior")


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*suffixes)
    return F.when(long, F.substring_index(name, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(name, ".", -1))


def beta_quantile(a: np.ndarray, b: np.ndarray, tail: float) -> np.ndarray:
    """Lower ``tail`` quantile of each beta distribution."""
    u = np.arange(-GRID, GRID + 1) / STEPS
    out = np.empty(len(a))
    for i in range(0, len(a), 256):
        x, y = a[i : i + 256, None], b[i : i + 256, None]
        t = np.log(x / y) + np.sqrt(1 / x + 1 / x**2 + 1 / y + 1 / y**2) * u
        density = x * t - (x + y) * np.logaddexp(0, t)
        mass = np.cumsum(np.exp(density - density.max(1, keepdims=True)), 1)
        share = mass / mass[:, -1:]
        k = (share < tail).sum(1, keepdims=True)
        at, before = (np.take_along_axis(share, np.maximum(k - j, 0), 1) for j in (0, 1))
        before = np.where(k > 0, before, 0)
        odds = np.take_along_axis(t, k, 1) - (at - tail) / (at - before) * (t[:, 1:2] - t[:, :1])
        out[i : i + 256] = (1 / (1 + np.exp(-odds)))[:, 0]
    return out


def host_reputation(pages: DataFrame, tail: float = TAIL, suffixes=SUFFIXES) -> DataFrame:
    """From rows (host, bad; bad is null where unlabelled): host, n, bad, rate (posterior mean), bound (its lower quantile)."""
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = suffixes.withColumn("prior", (bad - F.col("bad") + 1) / (total - F.col("n") + 2))
    domains = _priors(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), suffixes, "suffix")
    hosts = _priors(hosts.drop("suffix"), domains, "domain")
    s = _strength(hosts)
    rate = (s * F.col("prior") + F.col("bad")) / (s + F.col("n"))

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(a.to_numpy(float), b.to_numpy(float), tail))

    hosts = hosts.select("host", "n", "bad", rate.alias("rate"))
    return hosts.withColumn("bound", quantile(F.col("rate") * (s + F.col("n")), (1 - F.col("rate")) * (s + F.col("n"))))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, tail: float = TAIL, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's n (labelled pages), rate and bound. ``outcomes``: (page_id, bad), at most one row for each page."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = parsed.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id", "left")
    known = written(host_reputation(labelled, tail, suffixes).drop("bad"), "reputation")
    known = F.broadcast(known) if known.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else known.hint("merge")
    host, path = F.col("host"), F.col("path")
    ruled = rule_column(host, path, rules, lambda h, p, v: v)
    by_host = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return parsed.join(known, "host", "left").select(
        "page_id", "host", "path", rule_column(host, path, rules).alias("rule"), F.coalesce(ruled, by_host).alias("verdict"), "n", "rate", "bound"
    )


#: The number in a page's path is the id of the document it shows.
DOCUMENT = r"/(\d{1,18})(?:\D|$)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if its document is labelled as of low quality or as toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    shown = pages.select("page_id", F.regexp_extract(path_of(F.col("url")), DOCUMENT, 1).alias("d")).filter("d <> ''")
    outcomes = shown.select("page_id", F.col("d").cast("long").alias("doc_id")).join(labels, "doc_id")
    judged = filter_urls(pages, outcomes.groupBy("page_id").agg(F.max("bad").alias("bad")))
    return judged.withColumns({c: F.round(c, 6) for c in ("rate", "bound")})


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT page_id, max(bad) AS bad FROM p JOIN lab ON doc_id = try_cast(regexp_extract(path, '/(\d{1,18})(?:\D|$)', 1) AS BIGINT) GROUP BY page_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
      FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, ((SELECT sum(bad) FROM h) - sum(bad) + 1) / ((SELECT sum(n) FROM h) - sum(n) + 2) AS prior FROM h GROUP BY suffix),
k0 AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0), 1e-4), 0.5) - 1 AS s FROM s0 WHERE n > 0),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
d1 AS (SELECT domain, d0.n, d0.bad, (s * prior + s0.bad - d0.bad) / (s + s0.n - d0.n) AS prior FROM d0 JOIN s0 USING (suffix), k0),
k1 AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0), 1e-4), 0.5) - 1 AS s FROM d1 WHERE n > 0),
h1 AS (SELECT host, h.n, h.bad, (s * prior + d1.bad - h.bad) / (s + d1.n - h.n) AS prior FROM h JOIN d1 USING (domain), k1),
k2 AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - prior) ** 2) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0), 1e-4), 0.5) - 1 AS s FROM h1 WHERE n > 0),
h2 AS (SELECT host, n, (s * prior + bad) / (s + n) AS rate, s * prior + bad AS a, (s + n) - (s * prior + bad) AS b FROM h1, k2),
g0 AS (SELECT host, a, b, i, ln(a / b) + sqrt(1 / a + 1 / a ** 2 + 1 / b + 1 / b ** 2) * i / 128 AS t, sqrt(1 / a + 1 / a ** 2 + 1 / b + 1 / b ** 2) / 128 AS dt FROM h2, (SELECT unnest(range(-1536, 1537)) AS i)),
g1 AS (SELECT *, a * t - (a + b) * (greatest(t, 0) + ln(1 + exp(-abs(t)))) AS f FROM g0),
g2 AS (SELECT *, exp(f - max(f) OVER (PARTITION BY host)) AS m FROM g1),
g3 AS (SELECT *, sum(m) OVER (PARTITION BY host ORDER BY i) / sum(m) OVER (PARTITION BY host) AS share FROM g2),
g4 AS (SELECT *, lag(share, 1, 0) OVER (PARTITION BY host ORDER BY i) AS below FROM g3),
b AS (SELECT host, 1 / (1 + exp(-(t - (share - 0.05) / (share - below) * dt))) AS bound FROM g4 WHERE share >= 0.05 AND below < 0.05),
r AS (SELECT p.*, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, n, round(rate, 6) AS rate, round(bound, 6) AS bound FROM r JOIN h2 USING (host) JOIN b USING (host)
"""
