"""URL filters by rules and empirical-Bayes host reputation; DataFrame functions only.

Labelled outcomes of pages (good or not) are counted for each host.  A host's rate is drawn from a beta prior around
its registered domain's, that one from a prior around its suffix's, that one around the rate of all pages.  The
strength of each level's prior is estimated by the method of moments from the spread of the children's rates, and each
level's posterior mean is the mean of the next prior.  A page is blocked if the upper bound (mean + Z deviations) of
its host's posterior rate is below LEAST_GOOD; a host never seen has its domain's, suffix's or the global prior.

Rules come first.  They are few (at most MAX_RULES, checked) and go into the plan as a literal; one fits its host and
all subdomains if the path starts with the rule's, and the longest wins.

Defined results: a null url, or one without "://", has an empty host and path and fits no rule; a host without a dot is
its own domain and suffix; ports count for the host alone; a registered domain is the label before the suffix, which is the
last label, or the last two where a country gives out names under one of SECOND; a page without an outcome counts nowhere; without any outcome the global rate is 0.5 with
no evidence, and nothing is blocked but by rules; rows that repeat a page are judged each, their outcomes counted each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MAX_RULES, LEAST_GOOD, Z = 10_000, 0.5, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels under which countries' domains are given out, as in co.uk; with the country they are a suffix.
SECOND = "ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch"
SUFFIX, DOMAIN = rf"(?:^|\.)((?:{SECOND})\.[a-z][a-z]|[^.]*)$", rf"(?:^|\.)([^.]*\.(?:(?:{SECOND})\.[a-z][a-z]|[^.]*))$"
#: A port isn't part of a name; a number for a host is its own domain, all of these have one suffix.
PORT, ADDRESS, NUMBERS = r":[0-9]*$", r"^([0-9.]+|\[.*)$", "(number)"
#: Least and greatest strength of a prior, in observations.
WEAK, STRONG = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(verdict).alias("verdict")))
    known = F.create_map(*[x for h, r in by_host.items() for x in (F.lit(h), F.array(*r))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    return F.when(F.size(fits) > 0, F.array_max(fits))


def with_levels(df: DataFrame) -> DataFrame:
    """df with domain and suffix of its host."""
    bare = F.regexp_replace("host", PORT, "")
    named = lambda shape: F.coalesce(F.nullif(F.regexp_extract(bare, shape, 1), F.lit("")), bare)
    number = bare.rlike(ADDRESS)
    return df.withColumn("domain", F.when(number, bare).otherwise(named(DOMAIN))).withColumn("suffix", F.when(number, NUMBERS).otherwise(named(SUFFIX)))


def shrunk(children: DataFrame, parents: DataFrame, key: str, parent: str | None) -> DataFrame:
    """children (key, parent, n, good) with mean and strength by the prior around their parent's mean; the one row of
    parents is the parent of all where there is no column for it.

    The strength s solves Var(rate) = m (1 - m) (1 + (n - 1) / (s + 1)) / n on average over all children with outcomes.
    """
    if parent:
        c = children.join(parents.select(F.col(parent), F.col("mean").alias("m")), parent)
    else:
        c = children.withColumn("m", parents.select("mean").scalar())
    v = F.col("m") * (1 - F.col("m"))
    fit = c.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)).alias("ss"), F.sum(v).alias("own"), F.sum(v * (F.col("n") - 1)).alias("shared"))
    spread = F.greatest((F.col("ss") - F.col("own")) / F.col("shared"), F.lit(1 / (STRONG + 1)))
    fit = fit.select(F.when(F.col("shared") > 0, F.greatest(F.lit(WEAK), F.least(F.lit(STRONG), 1 / spread - 1))).otherwise(STRONG).alias("s"))
    c = c.withColumn("s", fit.scalar())
    post = (F.col("good") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))
    return c.select(*(x for x in {key: 0, "domain": 0, "suffix": 0} if x in children.columns), "n", "good", post.alias("mean"), (F.col("n") + F.col("s")).alias("strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, good, mean, strength) for a table (host, good 0/1/null); counts are combined before they are shuffled."""
    hosts = checkpointed(with_levels(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))))  # all levels are made of these
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    top = suffixes.agg(((F.sum("good") + 0.5) / (F.sum("n") + 1)).alias("mean"))
    s = shrunk(suffixes, top, "suffix", None)
    return shrunk(hosts, shrunk(domains, s, "domain", "suffix"), "host", "domain").drop("domain", "suffix")


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, good_rate, good_bound) of each page; outcomes (page_id, good), one of a page."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    rep = reputation(read.select("page_id", "host").join(known, "page_id", "left"))
    bound = F.col("mean") + Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    out = read.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(rep.select("host", "mean", bound.alias("bound")), "host")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("bound") < LEAST_GOOD, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.col("mean").alias("good_rate"), F.col("bound").alias("good_bound"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels of the documents that have the pages' ids."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judged(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


_FIT = "select greatest({w}, least({t}, 1 / greatest((sum(n * pow(good / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)), 1 / ({t} + 1)) - 1)) as s from {c} where n > 0"


def _level(name: str, child: str, parent: str, key: str) -> str:
    fit = _FIT.format(w=WEAK, t=STRONG, c=f"{name}_c")
    return f"{name}_c as (select c.*, p.mean as m from {child} c join {parent} p using ({key})), {name} as (select * exclude (m, s), (good + s * m) / (n + s) as mean, n + s as strength from {name}_c, ({fit}))"


ORACLE_SQL = f"""
with cut as (select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
named as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
known as (select doc_id as page_id, min(quality) as good from labels group by 1),
cleaned as (select *, regexp_replace(host, '{PORT}', '') as bare from named),
hosts as (select host, case when regexp_matches(bare, '{ADDRESS}') then bare else coalesce(nullif(regexp_extract(bare, '{DOMAIN}', 1), ''), bare) end as domain,
  case when regexp_matches(bare, '{ADDRESS}') then '{NUMBERS}' else coalesce(nullif(regexp_extract(bare, '{SUFFIX}', 1), ''), bare) end as suffix, count(good)::double as n, coalesce(sum(good), 0)::double as good
  from cleaned left join known using (page_id) group by 1, 2, 3),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by 1, 2),
suffixes as (select suffix, 1 as one, sum(n) as n, sum(good) as good from domains group by 1),
top as (select 1 as one, (sum(good) + 0.5) / (sum(n) + 1) as mean from suffixes),
{_level("rs", "suffixes", "top", "one")}, {_level("rd", "domains", "rs", "suffix").replace("p.mean as m from domains c join rs p", "p.mean as m from domains c join (select suffix, mean from rs) p")}, {_level("rh", "hosts", "(select domain, mean from rd)", "domain")},
rules(verdict, h, p) as (values {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
fits as (select page_id, max_by(h || p, length(h || p)) as rule, max_by(r.verdict, length(h || p)) as verdict from named, rules r
  where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
select page_id, host, path, rule, coalesce(fits.verdict, case when mean + {Z} * sqrt(mean * (1 - mean) / (strength + 1)) < {LEAST_GOOD} then 'block' else 'allow' end) as verdict
from named join (select host, mean, strength from rh) using (host) left join fits using (page_id)
"""
