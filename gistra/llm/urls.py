"""URL rules and host reputation.

Rules name a host suffix and a path prefix; the longest rule that fits a url
decides. Urls that no rule fits are judged by the reputation of their host: the
labelled outcomes of its pages are shrunk through a chain of beta-binomial
priors, global -> suffix -> registered domain -> host. The strength of each
level's prior comes from the spread between its members (the analysis-of-
variance estimate of the intra-class correlation), so hosts with few labelled
pages lean on their domain. A host is blocked when the lower bound of its
posterior bad-page rate is above a threshold.

All is DataFrame expressions: one aggregation by host, two small ones above it,
and a join of the (few) blocked hosts. Three rows of level statistics reach the
driver.

Defined results for odd input: a null url or one without ``://`` has an empty
host and path, fits no rule and is allowed; pages without a labelled outcome
count as no evidence; repeated rows count each; repeated labels of an id count
once (bad if any says so); empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.llm.common import ascii_lower, cut, table

#: (verdict, host, path) of the production rules. Fixed values.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Posterior lower bound: mean - Z standard deviations; hosts above BAD_RATE are blocked.
Z = 1.645
BAD_RATE = 0.5
#: Limits of the intra-class correlation of a level, so that priors stay proper.
RHO_MIN, RHO_MAX = 0.001, 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(_longest_first(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _domain(host: Column, labels: int) -> Column:
    """The last labels of a host name."""
    return F.substring_index(host, ".", -labels)


def _spread(children: DataFrame) -> tuple[float, float]:
    """(mean bad rate, prior strength) of a level's members with columns n, bad."""
    c = children.filter("n > 0")
    s = c.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("within"),
    ).first()
    if not s.n:
        return 0.5, 1 / RHO_MAX - 1
    m = s.bad / s.n
    rho = RHO_MIN
    if s.k > 1 and s.n > s.k:
        n0 = (s.n - s.n2 / s.n) / (s.k - 1)
        msb = (s.within - s.n * m * m) / (s.k - 1)
        msw = (s.bad - s.within) / (s.n - s.k)
        base = msb + (n0 - 1) * msw
        rho = min(RHO_MAX, max(RHO_MIN, (msb - msw) / base)) if base > 0 else RHO_MIN
    return m, 1 / rho - 1


def reputation(hosts: DataFrame, suffix_labels: int = 1) -> DataFrame:
    """hosts(host, n, bad) with posterior ``alpha``, ``beta`` and the lower bound ``bound``.

    ``suffix_labels``: labels of a public suffix; a registered domain has one more.
    """
    hosts = hosts.withColumn("domain", _domain(F.col("host"), suffix_labels + 1)).withColumn("suffix", _domain(F.col("host"), suffix_labels))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, k_suffix = _spread(suffixes)
    _, k_domain = _spread(domains)
    _, k_host = _spread(hosts)

    def shrunk(k: float, prior: Column) -> Column:
        return (k * prior + F.col("bad")) / (k + F.col("n"))

    top = suffixes.select("suffix", shrunk(k_suffix, F.lit(mean)).alias("suffix_mean"))
    mid = domains.join(top, "suffix").select("domain", shrunk(k_domain, F.col("suffix_mean")).alias("domain_mean"))
    post = hosts.join(mid, "domain")
    a = k_host * F.col("domain_mean") + F.col("bad")
    b = k_host * (1 - F.col("domain_mean")) + F.col("n") - F.col("bad")
    post = post.withColumn("alpha", a).withColumn("beta", b)
    n = F.col("alpha") + F.col("beta")
    m = F.col("alpha") / n
    return post.withColumn("bound", m - Z * F.sqrt(m * (1 - m) / (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages(page_id, url) and outcomes(page_id, bad 0/1) -> page_id, host, path, rule, verdict."""
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = (
        seen.select("page_id", "host").join(known, "page_id", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    hosts = cut(hosts)  # one row a host; read four times
    blocked = reputation(hosts).filter((F.col("bound") > BAD_RATE) & (F.col("host") != "")).select("host", F.lit(True).alias("__blocked"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return seen.join(blocked, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("__blocked"), "block").otherwise("allow")).alias("verdict"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a labelled page is one whose id is labelled, bad where its quality is 0."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


OP9_SQL = r"""
with seen as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
known as (select doc_id as page_id, max(case when quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null and quality is not null group by 1),
hosts as (
  select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix,
    count(bad)::double as n, coalesce(sum(bad), 0)::double as bad
  from seen left join known using (page_id) group by host),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by all),
members as (
  select 1 as level, n, bad from suffixes where n > 0 union all
  select 2, n, bad from domains where n > 0 union all
  select 3, n, bad from hosts where n > 0),
sums as (select level, count(*) as k, sum(n) as n, sum(bad) as bad, sum(n * n) as n2, sum(bad * bad / n) as within from members group by level),
squares as (
  select level, bad / n as m, k, n,
    (n - n2 / n) / (k - 1) as n0, (within - bad * bad / n) / (k - 1) as msb, (bad - within) / (n - k) as msw
  from sums),
strength as (
  select level, m, 1 / (case when k > 1 and n > k and msb + (n0 - 1) * msw > 0
    then least(0.5, greatest(0.001, (msb - msw) / (msb + (n0 - 1) * msw))) else 0.001 end) - 1 as kappa
  from squares),
k as (select max(case when level = 1 then m end) as mean, max(case when level = 1 then kappa end) as ks,
  max(case when level = 2 then kappa end) as kd, max(case when level = 3 then kappa end) as kh from strength),
top as (select suffix, (coalesce(ks, 1) * coalesce(mean, 0.5) + bad) / (coalesce(ks, 1) + n) as sm from suffixes, k),
mid as (select domain, (coalesce(kd, 1) * sm + bad) / (coalesce(kd, 1) + n) as dm from domains join top using (suffix), k),
post as (
  select host, coalesce(kh, 1) * dm + bad as a, coalesce(kh, 1) * (1 - dm) + n - bad as b from hosts join mid using (domain), k),
blocked as (select host from post where host <> '' and a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5),
ruled as (
  select *, case
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from seen)
select page_id, host, path, rule,
  case rule when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow' when 'net/' then 'block'
    else case when host in (select host from blocked) then 'block' else 'allow' end end as verdict
from ruled
"""
