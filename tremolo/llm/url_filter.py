"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted for each host, registered domain and suffix.
From the top down every level is shrunk towards its parent by a beta-binomial prior whose
strength comes from the data by moments: with rates p and parent means m of the children,
E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho), and the prior counts for 1 / rho - 1 pages. A host
is blocked if the lower bound of its posterior share of bad pages is above ``block_above``.
All of it is DataFrame expressions; counts are aggregated before any shuffle.

Defined results of odd inputs: a null url, or one without ``://``, has empty host and path,
matches no rule, and is judged like any host (the empty one); null outcomes are no outcomes;
several outcomes of a page count each; repeated pages are returned each; without outcomes
every host has the even prior and is allowed; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "co.za", "com.mx", "com.tr")
LEAST_RHO, MOST_RHO = 0.001, 0.9


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, cut at the first slash; it fits the host and its subdomains
    where the path starts with the rule's."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, SHAPE, 1), UPPER, LOWER), F.regexp_extract(url, SHAPE, 2)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    double = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(double, two).otherwise(F.substring_index(host, ".", -1)), F.when(double, F.substring_index(host, ".", -3)).otherwise(two)


def _strength(children: DataFrame) -> float:
    """Pages that the parent's mean counts for, from children (n, bad, m)."""
    row = children.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), F.lit(2.0)) - F.col("m") * (1 - F.col("m"))).alias("over"),
        F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)).alias("base"),
    ).first()
    rho = row["over"] / row["base"] if row["base"] else LEAST_RHO
    return 1.0 / min(max(rho, LEAST_RHO), MOST_RHO) - 1.0


def reputation(hosts: DataFrame, scratch: Scratch, z: float = 1.645) -> DataFrame:
    """``hosts(host, suffix, domain, n, bad)`` with posterior mean and lower bound."""
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    top = (total["bad"] + 0.5) / (total["n"] + 1.0)
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("m", F.lit(top))
    k = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix")
    k = _strength(domains)
    domains = scratch.keep(domains.select("domain", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("m")), "domains")
    hosts = hosts.join(domains, "domain")
    k = _strength(hosts)
    a, b = F.col("bad") + k * F.col("m"), F.col("n") - F.col("bad") + k * (1 - F.col("m"))
    spread = F.sqrt(a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1)))
    return hosts.select("host", "n", "bad", (a / (a + b)).alias("bad_share"), (a / (a + b) - z * spread).alias("bad_at_least"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, block_above: float = 0.5) -> DataFrame:
    """``pages(page_id, url)`` and ``outcomes(page_id, bad 0/1)`` -> page_id, host, path, rule,
    verdict, bad_share, bad_at_least. The longest fitting rule decides (of equal lengths the one
    with the longer host, then the first by text); else the host's reputation."""
    scratch = Scratch(pages.sparkSession, "hosts")
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = named.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = scratch.keep(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"), "hosts")
    judged = scratch.keep(reputation(hosts, scratch), "reputation").drop("n", "bad")
    out = named.join(judged, "host")
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.text.partition("/")[0]), r.text))
    fits = [r.fits(F.col("host"), F.col("path")) for r in ordered]
    rule = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(r.text)) for f, r in zip(fits, ordered, strict=True)])
    own = F.when(F.col("bad_at_least") > block_above, "block").otherwise("allow")
    verdict = F.coalesce(*[F.when(f, F.lit(r.verdict)) for f, r in zip(fits, ordered, strict=True)], own)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_share", "bad_at_least")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label of its number says low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    return judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, key: str, parent: str, mean: str) -> str:
    """SQL of one level: its children with the parent's mean, and the prior's strength."""
    return f"""
{name} AS (SELECT c.*, {mean} AS m FROM ({key}) c {parent}),
{name}_k AS (SELECT 1.0::DOUBLE / least(greatest(CASE WHEN base <> 0 THEN over_ / base ELSE {LEAST_RHO} END, {LEAST_RHO}::DOUBLE), {MOST_RHO}::DOUBLE) - 1 AS k FROM (
  SELECT sum(n * pow(bad / n - m, 2) - m * (1 - m)) AS over_, sum(m * (1 - m) * (n - 1)) AS base FROM {name} WHERE n > 0))"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_TAIL = "array_to_string(list_slice(parts, greatest(len(parts) - {n}, 1), len(parts)), '.')"
_ORDERED = sorted(RULES, key=lambda r: (-len(r.text), -len(r.text.partition("/")[0]), r.text))


def _fits(r: Rule) -> str:
    name, _, rest = r.text.partition("/")
    return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}'))"


ORACLE = f"""
WITH named AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{SHAPE}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{SHAPE}', 2) AS path FROM pages),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(greatest((quality = 0)::INT, (toxic = 1)::INT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL GROUP BY 1),
counted AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS parts FROM named LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, bad, CASE WHEN {_TAIL.format(n=1)} IN ({_TWO}) THEN {_TAIL.format(n=1)} ELSE parts[len(parts)] END AS suffix,
  CASE WHEN {_TAIL.format(n=1)} IN ({_TWO}) THEN {_TAIL.format(n=2)} ELSE {_TAIL.format(n=1)} END AS domain FROM counted),
{_level("s", "SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix", "", "(SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM hosts)")},
sm AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s, s_k),
{_level("d", "SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain", "JOIN sm USING (suffix)", "sm.m")},
dm AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM d, d_k),
{_level("h", "SELECT host, domain, n, bad FROM hosts", "JOIN dm USING (domain)", "dm.m")},
ab AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM h, h_k)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _ORDERED)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _ORDERED)} WHEN a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM named JOIN ab USING (host)
"""
