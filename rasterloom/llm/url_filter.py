"""URL filtering: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host and shrunk through
beta-binomial priors: host -> registered domain -> public suffix -> everything. A suffix is the
last label, or the last two where a country's registry keeps such a class of names (co.uk, com.au);
the registered domain has one label more.
The strength of each prior is the method-of-moments estimate of the spread
between the groups of that level. A page passes when the lower bound of its
host's posterior reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, materialize, table

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
THRESHOLD = 0.75
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 2.0, 200.0
#: Fixed value: classes of names below country codes under which sites are registered.
TWO_LABELS = r"(^|[.])(ac|co|com|edu|gob|gov|go|ltd|me|ne|net|nhs|nom|or|org|plc|sch)[.][a-z]{2}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where url is null or has no '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Add rule and rule_verdict from the longest rule that fits (host, path); null where none does.

    The rules are a short literal list (hundreds at most): one CASE, no join.
    """
    fits = [
        (F.col("host").eqNullSafe(h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        for _, h, p in rules
    ]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda i: len(rules[i][1] + rules[i][2]))
    for i in order:
        rule = F.when(fits[i], rules[i][1] + rules[i][2]).otherwise(rule)
        verdict = F.when(fits[i], rules[i][0]).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _strength(groups: DataFrame, key: str) -> tuple[float, float]:
    """Mean and prior strength over groups(key, n, good): one row comes back, whatever the input."""
    m = groups.groupBy(key).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    r = m.agg(
        F.sum("n").alias("n"), F.sum("good").alias("g"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"),
    ).first()
    if not r["n"]:
        return 0.5, MIN_STRENGTH
    p = r["g"] / r["n"]
    spread, free = r["gg"] - r["g"] * p, r["n"] - r["nn"] / r["n"]
    if p in (0.0, 1.0) or free <= 0 or r["k"] < 2:
        return p, MAX_STRENGTH
    rho = (spread / (p * (1 - p)) - (r["k"] - 1)) / max(free - (r["k"] - 1), 1e-9)
    return p, min(max(1 / max(rho, 1e-9) - 1, MIN_STRENGTH), MAX_STRENGTH)


def reputation(pages: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """Hosts of pages(host, ...) with their posterior; outcomes(host, outcome) holds the labelled pages.

    A hot host is pre-aggregated by Spark's partial counts. Hosts without outcomes
    take their domain's, suffix's or the overall posterior; null outcomes are ignored.
    Counts of each level are written first, so that Spark can split the hosts of a hot suffix.
    """
    two = F.col("host").rlike(TWO_LABELS)
    domain = F.when(two, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    suffix = F.when(two, F.substring_index("host", ".", -2)).otherwise(F.substring_index("host", ".", -1))
    counts = (
        outcomes.where(F.col("outcome").isNotNull()).groupBy("host")
        .agg(F.count("*").cast("double").alias("n"), F.sum("outcome").cast("double").alias("good"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    counts = materialize(counts, "host-counts")
    prior, s_suffix = _strength(counts, "suffix")
    _, s_domain = _strength(counts, "domain")
    _, s_host = _strength(counts, "host")

    def shrunk(key: str, parent: Column, strength: float) -> Column:
        g, n = F.coalesce(F.col(f"good_{key}"), F.lit(0.0)), F.coalesce(F.col(f"n_{key}"), F.lit(0.0))
        return (g + strength * parent) / (n + strength)

    def level(key: str) -> DataFrame:
        return materialize(counts.groupBy(key).agg(F.sum("n").alias(f"n_{key}"), F.sum("good").alias(f"good_{key}")), f"{key}-counts")

    hosts = pages.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    for key in ("host", "domain", "suffix"):
        hosts = hosts.join(level(key).hint("merge"), key, "left")
    by_suffix = shrunk("suffix", F.lit(prior), s_suffix)
    by_domain = shrunk("domain", F.col("m_suffix"), s_domain)
    mean = shrunk("host", F.col("m_domain"), s_host)
    hosts = hosts.withColumn("m_suffix", by_suffix).withColumn("m_domain", by_domain).withColumn("mean", mean)
    total = F.coalesce(F.col("n_host"), F.lit(0.0)) + s_host
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return hosts.select("host", "mean", bound.alias("bound"), F.when(bound >= threshold, "allow").otherwise("block").alias("host_verdict"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages(page_id, url) with host, path, rule, verdict, mean, bound.

    outcomes(page_id, outcome): labelled pages. A null url, or one without '://', has an
    empty host and path, fits no rule and is judged by the empty host's posterior. Other
    columns of pages are not read; repeated page_ids give repeated rows. Of several outcomes of a page the
    greatest counts. Urls of any length are taken whole. Without outcomes every mean is one half. Empty
    tables give no rows.
    """
    host, path = host_and_path(F.col("url"))
    judged = match_rules(pages.select("page_id", F.col("url")).withColumns({"host": host, "path": path}), rules)
    seen = outcomes.select("page_id", "outcome").groupBy("page_id").agg(F.max("outcome").alias("outcome"))
    labelled = judged.select("page_id", "host").join(seen.hint("merge"), "page_id").select("host", "outcome")
    known = reputation(judged, labelled, threshold)
    return judged.join(known.hint("merge"), "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "host_verdict").alias("verdict"), "mean", "bound",
    )


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality labels of the document that a page shows: the number after the language in its path."""
    doc = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[^/?#]*/(\d{1,18})", 1)
    shown = pages.select("page_id", F.nullif(doc, F.lit("")).try_cast("long").alias("doc_id"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("outcome"))
    return shown.join(marks.hint("merge"), "doc_id").select("page_id", "outcome")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = filter_urls(pages, outcomes_of(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_LEVEL = """
{k}s AS (SELECT {k}, sum(n) AS n, sum(good) AS good FROM counts GROUP BY 1),
{k}_m AS (SELECT sum(n) AS n, sum(good) AS g, count(*) AS k, sum(n * n) AS nn, sum(good * good / n) AS gg FROM {k}s),
{k}_s AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN 2.0::DOUBLE
    WHEN g = 0 OR g = n OR n - nn / n <= 0 OR k < 2 THEN 200.0::DOUBLE
    ELSE least(greatest(1 / greatest(((gg - g * (g / n)) / ((g / n) * (1 - g / n)) - (k - 1)) / greatest(n - nn / n - (k - 1), 1e-9), 1e-9) - 1, 2.0::DOUBLE), 200.0::DOUBLE) END AS s,
    CASE WHEN coalesce(n, 0) = 0 THEN 0.5::DOUBLE ELSE g / n END AS p FROM {k}_m)"""

SQL = (
    r"""
WITH parts AS (
  SELECT page_id, url, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
judged AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM judged),
shown AS (SELECT page_id, try_cast(nullif(regexp_extract(coalesce(url, ''), '://[^/?#]*/[^/?#]*/(\d{1,18})', 1), '') AS BIGINT) AS doc_id FROM pages),
marks AS (SELECT doc_id, max(quality) AS outcome FROM labels WHERE quality IS NOT NULL GROUP BY 1),
seen AS (SELECT page_id, max(outcome) AS outcome FROM shown JOIN marks USING (doc_id) GROUP BY 1),
counts AS (SELECT host, count(*)::DOUBLE AS n, sum(outcome)::DOUBLE AS good,
    CASE WHEN regexp_matches(host, '(^|[.])(ac|co|com|edu|gob|gov|go|ltd|me|ne|net|nhs|nom|or|org|plc|sch)[.][a-z]{2}$') THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
    CASE WHEN regexp_matches(host, '(^|[.])(ac|co|com|edu|gob|gov|go|ltd|me|ne|net|nhs|nom|or|org|plc|sch)[.][a-z]{2}$') THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE string_split(host, '.')[-1] END AS suffix
  FROM ruled JOIN seen USING (page_id) GROUP BY 1, 4, 5),"""
    + ",".join(_LEVEL.format(k=k) for k in ("suffix", "domain", "host"))
    + """,
names AS (SELECT DISTINCT host, CASE WHEN regexp_matches(host, '(^|[.])(ac|co|com|edu|gob|gov|go|ltd|me|ne|net|nhs|nom|or|org|plc|sch)[.][a-z]{2}$') THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain, CASE WHEN regexp_matches(host, '(^|[.])(ac|co|com|edu|gob|gov|go|ltd|me|ne|net|nhs|nom|or|org|plc|sch)[.][a-z]{2}$') THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE string_split(host, '.')[-1] END AS suffix FROM ruled),
a AS (SELECT names.*, (coalesce(s.good, 0) + (SELECT s FROM suffix_s) * (SELECT p FROM suffix_s)) / (coalesce(s.n, 0) + (SELECT s FROM suffix_s)) AS ms FROM names LEFT JOIN suffixs s USING (suffix)),
b AS (SELECT a.*, (coalesce(d.good, 0) + (SELECT s FROM domain_s) * ms) / (coalesce(d.n, 0) + (SELECT s FROM domain_s)) AS md FROM a LEFT JOIN domains d USING (domain)),
c AS (SELECT b.host, (coalesce(h.good, 0) + (SELECT s FROM host_s) * md) / (coalesce(h.n, 0) + (SELECT s FROM host_s)) AS mean, coalesce(h.n, 0) + (SELECT s FROM host_s) AS total FROM b LEFT JOIN hosts h USING (host)),
d AS (SELECT host, mean, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM c)
SELECT page_id, host, path, rule, CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block'
    WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' ELSE CASE WHEN bound >= 0.75 THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled LEFT JOIN d USING (host)"""
)
