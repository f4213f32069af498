"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk through beta-binomial priors along
suffix -> registered domain -> host: each level's posterior mean is the prior mean of the level
below, and each level's prior strength is estimated by moments from how much the rates of its
groups scatter. A host is blocked when the lower bound of its posterior bad rate exceeds a limit: the bound is taken
on the logit scale, where the beta posterior is close to normal, so it lies between 0 and 1.
Explicit rules go before the reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, if_small, table, tidy

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labels under which names are registered below any top-level domain of two letters, as in co.uk.
GENERIC = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "go", "id", "info", "mil", "net", "ne", "nom", "or", "org", "sch")
#: Some suffixes under which hosts belong to different owners. A full list of public suffixes goes into the parameter.
SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "readthedocs.io", "vercel.app", "web.app", "wordpress.com")
MAX_SUFFIX = 5  # labels
MAX_RULES = 1000
Z, MAX_BAD = 1.645, 0.3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty when it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_fit(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first in order) and its verdict, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule, verdict = F, F
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(said))
    return rule, verdict


def _last(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def read_suffixes(path: str) -> tuple[str, ...]:
    """The rules of a file of public suffixes: one a line, with ``*.`` and ``!``; lines that begin with // don't count."""
    with open(path, encoding="utf-8") as f:
        return tuple(x.split()[0] for x in f if x.strip() and not x.startswith("//"))


def with_domains(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``hosts`` (host, one row each, and others) with suffix and domain, the registered domain.

    The longest of the rules that fit is the suffix: a name, ``*.`` and a name for one more label of any kind, or
    ``!`` and a name that is registered itself; then GENERIC labels under two letters, then the last label alone.
    """
    host = F.col("host")
    labels = F.size(F.split(host, r"\."))
    rules = durable(hosts.sparkSession.createDataFrame([(x.lower(),) for x in sorted(set(suffixes))], "rule string"))
    tries = []
    for k in range(1, MAX_SUFFIX + 1):
        tries.append(F.when(labels >= k, F.struct(_last(host, k).alias("rule"), F.lit(k).alias("n"))))
        tries.append(F.when(labels >= k + 1, F.struct(F.concat(F.lit("*."), _last(host, k)).alias("rule"), F.lit(k + 1).alias("n"))))
        tries.append(F.when(labels >= k, F.struct(F.concat(F.lit("!"), _last(host, k)).alias("rule"), F.lit(100 + k - 1).alias("n"))))  # goes before all
    tried = hosts.select("host", F.inline(F.filter(F.array(*tries), lambda x: x.isNotNull())))
    fits = tried.join(if_small(rules), "rule").groupBy("host").agg(F.max("n").alias("_n"))
    generic = (F.length(_last(host, 1)) == 2) & F.substring_index(_last(host, 2), ".", 1).isin(*GENERIC) & (labels >= 2)
    n = F.greatest(F.coalesce("_n", F.lit(1)), F.when(generic, 2).otherwise(1))
    rows = hosts.join(fits, "host", "left").withColumn("_n", F.when(n >= 100, n - 100).otherwise(n))
    cut = lambda k: F.array_join(F.slice(F.split(host, r"\."), F.greatest(labels - k, F.lit(0)) + 1, F.greatest(k, F.lit(1))), ".")
    return rows.withColumns({"suffix": cut(F.col("_n")), "domain": cut(F.col("_n") + 1)}).drop("_n")


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """Prior strength at one level by moments: 1 / overdispersion - 1, held to 1 to 1000."""
    mean = F.sum("bad") / F.sum("n")
    seen = groups.where("n > 0").agg(F.sum("n").cast("double").alias("t"), F.count("*").cast("double").alias("k"), mean.alias("m"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"))
    spread = F.col("m") * (1 - F.col("m"))
    over = (F.col("q") / F.col("t") - F.col("m") * F.col("m") - spread * F.col("k") / F.col("t")) / (spread * (1 - F.col("k") / F.col("t")))
    usable = (F.col("t") > F.col("k")) & (spread > 0)
    return seen.select(F.coalesce(F.when(usable, F.when(over > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / over - 1))).otherwise(F.lit(1000.0))), F.lit(10.0)).alias(name))


def host_reputation(hosts: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``hosts`` has host, n and bad (labelled outcomes, 0 for none), one row a host.

    Returns host, n, bad, bad_rate (posterior mean) and bad_bound (``z`` posterior standard deviations below it on the
    logit scale). Without any labelled outcome the rate is that of 1 in 2. Hosts are counted once: the tables by domain
    and by suffix are written.
    """
    hosts = durable(with_domains(hosts, suffixes))
    domains = durable(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = durable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    scale = suffixes.agg(F.coalesce((F.sum("bad") + 0.5) / (F.sum("n") + 1), F.lit(0.5)).alias("m0"))
    for name, groups in (("s0", suffixes), ("s1", domains), ("s2", hosts)):
        scale = scale.crossJoin(_strength(groups, name))  # one row each
    scale = durable(scale)
    suffixes = durable(suffixes.crossJoin(F.broadcast(scale)).select("suffix", "s1", "s2", ((F.col("bad") + F.col("s0") * F.col("m0")) / (F.col("n") + F.col("s0"))).alias("p")))
    domains = durable(domains.join(if_small(suffixes), "suffix").select("suffix", "domain", "s2", ((F.col("bad") + F.col("s1") * F.col("p")) / (F.col("n") + F.col("s1"))).alias("p")))
    a, b = F.col("bad") + F.col("s2") * F.col("p"), F.col("n") - F.col("bad") + F.col("s2") * (1 - F.col("p"))
    bound = 1 / (1 + F.exp(z * F.sqrt(1 / a + 1 / b) - F.log(a / b)))
    return hosts.join(if_small(domains), ["suffix", "domain"]).select("host", "n", "bad", (a / (a + b)).alias("bad_rate"), F.when((a > 0) & (b > 0), bound).when(a > 0, 1.0).otherwise(0.0).alias("bad_bound"))


@tidy
def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, z: float = Z, max_bad: float = MAX_BAD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by rules, then by host reputation.

    ``outcomes`` has host, n and bad: labelled outcomes counted by host, any number of rows a host.
    Null urls and urls without ``://`` have the empty host, which has a reputation as any other.
    Repeated rows are each judged; of rules of equal length the first by its text wins; a very long url is a row like others;
    an empty table gives no rows, and without outcomes every host has the same rate; other columns of ``pages`` are
    ignored. Returns page_id, host, path, rule, verdict, bad_rate and bad_bound (rounded to 6 places). A hot host is counted
    before any shuffle, and the join that brings its reputation back is one that Spark can split.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    counts = pages.groupBy("host").agg(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bad"))
    counts = durable(counts.unionByName(outcomes.select("host", "n", "bad")).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    known = durable(host_reputation(counts, z, suffixes).select("host", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound")))
    rule, verdict = first_fit(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return pages.join(if_small(known), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_bound")


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes by host: a page is bad if the document that its path numbers is toxic or of low quality."""
    host, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') as bigint)")
    seen = pages.select(host.alias("host"), path.alias("path")).select("host", number.alias("doc_id")).where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    bad = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    return seen.join(bad, "doc_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("bad"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, outcomes_of(pages, table(spark, sf_dir, "labels")))


def oracle(rules: tuple[tuple[str, str], ...] = RULES, z: float = Z, max_bad: float = MAX_BAD) -> str:
    fits = {r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))" for r, _ in rules}
    longest = sorted(rules, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in longest) + " END"
    quoted = lambda names: ", ".join(f"'{x}'" for x in names)
    double = f"(two IN ({quoted(SUFFIXES)}) OR (len(parts) > 1 AND length(parts[1]) = 2 AND parts[2] IN ({quoted(GENERIC)})))"

    def strength(name: str, groups: str) -> str:
        return f"""{name} AS (SELECT coalesce(CASE WHEN t > k AND m * (1 - m) > 0 THEN CASE WHEN o > 0 THEN least(1000.0, greatest(1.0, 1 / o - 1)) ELSE 1000.0 END END, 10.0) AS v
          FROM (SELECT *, (q / t - m * m - m * (1 - m) * k / t) / nullif(m * (1 - m) * (1 - k / t), 0) AS o FROM
            (SELECT sum(n)::DOUBLE AS t, count(*)::DOUBLE AS k, sum(bad)::DOUBLE / sum(n) AS m, sum(bad::DOUBLE * bad / n) AS q FROM {groups} WHERE n > 0)))"""

    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
    labelled AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM p JOIN bad ON doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') AS BIGINT) GROUP BY host),
    h0 AS (SELECT host, coalesce(any_value(l.n), 0)::BIGINT AS n, coalesce(any_value(l.bad), 0)::BIGINT AS bad, list_reverse(string_split(host, '.')) AS parts FROM p LEFT JOIN labelled l USING (host) GROUP BY host),
    h1 AS (SELECT *, CASE WHEN len(parts) > 1 THEN parts[2] || '.' || parts[1] ELSE host END AS two FROM h0),
    h AS (SELECT host, n, bad, CASE WHEN {double} THEN two ELSE parts[1] END AS suffix,
      CASE WHEN {double} AND len(parts) > 2 THEN parts[3] || '.' || two ELSE two END AS domain FROM h1),
    d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
    s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
    m AS (SELECT coalesce((sum(bad) + 0.5::DOUBLE) / (sum(n) + 1), 0.5) AS v FROM s),
    {strength("s0", "s")}, {strength("s1", "d")}, {strength("s2", "h")},
    sp AS (SELECT suffix, (bad + s0.v * m.v) / (n + s0.v) AS p FROM s, s0, m),
    dp AS (SELECT suffix, domain, (bad + s1.v * p) / (n + s1.v) AS p FROM d JOIN sp USING (suffix), s1),
    ab AS (SELECT host, bad + s2.v * p AS a, n - bad + s2.v * (1 - p) AS b FROM h JOIN dp USING (suffix, domain), s2),
    r AS (SELECT host, round(a / (a + b), 6) AS bad_rate, round(CASE WHEN a > 0 AND b > 0 THEN 1 / (1 + exp({z}::DOUBLE * sqrt(1 / a + 1 / b) - ln(a / b))) WHEN a > 0 THEN 1 ELSE 0 END, 6) AS bad_bound FROM ab)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN bad_bound > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bad_bound
    FROM p JOIN r USING (host)"""
