"""Host reputation by empirical Bayes, and url rules. DataFrame functions only.

Labelled page outcomes (good or bad) are summed by host, registered domain and suffix. Each level is a beta-binomial
whose prior mean is the level above and whose prior strength comes from the spread between the level's groups (analysis
of variance). A host is blocked when the upper bound of its good share lies under a limit. The limit is learned: outcomes
are halved, and of the bounds that one half gives, the limit is the one that serves best on the other half, where a bad page
that stays costs as much as `cost` good pages that go; if no limit is better than none, no host is blocked.

Defined results: a null url or one without `://` has an empty host and path, fits no rule, and gets the prior of an
empty suffix's group like any other host. Hosts without outcomes get their domain's prior. Repeated pages each get
their verdict, and each counts as an outcome. Extra columns pass through (of the same name as a result: replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, others, quoted

#: Good pages that a bad one costs: hosts below a good share of COST / (1 + COST) do more harm than good.
COST = 2.0
#: Steps of a share in which limits are told apart.
STEPS = 1000
#: Standard deviations between a posterior's mean and its bounds.
Z = 1.645


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare(host: Column) -> Column:
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The last label, or the longest of `suffixes` (those with a dot, such as co.uk) that the host ends with. Numeric addresses
    share an empty one."""
    name = bare(host)
    out = F.when(name.rlike(r"^[0-9.]+$"), F.lit(""))
    for s in sorted(suffixes, key=len, reverse=True):
        out = out.when((name == s) | name.endswith(f".{s}"), F.lit(s))
    return out.otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The registered domain: the suffix and one label more; a numeric address is its own."""
    name = bare(host)
    out = F.when(name.rlike(r"^[0-9.]+$"), name)
    for s in sorted(suffixes, key=len, reverse=True):
        out = out.when((name == s) | name.endswith(f".{s}"), F.substring_index(name, ".", -2 - s.count(".")))
    return out.otherwise(F.substring_index(name, ".", -2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls. rules: (action, host/path); a short list of settings."""
    rule = action = None
    for act, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        on, _, rest = text.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule.otherwise(none)), (none if action is None else action.otherwise(none))


def strength(groups: DataFrame, n: str, good: str) -> float:
    """How many outcomes the prior of these groups is worth, from the spread of their shares."""
    g = groups.filter(F.col(n) > 0)
    share = F.col(good) / F.col(n)
    k, total, squares, wins, spread, within = g.agg(
        F.count(F.lit(1)), F.sum(n), F.sum(F.col(n) * F.col(n)), F.sum(good), F.sum(F.col(good) * share), F.sum(F.col(n) * share * (1 - share))
    ).first()
    if k < 2 or total <= k:
        return 10.0
    mean = wins / total
    between, inside = max(spread - total * mean * mean, 0.0) / (k - 1), within / (total - k)
    each = (total - squares / total) / (k - 1)
    rho = (between - inside) / (between + (each - 1) * inside) if between + (each - 1) * inside > 0 else 0.0
    return min(max((1 - rho) / rho, 1.0), 1000.0) if rho > 1e-3 else 1000.0


def host_sums(outcomes: DataFrame) -> DataFrame:
    """(host, n, s): of outcomes(host, good: 1, 0 or null where not known) the known ones and the good ones."""
    return outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("s"))


def reputation(hosts: DataFrame, suffixes: Sequence[str] = (), z: float = Z) -> DataFrame:
    """(host, mean, lower, upper) for each of hosts(host, n, s)."""
    hosts = hosts.select("host", "n", "s").withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"))
    tops = domains.groupBy("suffix").agg(F.sum("dn").alias("tn"), F.sum("ds").alias("ts"))
    n, s = tops.agg(F.sum("tn"), F.sum("ts")).first()
    mean = (s + 1) / (n + 2) if n else 0.5
    k0, k1, k2 = strength(tops, "tn", "ts"), strength(domains, "dn", "ds"), strength(hosts, "n", "s")
    tops = tops.select("suffix", ((F.col("ts") + k0 * mean) / (F.col("tn") + k0)).alias("tm"))
    domains = domains.join(tops, "suffix").select("domain", "suffix", ((F.col("ds") + k1 * F.col("tm")) / (F.col("dn") + k1)).alias("dm"))
    a, b = F.col("s") + k2 * F.col("dm"), F.col("n") - F.col("s") + k2 * (1 - F.col("dm"))
    both = hosts.join(domains, ["domain", "suffix"]).select("host", a.alias("a"), b.alias("b"))
    m = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(m * (1 - m) / (F.col("a") + F.col("b") + 1))
    return both.select("host", m.alias("mean"), F.greatest(m - z * sd, F.lit(0.0)).alias("lower"), F.least(m + z * sd, F.lit(1.0)).alias("upper"))


def learned_limit(halves: DataFrame, suffixes: Sequence[str] = (), cost: float = COST, z: float = Z) -> float:
    """The limit that serves best. halves(host, n0, s0, n1, s1): sums of each half of the outcomes. Bounds are told apart by
    STEPS, so the driver gets a row for each step, whatever the hosts."""
    sums = None
    for mine, other in ((0, 1), (1, 0)):
        known = reputation(halves.select("host", F.col(f"n{mine}").alias("n"), F.col(f"s{mine}").alias("s")), suffixes, z)
        held = halves.select("host", F.col(f"n{other}").alias("n"), F.col(f"s{other}").alias("s")).filter("n > 0")
        part = known.join(held, "host").groupBy(F.floor(F.col("upper") * STEPS).alias("step")).agg((F.sum("s") - cost * F.sum(F.col("n") - F.col("s"))).alias("worth"))
        sums = part if sums is None else sums.union(part)
    return best_limit([(r.step, r.worth) for r in sums.groupBy("step").agg(F.sum("worth").alias("worth")).collect()])


def best_limit(worth: list[tuple[int, float]]) -> float:
    """The limit below which hosts are worth least, taken together; 0 if they are worth something. worth: (step, worth of its hosts)."""
    best, total, limit = 0.0, 0.0, 0.0
    for step, w in sorted(worth):
        total += w
        if total < best:
            best, limit = total, (step + 1) / STEPS
    return limit


def judged(
    pages: DataFrame, good: Column, rules: Sequence[tuple[str, str]] = (), url: str = "url", limit: float | None = None, suffixes: Sequence[str] = (),
    cost: float = COST, z: float = Z,
) -> DataFrame:
    """`pages` with host, path, rule, verdict, and the posterior's mean, lower and upper. good: a page's outcome; limit: given,
    or learned where it isn't."""
    added = ("host", "path", "rule", "verdict", "mean", "lower", "upper")
    kept = others(pages, added)
    outcome, hash_ = fresh(pages, "page_outcome", "page_half")
    known = pages.withColumns({outcome: good.cast("int"), hash_: F.pmod(F.xxhash64(quoted(url), F.lit("half")), F.lit(2))})
    address = F.col(quoted(url))
    split = known.select(*map(quoted, kept), outcome, hash_, host_of(address).alias("host"), path_of(address).alias("path"))
    sums = [f(F.when(F.col(hash_) == i, F.col(outcome))).cast("double").alias(f"{name}{i}") for i in (0, 1) for name, f in (("n", F.count), ("s", F.sum))]
    halves = checkpointed(split.groupBy("host").agg(*sums).fillna(0.0))  # a row for each host, which serves for all that follows
    if limit is None:
        limit = learned_limit(halves, suffixes, cost, z)
    scores = reputation(halves.select("host", (F.col("n0") + F.col("n1")).alias("n"), (F.col("s0") + F.col("s1")).alias("s")), suffixes, z)
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    return split.select(*map(quoted, kept), "host", "path").join(scores, "host").select(
        *map(quoted, kept), "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("upper") < limit, "block").otherwise("allow")).alias("verdict"), "mean", "lower", "upper"
    )
