"""URL filter by the reputation of hosts, with explicit rules above it.

Labelled pages give each host a number of outcomes, good or bad. A host's bad rate has a beta prior around the rate
of its registered domain, a domain's around that of its suffix, and a suffix's around the rate of all pages; how
strongly each level holds to the one above it is estimated from the spread of the observed rates (moments of the
beta-binomial). A host is blocked when a lower bound of its posterior rate exceeds ``max_bad``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Applies to ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


#: Frequent suffixes of more than one label, below which names belong to different owners. ``*.`` stands for
#: any one label, ``!`` for an exception. The full public list can be read with :func:`read_suffix_rules`.
SUFFIX_RULES = (
    "ac.at", "co.at", "gv.at", "or.at", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "*.bd", "com.br", "edu.br",
    "gov.br", "net.br", "org.br", "*.ck", "!www.ck", "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.co", "com.eg",
    "*.er", "*.fk", "com.hk", "edu.hk", "org.hk", "co.id", "ac.il", "co.il", "org.il", "ac.in", "co.in", "edu.in", "gov.in",
    "net.in", "org.in", "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "*.jm", "co.ke", "*.kh",
    "ac.kr", "co.kr", "go.kr", "or.kr", "*.mm", "com.mx", "edu.mx", "gob.mx", "org.mx", "com.my", "com.ng", "*.np", "ac.nz",
    "co.nz", "govt.nz", "net.nz", "org.nz", "school.nz", "com.pe", "*.pg", "com.ph", "com.pk", "com.pl", "net.pl", "org.pl",
    "com.sa", "com.sg", "edu.sg", "gov.sg", "ac.th", "co.th", "com.tr", "edu.tr", "gov.tr", "com.tw", "edu.tw", "org.tw",
    "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "sch.uk",
    "com.uy", "com.ve", "com.vn", "ac.za", "co.za", "gov.za", "org.za", "appspot.com", "azurewebsites.net", "blogspot.com",
    "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "onrender.com",
    "pages.dev", "readthedocs.io", "web.app", "vercel.app", "wordpress.com", "workers.dev",
)


@dataclass(frozen=True)
class ReputationModel:
    """``z`` standard deviations below the posterior mean give the bound; ``suffixes`` end the names that can be registered."""

    max_bad: float = 0.25
    z: float = 1.645
    suffixes: tuple[str, ...] = SUFFIX_RULES


def read_suffix_rules(text: str) -> tuple[str, ...]:
    """The rules of a suffix list: one a line, up to the first blank; empty lines and those after ``//`` are none."""
    lines = (line.split(maxsplit=1)[0] for line in text.splitlines() if line.strip())
    return tuple(dict.fromkeys(rule.lower() for rule in lines if not rule.startswith("//")))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without a url or ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, else null; a later one of equal rules does not count.

    Looks up the parent domains of the host in a map, so the cost does not grow with the number of rules.
    """
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        if not any(o.host == r.host and o.path == r.path for o in by_host.get(r.host, [])):
            by_host.setdefault(r.host, []).append(r)
    nothing = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    if not by_host:
        return nothing.dropFields("size")

    def held(r: Rule) -> Column:
        return F.struct(F.lit(r.path).alias("path"), F.lit(len(r.host) + len(r.path)).alias("size"),
                        F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))

    table = F.create_map(*(c for h, rs in by_host.items() for c in (F.lit(h), F.array(*map(held, rs)))))
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(parents, lambda h: F.try_element_at(table, h)), lambda x: x.isNotNull()))
    fits = F.transform(F.filter(found, lambda r: F.startswith(path, r["path"])),
                       lambda r: F.struct(r["size"], r["rule"], r["verdict"]))
    return F.coalesce(F.array_max(fits), nothing).dropFields("size")


def registered_name(host: Column) -> Column:
    """The host without user, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.+$|\.*:[0-9]*$", "")


def owner_of(host: Column, suffixes: Sequence[str]) -> Column:
    """``struct(domain, suffix)``: the registered domain and the suffix below which it was registered.

    The longest rule that fits gives the suffix, an exception goes before all others, and without a rule it is the last
    label. A name that is itself a suffix is its own domain. Numeric addresses are domains of their own, with one common
    suffix, since parts of an address are no owners.
    """
    plain = [r for r in suffixes if r[:2] != "*." and r[:1] != "!"]
    wild, kept = [r[2:] for r in suffixes if r[:2] == "*."], [r[1:] for r in suffixes if r[:1] == "!"]

    def listed(name: Column, rules: list[str]) -> Column:
        return name.isin(*rules) if rules else F.lit(False)

    def of(name: Column) -> Column:
        labels = F.split(name, r"\.", -1)
        size = F.size(labels)

        def from_label(i: Column) -> Column:
            return F.array_join(F.slice(labels, i, size), ".")

        places = F.sequence(F.lit(1), size)
        fits = F.filter(places, lambda i: listed(from_label(i), plain) | ((i < size) & listed(from_label(i + 1), wild)))
        exception = F.get(F.filter(places, lambda i: listed(from_label(i), kept)), 0)
        first = F.coalesce(exception + 1, F.get(fits, 0), size)
        numeric = name.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$")
        return F.when(numeric, F.struct(name.alias("domain"), F.lit("[]").alias("suffix"))).otherwise(F.struct(
            from_label(F.greatest(first - 1, F.lit(1))).alias("domain"), from_label(first).alias("suffix")))

    return F.get(F.transform(F.array(registered_name(host)), of), 0)


def _strengths(levels: dict[str, tuple[DataFrame, Column]]) -> Column:
    """Prior observations that a child borrows from its parent, one figure for a level, as a map."""
    every = [df.select(F.lit(level).alias("level"), parent.alias("parent"), "n", "x") for level, (df, parent) in levels.items()]
    rate = F.col("x") / F.col("n")
    up = reduce(DataFrame.unionByName, every).groupBy("level", "parent").agg(
        F.sum("n").alias("pn"), F.sum("x").alias("px"), F.count("*").alias("g"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * rate * rate).alias("nr2"))
    p = F.col("px") / F.col("pn")
    inner = up.where((F.col("px") > 0) & (F.col("px") < F.col("pn")) & (F.col("g") > 1)).select(
        "level", ((F.col("nr2") - F.col("pn") * p * p) / (p * (1 - p))).alias("spread"), (F.col("g") - 1).alias("free"),
        (F.col("pn") - F.col("n2") / F.col("pn") - F.col("g") + 1).alias("room"))
    total = inner.groupBy("level").agg(F.sum("spread").alias("s"), F.sum("free").alias("f"), F.sum("room").alias("r"))
    rho = F.least(F.greatest(F.when(F.col("r") > 0, (F.col("s") - F.col("f")) / F.col("r")), F.lit(1e-4)), F.lit(0.99))
    return total.agg(F.map_from_entries(F.collect_list(F.struct("level", ((1 - rho) / rho).alias("k"))))).scalar()


def _posterior(children: DataFrame, prior: Column, strength: Column) -> DataFrame:
    return children.withColumn("weight", F.col("n") + strength).withColumn(
        "mean", (prior * strength + F.col("x")) / F.col("weight"))


def host_reputation(outcomes: DataFrame, model: ReputationModel = ReputationModel()) -> DataFrame:
    """``host, n, x, mean, bound`` from one row per labelled page with ``host`` and ``bad`` (0 or 1; null: ignored)."""
    counts = (F.sum("n").alias("n"), F.sum("x").alias("x"))
    hosts = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("x")).withColumn(
        "owner", owner_of(F.col("host"), model.suffixes)).select("host", "n", "x", "owner.*")
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    strengths = _strengths({"host": (hosts, F.col("domain")), "domain": (domains, F.col("suffix")),
                            "suffix": (suffixes, F.lit(""))})

    def strength(level: str) -> Column:
        return F.coalesce(F.try_element_at(strengths, F.lit(level)), F.lit(10.0))

    def below(parents: DataFrame, key: str) -> DataFrame:
        return parents.select(key, F.col("mean").alias("prior"))

    top = suffixes.agg((F.sum("x") + 0.5) / (F.sum("n") + 1)).scalar()
    of_suffix = _posterior(suffixes, top, strength("suffix"))
    of_domain = _posterior(domains.join(below(of_suffix, "suffix"), "suffix"), F.col("prior"), strength("domain"))
    of_host = _posterior(hosts.join(below(of_domain, "domain"), "domain"), F.col("prior"), strength("host"))
    m = F.col("mean")
    return of_host.select("host", "n", "x", "mean", (
        m - model.z * F.sqrt(m * (1 - m) / (F.col("weight") + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (),
               model: ReputationModel = ReputationModel(), page: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, n_labelled, bound``, one row per page.

    ``outcomes`` has ``page_id`` and ``bad``; several outcomes of one page all count. A rule's verdict goes before
    the reputation's; a host without labelled pages is allowed. A null url, or one without ``://``, has an empty
    host and path, shares the reputation of the empty host and fits no rule. Pages without an id are judged, but
    carry no label. Repeated rows stay; other columns of the input are not read.
    """
    parts = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labelled = parts.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id")
    known = host_reputation(labelled, model)
    judged = parts.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).join(
        known.select("host", F.col("n").alias("n_labelled"), "bound"), "host", "left")
    blocked = F.coalesce(F.col("bound") > model.max_bad, F.lit(False))
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), "bound")
