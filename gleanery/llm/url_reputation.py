"""URL filter: empirical-Bayes reputation of hosts.

Labelled pages are good or bad.  Outcomes are counted by host, registered domain
and public suffix, and shrunk level by level through beta-binomial priors:

* the root prior is Beta(m*s, (1-m)*s) with m the overall bad share;
* a suffix's posterior mean is the prior mean of its domains, a domain's that of
  its hosts; the strength s of each level is estimated by moments from the
  spread of that level's units round their parents' means, within bounds.

A host without labels gets its domain's posterior, and so on.  A page stays when
the upper posterior bound mean + z * sd of its host's bad share is at most
``max_bad``.

Pages are aggregated to hosts once, with partial sums before the shuffle, and the
three levels are written tables of ever fewer rows; only their totals and strengths,
four numbers, come to the driver.  A suffix or domain that holds most units is one
row on the small side of its join, whose large side AQE splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

_SECOND = {
    "ae": "ac co gov net org sch", "ar": "com edu gob gov net org", "at": "ac co gv or", "au": "asn com edu gov id net org",
    "bd": "ac com edu gov net org", "br": "art blog com edu gov ind net org", "cn": "ac com edu gov net org", "co": "com edu gov net org",
    "cr": "ac co ed fi go or", "cy": "ac com gov net org", "ec": "com edu gob net org", "eg": "com edu gov net org", "es": "com edu gob nom org",
    "fj": "ac com gov net org", "gh": "com edu gov org", "gr": "com edu gov net org", "gt": "com edu gob net org", "hk": "com edu gov idv net org",
    "hu": "co info org", "id": "ac co desa go mil net or sch web", "il": "ac co gov k12 muni net org", "in": "ac co edu firm gen gov ind net nic org res",
    "it": "edu gov", "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go me ne or sc", "kr": "ac co go ne or pe re", "kw": "com edu gov net org",
    "lk": "ac com edu gov net org", "ma": "ac co gov net org", "mx": "com edu gob net org", "my": "com edu gov name net org", "ng": "com edu gov net org sch",
    "np": "com edu gov net org", "nz": "ac co geek gen govt iwi kiwi maori net org school", "pe": "com edu gob net nom org", "ph": "com edu gov net org",
    "pk": "com edu gov net org", "pl": "com edu gov info net org waw", "pt": "com edu gov net org", "py": "com edu gov net org", "qa": "com edu gov net org",
    "ro": "com info org", "rs": "ac co edu gov org", "ru": "ac com edu gov int msk net org spb", "sa": "com edu gov net org", "sg": "com edu gov net org per",
    "th": "ac co go in net or", "tn": "com gov net org", "tr": "av bel com edu gen gov k12 net org web", "tw": "club com edu gov idv net org",
    "tz": "ac co go ne or sc", "ua": "com edu gov kiev kyiv lviv net odessa org", "ug": "ac co go ne or sc", "uk": "ac co gov ltd me net nhs org plc police sch",
    "uy": "com edu gub net org", "ve": "co com edu gob net org", "vn": "ac com edu gov net org", "za": "ac co edu gov net nom org school web", "zw": "ac co gov org",
}
#: Names under which strangers host their sites: as suffixes, so each site is a domain.
_SHARED = """
appspot.com azurewebsites.net blogspot.com cloudfront.net firebaseapp.com fly.dev github.io gitlab.io glitch.me herokuapp.com
netlify.app ngrok.io onrender.com pages.dev readthedocs.io surge.sh translate.goog tumblr.com typepad.com vercel.app web.app
weebly.com wixsite.com wordpress.com workers.dev
"""
#: Suffixes of two labels under which names are registered.  Others have one label.
#: The list covers the common registries; a run may pass the full public list.
TWO_LABEL_SUFFIXES = tuple(sorted({f"{s}.{country}" for country, seconds in _SECOND.items() for s in seconds.split()} | set(_SHARED.split())))
#: What stands for the suffix of numeric addresses, which have none.
ADDRESS = "(address)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"
_NUMERIC = r"^(?:[0-9.]+|\[.*\])$"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none.

    An IPv6 address keeps its brackets.
    """
    raw = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(raw != "", raw)


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    named = F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(_NUMERIC), F.lit(ADDRESS)).otherwise(named)


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Suffix and one label; the host itself when it has no more, or is an address."""
    two = F.substring_index(host, ".", -2)
    named = F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when(host.rlike(_NUMERIC), host).otherwise(named)


def strength(units: DataFrame, least: float, most: float) -> float:
    """Moment estimate of a level's prior strength from its units (n, k, m).

    sum (k/n - m)^2 = sum m(1-m)(1/n + rho(1 - 1/n)) gives rho, and s = 1/rho - 1.
    """
    v, inv = F.col("m") * (1 - F.col("m")), 1 / F.col("n")
    got = units.where("n > 0").agg(
        F.sum(F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("dev"), F.sum(v * inv).alias("least"), F.sum(v * (1 - inv)).alias("spread")
    ).first()
    rho = (got.dev - got.least) / got.spread if got.spread else 0.0
    return min(max(1 / rho - 1, least), most) if rho > 0 else most


def host_reputation(
    pages: DataFrame,
    labels: DataFrame,
    *,
    least: float = 2.0,
    most: float = 1000.0,
    id_col: str,
    label_id_col: str,
    url_col: str,
    bad: Column,
    two_label: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """(host, domain, suffix, n, k, a, b): posterior Beta(a, b) of every host seen."""
    keyed = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host")).where("host is not null")
    lab = labels.select(labels[label_id_col].alias("id"), bad.cast("int").alias("bad")).where("id is not null and bad is not null")
    lab = lab.groupBy("id").agg(F.max("bad").alias("bad"))  # one outcome a page, the worst
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c)
    hosts = keyed.join(lab, "id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    host = F.col("host")
    hosts = materialise(hosts.withColumns({"domain": domain_of(host, two_label), "suffix": suffix_of(host, two_label)}), "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(count("n"), count("k")), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(count("n"), count("k")), "suffixes")
    all_ = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = ((all_.k or 0.0) + 0.5) / ((all_.n or 0.0) + 1.0)

    def posterior(units: DataFrame) -> DataFrame:
        s = F.lit(strength(units, least, most))
        return units.withColumns({"a": F.col("m") * s + F.col("k"), "b": (1 - F.col("m")) * s + F.col("n") - F.col("k")})

    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("m")
    top = posterior(suffixes.withColumn("m", F.lit(root))).select("suffix", mean)
    mid = materialise(posterior(materialise(domains.join(top, "suffix"), "domains", suffixes, domains)).select("domain", mean), "means")
    out = materialise(hosts.join(mid, "domain"), "hosts", hosts, mid)
    return posterior(out).select("host", "domain", "suffix", "n", "k", "a", "b")


def judge_pages(
    pages: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
    bad: Column | None = None,
    z: float = 1.645,
    max_bad: float = 0.35,
    **options,
) -> DataFrame:
    """(id, host, domain, suffix, labelled, bad, mean, upper, keep) for every page.

    A URL without a host gives nulls and ``keep`` false.  Labels that are null
    or name no page are not used; several of one page count as the worst.  Rows
    that repeat a page each count and each get a row; URLs may be of any length;
    other columns are not read.  Without labels every host has the root prior's
    mean, and an empty table stays empty.
    """
    if bad is None:
        bad = (labels["quality"] == 0) | (labels["toxic"] == 1)
    rep = host_reputation(pages, labels, id_col=id_col, label_id_col=label_id_col, url_col=url_col, bad=bad, **options)
    s = F.col("a") + F.col("b")
    rep = rep.select(
        F.col("host").alias("__host"), "domain", "suffix", F.col("n").cast("bigint").alias("labelled"),
        F.col("k").cast("bigint").alias("bad"), F.round(F.col("a") / s, 9).alias("mean"),
        F.round(F.col("a") / s + z * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1))), 9).alias("upper"),
    )
    out = pages.select(pages[id_col], host_of(pages[url_col]).alias("host"))
    out = out.join(rep, out["host"] == rep["__host"], "left").drop("__host")
    return out.withColumn("keep", F.coalesce(F.col("upper") <= max_bad, F.lit(False)))


def filter_pages(pages: DataFrame, labels: DataFrame, *, url_col: str = "url", **options) -> DataFrame:
    """The pages that stay, columns as given.

    Pages are judged by their host, so null and repeated ids change nothing; pages
    without a host go; an empty table stays empty.
    """
    (ok,) = unused(pages.columns, "ok")
    verdicts = judge_pages(pages, labels, url_col=url_col, **options).where("keep").select(F.col("host").alias(ok))
    return pages.join(verdicts.distinct(), host_of(pages[url_col]) == F.col(ok), "left_semi")


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _strength_sql(source: str) -> str:
    return f"""(SELECT coalesce(least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000.0 END, 2.0), 1000.0), 1000.0) AS s
  FROM (SELECT (sum(power(k / n - m, 2)) - sum(m * (1 - m) / n)) / nullif(sum(m * (1 - m) * (1 - 1 / n)), 0) AS rho
        FROM {source} WHERE n > 0))"""


ORACLE = rf"""
WITH p AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\.+$', ''), '') AS host FROM pages),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, string_split(host, '.') AS w
       FROM p LEFT JOIN l ON doc_id = page_id WHERE host IS NOT NULL GROUP BY host),
h1 AS (SELECT *, array_to_string(w[-2:], '.') AS two, regexp_matches(host, '{_NUMERIC}') AS num FROM h0),
h AS (SELECT host, n, k, CASE WHEN num THEN host WHEN two IN ({_TWO}) THEN array_to_string(w[-3:], '.') ELSE two END AS domain,
      CASE WHEN num THEN '{ADDRESS}' WHEN two IN ({_TWO}) THEN two ELSE w[-1] END AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
f AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
f1 AS (SELECT f.*, (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM f) AS m FROM f),
f2 AS (SELECT suffix, (m * s + k) / (s + n) AS m FROM f1, {_strength_sql("f1")}),
d1 AS (SELECT d.*, m FROM d JOIN f2 USING (suffix)),
d2 AS (SELECT domain, (m * s + k) / (s + n) AS m FROM d1, {_strength_sql("d1")}),
h2 AS (SELECT h.*, m FROM h JOIN d2 USING (domain)),
h3 AS (SELECT *, m * s + k AS a, (1 - m) * s + n - k AS b FROM h2, {_strength_sql("h2")}),
r AS (SELECT host, domain, suffix, n::BIGINT AS labelled, k::BIGINT AS bad, round(a / (a + b), 9) AS mean,
      round(a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS upper FROM h3)
SELECT page_id, p.host, domain, suffix, labelled, bad, mean, upper, coalesce(upper <= 0.35, false) AS keep
FROM p LEFT JOIN r ON r.host = p.host
"""
