"""URL filters: rules by host and path, and trust that spreads over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: All later steps together move less than this times what the last one moved, with a damping of 0.85.
_TRACE = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts that a page names: those of absolute links, and the one after its copyright sign.
_NAMED = r"(?:://|&copy;\s*|©\s*)([A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,})"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits a host, or a subdomain of its own, and the beginning of a path; else null."""
    cases = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = (host == name) | F.endswith(host, F.lit("." + name))
        cases.append(F.when(fits & F.startswith(path, F.lit("/" + start)), F.lit(rule)))
    return F.coalesce(*cases)


def host_links(pages: DataFrame) -> DataFrame:
    """(host, html) -> src, dst, n: how often pages of one host name another one."""
    named = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_NAMED), F.lit(1)))
    links = pages.select(F.col("host").alias("src"), named.alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return links.filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread_trust(seeds: DataFrame, links: DataFrame, damping: float = 0.85, residual: float = 0.001) -> DataFrame:
    """Personalised PageRank: seeds (host, allowed, blocked), links (src, dst, n) -> host, trust, distrust.

    Scores are sums of what each step moves, until a step moves less than `residual` of an average seed:
    the number of steps grows with the logarithm of the number of seeds. Trust starts at allowed pages and follows links; distrust starts at blocked pages and follows them
    backwards, to those who link there. Each host passes its score on in proportion to its links; both
    run in one join and one aggregation a step, with partial sums before the shuffle. Hosts that nothing
    reaches score 0.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    back = links.groupBy("dst").agg(F.sum("n").alias("all"))
    forth = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    against = links.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all")).alias("d"))
    arcs = stored(forth.unionByName(against).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    sums = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    a, b = float(sums["a"] or 0) or 1.0, float(sums["b"] or 0) or 1.0
    start = seeds.groupBy("host").agg((F.sum("allowed") / a).alias("trust"), (F.sum("blocked") / b).alias("distrust"))
    start = stored(start.filter("trust > 0 OR distrust > 0"))
    scores = ("trust", "distrust")
    last = residual / max(1, start.count())
    own = [F.col(c) * (1 - damping) for c in scores]
    ranks = start.select("host", *[x.alias(p + c) for p in ("", "new_") for c, x in zip(scores, own)])
    moving = True
    while moving:
        for _ in range(5):  # steps between checkpoints
            on = [F.col(f"new_{c}") * F.col(a) * damping for c, a in zip(scores, ("t", "d"))]
            moved = ranks.filter("new_trust > 0 OR new_distrust > 0").join(arcs, "host").select(
                F.col("to").alias("host"), *[x.alias(p + c) for p in ("", "new_") for c, x in zip(scores, on)]
            )
            held = ranks.select("host", *scores, *[F.lit(0.0).alias(f"new_{c}") for c in scores])
            ranks = moved.unionByName(held).groupBy("host").agg(*[F.sum(c).alias(c) for c in held.columns[1:]])
        ranks = ranks.checkpoint()
        moving = max(x or 0.0 for x in ranks.agg(*[F.sum(f"new_{c}") for c in scores]).first()) > last
    return ranks.select("host", *scores).filter("trust > 0 OR distrust > 0")


def judged_pages(pages: DataFrame, rules=RULES, threshold: float = 0.9, damping: float = 0.85, residual: float = 0.001) -> DataFrame:
    """(page_id, url, html) -> page_id, host, path, rule, verdict: one row for each row of pages.

    The longest rule that fits decides. Without one a page is blocked if its host has more than
    `threshold` of its trust and distrust in distrust, and that is no trace (under _TRACE times what ends
    the propagation, so that no later step could matter), else allowed; so is a page without a host. Repeated
    rows stay; texts of any length are read whole; other columns are dropped; an empty table gives an empty
    result.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    base = base.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    base = base.withColumn("ruled", verdict[F.col("rule")])
    seeds = base.filter("ruled IS NOT NULL AND host <> ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    seeds = stored(seeds)
    trace = _TRACE * residual / max(1, seeds.count())
    ranks = spread_trust(seeds, stored(host_links(base)), damping, residual)
    hosts = ranks.filter((F.col("distrust") > trace) & (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))).select(
        "host", F.lit("block").alias("by_host")
    )
    return base.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict")
    )


def pages_sql(rules=RULES, threshold: float = 0.9, damping: float = 0.85, residual: float = 0.001) -> str:
    """DuckDB SQL for judged_pages(pages)."""
    named = _NAMED.replace("(?:", "(?:").replace("'", "''")
    fits = lambda name, start: f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}'))"
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(*r.partition('/')[::2])} THEN '{r}'" for _, r in order) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules) + " END"
    return f"""
    WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    v AS (SELECT *, {rule} AS rule FROM u), b AS (SELECT *, {verdict} AS ruled FROM v),
    links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src,
        translate(unnest(regexp_extract_all(coalesce(html, ''), '{named}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM b)
        WHERE src <> dst AND src <> '' GROUP BY ALL),
    arcs AS (SELECT host, "to", sum(t) AS t, sum(d) AS d FROM (
        SELECT src AS host, dst AS "to", n / sum(n) OVER (PARTITION BY src) AS t, 0.0::DOUBLE AS d FROM links
        UNION ALL SELECT dst, src, 0.0::DOUBLE, n / sum(n) OVER (PARTITION BY dst) FROM links) GROUP BY ALL),
    seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM b
        WHERE ruled IS NOT NULL AND host <> '' GROUP BY host),
    r0 AS (SELECT host, coalesce(a / nullif((SELECT sum(a) FROM seeds), 0), 0) AS trust,
        coalesce(b / nullif((SELECT sum(b) FROM seeds), 0), 0) AS distrust FROM seeds),
    seeded AS (SELECT count(*) AS n FROM seeds),
    moved AS (SELECT 0 AS step, host, trust * {1 - damping} AS trust, distrust * {1 - damping} AS distrust FROM r0
        UNION ALL SELECT step + 1, a."to", sum(m.trust * a.t * {damping}), sum(m.distrust * a.d * {damping}) FROM moved m JOIN arcs a ON a.host = m.host
        WHERE step < (SELECT ceil(ln({residual} / n) / ln({damping})) FROM seeded) GROUP BY step, a."to"
        HAVING sum(m.trust * a.t) > 0 OR sum(m.distrust * a.d) > 0),
    ranks AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM moved GROUP BY host)
    SELECT page_id, host, path, rule, coalesce(ruled, (SELECT 'block' FROM ranks r WHERE r.host = b.host
        AND r.distrust > {_TRACE * residual} / (SELECT n FROM seeded) AND r.distrust > {threshold} * (r.trust + r.distrust)), 'allow') AS verdict FROM b"""
