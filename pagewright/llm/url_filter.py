"""URL filters: prefix rules per host, carried to aliases over redirect and canonical links.

A rule names a host and a start of the path and holds for subdomains too; the longest that fits decides. URLs
that one page declares to be another (canonical link, refresh redirect, or rows of an edge table) are aliases,
and connected components of those edges share decisions: a page without a rule of its own is blocked if its
component holds a blocked URL and no URL that a rule allows. An explicit allow always comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import connected_components, read_table

#: (verdict, host, start of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules up to this many travel inside the plan; longer lists, and DataFrames of rules, are joined.
MOST_INLINE = 200
#: Rule hosts up to this many are broadcast in that join.
MOST_BROADCAST = 50_000

_LINK = regex.compile(r"(?is)<link\b[^>]*>|<meta\b[^>]*>")
_ATTRIBUTE = regex.compile(r"""(?is)([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_REFRESH = regex.compile(r"""(?is)^\s*\d+(?:\.\d*)?\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']+)""")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alias_links(url: str | None, html: str | None) -> list[str]:
    """Absolute targets, without fragments, of a page's canonical links and refresh redirects."""
    out: list[str] = []
    for tag in _LINK.findall(html or ""):
        found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(tag)}
        target = ""
        if tag[1:5].lower() == "link" and "canonical" in found.get("rel", "").lower().split():
            target = found.get("href", "")
        elif tag[1:5].lower() == "meta" and found.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(found.get("content", ""))):
            target = m[1]
        if target.strip():
            try:
                out.append(urldefrag(urljoin(url or "", target.strip()))[0])
            except ValueError:
                pass  # not a URL at all, so not an alias either
    return out


def _edges(batches):
    for batch in batches:
        src, dst = [], []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for target in alias_links(url, html):
                src.append(url.partition("#")[0])
                dst.append(target)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src_url", "dst_url"])


def page_edges(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url) declared in the html of pages; only pages with such a tag reach Python."""
    low = F.lower("html")
    able = pages.filter(F.col("url").isNotNull() & (low.contains("canonical") | low.contains("http-equiv")))
    return able.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_edges, "src_url string, dst_url string")


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """df with host and path, plus rule (host and path start of the longest that fits) and rule_verdict.

    rules are (verdict, host, path), as a list or a DataFrame, of any number; of equal ones that disagree, block wins.
    """
    if isinstance(rules, DataFrame) or len(rules) > MOST_INLINE:
        listed = rules if isinstance(rules, DataFrame) else df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        return _joined_rule(df, listed)
    none = F.lit(None).cast("struct<size:int,host_size:int,verdict:string,name:string>")
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    listed = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("name"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(listed, lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"]))
    best = F.coalesce(F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["verdict"].alias("verdict"), r["name"].alias("name")))), none)
    return df.withColumn("_best", best).withColumns({"rule": F.col("_best.name"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


def _joined_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """with_rule by two equi-joins of distinct (host, path): host suffixes find hosts with rules, and at these the path
    starts of the lengths that the host's rules have find the rules themselves. A URL brings as many rows as its host
    has suffixes no longer than the longest rule host, then as its rule hosts have lengths of paths."""
    rules = rules.select("verdict", F.col("host").alias("_h"), F.col("path").alias("_p")).filter("_h is not null and _p is not null").groupBy("_h", "_p").agg(F.max("verdict").alias("verdict"))
    hosts = rules.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_sizes"))
    count, longest = hosts.agg(F.count("*"), F.max(F.length("_h"))).first()
    hosts = F.broadcast(hosts) if count <= MOST_BROADCAST else hosts
    urls = df.select("host", "path").distinct()
    # a suffix begins at the start or after a dot; only the last `longest` characters can be a rule's host
    tail = F.when(F.length("host") > (longest or 0), F.right("host", F.lit((longest or 0) + 1))).otherwise(F.concat(F.lit("."), F.col("host")))
    starts = F.filter(F.sequence(F.lit(1), F.length("_tail")), lambda k: F.substring("_tail", k, F.lit(1)) == ".")
    near = urls.withColumn("_tail", tail).withColumn("_h", F.explode(F.transform(starts, lambda k: F.substring("_tail", k + 1, F.length("_tail"))))).drop("_tail").join(hosts, "_h")
    near = near.withColumn("_size", F.explode("_sizes")).filter("_size <= length(path)").withColumn("_p", F.substring("path", F.lit(1), F.col("_size")))
    fits = near.join(rules, ["_h", "_p"])
    order = F.struct((F.length("_h") + F.length("_p")).alias("size"), F.length("_h").alias("host_size"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("verdict").alias("rule_verdict")), order).alias("_best"))
    return df.drop("rule", "rule_verdict").join(best, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.rule_verdict")}).drop("_best")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages (url, html): page_id, host, path, rule, verdict and decided_by (rule, alias, default).

    redirects may add edges (src_url, dst_url). Fragments do not tell aliases apart. Null or malformed URLs have
    empty host and path, no aliases, and are allowed by default; null html has no links. Repeated rows are judged
    alike; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = with_rule(pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(*[F.substring_index(F.col(c).cast("string"), "#", 1).alias(c) for c in ("src_url", "dst_url")]))
    # Components run over the URLs themselves; only URLs in an edge take part, wherever their pages are.
    members = connected_components(edges, "src_url", "dst_url")
    judged = with_rule(members.select("component", F.col("id"), host_of(F.col("id")).alias("host"), path_of(F.col("id")).alias("path")), rules)
    decided = judged.groupBy("component").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    alias = members.join(decided, "component").select(F.col("id").alias("node"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict")).filter("alias_verdict is not null")
    out = rows.withColumn("node", F.substring_index("url", "#", 1)).join(alias, "node", "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"), by.alias("decided_by"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def page_redirects(pages: DataFrame) -> DataFrame:
    """An edge table made of pages, as the tables declare no aliases: a page redirects to the next page_id if that page's html is shorter."""
    one = pages.select(F.col("page_id").alias("_of"), F.col("url").alias("src_url"), F.length("html").alias("_n"))
    other = pages.select((F.col("page_id") - 1).alias("_of"), F.col("url").alias("dst_url"), F.length("html").alias("_m"))
    return one.join(other, "_of").filter("_n > _m").select("src_url", "dst_url")


def redirected_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged with the edges of page_redirects: decisions reach aliases across hosts."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return judge_urls(pages, redirects=page_redirects(pages)).select("page_id", "rule", "verdict", "decided_by")


#: Pages of the tables declare no aliases, so rules and the default decide.
ORACLE = r"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict, case when rule is null then 'default' else 'rule' end as decided_by
from parts left join best using (page_id)
"""

REDIRECTED_ORACLE = r"""
with recursive parts as (
  select page_id, url, length(html) as n, split_part(url, '#', 1) as node, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
edges as (select a.node as x, b.node as y from parts a join parts b on b.page_id = a.page_id + 1 and a.n > b.n),
both_ways as (select x, y from edges union select y, x from edges),
reach(node, other) as (select distinct x, x from both_ways union select node, y from reach join both_ways on x = other),
decided as (
  select r.node, bool_or(verdict = 'allow') as allowed, bool_or(verdict = 'block') as blocked
  from reach r join parts on parts.node = r.other join best using (page_id) group by r.node)
select parts.page_id, rule, case when rule is not null then verdict when allowed then 'allow' when blocked then 'block' else 'allow' end as verdict,
       case when rule is not null then 'rule' when allowed or blocked then 'alias' else 'default' end as decided_by
from parts left join best on best.page_id = parts.page_id left join decided on decided.node = parts.node
"""
