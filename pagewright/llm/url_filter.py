"""Operator 7, URL filters: a tree of path templates for each host.

1. A URL becomes its host and a row of tokens: path segments (numbers, hexadecimal ids, UUIDs and dates by
   their class, file endings kept) and the set of its query keys. Equal rows are counted once.
2. From the root down, children of a node with too few pages to be judged by themselves are variable: they
   become one wildcard. Every other child stays a branch of its own, however small its share of the node. A branch
   is followed as deep as it has enough pages; from there on it is one tail ``**``.
3. From the leaves up, branches that differ in one token and whose share of good labels doesn't differ from
   that of all of them together (a z test) are merged; more than ``most_names`` under one name are ``{*}``.
4. Each template's purity is its share of good labels, smoothed by its host's, which is smoothed by that of
   all pages; pages of a template under ``least_purity`` are rejected.

All of it is DataFrame work on aggregated rows; the number of steps follows the depth of the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class UrlParams:
    """A literal segment, and a branch that is followed further, needs ``min_pages`` pages. ``z`` bounds the deviation
    of branches that merge, ``strength`` is how many labels the smoothing counts for."""

    min_pages: int = 3
    z: float = 2.0
    strength: float = 10.0
    least_purity: float = 0.5
    most_names: int = 20


#: Classes of segments without their ending: a pattern, then what stands for it.
CLASSES = (("^[0-9]+$", "<num>"), ("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "<date>"), ("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "<uuid>"), ("^[0-9a-f]*[0-9][0-9a-f]*$", "<hex>"))
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)([^?#]*)([?]([^#]*))?"
_ENDING = r"[.][a-z][a-z0-9]{1,4}$"
_FIXED = r"^(<|[?]|[*])"


def _segment(seg: Column) -> Column:
    seg = F.lower(seg)
    stem, ending = F.regexp_replace(seg, _ENDING, ""), F.regexp_extract(seg, f"({_ENDING})", 1)
    kind = stem
    for pattern, name in reversed(CLASSES):
        long_enough = F.length(stem) >= 8 if name == "<hex>" else F.lit(True)
        kind = F.when(stem.rlike(pattern) & long_enough, name).otherwise(kind)
    return F.when(stem == "", seg).otherwise(F.concat(kind, ending))


def tokens(pages: DataFrame, p: UrlParams) -> DataFrame:
    """``(page_id, host, raw, tokens)``; ``raw`` is the joined tokens, all but page_id null where there is no host."""
    url = F.trim("url")
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.nullif(F.regexp_replace(F.lower(part(1)), "^.*@|:[0-9]*$", ""), F.lit(""))
    segs = F.filter(F.split(part(2), "/"), lambda x: x != "")
    path = F.transform(segs, _segment)
    keys = F.transform(F.split(part(4), "&"), lambda x: F.lower(F.split(x, "=")[0]))
    keys = F.array_sort(F.array_distinct(F.filter(keys, lambda x: (x != "") & ~x.startswith("utm_"))))
    query = F.array(F.concat(F.lit("?"), F.array_join(keys, "&")))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.concat(path, query).alias("tokens"))
    return out.select("page_id", "host", F.when(F.col("host").isNotNull(), F.array_join("tokens", "/")).alias("raw"), "tokens")


def _set(row: str, at: int, value: Column) -> Column:
    """``row`` with another token at place ``at``."""
    return F.transform(row, lambda x, i: F.when(i == at, value).otherwise(x))


def generalise(rows: DataFrame, p: UrlParams) -> tuple[DataFrame, int]:
    """``rows (host, raw, tokens, n, ...)`` with ``cur``: tokens that are variable among their siblings as wildcards and
    branches of few pages cut to a tail; and the depth of the deepest branch that is left."""
    rows = cut(rows.withColumn("cur", F.col("tokens")))
    d = 0
    while True:
        at = rows.withColumn("prefix", F.array_join(F.slice("cur", 1, d), "/"))
        node = at.filter(F.size("cur") > d).groupBy("host", "prefix", F.get("cur", F.lit(d)).alias("seg")).agg(F.sum("n").alias("n"))
        node = cut(node.filter(F.col("seg") != "**"))
        if node.isEmpty():
            return rows, d
        few = node.groupBy("host", "prefix").agg(F.sum("n").alias("all")).filter(F.col("all") < p.min_pages).select("host", "prefix", F.lit(True).alias("few"))
        rare = node.filter(~F.col("seg").rlike(_FIXED) & (F.col("n") < p.min_pages)).select("host", "prefix", "seg", F.lit(True).alias("rare"))
        wild = F.concat(F.lit("*"), F.regexp_extract("seg", f"({_ENDING})", 1))
        told = at.withColumn("seg", F.get("cur", F.lit(d))).join(few, ["host", "prefix"], "left").join(rare, ["host", "prefix", "seg"], "left")
        tail = F.concat(F.slice("cur", 1, d), F.array(F.lit("**")))
        told = told.withColumn("cur", F.when(F.col("few") & (F.size("cur") > d), tail).when(F.col("rare"), _set("cur", d, wild)).otherwise(F.col("cur")))
        rows = cut(told.select(*rows.columns))
        d += 1


def merge(rows: DataFrame, p: UrlParams, levels: int) -> DataFrame:
    """``rows (host, cur, n, labelled, good)`` with ``template``: similar branches under one name."""
    rows = rows.withColumn("template", F.col("cur"))
    for d in reversed(range(levels)):
        now = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        now = now.filter(F.size("template") > d).withColumn("seg", F.get("template", F.lit(d))).withColumn("rest", F.array_join(_set("template", d, F.lit("\t")), "/"))
        pool = now.groupBy("host", "rest").agg(F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good"))
        share = F.try_divide("all_good", "all_labelled")
        off = F.col("good") - F.col("labelled") * share
        like = (F.col("labelled") == 0) | (off * off <= p.z * p.z * F.greatest(F.col("labelled") * share * (1 - share), F.lit(0.25)))
        alike = now.join(pool, ["host", "rest"]).filter(like)
        groups = alike.groupBy("host", "rest").agg(F.count("*").alias("branches")).filter("branches > 1")
        few = alike.join(groups.filter(F.col("branches") <= p.most_names), ["host", "rest"]).groupBy("host", "rest").agg(F.array_sort(F.collect_set("seg")).alias("names"))
        few = few.select("host", "rest", F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")).alias("name"))
        names = few.union(groups.filter(F.col("branches") > p.most_names).select("host", "rest", F.lit("{*}")))
        renamed = alike.join(names, ["host", "rest"]).select("host", "template", "name")
        rows = cut(rows.join(renamed, ["host", "template"], "left").withColumn("template", F.when(F.col("name").isNotNull(), _set("template", d, F.col("name"))).otherwise(F.col("template"))).select(*rows.columns))
    return rows


def filter_urls(pages: DataFrame, labels: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """``(page_id, host, template, labelled, purity, kept)`` for every row of ``pages``.

    ``labels (doc_id, quality, toxic)`` belong to pages by ``doc_id = page_id``; good is quality 1 and not
    toxic, and several labels of a page must all be good. Defined results: a null, empty or malformed URL (no
    scheme or host) has null host, template, labelled and purity and isn't kept; a template without labels
    has its host's purity and a host without labels that of all pages; without any label purity is null and
    all pages with a host are kept; a purity equal to the bar is kept; repeated rows and null page_ids have a
    row each (a null page_id has no label); an empty table gives an empty result; other columns are not read.
    """
    p = params
    toks = tokens(pages.select("page_id", "url"), p)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.min(good).alias("good"))
    rows = cut(
        toks.filter("host is not null").join(marks, "page_id", "left").groupBy("host", "raw").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    rows, levels = generalise(rows, p)
    known = merge(rows.groupBy("host", "cur").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "good"))), p, levels)
    s = p.strength
    total = known.agg(F.try_divide(F.sum("good"), F.sum("labelled")).alias("overall"))
    hosts = known.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).crossJoin(F.broadcast(total)).select("host", ((F.col("g") + F.col("overall") * s) / (F.col("l") + s)).alias("prior"))
    stats = known.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).join(hosts, "host")
    stats = stats.select("host", "template", "labelled", F.round((F.col("good") + F.col("prior") * s) / (F.col("labelled") + s), 6).alias("purity"))
    verdict = rows.select("host", "raw", "cur").join(known.select("host", "cur", "template"), ["host", "cur"]).join(stats, ["host", "template"])
    name = F.concat(F.lit("/"), F.array_join("template", "/"))
    verdict = verdict.select("host", "raw", name.alias("template"), "labelled", "purity")
    out = toks.select("page_id", "host", "raw").join(verdict, ["host", "raw"], "left")
    return out.select("page_id", "host", "template", "labelled", "purity", (F.col("host").isNotNull() & F.coalesce(F.col("purity") >= p.least_purity, F.lit(True))).alias("kept"))


def oracle_sql(params: UrlParams = UrlParams(), levels: int = 8) -> str:
    """DuckDB SQL for the rows of :func:`filter_urls` over ``pages`` and ``labels``.

    Its steps are written out, so it stands for the rows where no branch of ``min_pages`` pages is deeper than
    ``levels``; those of the tables at hand end at three.
    """
    p, s = params, params.strength
    stem, ending = f"regexp_replace(s, '{_ENDING}', '')", f"regexp_extract(s, '({_ENDING})', 1)"
    kinds = " ".join(f"WHEN regexp_matches({stem}, '{pattern}')" + (f" AND length({stem}) >= 8" if name == "<hex>" else "") + f" THEN '{name}'" for pattern, name in CLASSES)
    token = f"CASE WHEN {stem} = '' THEN s ELSE (CASE {kinds} ELSE {stem} END) || {ending} END"
    put = lambda row, d, value: f"[CASE WHEN i = {d + 1} THEN {value} ELSE {row}[i] END FOR i IN range(1, len({row}) + 1)]"
    out = rf"""
WITH u AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '{_URL}', 1)), '^.*@|:[0-9]*$', '', 'g'), '') AS host,
    list_filter(string_split(regexp_extract(trim(url), '{_URL}', 2), '/'), lambda x: x <> '') AS segs,
    list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(trim(url), '{_URL}', 4), '&'), lambda x: lower(string_split(x, '=')[1])), lambda x: x <> '' AND NOT starts_with(x, 'utm_')))) AS keys
  FROM pages
), toks AS MATERIALIZED (
  SELECT page_id, host, list_concat([{token} FOR s IN list_transform(segs, lambda x: lower(x))], ['?' || array_to_string(keys, '&')]) AS t FROM u
), marks AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), g0 AS MATERIALIZED (
  SELECT host, t AS raw, t AS cur, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good FROM toks LEFT JOIN marks USING (page_id) WHERE host IS NOT NULL GROUP BY ALL
)"""
    for d in range(levels):
        out += rf""", a{d} AS (SELECT *, cur[{d + 1}] AS seg, array_to_string(cur[1:{d}], '/') AS prefix FROM g{d}),
c{d} AS (SELECT host, prefix, seg, sum(n) AS n FROM a{d} WHERE seg IS NOT NULL AND seg <> '**' GROUP BY ALL),
r{d} AS MATERIALIZED (SELECT host, prefix, seg, NOT regexp_matches(seg, '{_FIXED}') AND n < {p.min_pages} AS rare, sum(n) OVER (PARTITION BY host, prefix) < {p.min_pages} AS few FROM c{d}),
g{d + 1} AS MATERIALIZED (SELECT host, raw, CASE WHEN few THEN list_concat(cur[1:{d}], ['**']) WHEN rare THEN {put("cur", d, f"'*' || regexp_extract(seg, '({_ENDING})', 1)")} ELSE cur END AS cur, n, labelled, good FROM a{d} LEFT JOIN r{d} USING (host, prefix, seg))"""
    out += f", m{levels} AS MATERIALIZED (SELECT host, cur, cur AS template, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good FROM g{levels} GROUP BY ALL)"
    for d in reversed(range(levels)):
        out += f""", n{d} AS (SELECT host, template, sum(labelled) AS labelled, sum(good) AS good, template[{d + 1}] AS seg, array_to_string({put("template", d, "chr(9)")}, '/') AS rest FROM m{d + 1} WHERE len(template) > {d} GROUP BY ALL),
l{d} AS MATERIALIZED (SELECT * FROM (SELECT *, sum(good) OVER w / sum(labelled) OVER w AS share FROM n{d} WINDOW w AS (PARTITION BY host, rest))
  WHERE labelled = 0 OR (good - labelled * share) * (good - labelled * share) <= {p.z * p.z}::DOUBLE * greatest(labelled * share * (1 - share), 0.25::DOUBLE)),
k{d} AS MATERIALIZED (SELECT host, template, name FROM l{d} JOIN (SELECT host, rest, '{{' || array_to_string(list_sort(list_distinct(list(seg))), '|') || '}}' AS name FROM l{d} GROUP BY 1, 2 HAVING count(DISTINCT seg) > 1) USING (host, rest)),
m{d} AS MATERIALIZED (SELECT host, cur, CASE WHEN name IS NOT NULL THEN {put("template", d, "name")} ELSE template END AS template, n, labelled, good FROM m{d + 1} LEFT JOIN k{d} USING (host, template))"""
    return out + f""", prior AS (
  SELECT host, (sum(good) + (SELECT sum(good) / sum(labelled) FROM m0) * {s}::DOUBLE) / (sum(labelled) + {s}::DOUBLE) AS prior FROM m0 GROUP BY 1
), stats AS (
  SELECT host, template, labelled, round((good + prior * {s}::DOUBLE) / (labelled + {s}::DOUBLE), 6) AS purity
  FROM (SELECT host, template, sum(labelled) AS labelled, sum(good) AS good FROM m0 GROUP BY 1, 2) JOIN prior USING (host)
), verdict AS (SELECT host, raw, '/' || array_to_string(template, '/') AS template, stats.labelled::BIGINT AS labelled, purity FROM g{levels} JOIN m0 USING (host, cur) JOIN stats USING (host, template))
SELECT page_id, t.host, template, v.labelled, purity, t.host IS NOT NULL AND coalesce(purity >= {p.least_purity}::DOUBLE, TRUE) AS kept
FROM toks t LEFT JOIN verdict v ON t.host = v.host AND t.t = v.raw"""
