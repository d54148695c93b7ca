"""URL filters: explicit rules for hosts and paths, and association rules mined from labelled pages.

A URL becomes at most eight tokens, one of a kind: scheme, top-level domain, site, host, first host label, first folder, extension
and first query key. Spark's FP-growth finds the token sets that labelled pages share, with the class of the page as one more
item; sets that speak for blocking are kept if enough pages have them (support) and enough of those are bad (confidence). A set
that contains a set at least as confident says nothing new and goes.

With eight tokens a page has at most 256 token sets, so at a support of s at most 256 / s sets are frequent, however many pages
there are: the rules fit a task. They are matched by an inverted index, each rule under its rarest token, so that a URL meets
only rules that it has a chance to fit; pages are not shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Share of the labelled pages that a blocking set needs, and confidence that it needs when `DOUBT` more pages count as good.
SUPPORT, CONFIDENCE, DOUBT = 0.01, 0.5, 10
#: The item that says that a page is bad; no token begins like this.
BAD = "!bad"
#: (host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: str) -> Column:
    """What follows the first `://`; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, ASCII letters in lower case."""
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str) -> Column:
    """From the host up to `?`, `#` or the end."""
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. The rules are a list in code: a short one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: str) -> Column:
    """At most eight tokens of a URL, one of a kind; a URL without `://`, or null, has none."""
    host, path, rest = host_of(url), path_of(url), after_scheme(url)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    last = F.get(labels, n - 1)
    # the first folder of a path has a slash after it; digits are all alike
    folder = F.regexp_replace(F.regexp_extract(path, "^/([^/]+)/", 1), "[0-9]+", "0")
    extension = F.regexp_extract(path, "\\.([A-Za-z0-9]{1,8})\\z", 1)
    key = F.regexp_extract(rest, "^[^?#]*\\?([^=&#]+)", 1)
    kind = lambda k, value, when: F.when((F.instr(url, "://") > 0) & when, F.concat(F.lit(k), value))
    return F.array_compact(
        F.array(
            kind("scheme=", F.translate(F.substring_index(url, "://", 1), UPPER, LOWER), F.lit(True)),
            kind("tld=", last, host != ""),
            kind("site=", F.concat(F.get(labels, n - 2), F.lit("."), last), n > 1),
            kind("host=", host, host != ""),
            kind("label=", F.get(labels, F.lit(0)), n > 2),
            kind("folder=", folder, folder != ""),
            kind("ext=", F.translate(extension, UPPER, LOWER), extension != ""),
            kind("key=", key, key != ""),
        )
    )


def mine(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, doubt: int = DOUBT) -> DataFrame:
    """Rules (`tokens`, `n`, `n_bad`): sets of tokens that at least `support` of the labelled pages have and are bad with, and
    for which n_bad / (n + `doubt`) reaches `confidence`; without those that contain a rule at least as confident.

    A page is labelled by the rows of `labels` whose doc_id is its id: bad if any has quality = 0 or toxic = 1, good if none
    has and any value is known. Null and repeated ids and rows are possible: every page row counts. Without labelled pages,
    or without any token, there are no rules.
    """
    spark = pages.sparkSession
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    by_id = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("__bad"))
    known = pages.select(F.col(id_col).alias("__id"), tokens_of(url_col).alias("__t")).join(by_id, "__id")
    items = known.select(F.when(F.col("__bad"), F.array_append("__t", F.lit(BAD))).otherwise(F.col("__t")).alias("items"))
    none = spark.createDataFrame([], "tokens array<string>, n long, n_bad long")
    if not items.take(1):
        return none
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    spoken = sets.filter(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("n_bad")).filter(F.size("tokens") > 0)
    rules = spoken.join(sets.select(F.col("items").alias("tokens"), F.col("freq").alias("n")), "tokens").filter(F.col("n_bad") >= confidence * (F.col("n") + doubt))
    # a rule has at most 256 subsets: each asks for a rule of that name that is at least as confident
    ratio = F.col("n_bad") / (F.col("n") + doubt)
    rules = rules.withColumn("ratio", ratio)
    subsets = F.aggregate("tokens", F.array(F.array().cast("array<string>")), lambda a, t: F.concat(a, F.transform(a, lambda s: F.array_append(s, t))))
    asked = rules.select(F.col("tokens").alias("whole"), F.col("ratio").alias("need"), F.explode(subsets).alias("tokens")).filter("size(tokens) > 0 and size(tokens) < size(whole)")
    idle = asked.join(rules.select("tokens", "ratio"), "tokens").filter("ratio >= need").select(F.col("whole").alias("tokens")).distinct()
    return rules.join(idle, "tokens", "left_anti").select("tokens", "n", "n_bad")


def inverted(rules: Iterable[tuple[list[str], int, int]], doubt: int = DOUBT) -> dict[str, list[tuple[float, str, frozenset]]]:
    """token -> (confidence, name, other tokens) of the rules posted under it, best first; each under its rarest token.

    A token is rare if few rules have it, so that postings are short; ties go by name.
    """
    rules = [(sorted(t), n, b) for t, n, b in rules]
    uses: dict[str, int] = defaultdict(int)
    for t, _, _ in rules:
        for x in t:
            uses[x] += 1
    index = defaultdict(list)
    for t, n, b in rules:
        post = min(t, key=lambda x: (uses[x], x))
        index[post].append((b / (n + doubt), " ".join(t), frozenset(t) - {post}))
    return {k: sorted(v, key=lambda r: (-r[0], r[1])) for k, v in index.items()}


def matches(index: dict) -> Column:
    """A function of a token array: the name of the most confident rule that it fits, or null."""

    @F.pandas_udf("string")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tokens in batches:
            out = []
            for own in tokens:
                have, top = set(own), None
                for t in own:
                    for ratio, name, others in index.get(t, ()):
                        if top and (-ratio, name) > top:
                            break  # postings are sorted: none after this is better
                        if others <= have:
                            top = (-ratio, name)
                            break
                out.append(top and top[1])
            yield pd.Series(out, dtype="object")

    return best


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", overrides: Iterable[tuple[str, str, str]] = RULES, doubt: int = DOUBT) -> DataFrame:
    """Every row's id, `host`, `path`, `rule`, `verdict` (allow or block) and `because`, the mined rule that its URL fits best.

    An explicit rule that fits decides; else a mined rule that fits blocks, and what fits none is allowed. A URL that is null
    or has no `://` has an empty host and path and fits none. Repeated rows are judged alike; null ids stay; URLs of any length
    are read whole; an empty table gives no rows. Columns of the input other than id and URL are dropped.
    """
    index = inverted([tuple(r) for r in rules.select("tokens", "n", "n_bad").collect()], doubt)  # at most 256 / support rows
    row = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    row = row.select("__id", host_of("__url").alias("__host"), path_of("__url").alias("__path"), tokens_of("__url").alias("__tokens"))
    # null URLs: no host, no path
    row = row.withColumns({"__host": F.coalesce("__host", F.lit("")), "__path": F.coalesce("__path", F.lit(""))})
    row = row.withColumn("because", matches(index)(F.col("__tokens")))
    rule, verdict = explicit(F.col("__host"), F.col("__path"), overrides)
    mined = F.when(F.col("because").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return row.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "because")


#: All sets of tokens of the labelled pages, counted; a page has at most 256 of them.
OP11_SQL = r"""
WITH u AS (SELECT page_id, url, instr(url, '://') AS pos, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, pos, CASE WHEN pos > 0 THEN translate(substr(url, 1, pos - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS scheme, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT *, string_split(host, '.') AS l, regexp_replace(regexp_extract(path, '^/([^/]+)/', 1), '[0-9]+', '0', 'g') AS folder,
    translate(regexp_extract(path, '\.([A-Za-z0-9]{1,8})\z', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ext, regexp_extract(rest, '^[^?#]*\?([^=&#]+)', 1) AS key FROM p),
t AS (SELECT page_id, host, path, CASE WHEN coalesce(pos, 0) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_filter(['scheme=' || scheme, CASE WHEN host <> '' THEN 'tld=' || l[-1] END,
    CASE WHEN len(l) > 1 THEN 'site=' || l[-2] || '.' || l[-1] END, CASE WHEN host <> '' THEN 'host=' || host END, CASE WHEN len(l) > 2 THEN 'label=' || l[1] END,
    CASE WHEN folder <> '' THEN 'folder=' || folder END, CASE WHEN ext <> '' THEN 'ext=' || ext END, CASE WHEN key <> '' THEN 'key=' || key END], lambda x: x IS NOT NULL)) END AS t FROM k),
b AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
known AS (SELECT t, bad FROM t JOIN b ON page_id = doc_id),
sub AS (SELECT list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s, bad FROM (SELECT t, bad, unnest(range(1, 1 << len(t))) AS m FROM known)),
r AS (SELECT s, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM sub GROUP BY s),
c AS (SELECT s FROM r WHERE n_bad >= ceil(0.01::DOUBLE * (SELECT count(*) FROM known)) AND n_bad >= 0.5::DOUBLE * (n + 10)),
hit AS (SELECT DISTINCT t FROM (SELECT DISTINCT t FROM t) JOIN c ON list_has_all(t, s)),
e AS (SELECT page_id, host, path, hit.t IS NOT NULL AS mined,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM t LEFT JOIN hit USING (t))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR mined THEN 'block' ELSE 'allow' END AS verdict FROM e
"""


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the explicit rules and by those mined from all labelled pages."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(pages, table(spark, sf_dir, "labels"))).drop("because")


QUERIES = {"op11_url_rules": op11_url_rules}
ORACLE = {"op11_url_rules": OP11_SQL}
