"""Queries over scraped documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.pairs import nearest
from ..operators.selection import semantic_duplicates
from ..sources.storage import cut
from ..sources.views import strategies, table
from ..sql import with_views
from .common import SHIFT, rounded

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = sql


def quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def count_sql(patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(text, {quote(p)}, 'i') AS INTEGER)" for p in patterns) + ")"


#: Documents with a strategy note after every third, so that the patterns have something to find.
NOTE = "Entry signal: buy when momentum is above the threshold = 0.5. Sharpe ratio = 1.2, max drawdown = 10. fast period = 12, stop loss = 2.5. import pandas, def next. Walk-forward over the confidence interval; exit on a crossover."
docs = lambda s, d: table(s, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n" + NOTE))).otherwise(F.col("text")).alias("text"))
DOCS = f"WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || {quote(NOTE)} ELSE text END AS text FROM documents)"
KIND = "CASE doc_id % 5 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'github' WHEN 2 THEN 'reddit' WHEN 3 THEN 'blog' ELSE 'general' END"
CLARITY = "least(1.0, 0.5 + CASE WHEN length(text) > 3000 THEN 0.2 WHEN length(text) > 1000 THEN 0.1 ELSE 0 END + CASE WHEN k >= 9 THEN 0.3 WHEN k >= 4 THEN 0.15 ELSE 0 END)"
KEYS = "(" + " + ".join(f"CAST(contains(lower(text), {quote(k)}) AS INTEGER)" for k in tx.KEYWORDS) + ") AS k"
COUNTS = ", ".join(f"{count_sql(p)} AS {k}_matches" for k, (p, _) in tx.FAMILIES.items())
SCORED = DOCS + f""", c AS (SELECT *, {COUNTS}, {KEYS}, CASE {KIND} WHEN 'arxiv' THEN 1.0 WHEN 'github' THEN 0.7 WHEN 'reddit' THEN 0.3 ELSE 0.5 END AS w FROM d),
s AS (SELECT *, {CLARITY} AS clarity, round(least(w * {CLARITY}{''.join(f' * CASE WHEN {k}_matches > 0 THEN {b} ELSE 1.0 END' for k, (_, b) in tx.FAMILIES.items())} / 2, 1.0) + 1e-9, 4) AS quality_score FROM c) """
scores = lambda s, d: tx.document_scores(docs(s, d), "text", F.expr(KIND))
FAM = ", ".join(f"{k}_matches" for k in tx.FAMILIES)
add("T1_pattern_counts", lambda s, d: scores(s, d).select("doc_id", *[f"{k}_matches" for k in tx.FAMILIES]), SCORED + f"SELECT doc_id, {FAM} FROM s")
add("T2_clarity", lambda s, d: scores(s, d).select("doc_id", "clarity"), SCORED + f"SELECT doc_id, round(CAST(clarity AS DOUBLE) + {SHIFT}, 6) + 0.0 AS clarity FROM s")
add("T3_document_score", lambda s, d: scores(s, d).select("doc_id", "quality_score"), SCORED + f"SELECT doc_id, round(CAST(quality_score AS DOUBLE) + {SHIFT}, 6) + 0.0 AS quality_score FROM s")
# stored: a filter over the score itself would find the text in lower case anew for every pattern
add("T4_score_threshold", lambda s, d: cut(scores(s, d).select("doc_id", "quality_score"), "scores").filter("quality_score >= 0.3").select("doc_id"), SCORED + "SELECT doc_id FROM s WHERE quality_score >= 0.3")
WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
add("T5_summary_quality", lambda s, d: docs(s, d).select("doc_id", tx.summary_quality(F.col("text")).alias("q")), DOCS + f" SELECT doc_id, round(CAST(CASE WHEN text IS NULL OR {WORDS} < 10 THEN 0.7 ELSE least(1.1, 0.8 + CASE WHEN {WORDS} >= 30 THEN 0.1 ELSE 0 END + CASE WHEN " + " OR ".join(f"contains(lower(text), '{a}')" for a in tx.ACTIONS) + f" THEN 0.1 ELSE 0 END) END AS DOUBLE) + {SHIFT}, 6) + 0.0 AS q FROM d")
add("T6_exact_dedup", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
PATH = "lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1))"
pages = lambda s, d: table(s, d, "pages").withColumn("url", F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "example\\.com", "github.com")).when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "example\\.net", "medium.com")).otherwise(F.col("url")))
PAGES = "WITH p AS (SELECT page_id, html, CASE WHEN page_id % 4 = 0 THEN replace(url, 'example.com', 'github.com') WHEN page_id % 7 = 0 THEN replace(url, 'example.net', 'medium.com') ELSE url END AS url FROM pages)"
add("T7_url_rules", lambda s, d: pages(s, d).select("page_id", tx.source_type("url").alias("source_type"), tx.skip_url("url").alias("skip")), PAGES + " SELECT page_id, CASE " + " ".join(f"WHEN contains({HOST}, '{a}') THEN '{b}'" for a, b in tx.SOURCES) + " ELSE 'general' END AS source_type, " + " OR ".join([f"contains({HOST}, '{x}')" for x in tx.SKIP_DOMAINS] + [f"ends_with({PATH}, '{x}')" for x in tx.SKIP_ENDINGS]) + " AS skip FROM p")
add("T8_html_to_text", lambda s, d: table(s, d, "pages").select("page_id", F.md5(tx.html_to_text("html", None)).alias("digest"), F.length(tx.html_to_text("html", None)).alias("n")), r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS t FROM pages) SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM t""")
NESTED = "(?is)</?(?:" + "|".join(tx.NESTED_BLOCKS) + r")(?:[\s/][^>]*)?>"
add("T8_page_text", lambda s, d: table(s, d, "pages").withColumn("t", tx.page_text("html")).filter("t is not null").select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n")), rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<script(?:[\s/][^>]*)?>.*?</script\s*>', chr(10), 'g'), '(?is)<style(?:[\s/][^>]*)?>.*?</style\s*>', chr(10), 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_split_to_array(h, '{NESTED}') AS p, regexp_extract_all(h, '{NESTED}') AS g FROM a),
c AS (SELECT *, list_prepend(0, list_transform(g, lambda t: CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') THEN 0 ELSE 1 END)) AS m FROM b),
d AS (SELECT *, list_transform(range(1, len(m) + 1), lambda i: list_sum(m[1:i])) AS s FROM c),
e AS (SELECT page_id, array_to_string(list_filter(p, lambda x, i: s[i] - least(0, list_min(s[1:i])) = 0), chr(10)) AS h FROM d),
f AS (SELECT page_id, {"replace(" * len(tx.ENTITIES)}regexp_replace(h, '<[^>]+>', chr(10), 'g'){"".join(f", '{x}', '{quote(y)[1:-1] if y == chr(39) else y}')" for x, y in tx.ENTITIES)} AS h FROM e),
g AS (SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(h, '[\r\n]'), lambda x: regexp_replace(x, '^[ \t\f]+|[ \t\f]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM f)
SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM g WHERE length(t) >= 200""")
add("T14_slug", lambda s, d: strategies(s, d).select("strategy_id", tx.slug("name").alias("slug")), with_views("strategies", "SELECT strategy_id, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS slug FROM strategies"))
add("T15_hash_feature", lambda s, d: strategies(s, d).select("strategy_id", tx.hash_feature(F.col("name")).alias("x")), with_views("strategies", f"SELECT strategy_id, round(('0x' || substr(md5(name), 1, 8))::BIGINT / 4294967295.0::DOUBLE + {SHIFT}, 6) + 0.0 AS x FROM strategies"))
add("T17_mojibake", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(tx.fix_mojibake("text")).alias("digest")), "SELECT doc_id, md5(" + "replace(" * len(tx.MOJIBAKE) + "text" + "".join(f", '{a}', '{b}')" for a, b in tx.MOJIBAKE) + ") AS digest FROM documents")
add("T18_idea_lines", lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("n", "line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("line")).alias("longest")), "SELECT doc_id, len(l) AS lines, list_max(list_transform(l, lambda x: CAST(length(x) AS INTEGER))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) WHERE len(l) > 0")
add("S8_year_of_name", lambda s, d: strategies(s, d).select("strategy_id", F.regexp_extract(F.concat("name", F.lit("_2"), F.lpad((F.col("strategy_id") % 1000).cast("string"), 3, "0"), F.lit(".csv")), r"(\d{4})", 1).alias("year")), with_views("strategies", r"SELECT strategy_id, regexp_extract(name || '_2' || lpad(CAST(strategy_id % 1000 AS VARCHAR), 3, '0') || '.csv', '(\d{4})', 1) AS year FROM strategies"))


COS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)"
vectors = lambda s, d: table(s, d, "embeddings")
hundredth = lambda s, d: vectors(s, d).filter("vec_id % 100 = 0")  # noqa: E731  the queries, against all rows
add("J7_top1_cosine", lambda s, d: nearest(vectors(s, d), hundredth(s, d), "cosine").select(F.col("query_id").alias("vec_id"), "ref_id", F.col("value").alias("sim")), COS + f", x AS (SELECT a.vec_id, b.vec_id AS ref_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.norm * b.norm) + 3.05e-11, 9) AS sim FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT vec_id, first(ref_id ORDER BY sim DESC, ref_id) AS ref_id, round(max(sim) + {SHIFT}, 6) + 0.0 AS sim FROM x GROUP BY vec_id")
add("J6_nearest_vector", lambda s, d: nearest(vectors(s, d), hundredth(s, d), "distance").select(F.col("query_id").alias("vec_id"), "ref_id", F.col("value").alias("d")), COS + f", x AS (SELECT a.vec_id, b.vec_id AS ref_id, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) + 3.05e-11, 9) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT vec_id, first(ref_id ORDER BY d, ref_id) AS ref_id, round(min(d) + {SHIFT}, 6) + 0.0 AS d FROM x GROUP BY vec_id")
add("X11_vector_norms", lambda s, d: vectors(s, d).select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")), COS + f" SELECT vec_id, round(norm + {SHIFT}, 6) + 0.0 AS norm FROM n")
REPLIES = [
    ("{{'id': {i}, 'ok': True}}", '{{"id": {i}, "ok": true}}'), ('```json\n{{"b": [{i}], "a": null}}\n```\nDone.', '{{"a": null, "b": [{i}]}}'),
    ('Here: {{"a": {{"b": {i}}}}} and more', '{{"a": {{"b": {i}}}}}'), ("no object, {i}", None), ('{{"n": {i}, "open": ', None), ('[{i}, "x"]', '[{i}, "x"]'),
]


def _replies(column: str, at: int) -> str:
    """The reply, or what it holds, of a strategy: by its id modulo the number of kinds."""
    show = lambda t: "NULL" if t is None else "replace(" + quote(t.format(i="#")) + ", '#', CAST(strategy_id AS STRING))"
    return "CASE strategy_id % " + str(len(REPLIES)) + "".join(f" WHEN {i} THEN {show(x[at])}" for i, x in enumerate(REPLIES)) + f" END AS {column}"


spark_text = lambda t: t.replace("\n", "\\n")  # noqa: E731  Spark reads the escape in a literal
add("T11_json_reply", lambda s, d: strategies(s, d).selectExpr("strategy_id", spark_text(_replies("reply", 0)).replace("''", "\\'")).select("strategy_id", tx.json_reply("reply").alias("parsed")), with_views("strategies", "SELECT strategy_id, " + _replies("parsed", 1) + " FROM strategies"))
CODES = [("Here:\n```python\nimport x\nclass A:\n    n = #\nThat is all.\n```", "import x\nclass A:\n    n = #"), ("Sure, the code:\n\nimport y\nn = #\n\nThis uses y.", "import y\nn = #"), ("nothing here, #", "")]


def _codes(column: str, at: int) -> str:
    return "CASE strategy_id % 3" + "".join(f" WHEN {i} THEN replace({quote(x[at])}, '#', CAST(strategy_id AS STRING))" for i, x in enumerate(CODES)) + f" END AS {column}"


add("T12_code_of_reply", lambda s, d: strategies(s, d).selectExpr("strategy_id", spark_text(_codes("reply", 0))).select("strategy_id", tx.code_of_reply("reply").alias("code")).withColumn("ok", tx.code_ok("code")), with_views("strategies", "SELECT *, code <> '' AS ok FROM (SELECT strategy_id, " + _codes("code", 1) + " FROM strategies)"))
GOOD = "class VariantNN(bt.Strategy):\n    def next(self):\n        if len(self) < 5:\n            return\n        self.buy()"
FLAWED = "class V(bt.Strategy):\n    def __init__(self):\n        self.o = bt.ind.OnBalanceVolume(self.data)\n    def next(self):\n        self.sell(price=self.position.price)"
BROKEN = "class VariantNN(bt.Strategy)\n    pass"
OTHER = "class Helper:\n    pass"
PART = lambda n, code: f"### VARIANT_{n} ###\n```python\n{code}\n```\n"
#: Replies of a model, and (number, ok, warnings) of the variants in them.
VARIED = [
    (PART("01", GOOD) + "And:\n" + PART("2", FLAWED), [(1, True, []), (2, True, ["obv", "price", "bars"])]), ("No variants today, NN.", []),
    (PART("07", BROKEN) + PART("08", OTHER), [(7, False, [])]), (PART("10", GOOD).lower().replace("variant_10", "Variant_10").replace("bt.strategy", "bt.Strategy"), [(10, True, [])]),
]


def _varied(s, d):
    reply = F.get(F.array(*[F.lit(t) for t, _ in VARIED]), (F.col("strategy_id") % len(VARIED)).cast("int"))
    x = strategies(s, d).select("strategy_id", F.replace(reply, F.lit("NN"), F.lpad((F.col("strategy_id") % 100).cast("string"), 2, "0")).alias("reply"))
    v = x.select("strategy_id", F.explode(tx.variants_of_reply("reply")).alias("v"))
    return v.select("strategy_id", F.col("v.number").alias("number"), F.col("v.ok").alias("ok"), F.concat_ws(",", "v.warnings").alias("warnings"))


ROWS = ", ".join(f"({i}, {n}, {str(ok).lower()}, '{','.join(w)}')" for i, (_, vs) in enumerate(VARIED) for n, ok, w in vs)
add("T13_variants", _varied, with_views("strategies", f"SELECT strategy_id, number, ok, warnings FROM strategies JOIN (VALUES {ROWS}) v(kind, number, ok, warnings) ON strategy_id % {len(VARIED)} = kind"))


BUCKETS = 5000


def _tf(s, d):
    """Hashed term frequencies, each text of length 1: buckets by MD5, counts combined in the map tasks."""
    words = table(s, d, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), "[ \\t\\n\\r\\f]+"), lambda w: w != "")).alias("w"))
    tf = words.groupBy("doc_id", (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")))
    return tf.groupBy("doc_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("words"), (F.max("n") / norm).alias("most"), (F.sum("n") / norm).alias("total"), F.sum("bucket").alias("places"))


add("T10_hashed_tf", _tf, f"WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS w FROM documents), t AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {BUCKETS} AS bucket, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS words, round(max(n) / sqrt(sum(n * n)) + {SHIFT}, 6) + 0.0 AS most, round(sum(n) / sqrt(sum(n * n)) + {SHIFT}, 6) + 0.0 AS total, CAST(sum(bucket) AS BIGINT) AS places FROM t GROUP BY 1")


add("T9_semantic_near_duplicates", lambda s, d: semantic_duplicates(table(s, d, "embeddings")))
