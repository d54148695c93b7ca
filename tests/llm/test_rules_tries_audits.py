"""URL rules, prefix tries and filter audits: brute force on small tables, and the odd cases of each."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest


# -- 11: URL rules ---------------------------------------------------------------------------------


PAGES = "page_id long, url string, html string, host string, __id string, verdict string"
ALLOWED = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z") for i, u in rows], PAGES)


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [h + "/" + p for h, p in (r.split("/", 1) for r in ALLOWED) if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=len, default=None)


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.ORG", "http://a.org/", "http://org/x", "http://borg/", "http://ÄB.Com/fr/1", "x://Example.ORG/es/a?b=http://c.com/de/", "x://www.example.org/en/12#f",
            "x://example.org/en/2", "x://notexample.org/en/1", "x://a.com?/fr/", "x://a.com#/fr/", "x://a.com/fr", "x://a.com/de/é.html\n", "x://u:p@h.com:80/de/", "http://a.b.c.d.e.net/" + "p/" * 20_000 + "x.php?k=1&l=2", "a://b://c.com/fr/", "http://./", "http://a..b/"]


def test_url_parts_and_explicit_rules(spark):
    from tickloom.llm.url_rules import judge

    rules = spark.createDataFrame([], "tokens array<string>, n long, n_bad long")
    rows = list(enumerate(ODD_URLS)) + [(3, "x://same.com/de/")] * 3 + [(None, "x://a.org/")]
    got = collections.Counter(tuple(r) for r in judge(pages(spark, rows), rules).collect())
    want = collections.Counter((i, h, p, brute_rule(h, p), ALLOWED.get(brute_rule(h, p), "allow"), None) for i, u in rows for h, p in [brute_parts(u)])
    assert got == want
    assert judge(pages(spark, []), rules).count() == 0


def brute_mined(known, support, confidence, doubt):
    """(tokens, n, n_bad) of all sets of tokens, counted one by one."""
    n, bad = collections.Counter(), collections.Counter()
    for tokens, is_bad in known:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                n[s] += 1
                bad[s] += is_bad
    least = -(-len(known) * round(support * 1000) // 1000)
    good = {s: bad[s] / (n[s] + doubt) for s in n if bad[s] >= max(least, 1) and bad[s] >= confidence * (n[s] + doubt)}
    return {(s, n[s], bad[s]) for s in good if not any(t in good and good[t] >= good[s] for k in range(1, len(s)) for t in itertools.combinations(s, k))}


def test_mined_rules_and_their_matches(spark):
    from tickloom.llm.url_rules import judge, mine, tokens_of

    rng = random.Random(31)
    hosts = ["blog.cheap-pills.net", "www.news.net", "shop.win.io", "a.b.museum"]
    rows = [(i, f"{rng.choice(['http', 'HTTPS'])}://{(h := rng.choice(hosts))}/{rng.choice(['en', 'fr', 'x12'])}/{i}{rng.choice(['', '.html', '.php'])}{rng.choice(['', '?ref=1', '?utm=a&b=2'])}") for i in range(1500)]
    rows += [(7, rows[7][1])] * 3 + [(2000 + i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://shop.win.io/en/1")]
    bad = lambda u: "pills" in u or "win.io/x12" in u and ".php" in u
    labels = []
    for i, u in rows[:1500]:
        if rng.random() < 0.8:
            wrong = rng.random() < 0.05
            labels.append((i, int(bad(u) == wrong), 0) if rng.random() < 0.6 else (i, 1, int(bad(u) != wrong)))
    labels += [labels[0], (5, None, None), (5, None, 1), (6, 0, None), (None, 0, 1), (5000, 0, 0)] + [(2000 + i, 1, 0) for i in range(len(ODD_URLS))]
    frame = spark.createDataFrame([(*x, "u") for x in labels], "doc_id long, quality int, toxic int, url string")
    table = pages(spark, rows)
    marked = collections.defaultdict(list)
    for i, q, t in labels:
        if q is not None or t is not None:
            marked[i].append(q == 0 or t == 1)
    tokens = {r["url"]: r["t"] for r in table.select("url", tokens_of("url").alias("t")).collect()}
    assert all(len(t) == len(set(t)) <= 8 for t in tokens.values())
    assert set(tokens["x://u:p@h.com:80/de/"]) == {"scheme=x", "tld=com:80", "site=u:p@h.com:80", "host=u:p@h.com:80", "folder=de"} and tokens[None] == tokens["no scheme"] == []
    known = [(tokens[u], any(marked[i])) for i, u in rows if i in marked and i is not None]
    for support, confidence, doubt in ((0.01, 0.5, 10), (0.05, 0.7, 0), (0.4, 0.9, 3)):
        mined = mine(table, frame, support=support, confidence=confidence, doubt=doubt)
        found = {(tuple(r["tokens"]), r["n"], r["n_bad"]) for r in mined.collect()}
        assert found == brute_mined(known, support, confidence, doubt)
        best = lambda own: min(((-b / (n + doubt), " ".join(s)) for s, n, b in found if set(s) <= set(own)), default=(0, None))[1]  # noqa: B023, E731
        for r in judge(table, mined, doubt=doubt).collect():
            rule = brute_rule(r["host"], r["path"])
            assert r["rule"] == rule and r["verdict"] == (ALLOWED[rule] if rule else "block" if r["because"] else "allow")
        assert collections.Counter((r["page_id"], r["because"]) for r in judge(table, mined, doubt=doubt).collect()) == collections.Counter((i, best(tokens[u])) for i, u in rows)
        if support == 0.01:
            assert any("pills" in " ".join(s) for s, _, _ in found) and any("ext=php" in s and "folder=x0" in s for s, _, _ in found)
    assert mine(table, frame.filter("false")).count() == 0 and mine(table.filter("false"), frame).count() == 0


# -- 12: prefix trie -------------------------------------------------------------------------------


def brute_trie(messages, every=100, most=6):
    """The contract, one prefix at a time. Equal turns are in the order of the hash of their role and text."""
    own = collections.defaultdict(list)
    for c, turn, role, text in messages:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest(), r, t))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, tokens = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            tokens[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if rebuilt[c] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], tokens[p], ends(p)) for p, m in members.items())


def conversations(spark, messages):
    return spark.createDataFrame([(*m, "x", b"k", 1) for m in messages], "conv_id long, turn long, role string, text string, turns string, key binary, block long")


def some_conversations(rng, n, ids=range(-250, 420)):
    out = []
    for c in rng.sample(list(ids), n):
        first = rng.choice(["hello", "hi", ""])
        for t in range(rng.randrange(1, 7)):
            out.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if t else "system", first if not t else rng.choice(["yes", "no", "é漢", None, "\0"])))
    out += rng.sample(out, 10)  # repeated rows
    return out + [(None, 0, "user", "lost")] * 2


@pytest.mark.parametrize("partitions", ["1", "3", "9", "40"])
def test_prefix_trie(spark, partitions):
    from tickloom.llm.prefix_trie import branched, keyed_turns, prefix_trie
    from tickloom.llm.shared import setting

    rng = random.Random(int(partitions))
    messages = some_conversations(rng, 300)
    messages += [(1000 + i, t, "user", f"same {t}") for i in range(150) for t in range(8)]  # copies, some begun otherwise
    messages += [(2000 + i, t, "user", f"chain {t}") for i in range(60) for t in range(i)]  # every one a beginning of the next
    messages += [(5000, t, "user", "x" * 5000) for t in range(300)]
    rng.shuffle(messages)
    with setting(spark, "spark.sql.shuffle.partitions", partitions):
        got = prefix_trie(branched(keyed_turns(conversations(spark, messages))))
        assert sorted(map(tuple, got.collect()), key=lambda r: tuple(-1 if x is None else x for x in r)) == sorted(brute_trie(messages), key=lambda r: tuple(-1 if x is None else x for x in r))


def test_prefix_trie_of_few_conversations(spark):
    from tickloom.llm.prefix_trie import branched, keyed_turns, prefix_trie

    trie = lambda m: sorted(map(tuple, prefix_trie(branched(keyed_turns(conversations(spark, m)))).collect()))
    assert trie([]) == [] == trie([(None, 1, "user", "x")])
    bare = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)  # loses its two turns, and has no beginning
    assert trie([(bare, 1, "a", "b"), (bare, 2, "a", "c")]) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]
    assert trie([(0, 1, None, None)]) == brute_trie([(0, 1, None, None)])


def test_range_minima():
    import numpy as np

    from tickloom.llm.prefix_trie import RangeMin

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        v = rng.integers(0, 5, n)
        table = RangeMin(v)
        at, d = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        left, right = table.left(at, d), table.right(at, d)
        for i, x, lo, hi in zip(at, d, left, right, strict=True):
            assert lo == next(k for k in range(n) if all(v[k + 1 : i + 1] >= x)) and hi == max(k for k in range(i, n) if all(v[i + 1 : k + 1] >= x))
        a, b = (np.array(x) for x in zip(*itertools.combinations_with_replacement(range(n), 2), strict=True))
        assert (table.least(a, b) == [v[i : j + 1].min() for i, j in zip(a, b, strict=True)]).all()


# -- 13: filter audit ------------------------------------------------------------------------------


def brute_audit(rows, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = collections.defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = word.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first.get(t, i)}
        docs[s or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, d in docs.items():
        share = collections.Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = d
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[f] += len(gone)
                lines.append(("".join(order), k + 1, len(left), len(gone), sum(f in x[0] for x in d) - len(gone), sum(x[0] == {f} for x in d), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(part, *x, share[x[0][x[1] - 1]]) for x in lines]
    return sorted(out)


def test_filter_audit(spark):
    from test_operators import odd_rows, table

    from tickloom.llm.filter_audit import audit

    rng = random.Random(41)
    rows = odd_rows() + [(500 + i, "same text, " * 60, rng.choice("ab")) for i in range(40)] + [(500, "same text, " * 60, "q")]
    rows += [(700 + i, " ".join(rng.choice(["Word", "word", "#", "a|b", "ÀÉ", "x y"]) + str(rng.randrange(90)) for _ in range(rng.randrange(30, 90))), rng.choice(["a", "", None])) for i in range(60)]
    rows += [(None, "same text, " * 60, "a"), (900, None, "e"), (901, "", "e"), (902, " \x0b\x1c\u00a0 ", "e"), (903, "A" * 2_000_000, "e")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(1000) if i % 3] + [(1, 0, 0), (1, 1, 1), (None, 1, 1), (4000, 1, 1)]
    frame = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    docs = table(spark, rows)
    assert sorted(map(tuple, audit(docs, frame).collect())) == brute_audit(rows, labels)
    assert sorted(map(tuple, audit(docs, frame.filter("false")).collect())) == brute_audit(rows, [])
    assert audit(docs.filter("false"), frame).count() == 0


def test_shapley_coefficients_are_means_over_orders():
    from math import factorial

    from tickloom.llm.filter_audit import shapley_coefficients

    rng = random.Random(42)
    for n in range(1, 7):
        v = [rng.randrange(1000) for _ in range(1 << n)]
        want = [0] * n
        for order in itertools.permutations(range(n)):
            s = 0
            for i in order:
                want[i] += v[s | 1 << i] - v[s]
                s |= 1 << i
        got = [sum(c * x for c, x in zip(r, v, strict=True)) for r in shapley_coefficients(n)]
        assert got == want and sum(got) == factorial(n) * (v[-1] - v[0])


@pytest.mark.parametrize("name", ["op11_url_rules", "op12_prefix_trie", "op13_filter_audit"])
def test_sql(name, spark, duck, data, rows_of):
    from tickloom.llm.queries import oracle_sql, queries

    wanted = duck.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, data).toPandas()
    for frame in (got, wanted):
        if "parent_conv_id" in frame:
            frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
    assert sorted(got.columns) == sorted(wanted.columns) and rows_of(got) == rows_of(wanted)


# -- 10: long texts ----------------------------------------------------------------------------------


def test_chat_texts_of_millions(spark):
    import time

    from tickloom.llm.chat import as_events, fold_and_render

    text = "line\n😀\r x" * 300_000  # 2,700,000 characters with all that a dot may not match
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text[:1_000_001]), (2, 0, None, ""), (None, 0, "user", "a" * 200), (None, None, "user", "b" * 201)], "conv_id long, turn long, role string, text string")
    began = time.time()
    back = collections.Counter((r["conv_id"], r["role"], r["text"]) for r in fold_and_render(as_events(df)).collect())
    assert back == collections.Counter({(1, "user", text): 1, (1, "assistant", text[:1_000_001]): 1, (2, "", ""): 1, (None, "user", "a" * 200): 1, (None, "user", "b" * 201): 1})
    assert time.time() - began < 60 and as_events(df.filter("false")).count() == 0
