"""Operators of training data: brute force on small tables, and the odd cases of every one."""

import collections
import hashlib
import math
import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, id string, k string, h long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "c", "d", "e", 1) for i, t, s in rows], DOCS)


def odd_rows():
    rng = random.Random(4)
    base = words(rng, 80)
    long = words(rng, 30_000, 5000)
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " end", "b"), (4, None, None), (5, "", "b"), (6, " \n\t ", "b"), (7, "ab", "c"), (8, "aaaa" * 100, "a"), (9, long, "a"), (10, "x. " + long, "a"), (11, "é ü 漢字 " * 30, None), (11, "é ü 漢字 " * 30, None)]
    rows += [(12 + i, "\n".join(words(rng, 12) for _ in range(5)) + "\n" + base, "a") for i in range(20)]
    rows += [(None, base, "a")]
    return rows


def empty(spark):
    return table(spark, [])


# -- 1: suffix dedup -------------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    encoded = [(i, (t or "").encode()) for i, t, _ in rows]
    key = lambda i: math.inf if i is None else i
    for i, b in encoded:
        for s in range(len(b) - 49):
            g = b[s : s + 50]
            first[g] = min(first.get(g, math.inf), key(i))
    out = collections.Counter()
    for i, b in encoded:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key(i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out[(i, len(b), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [1 << 23, 4000])
def test_suffix_dedup(spark, block):
    from tickloom.llm.suffix_dedup import remove_repeats

    rows = [(i, (t[:3000] if t else t), s) for i, t, s in odd_rows()]
    if block > 4000:  # whole long texts, of 200,000 bytes
        rows = odd_rows()
    got = collections.Counter((r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in remove_repeats(table(spark, rows), block_bytes=block).collect())
    assert got == brute_repeats(rows)
    assert remove_repeats(empty(spark)).count() == 0


def test_deep_shallow_sort():
    import numpy as np

    from tickloom.llm.suffix_dedup import deep_shallow

    rng = np.random.default_rng(1)
    for n in (60, 200, 900):
        b = rng.integers(97, 99, n).astype(np.uint8)
        b = np.concatenate([b, b[:50], b[-55:], np.zeros(60, np.uint8)])
        starts = np.arange(len(b) - 58)
        order, new = deep_shallow(b, starts)
        text = b.tobytes()
        keys = [text[i : i + 50] for i in order]
        assert keys == sorted(text[i : i + 50] for i in starts)
        assert [bool(x) for x in new] == [not i or keys[i] != keys[i - 1] for i in range(len(keys))]


# -- 2: top-k --------------------------------------------------------------------------------------


def test_topk(spark):
    from pyspark.sql import functions as F

    from tickloom.llm.topk_index import build_index, quantised, search_index

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)] + [(i, [0.1] * 16) for i in range(300, 320)]
    rows += [(400, None), (401, [None] + [0.1] * 15), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, []), (450, [0.5, -0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    v = quantised(df, "vec_id", "embedding")
    index, shards = build_index(v, 64)
    got = collections.defaultdict(list)
    for r in search_index(index, shards, v.filter(F.col("id") % 50 == 0)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    good = {i: [math.floor(256 * f32(x)) for x in w] for i, w in rows if w is not None and all(x is not None and math.isfinite(x) for x in w)}
    for q in [i for i in good if i % 50 == 0]:
        want = sorted(((sum(a * b for a, b in zip(good[q], w)), i) for i, w in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == [(i, s) for s, i in want]
    none = quantised(df.filter("false"), "vec_id", "embedding")
    index, shards = build_index(none)
    assert search_index(index, shards, none).count() == 0


def test_topk_of_queries_that_share_an_id(spark):
    from tickloom.llm.topk_index import build_index, search_index

    rng = random.Random(21)
    rows = [(i, [rng.randrange(-90, 90) for _ in range(8)]) for i in range(40)] + [(0, [9] * 8), (0, [9] * 8)]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    index, shards = build_index(v, 16)
    out = search_index(index, shards, v.filter("id % 20 = 0")).collect()
    want = collections.Counter()
    for q in {(i, tuple(x)) for i, x in rows if i % 20 == 0}:
        scores = sorted(((sum(a * b for a, b in zip(q[1], w)), i) for i, w in rows if i != q[0]), key=lambda x: (-x[0], x[1]))[:5]
        want.update((q[0], n + 1, i, s) for n, (s, i) in enumerate(scores))
    assert collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == want


# -- 3: decontamination ----------------------------------------------------------------------------


def shingles_of(text):
    import regex

    w = [x for x in regex.sub(r"[^\p{L}\p{N}\p{M}]+", " ", (text or "").lower()).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decontamination(spark, monkeypatch):
    from tickloom.llm import decontamination as dec

    rng = random.Random(5)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate((3, 5, 8, 20, 40, 90))] + [(50, None), (51, ""), (52, "..."), (None, "a b c d e")]
    rows = odd_rows()
    rows += [(100 + i, f"{words(rng, 200)} {t} {words(rng, 50)}", "a") for i, t in items if t and i is not None]
    w = items[4][1].split()
    rows += [(200, " ".join(w[:36]), "a"), (201, " ".join(w[:20]), "a"), (202, items[0][1], "a"), (203, items[3][1].upper().replace(" ", " -- "), "a")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h long")
    want = {(i, j) for i, t, _ in rows for j, u in items if i is not None and j is not None and shingles_of(u) and len(shingles_of(t) & shingles_of(u)) >= math.ceil(0.8 * len(shingles_of(u)) - 1e-9)}
    docs = table(spark, rows)
    assert {(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs, bench).collect()} == want
    assert {r["doc_id"] for r in dec.clean(docs, bench).collect()} == {i for i, _, _ in rows} - {i for i, _ in want}
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)  # the way by shuffle gives the same
    assert {(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs, bench).collect()} == want
    assert dec.contaminated(empty(spark), bench).count() == 0 and dec.contaminated(docs, bench.filter("false")).count() == 0


# -- 4: n-gram join --------------------------------------------------------------------------------


def runs_of_five(text):
    """Distinct runs of five words, of all words if there are fewer; any character beyond ASCII is part of a word."""
    w = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower()).split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join(spark, monkeypatch):
    from tickloom.llm import ngram_join as join

    rng = random.Random(6)
    rows = odd_rows()
    for g in range(12):
        w = words(rng, 150, 3000).split()
        for k in range(8):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = f"edit{rng.randrange(1000)}"
            rows.append((1000 + 10 * g + k, " ".join(v), "a"))
    sets = {i: runs_of_five(t) for i, t, _ in rows if i is not None}
    copies = collections.Counter(runs_of_five(t) for i, t, _ in rows if i is not None)
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    reps = sorted(i for s, i in rep.items() if s)
    near = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    up = {i: i for i in reps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    links = collections.Counter(x for p in near for x in p)
    want = {i: (find(rep[s]), rep[s], copies[s], links[rep[s]]) if s else (i, i, 1, 0) for i, s in sets.items()}
    docs = table(spark, rows)
    for tile in (1024, 3):
        monkeypatch.setattr(join, "TILE", tile)
        got = {r["doc_id"]: tuple(r)[1:] for r in join.similar_documents(docs).collect() if r["doc_id"] is not None}
        assert got == want
    kept = sorted((r["doc_id"] for r in join.one_of_each(docs).collect()), key=lambda x: (x is None, x))
    assert kept == sorted(i for i in want if want[i][0] == i) + [None]
    assert join.similar_documents(empty(spark)).count() == 0 and join.one_of_each(empty(spark)).count() == 0


def edited(rng, w, share):
    """A copy of the words with edits in a row, so that the Jaccard similarity of 5-grams comes near `share`."""
    n = len(w) - 4
    lost = round((1 - share) / (1 + share) * n)
    at = rng.randrange(len(w) - max(lost - 4, 1))
    return w[:at] + [f"e{rng.randrange(10**6)}" for _ in range(max(lost - 4, 1))] + w[at + max(lost - 4, 1) :]


def test_ngram_join_finds_isolated_pairs(spark):
    from tickloom.llm import ngram_join as join

    rng, rows = random.Random(16), []
    for i in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(2 * i, " ".join(w), "a"), (2 * i + 1, " ".join(edited(rng, w, 0.815)), "a")]
    near = {2 * i for i in range(300) if len(runs_of_five(rows[2 * i][1]) & runs_of_five(rows[2 * i + 1][1])) >= 0.8 * len(runs_of_five(rows[2 * i][1]) | runs_of_five(rows[2 * i + 1][1]))}
    linked = {r["doc_id"] for r in join.similar_documents(table(spark, rows)).collect() if r["n_links"] and r["doc_id"] % 2 == 0}
    assert len(near) > 250 and linked <= near and len(linked) >= 0.99 * len(near)


def test_chains_of_bands_are_compared_band_by_band(spark, monkeypatch):
    """Neighbours at 0.83 and texts at 0.6: one long component of bands, whose classes and links are those of brute force."""
    from tickloom.llm import ngram_join as join

    rng, rows = random.Random(17), []
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        rows.append((i, " ".join(w), "a"))
        w = edited(rng, w, 0.83 if i % 4 else 0.6)
    rows += [(5, rows[5][1], "a"), (5, rows[5][1], "b"), (None, "a b c d e f", "a")] + [(None, rows[5][1], "a")] * 2
    sets = {i: runs_of_five(t) for i, t, _ in rows if i is not None}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    up = {i: i for i in sets}
    for _ in range(60):
        for a, b in near:
            up[a] = up[b] = min(up[a], up[b])
    links = collections.Counter(x for p in near for x in p)
    for tile in (1024, 4):
        monkeypatch.setattr(join, "TILE", tile)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in join.similar_documents(table(spark, rows)).collect() if r["doc_id"] is not None}
        assert got == {i: (up[i], links[i]) for i in sets}
    kept = [r["doc_id"] for r in join.one_of_each(table(spark, rows)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i in sets if up[i] == i) and kept.count(None) == 3


def test_pruning_keeps_what_may_reach_the_threshold():
    from tickloom.llm.ngram_join import fewest_matches

    limits = dict(fewest_matches(0.8, 1e-6))
    assert all(0 < m < 0.8 * n for n, m in limits.items()) and limits[160] > limits[32]


# -- 5: line dedup ---------------------------------------------------------------------------------


def brute_lines(rows):
    occurrences = collections.defaultdict(list)
    for i, t, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip() and i is not None:
                occurrences[line].append((i, p))
    lines = sorted(occurrences)
    units = lambda s: [s.encode("utf-16-be")[i : i + 2] for i in range(0, len(s.encode("utf-16-be")), 2)]
    sets = [{tuple(u[i : i + 8]) for i in range(max(1, len(u) - 7))} for u in map(units, lines)]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = collections.defaultdict(set)
    for i, line in enumerate(lines):
        groups[find(i)] |= set(occurrences[line])
    return {o for g in groups.values() for o in sorted(g)[1:]}


def test_line_dedup(spark):
    from tickloom.llm.line_dedup import repeated_lines, without_copies

    rng = random.Random(8)
    rows = [(i, (t[:4000] if t else t), s) for i, t, s in odd_rows()]
    base = words(rng, 30)
    rows += [(300 + i, base[:60] + f" {i} " + base[60:] + "\nunique " + words(rng, 9), "a") for i in range(12)] + [(400, "a\n\nb\n a\na", "b"), (401, "b", "b")]
    docs = table(spark, rows)
    want = brute_lines(rows)
    assert {(r["doc"], r["at"]) for r in repeated_lines(docs).collect()} == want
    got = {r["doc_id"]: r["text"] for r in without_copies(docs).collect()}
    for i, t, _ in rows:
        if i is None or not t or not t.strip():
            assert got[i] == t
            continue
        rest = "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in want)
        assert got.get(i) == (rest if rest.strip() else None)
    assert repeated_lines(empty(spark)).count() == 0 and without_copies(empty(spark)).count() == 0


def test_isolated_pairs_of_lines(spark):
    """Recall at similarities just above the threshold; what is found reaches it."""
    from tickloom.llm.line_dedup import repeated_lines

    rng, rows, near = random.Random(18), [], set()
    grams = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    for i in range(400):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([90, 150, 400])))
        n = len(t) - 7
        cut = max(1, round((1 - 0.82) / (1 + 0.82) * n) - 7)
        at = rng.randrange(len(t) - cut)
        u = t[:at] + "".join(rng.choice("ABCDEFGHIJK") for _ in range(cut)) + t[at + cut :]
        rows += [(2 * i, t, "a"), (2 * i + 1, u, "a")]
        if len(grams(t) & grams(u)) >= 0.8 * len(grams(t) | grams(u)):
            near.add(2 * i + 1)
    got = {r["doc"] for r in repeated_lines(table(spark, rows)).collect()}
    assert len(near) > 300 and got <= near and len(got) >= 0.97 * len(near)


def test_large_bands_keep_most_links(spark):
    """A group of several hundred near copies without a common centre is still one component, but for a few lines."""
    from tickloom.llm.line_dedup import repeated_lines

    rng = random.Random(9)
    base = words(rng, 60).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    removed = repeated_lines(table(spark, rows)).count()
    assert removed >= 0.97 * len(brute_lines(rows))


def test_very_long_lines(spark):
    """Lines of 200,000 characters: near copies go, others stay."""
    from tickloom.llm.line_dedup import repeated_lines

    rng = random.Random(19)
    long, other = words(rng, 30_000, 5000), words(rng, 30_000, 5000)
    rows = [(1, long, "a"), (2, "short\n" + long + " end", "a"), (3, other, "a"), (4, long[:150_000], "a")]
    assert {(r["doc"], r["at"]) for r in repeated_lines(table(spark, rows)).collect()} == brute_lines(rows)


def test_repetitive_lines_of_all_lengths(spark):
    """Rules and repeated phrases have few shingles at many places: lengths across 100 and 128 shingles are one group each."""
    from tickloom.llm.line_dedup import repeated_lines

    long = words(random.Random(10), 30)
    lines = [c * n for c in "=-*#.~" for n in (80, 104, 107, 120, 134, 135, 140, 600)]
    lines += [(phrase * 400)[:n] for phrase in ("to be or not ", "la ", "all work and no play makes a dull day; ") for n in (90, 106, 108, 130, 136, 150, 900)]
    lines += [long, long + " end"]
    rows = [(i, line, "a") for i, line in enumerate(lines)]
    assert {(r["doc"], r["at"]) for r in repeated_lines(table(spark, rows)).collect()} == brute_lines(rows)


# -- 6: language ID --------------------------------------------------------------------------------


def test_language_id(spark, data):
    from tickloom.llm import language_id as lid

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = lid.train(docs)
    out = lid.op6_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in model.names for r in out)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    odd = {r["doc_id"]: r for r in lid.identify(table(spark, odd_rows()), model).collect()}
    for i in (4, 5, 6):
        assert (odd[i]["lang_pred"], odd[i]["score"], odd[i]["rejected"], odd[i]["cross_entropy"]) == ("und", 0.0, True, None)
    digits = lid.identify(table(spark, [(1, "12 34 !?", "a")]), model).first()
    assert digits["lang_pred"] == "und"
    kept = lid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    nothing = lid.train(docs.filter("false"))
    assert {r["lang_pred"] for r in lid.identify(docs.limit(3), nothing).collect()} == {"und"}
    assert lid.identify(empty(spark), model).count() == 0
    # a text of another alphabet, however long, is beyond every model's limit
    assert lid.identify(table(spark, [(1, "漢字仮名交文" * 50, "a")]), model).first()["rejected"]


def test_rare_languages_keep_their_models(spark):
    """A language trains on all its few documents, though all of them have the hash that holds back."""
    from pyspark.sql import functions as F

    from tickloom.llm import language_id as lid

    ids = spark.range(2000).withColumnRenamed("id", "doc_id").filter(lid.may_train())
    held = F.pmod(F.xxhash64(F.lit(7), F.xxhash64(F.col("doc_id").cast("string"))), F.lit(lid.HELD_BACK)) == 0
    rare = [r[0] for r in ids.filter(held).orderBy("doc_id").limit(2).collect()]
    others = [r[0] for r in ids.orderBy("doc_id").limit(150).collect() if r[0] not in rare]
    rng = random.Random(11)
    rows = [(i, words(rng, 40), "en") for i in others] + [(i, "сто слов о погоде и море " * 8, "ru") for i in rare]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs)
    assert model.names == ["en", "ru"]
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in lid.identify(docs, model).collect()}
    assert all(got[i] == ("ru", False) for i in rare)


def test_languages_without_a_model(spark):
    """Twenty languages of one document each, and texts without letters: no crash, und or a known language."""
    from tickloom.llm import language_id as lid

    rng = random.Random(12)
    letters = lambda: "".join(rng.choice("abcdefghijklm ") for _ in range(200))
    rows = [(i, letters(), "en") for i in range(120)] + [(200 + i, f"{chr(0x430 + i) * 3} слово {i} " * 5, f"r{i}") for i in range(20)]
    rows += [(300 + i, "12 34 ...", "digits") for i in range(40)] + [(400, None, "r1"), (401, "", "r2"), (402, "abc", None), (None, "abc", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs)
    assert "digits" not in model.names and "en" in model.names
    got = lid.identify(docs, model).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {*model.names, "und"}
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in got if r["doc_id"] and (r["doc_id"] in (400, 401) or 300 <= r["doc_id"] < 340))
    few = lid.train(docs, most_docs=5, most_chars=200)
    assert "en" in few.names and sum(len(h) for h, _ in few.models[few.names.index("en")].grams) < sum(len(h) for h, _ in model.models[model.names.index("en")].grams)


def kneser_ney(texts):
    """Interpolated Kneser-Ney of order 4 by plain counting: a function of (history, symbol)."""
    show = lambda t: " " * 3 + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    top = collections.Counter(t[i : i + 4] for t in map(show, texts) for i in range(len(t) - 3))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def probability(history, symbol, n=4):
        if not n:
            return 1 / 65536
        c, h = counts[n], history[len(history) - n + 1 :]
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        after = [x for g, x in c.items() if g[:-1] == h]
        lower = probability(history, symbol, n - 1)
        return (max(c[h + symbol] - d, 0) + d * len(after) * lower) / sum(after) if after else lower

    def entropy(text):
        t = show(text)
        return -sum(math.log(probability(t[i - 3 : i], t[i])) for i in range(3, len(t))) / (len(t) - 3)

    return entropy


def test_models_against_plain_counting(spark):
    """Cross-entropies and predictions of the operator equal those of Kneser-Ney by dictionaries."""
    from tickloom.llm import language_id as lid

    texts = {"en": ["the cat sat on the mat", "a dog, and the other dog", "it was there then"], "de": ["der hund und die katze", "das ist ein Haus - dort", "über den Fluß"], "ru": ["кот сидит на окне", "собака и дом", "это был он"]}
    n, rows = 0, []
    for lang, own in texts.items():
        for t in own:
            while __import__("zlib").crc32(str(n).encode()) % 4 == 2:
                n += 1
            rows.append((n, t, lang))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs)
    brute = {k: kneser_ney(v) for k, v in texts.items()}
    probe = ["the dog there", "die katze dort", "кот и собака", "zzz", "the кот", "über 12 the!"] + [t for own in texts.values() for t in own]
    got = {r["doc_id"]: r for r in lid.identify(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(probe):
        e = {k: f(t) for k, f in brute.items()}
        assert abs(got[i]["cross_entropy"] - min(e.values())) < 1e-4 and abs(e[got[i]["lang_pred"]] - min(e.values())) < 1e-4


def test_model_is_a_distribution():
    import numpy as np

    from tickloom.llm.language_id import SPACE, fit, grams, symbols

    model = fit(grams(symbols("abracadabra and a cadabra abra")))
    letters = [SPACE, *map(ord, "abcdnr")]
    history = (ord("a") << 48) | (ord("b") << 32) | (ord("r") << 16)
    p = np.exp(model.log_probs(np.array([history | c for c in letters], np.uint64)))
    rest = np.exp(model.log_probs(np.array([history | 0x4E00], np.uint64)))[0] * (65536 - len(letters))
    assert abs(p.sum() + rest - 1) < 1e-6 and p.argmax() == letters.index(ord("a"))


# -- 7: WARC ---------------------------------------------------------------------------------------


def test_warc(spark):
    from tickloom.llm import warc

    big, small = "<html>" + "é" * 200, "tiny"
    rows = [(5, "http://www.a.com/x?q=1#f", big), (3, "https://b.org:8080", big), (9, "http://a.com/x", big), (4, None, small), (6, "bad url\twith tab", small), (7, "http://c.net/", None), (8, "http://d.net/" + "p" * 3000, "z" * 500_000), (10, "http://[broken", ""), (None, "http://e.com", big)]
    pages = spark.createDataFrame([(p, u, h, "k") for p, u, h in rows], "page_id long, url string, html string, key string")
    captures = warc.write_archives(pages)
    index = warc.build_index(captures, block_lines=2)
    got = {r["page_id"]: r for r in warc.lookup(index, captures).collect()}
    for p, u, h in rows[:-1]:
        payload = (h or "").encode()
        assert (got[p]["payload_bytes"], got[p]["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (got[p]["record_type"], got[p]["refers_to"]) == (("revisit", 3) if h == big and p != 3 else ("response", None))
        assert got[p]["target_uri"] == warc.escaped(u)
    assert set(got) == {p for p, _, _ in rows[:-1]}
    missing = spark.createDataFrame([("zzz)/", 1), ("", 1), (warc.url_key(rows[0][1]), 77)], "key string, page_id long")
    assert warc.lookup(index, missing).count() == 0
    none = warc.write_archives(pages.filter("false"))
    assert warc.lookup(warc.build_index(none), none).count() == 0
    assert warc.url_key("http://WWW.Example.com/A?b#c") == "com,example)/A?b" and warc.url_key(None).endswith(")/")


def test_warc_odd_urls_and_repeated_ids(spark, monkeypatch):
    """White space and line ends of any alphabet in URLs; rows that repeat an id with other payloads and URLs; many of them, over several blocks."""
    from tickloom.llm import warc

    p, q = "<p>" + "a" * 200, "<q>" + "b" * 300
    rows = [(1, "http://a.com/x\ty  z", p), (2, "http://b.com/line\u2028and\u0085next", p), (3, "http://c.com/\r\n", q), (4, "http://d.com/é ü", q), (2, "http://b.com/line\u2028and\u0085next", q), (5, " http://e.com/ ", q), (6, "http://f.com/\u3000\x00", None)]
    rows += [(7, "http://same.com/", f"<r>{i % 5}" + "c" * 150) for i in range(15)] + [(8, "http://same.com/", "<r>0" + "c" * 150)] + [(9, f"http://g.com/{i}", "<s>" + "d" * 200) for i in range(3)]
    first = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, i), i)
    want = collections.Counter()
    for i, u, h in rows:
        revisit = len((h or "").encode()) >= 100 and first[h] < i
        want[(i, warc.escaped(u), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None)] += 1
    pages = spark.createDataFrame([(i, u, h, "k") for i, u, h in rows], "page_id long, url string, html string, digest string")
    for hot in (10_000, 2):
        monkeypatch.setattr(warc, "HOT_ROWS", hot)
        captures = warc.write_archives(pages)
        index = warc.build_index(captures, block_lines=2)
        found = warc.lookup(index, captures).collect()
        assert collections.Counter((r["page_id"], r["target_uri"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want


# -- 8: mixing -------------------------------------------------------------------------------------


def test_mixing(spark):
    from tickloom.llm.mixing import mix, targets

    rng = random.Random(10)
    rows = odd_rows() + [(500 + i, words(rng, rng.randrange(1, 60)), f"s{i % 5}") for i in range(400)]
    docs = table(spark, rows)
    out = mix(docs).collect()
    assert len(out) == len(rows)
    size = collections.Counter()
    import re

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        size[s] += count(t)
    plan = {s: t for s, _, t in targets(list(size.items()))}
    assert math.isclose(sum(plan.values()), 1.5 * sum(size.values())) and all(t <= 2 * size[s] + 1e-9 for s, t in plan.items())
    assert collections.Counter((r["doc_id"], r["size"]) for r in out) == collections.Counter((i, count(t)) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in out:
        taken[source[r["doc_id"]]] += r["taken"]
    for s in plan:
        largest = max(count(t) for _, t, x in rows if x == s)
        assert plan[s] - largest <= taken[s] <= plan[s] + 1e-6
    assert sorted(map(str, mix(docs.repartition(7)).collect())) == sorted(map(str, out))
    assert mix(empty(spark)).count() == 0 and targets([]) == [] and targets([("a", 0)])[0][2] == 0


def test_mixing_takes_repeated_rows_one_by_one(spark, monkeypatch):
    from tickloom.llm import mixing

    monkeypatch.setattr(mixing, "PORTION", 300)
    same = [(1, "five words are in here", "a")] * 1000
    for rows, share in ((same, 0.5), (same, 1.5), (same + [(2, "x y", "a")] * 10 + [(3, "z " * 40, "b")], 0.7), ([(None, "a b c", None)] * 50, 1.1)):
        sizes = collections.Counter()
        for _, t, s in rows:
            sizes[s] += len(t.split())
        out = mixing.mix(table(spark, rows), share=share).collect()
        assert collections.Counter((r["doc_id"], r["size"]) for r in out) == collections.Counter((i, len(t.split())) for i, t, _ in rows)
        for s, n, target in mixing.targets(list(sizes.items()), share=share):
            taken = sum(r["taken"] for r in out if r["source_size"] == n)
            assert target - 40 < taken <= target + 1e-6 and all(r["taken"] <= 2 * r["size"] for r in out), (s, taken, target)


def test_larger_budgets_take_supersets(spark):
    from tickloom.llm.mixing import mix

    rng = random.Random(11)
    docs = table(spark, [(i, words(rng, 20), "a") for i in range(200)])
    a, b = ({r["doc_id"] for r in mix(docs, share=s).collect() if r["taken"]} for s in (0.3, 0.6))
    assert a < b


# -- 9: token scan ---------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_token_scan(spark, tmp_path, block):
    import numpy as np

    from tickloom.llm.token_scan import count_tokens

    docs = [3, 0, 0, 500, 1, 7]
    for name, tail in (("a", 0), ("b", 4)):
        ids = np.concatenate([x for n in docs for x in (np.full(n, 7, "<u2"), np.array([9], "<u2"))] + [np.full(tail, 5, "<u2")])
        (tmp_path / f"{name}.tok").write_bytes(ids.astype("<u2").tobytes() + (b"\1" if tail else b""))
    (tmp_path / "empty.tok").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / f"{n}.tok"),) for n in ("a", "b", "empty", "a")] + [(None,)], "file string")
    got = sorted((r["file"][-5], r["ordinal"], r["n_tokens"], r["closed"]) for r in count_tokens(files, eod=9, block_bytes=block).collect())
    assert got == sorted([(f, i, n, True) for f in "ab" for i, n in enumerate(docs)] + [("b", 6, 4, False)])


def test_token_counts_of_documents(spark):
    from tickloom.llm.token_scan import _encoder, EOD, PATTERN, TOKENIZER, count_tokens, write_token_files

    rows = odd_rows()
    where = write_token_files(table(spark, rows))
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in where.join(count_tokens(where.select("file"), EOD), ["file", "ordinal"]).collect())
    assert got == collections.Counter((i, len(_encoder(TOKENIZER, PATTERN).encode_ordinary(t or ""))) for i, t, _ in rows)
    assert write_token_files(empty(spark)).count() == 0


# -- 10: chat --------------------------------------------------------------------------------------


def test_chat_round_trip():
    from tickloom.llm.chat import parse_turns, render_turn, unescape

    rng = random.Random(12)
    pieces = ["\\", "###", "### Assistant: ", " </turn>\n", "</turn>", "\n", "a", "é", ":", " ", "\\###", "####"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "a:b", "", "User", "role=x"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for _ in range(4)]
        shown = [render_turn(*t) for t in turns]
        assert parse_turns("".join(s for s, _, _ in shown)) == turns
        assert all(unescape(s[a:b]) == (t if r == "assistant" else "") for (s, a, b), (r, t) in zip(shown, turns, strict=True))


def test_event_folding(spark):
    from tickloom.llm.chat import EVENTS, as_events, fold_and_render

    e = [(1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "teh"), (1, 3, 1, "edit", None, "the"), (1, 4, 2, "start", "assistant", None), (1, 5, 2, "delta", None, "no"), (1, 6, 3, "start", "user", None), (1, 7, 2, "regenerate", None, None), (1, 8, 2, "delta", None, "y"), (1, 9, 2, "delta", None, "es"), (1, 10, 2, "other", None, "!"), (2, 1, 5, "delta", "user", "late"), (None, 1, 1, "delta", "user", "none")]
    got = sorted((r["conv_id"] or 0, r["turn"], r["role"], r["text"]) for r in fold_and_render(spark.createDataFrame(e, EVENTS)).collect())
    assert got == [(0, 1, "user", "none"), (1, 1, "user", "the"), (1, 2, "assistant", "yes"), (2, 5, "user", "late")]
    rng = random.Random(13)
    m = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "x" * 1000, "a\nb", "é" * 401])) for c in range(30) for t in range(rng.randrange(1, 6))] + [(99, 1, "user", "same")] * 3
    df = spark.createDataFrame([(*x, "z") for x in m], "conv_id long, turn long, role string, text string, seq string")
    back = collections.Counter((r["conv_id"], r["role"], r["text"]) for r in fold_and_render(as_events(df)).collect())
    assert back == collections.Counter((c, r or "", t or "") for c, _, r, t in m)
    assert fold_and_render(as_events(df.filter("false"))).count() == 0


# -- queries and pipeline --------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_topk_search", "op3_decontaminate", "op7_warc_captures", "op8_mix_sources", "op10_chat_format"])
def test_sql(name, spark, duck, data, rows_of):
    from tickloom.llm.queries import oracle_sql, queries

    assert rows_of(queries()[name](spark, data).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())


def test_components(spark):
    from tickloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7), (None, 1), (200, 200)]
    got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, data)
        if i < len(p.STAGES) - 1:
            assert out.columns == columns
            docs = p.saved(out, "test-stage")
            now = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert now <= ids
            ids = now
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= ids and all(r["taken"] > 0 for r in rows)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Odd rows through every stage, each judged on its own input by plain loops; then the stages on an empty table."""
    import corpus_pipeline as p

    rng = random.Random(31)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    item = letters(20)
    rows = [(i, "\n".join(letters(12) for _ in range(4)), f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "s0"), (101, rows[1][1] + " more", "s1"), (102, f"{letters(30)} {item} {letters(9)}", "s2"), (103, None, "s0"), (104, "", None), (105, "12 34", "s0"), (106, letters(9) + "\n" + rows[2][1].split("\n")[0], "s1")]
    rows += [(107, letters(40), None)] * 2 + [(None, letters(30), "s1"), (108, "漢字仮名交" * 40, "s0"), (109, letters(4000), "s2")]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(p.STAGES)
    of = lambda df: collections.Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    own = collections.Counter(rows)
    kept = of(stages["language ID"](spark, docs, str(tmp_path)))
    kept = collections.Counter({r: n for r, n in kept.items() if r[0] != 108})  # another alphabet, which may or may not have trained
    assert kept == collections.Counter({r: n for r, n in own.items() if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 108})
    gone = brute_lines(rows)
    want = collections.Counter()
    for i, t, s in rows:
        rest = t if i is None or not t or not t.strip() else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if i is None or not t or not t.strip() or rest.strip():
            want[(i, rest, s)] += 1
    assert of(stages["line dedup"](spark, docs, str(tmp_path))) == want
    sets = {i: runs_of_five(t) for i, t, _ in rows if i is not None}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and of(stages["n-gram Jaccard join"](spark, docs, str(tmp_path))) == collections.Counter({r: (1 if r[0] is not None else n) for r, n in own.items() if r[0] not in {b for _, b in near}})
    held = {i for i, t, _ in rows if i is not None and len(shingles_of(t) & shingles_of(item)) >= 0.8 * len(shingles_of(item))}
    assert held == {102} and of(stages["benchmark decontamination"](spark, docs, str(tmp_path))) == collections.Counter({r: n for r, n in own.items() if r[0] not in held})
    mixed = stages["mixing sources"](spark, docs, str(tmp_path)).collect()
    assert mixed and all(0 < r["taken"] <= 2 * r["size"] for r in mixed) and {r["doc_id"] for r in mixed} <= {r[0] for r in rows}
    assert len(p.run(spark, str(tmp_path)).collect()) > 10
    for name, stage in p.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name
