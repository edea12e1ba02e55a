"""Problems 2, 4, 7, 8 and 9 against brute force, on small fixtures and with odd input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasklathe.llm import frequent, leakage, linespam, packing, percentiles, tokens
from tasklathe.llm.words import words

quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


# --- percentiles -------------------------------------------------------------


@quick
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 20, 10**6]))
def test_multi_select_is_exact(spark, seed, finish):
    r = random.Random(seed)
    data = [(r.choice(["a", "a", "a", "b", "", None]), r.choice([None, *(int(r.gauss(0, 3000)) for _ in range(6))])) for _ in range(1500)]
    df = spark.createDataFrame(data, "g string, v bigint").withColumn("value", F.lit("clash")).repartition(5)
    folded = percentiles.fold_values(df, ["g"], F.col("v"))
    got = {(x["g"], x["quantile"]): (x["value"], x["n"]) for x in percentiles.multi_select(folded, ["g"], [0.0, 0.07, 0.5, 0.99, 1.0], finish=finish).collect()}
    by = defaultdict(list)
    for g, v in data:
        if v is not None:
            by[g].append(v)
    want = {}
    for g, v in by.items():
        v.sort()
        for q, hundredths in ((0.0, 0), (0.07, 7), (0.5, 50), (0.99, 99), (1.0, 100)):
            want[g, q] = (v[max(1, -(-hundredths * len(v) // 100)) - 1], len(v))
    assert got == want


def test_ranks_are_not_rounded(spark):
    assert percentiles.rank_of(0.07, 100) == 7 and percentiles.rank_of(0.55, 100) == 55 and percentiles.rank_of(0.999, 10**18) == 999 * 10**15
    df = spark.range(1, 101).select(F.lit("a").alias("g"), F.col("id").alias("value"), F.lit(1).cast("bigint").alias("n"))
    for finish in (0, 1000):
        got = {r["quantile"]: r["value"] for r in percentiles.multi_select(df, ["g"], [0.07, 0.55], finish=finish).collect()}
        assert got == {0.07: 7, 0.55: 55}


def test_folds_combine_with_bounded_error(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("day"), ((F.col("id") * 7919) % 100_003 - 20_000).alias("v"))
    exact = {r["quantile"]: r["value"] for r in percentiles.multi_select(percentiles.fold_values(df.withColumn("g", F.lit(1)), ["g"], F.col("v")), ["g"], [0.1, 0.5, 0.9]).collect()}
    parts = percentiles.fold_values(df, ["day"], F.col("v"), bits=7).withColumn("g", F.lit(1))
    rough = {r["quantile"]: r["value"] for r in percentiles.multi_select(percentiles.combine(parts, ["g"]), ["g"], [0.1, 0.5, 0.9]).collect()}
    assert all(abs(rough[q] - exact[q]) <= abs(exact[q]) / 128 + 1 for q in exact)
    edge = spark.createDataFrame([(0,), (1,), (-1,), (127,), (128,), (2**62,), (-(2**62),)], "v bigint").select("v", percentiles.coarse(F.col("v"), 7).alias("c")).collect()
    assert all(abs(r["c"] - r["v"]) <= abs(r["v"]) / 128 for r in edge)


def test_percentiles_of_nothing_and_in_slices(spark):
    none = spark.createDataFrame([("a", None)], "g string, v bigint")
    assert percentiles.multi_select(percentiles.fold_values(none, ["g"], F.col("v")), ["g"], [0.5]).count() == 0
    many = spark.range(600).select((F.col("id") % 60).alias("g"), F.col("id").alias("v"))
    old, percentiles.MAX_STATES = percentiles.MAX_STATES, 10
    read, select = [], percentiles._select

    def watched(data, states, finish):
        read.append((data.count(), {f.split("slice=")[1].split("/")[0] for f in data.inputFiles()}))
        return select(data, states, finish)

    percentiles._select = watched
    try:
        got = percentiles.multi_select(percentiles.fold_values(many, ["g"], F.col("v")), ["g"], [0.5], finish=3).collect()
    finally:
        percentiles.MAX_STATES, percentiles._select = old, select
    assert {(r["g"], r["value"]) for r in got} == {(g, g + 240) for g in range(60)}
    assert len(read) > 3 and sum(n for n, _ in read) == 600 and all(len(f) == 1 for _, f in read)  # a slice reads its own files


def test_candidates_are_written_anew(spark, monkeypatch):
    kept, write = [], percentiles.written

    def watched(df, name):
        out = write(df, name)
        if name == "kept":
            kept.append(out.count())
        return out

    monkeypatch.setattr(percentiles, "written", watched)
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 100_003).alias("v"))
    got = percentiles.multi_select(percentiles.fold_values(df, ["g"], F.col("v")), ["g"], [0.3], finish=50).first()["value"]
    assert got == sorted(i * 7919 % 100_003 for i in range(20_000))[5999]
    assert len(kept) >= 2 and kept == sorted(kept, reverse=True) and kept[-1] < 2000


# --- frequent items -------------------------------------------------------------


@quick
@given(st.integers(0, 10**6))
def test_frequent_is_exact(spark, seed):
    r = random.Random(seed)
    data = [("hot" if r.random() < 0.34 else r.choice([None, "b", "ü", f"x{r.randrange(10**6)}"]), r.choice(["i", f"y{r.randrange(2000)}"])) for _ in range(4000)]
    df = spark.createDataFrame(data, "a string, b string").repartition(6)
    got = {(x["field_name"], x["item"]): (x["n"], x["estimate"]) for x in frequent.frequent(df, {"a": F.col("a"), "b": F.col("b")}, 0.02).collect()}
    want = {(f, x): n for i, f in enumerate("ab") for x, n in Counter(d[i] for d in data).items() if x is not None and n >= 0.02 * len(data)}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(e - n) <= 0.01 * len(data) for n, e in got.values())
    assert frequent.frequent(df.limit(0), {"a": F.col("a")}, 0.02).count() == 0
    assert frequent.frequent(df.select(F.lit(None).cast("string").alias("a")), {"a": F.col("a")}, 0.02).count() == 0


def test_sketches_add_up():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**64, 5000, dtype=np.uint64)
    width = 1024
    whole, parts = np.zeros((frequent.DEPTH, width), np.int64), np.zeros((frequent.DEPTH, width), np.int64)
    frequent._add(whole, h, 24, width)
    for p in np.array_split(h, 7):
        frequent._add(parts, p, 24, width)
    assert (whole == parts).all()
    assert (frequent._unpack(frequent._pack(whole)).reshape(whole.shape) == whole).all()
    assert frequent._unpack(frequent._pack(whole + 2**40))[0] == whole.ravel()[0] + 2**40


# --- packing ----------------------------------------------------------------------


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=30))
@settings(deadline=None, max_examples=60)
def test_plan_is_best_fit_decreasing(hist):
    capacity = 50
    slots, made = packing.plan(hist, capacity)
    load, count = Counter(), Counter()
    for length, a, b, at in slots:
        assert a == count[length]
        count[length] += b - a + 1
        for i in range(b - a + 1):
            load[at + i] += length
    assert count == Counter(hist) and set(load) == set(range(made)) and all(x <= capacity for x in load.values())
    free = []  # one by one, into the fullest container with room
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            k = min((i for i in range(len(free)) if free[i] >= length), key=lambda i: free[i], default=None)
            if k is None:
                free.append(capacity - length)
            else:
                free[k] -= length
    assert made == len(free)


def check_packed(rows, sizes, capacity):
    pieces, load = defaultdict(list), Counter()
    for r in rows:
        pieces[r["id"]].append((r["token_from"], r["length"]))
        if r["container_no"] is None:
            assert r["length"] == 0
        else:
            load[r["container_no"]] += r["length"]
    assert max(load.values(), default=0) <= capacity and sorted(load) == list(range(len(load)))
    for i, n in sizes:
        at = 0
        for a, b in sorted(pieces[i]):
            assert a == at
            at += b
        assert at == (n or 0) and len(pieces[i]) == max(1, -(-(n or 0) // capacity))


def test_pack(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([0, None, 5, 5, 5, r.randrange(100), 64, 640, 1000])) for i in range(900)]
    df = spark.createDataFrame(sizes, "id bigint, n_tokens bigint").repartition(5).withColumn("rank", F.lit(1))
    old, packing.SLICE_ROWS, packing.RANK_BLOCK = packing.SLICE_ROWS, 10, 16
    try:
        got = packing.pack(df, 64).collect()
    finally:
        packing.SLICE_ROWS, packing.RANK_BLOCK = old, 65_536
    check_packed(got, sizes, 64)
    assert packing.fill(packing.pack(df, 64), 64).first()["unused"] < 0.02
    assert packing.pack(df.limit(0), 64).count() == 0
    assert packing.fill(packing.pack(df.limit(0), 64), 64).first()["n_containers"] == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)
    with pytest.raises(Exception, match="negative"):
        packing.pack(spark.createDataFrame([(1, -1)], "id bigint, n_tokens bigint"), 8)


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    docs = spark.createDataFrame([(1, "Hello, world!"), (2, None), (3, ""), (4, "a" * 50_000), (5, "日本語です。"), (6, "<|endoftext|>")], "doc_id bigint, text string").withColumn("id", F.lit(9))
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(docs).collect()}
    c = tokens.Counter(open(tokens.VOCABULARY, "rb").read())
    assert got[1] == 4 and got[2] == got[3] == 0 and got[6] > 1
    assert c.encoding.decode(c.encode("日本語です。 x")) == "日本語です。 x"
    check_packed(packing.pack_texts(docs, 100).collect(), list(got.items()), 100)


# --- leakage ------------------------------------------------------------------------


def test_words():
    assert words("Ärger  beim <b>Kauf</b>en, dor-\n> mant co​pper &amp; l’été [x](http://a.b)!") == ["arger", "beim", "kaufen", "dormant", "copper", "lete", "x"]
    assert words(None) == words("") == words(" .,\n") == []


VOCAB = [f"{a}{b}" for a in ("kor", "mal", "tin", "ves", "lop", "dra", "fen", "gul") for b in ("a", "eth", "ion", "ur", "ix", "ond", "ey")]


def damaged(run, r, errors):
    w = list(run)
    for i in errors:
        kind = r.randrange(4)
        w[i] = {0: [w[i] + "q"], 1: ["other"], 2: [], 3: [w[i], "extra"]}[kind]
    return [x for y in w for x in ([y] if isinstance(y, str) else y)]


def brute_run(p, d, min_run=12, errors_in=8):
    """Longest run by dynamic programming over all pairs of starts."""
    best = 0
    for i in range(len(p)):
        for j in range(len(d)):
            if p[i] != d[j]:
                continue
            cost = {(i, j): 0}
            rows = list(range(j, min(len(d), j + 2 * (len(p) - i) + 4) + 1))
            prev = {y: y - j for y in rows}
            for x in range(i + 1, len(p) + 1):
                cur = {rows[0]: x - i}
                for y in rows[1:]:
                    cur[y] = min(prev[y] + 1, cur[y - 1] + 1, prev[y - 1] + (p[x - 1] != d[y - 1]))
                    if p[x - 1] == d[y - 1] and cur[y] == prev[y - 1] and x - i >= min_run and (x - i) >= errors_in * cur[y]:
                        best = max(best, x - i)
                prev = cur
            del cost
    return best


@given(st.integers(0, 10**6))
@settings(deadline=None, max_examples=60)
def test_longest_run_is_brute_force(seed):
    r = random.Random(seed)
    p = [r.choice(VOCAB) for _ in range(r.randrange(5, 30))]
    n = r.randrange(4, len(p) + 1)
    a = r.randrange(0, len(p) - n + 1)
    d = [r.choice(VOCAB) for _ in range(r.randrange(6))] + damaged(p[a : a + n], r, r.sample(range(n), min(n, r.randrange(4)))) + [r.choice(VOCAB) for _ in range(r.randrange(6))]
    assert (leakage.longest_run(p, d, leakage.seeds_of(p)) > 0) == (brute_run(p, d) > 0)


def test_leaks(spark):
    r = random.Random(2)
    passages = [[r.choice(VOCAB) for _ in range(r.randrange(20, 60))] for _ in range(30)]
    items = [(i, " ".join(p).capitalize() + ".") for i, p in enumerate(passages)] + [(100, " ".join(passages[0])), (101, None), (102, "")]
    filler = lambda n: [f"w{r.randrange(300)}" for _ in range(n)]
    docs, want = [(900, None), (901, ""), (902, "kora " * 3000)], set()
    for d in range(240):
        k = d % 30
        p = passages[k]
        n = (12, 16, 20, 8)[d % 4]
        a = r.randrange(0, len(p) - n + 1)
        run = p[a : a + n]
        if d % 3 == 0 and n >= 12:
            run = damaged(run, r, [r.randrange(1, n - 1)])
        docs.append((d, " ".join(filler(r.randrange(40)) + ([w.upper() for w in run] if d % 5 else run) + filler(r.randrange(40)))))
        if leakage.longest_run(p, words(docs[-1][1]), leakage.seeds_of(p)):
            want.add((d, k))
            if k == 0:
                want.add((d, 100))
    assert len(want) > 150
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"id": F.lit(1), "words": F.lit("x")}).repartition(4)
    it = spark.createDataFrame(items, "item_id bigint, passage string").withColumn("words", F.lit("x"))
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaked(df, it).collect()}
    assert got <= want | {p for p in got if p[0] >= 900}
    assert len(got & want) >= 0.98 * len(want)
    assert leakage.leaked(df.limit(0), it).count() == 0 and leakage.leaked(df, it.limit(0)).count() == 0


def test_paraphrases(spark):
    p = VOCAB[:24]
    shuffled = [w for i in range(0, 24, 3) for w in (p[i + 1], p[i], p[i + 2])]
    items = spark.createDataFrame([(1, " ".join(p), "Lopur")], "item_id bigint, passage string, answer string")
    docs = spark.createDataFrame([(1, " ".join(shuffled) + " lopur"), (2, "nothing like it at all here")], "doc_id bigint, text string")
    got = leakage.paraphrases(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["answer_found"]) for r in got] == [(1, 1, True)] and got[0]["lcs_share"] > 0.5


def planted(n_passages, r, n_words=20_000, length=40):
    """Passages of drawn words, and for each a document that holds 12 words of it, half of them with one other word inside."""
    word = lambda: f"v{r.randrange(n_words)}"
    passages = [[word() for _ in range(length)] for _ in range(n_passages)]
    docs = []
    for k, p in enumerate(passages):
        a = r.randrange(length - 11)
        run = p[a : a + 12]
        if k % 2:
            run[r.randrange(1, 11)] = word()
        docs.append((k, " ".join([word() for _ in range(r.randrange(30))] + run + [word() for _ in range(r.randrange(30))])))
    return [(k, " ".join(p)) for k, p in enumerate(passages)], docs


@pytest.mark.parametrize("n", [200, 3000])
def test_recall_holds_with_many_passages(spark, n):
    items, docs = planted(n, random.Random(n))
    want = {k for k, t in docs if leakage.longest_run(items[k][1].split(), t.split(), leakage.seeds_of(items[k][1].split()))}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    got = {r["doc_id"] for r in leakage.leaked(df, it).collect() if r["doc_id"] == r["item_id"]}
    assert len(want) > 0.9 * n and got <= want and len(got) >= 0.99 * len(want)


def test_slices_find_the_same(spark, monkeypatch):
    items, docs = planted(60, random.Random(5))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    whole = {tuple(r) for r in leakage.leaked(df, it).collect()}
    monkeypatch.setattr(leakage, "SLICE_WORDS", 700)
    assert {tuple(r) for r in leakage.leaked(df, it).collect()} == whole and len(whole) > 50


def test_paraphrase_of_every_second_word(spark):
    p = VOCAB[:24]
    items = spark.createDataFrame([(1, " ".join(p), "nothing")], "item_id bigint, passage string, answer string")
    docs = [(1, " ".join(w if i % 2 else f"other{i}" for i, w in enumerate(p))), (2, " ".join(p[:4])), (3, "no word of it at all here")]
    got = {r["doc_id"]: r for r in leakage.paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got[1]["lcs_share"] == 0.5 and got[1]["paraphrase"]
    assert 3 not in got and not any(r["paraphrase"] for d, r in got.items() if d != 1)


def test_planted_paraphrases_are_decided(spark):
    r = random.Random(9)
    word = lambda: f"v{r.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(40)), f"answer{k}") for k in range(150)]
    docs = []
    for k, p, a in items:
        w = p.split()
        if k % 3 == 0:  # every third word another, anywhere in a longer text
            w = [x if i % 3 else word() for i, x in enumerate(w)]
        elif k % 3 == 1:  # four words in ten kept, and the answer
            w = [x if i % 5 in (1, 3) else word() for i, x in enumerate(w)] + [a]
        else:  # as few kept, without the answer: no paraphrase
            w = [x if i % 5 in (1, 3) else word() for i, x in enumerate(w)]
        docs.append((k, " ".join([word() for _ in range(20)] + w + [word() for _ in range(20)])))
    got = leakage.paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string, answer string"))
    marked = {x["doc_id"] for x in got.filter("paraphrase").collect() if x["doc_id"] == x["item_id"]}
    assert len([k for k in marked if k % 3 == 0]) >= 48 and len([k for k in marked if k % 3 == 1]) >= 40 and not [k for k in marked if k % 3 == 2]


def test_words_of_long_markup():
    long = "x" * 5000
    assert words(f'one <a href="{long}" rel=nofollow>two</a> <!-- {long} --> [three](http://{long}) <b and no close') == ["one", "two", "three", "b", "and", "no", "close"]
    assert words("a < b and c > d <!-- open") == ["a", "b", "and", "c", "d", "open"]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert leakage.lcs_length(a, b) == t[-1][-1]


# --- spam pages --------------------------------------------------------------------------


PROSE = "We had it for two weeks before I wrote this. The handle feels solid and the lid closes well. My neighbour asked where I got it."


def test_spam_pages(spark):
    spam = {
        1: "\n".join(f"https://shop{i}.example/kettle-{i}" for i in range(12)),
        2: " ".join(f"#kettle #deal{i % 3} #shop" for i in range(10)),
        3: " | ".join(["kettle", "shop", "sale", "KET904", "kettle", "deal"] * 8),
        4: "kettle kettle cheap kettle buy kettle sale shop kettle cheap cheap kettle online kettle best kettle sale " * 3,
        5: "\n".join(f"* [kettle deal](http://a{i}.test/k)" for i in range(9)),
        6: " ".join(f"KEL-{10000 + i}/X" for i in range(40)),
        7: PROSE[:60] + "\n" + "kettle sale, kettle price, cheap kettle, best kettle, " * 12,
        8: "電気ケトル 激安 電気ケトル 通販 電気ケトル 最安値 送料無料 電気ケトル " * 4,
    }
    fine = {
        11: PROSE,
        12: PROSE * 3 + " #kettle #nice https://a.example/x",
        13: "Good value",
        14: "このケトルは軽くて使いやすいです。台所で毎日使っています。とても気に入りました。",
        15: PROSE.lower().replace(".", ""),
        16: "Nach drei Wochen ist der Deckel noch wie neu. Ich benutze ihn im Büro fast täglich und bin zufrieden. " * 2,
        17: PROSE + "\n+ light\n+ quiet\n- noisy",
        18: None,
        19: " \n ",
        20: "x" * 50_000,
    }
    docs = spark.createDataFrame([*spam.items(), *fine.items()], "doc_id bigint, text string").withColumns({"codes": F.lit(1), "sizes": F.lit(2)})
    got = {r["doc_id"] for r in linespam.spam_pages(docs).collect()}
    assert got - {20} == set(spam)
    shares = {r["doc_id"]: r for r in linespam.page_shares(docs).collect()}
    assert len(shares) == len(spam) + len(fine) and shares[18]["n_words"] == 0 and shares[18]["main_kind"] is None and shares[1]["main_kind"] == "link list"
    assert linespam.spam_pages(docs.limit(0)).count() == 0


NOUNS = "kettle toaster blender mixer lamp desk chair pillow router keyboard speaker heater fan grill pan pot knife scale tent backpack".split()


def crawl(r, n):
    """Pages like a shop's crawl: reviews in sentences, and keyword pages, so that words can be learnt."""
    say = ["the {} came after two weeks and works well in the kitchen.", "we bought the {} for our office and it is quiet.", "my neighbour asked me where i got this.", "after a month the lid was loose, but they sent a new one.", "i would not buy it again because it is too loud for me."]
    ad = ["cheap", "best", "sale", "online", "price", "shop"]
    for i in range(n):
        if i % 20 == 0:
            w = [r.choice(ad) if r.random() < 0.4 else r.choice(NOUNS) for _ in range(40)]
            yield (", " if i % 40 else " ").join(x for k, x in enumerate(w) for _ in range(1 + (k % 7 == 0)))
        else:
            own = r.choice(NOUNS)
            yield " ".join(x.format(own).capitalize() for x in r.sample(say, 3))


def test_probes(spark):
    """Pages that a list of function words got wrong; words are learnt from the crawl around them."""
    r = random.Random(8)
    docs = list(enumerate(crawl(r, 1500)))
    probes = {
        "stop words stuffed": "the best kettle for you and the cheap kettle for you and the best kettle in the shop for you and the kettle for the sale " * 3,
        "distinct products": " ".join(NOUNS[:18]),
        "prose": "We bought the kettle for our office. It came after two weeks and it is too loud for me, but my neighbour works with it.",
    }
    docs += [(10_000 + i, t) for i, t in enumerate(probes.values())]
    got = {x["doc_id"]: x["non_prose"] for x in linespam.page_shares(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[10_000 + i] > 0.5 for i in range(3)] == [True, True, False]
    spam = {i for i in range(0, 1500, 20)}
    flagged = {i for i in range(1500) if got[i] > 0.5}
    assert len(flagged & spam) >= 0.97 * len(spam) and len(flagged - spam) <= 2


def test_vocabulary_is_learnt(spark):
    lines = linespam.line_table(spark.createDataFrame(list(enumerate(crawl(random.Random(1), 600))), "doc_id bigint, text string"))
    v = linespam.vocabulary(lines)
    assert {"the", "and", "it", "is", "for"} <= v.sentence and {"cheap", "best", "sale"} <= {w for w, x in v.kind.items() if x == linespam.LISTED}
    counts = {x["word"]: x for x in linespam.word_counts(lines).collect()}
    assert counts["the"]["docs"] <= 600 and counts["cheap"]["lists"] > 0 == counts["cheap"]["sentences"]
    assert not linespam.vocabulary(lines.limit(0)).kind


@given(st.lists(st.integers(0, linespam.N_CODES - 1), min_size=1, max_size=7))
@settings(deadline=None, max_examples=40)
def test_posteriors_are_brute_force(codes):
    from itertools import product

    m = linespam.Model.initial()
    e = m.emission()
    k = len(linespam.STATES)
    want = np.zeros((len(codes), k))
    if len(codes) > 5:
        codes = codes[:5]
        want = want[:5]
    for path in product(range(k), repeat=len(codes)):
        w = m.start[path[0]] * e[codes[0], path[0]]
        for a, b, c in zip(path, path[1:], codes[1:]):
            w *= m.step[a, b] * e[c, b]
        for t, s in enumerate(path):
            want[t, s] += w
    want /= want.sum(1, keepdims=True)
    other = np.array([0, 1, 2])
    got = linespam.posteriors([other, np.array(codes), np.array([], np.int64)], m, e)
    assert np.allclose(got[1], want) and got[2].shape == (0, k)


def test_tables_are_distributions():
    m = linespam.Model.initial()
    assert np.allclose(m.step.sum(1), 1) and np.isclose(m.start.sum(), 1)
    for t, n in zip(m.looks, linespam.BINS):
        assert t.shape == (4, n) and np.allclose(t.sum(1), 1)
    assert np.allclose(m.emission().sum(0), 1)
