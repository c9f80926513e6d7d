"""The corpus operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlens.llm import exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, quality_rules, repeats, token_counts, url_filter
from twinlens.llm import words as word_spans
from twinlens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, h int, label string, hit int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b", "A  b\x0b", "é ñ ß", "日本 語", "it's we 'll", "<|endoftext|> x<|endoftext|>y", "%%% ### $$", "x" * 3000, "the cat sat " * 400]


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, k, s, len(t or ""), 7, "x", 1, "y", 2) for i, t, k, s in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(60)]
    out = [(i, t, "en", None if i % 3 else "s0") for i, t in enumerate(ODD)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 120))) for _ in range(12)]
    for i in range(len(ODD), len(ODD) + n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        text = "".join(x + r.choice(["\n", " ", " ", " "]) for x in w)
        out.append((i, text, r.choice(["en", "fr", None]), f"s{r.choice([0, 0, 0, 1, 2, 3])}"))
    return out


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return table(spark, docs).persist()


def got(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def words(t):
    return WORDS.findall(t or "")


def test_token_counts(frame, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for i, x, *_ in docs}
    for chunk, overlap in ((200, 10), (32_768, 1024)):
        assert got(token_counts.count_tokens(frame, limit=100, chunk=chunk, overlap=overlap), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_splice_without_boundaries():
    import public_tokenizers

    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    for text in ["z" * 2000, "ab " * 900, "a  b\n" * 300, "".join(r.choice("ab \n\t.é日1'<|endoftext|>") for _ in range(4000))]:
        assert token_counts.splice(text, c.encode, 120, 7) == c.tokenizer.encode(text, add_special_tokens=False).ids


class Watched:
    """A tokenizer that keeps what its batches are asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **more):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_counts_of_letters_come_from_the_model():
    import public_tokenizers

    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    c.tokenizer = Watched(c.tokenizer)
    text = "The Straße, déjà vu.\nÀ côté  of 12 words;x_y\t(ÿes) \r\n" * 30
    n = len(c.encode(text)[0])
    assert [c.count([text], chunk, 20)[0] for chunk in (40, 100_000)] == [n, n]
    assert c.tokenizer.asked and not any(x.isalpha() for w in c.tokenizer.asked for x in w)
    r = random.Random(13)
    parts = ["a", "É", "ß", "÷", "×", "'s", "'re", "'", "’", "0", "²", ".", "-", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "e\u0301", "日", "<|endoftext|>", "<|", "\0", "the", " word", "I'm"]
    for k in range(300):
        text = "".join(r.choice(parts if k % 2 else [x for x in parts if x.isascii()]) for _ in range(r.choice([3, 20, 200])))
        n = len(c.encode(text)[0])
        assert [c.count([text], chunk, 9)[0] for chunk in (64, 8192)] == [n, n], text


def test_language_gradients():
    r = np.random.default_rng(0)
    m = language_id.ByteTagger(["a", "b"], 3)
    m.w = {k: v.astype(float) for k, v in m.w.items()}
    x, y = r.integers(97, 103, (4, 6)), np.array([0, 1, 1, 0])
    _, g = m.loss_gradients(x, y)
    for k, w in m.w.items():
        for at in [np.unravel_index(j, w.shape) for j in (r.integers(0, w.size, 5) if k[0] != "x" else x.ravel()[:5] * w.shape[1] + 1)]:
            keep, e = w[at], 1e-5
            w[at] = keep + e
            up = m.loss_gradients(x, y)[0]
            w[at] = keep - e
            down = m.loss_gradients(x, y)[0]
            w[at] = keep
            assert (up - down) / (2 * e) == pytest.approx(g[k][at], abs=1e-6)


def test_language(spark):
    r = random.Random(3)
    parts = {"aa": ["the", "th", "ing", "wh"], "bb": ["sch", "ein", "ung", "ß"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(2)) for _ in range(r.randint(5, 60))), k, "s") for i in range(300) for k in [r.choice(["aa", "bb"])]]
    rows += [(300, None, "aa", "s"), (301, "12 34 !!", "bb", "s"), (302, "", None, None), (303, "thing", None, None)]
    d = table(spark, rows)
    found = got(language_id.identify(d), "doc_id", "held_out", "lang_pred", "score")
    assert len(found) == 304
    assert all(found[i][0] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    assert [found[i][1] for i in (300, 301, 302)] == ["und"] * 3 and found[300][2] == 0
    tested = [(found[i][1], k) for i, _, k, _ in rows[:300] if found[i][0]]
    assert len(tested) > 40 and sum(a == b for a, b in tested) / len(tested) > 0.95
    assert all(0 <= f[2] <= 1 for f in found.values())
    assert {r.lang_pred for r in language_id.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_segments_cover_every_byte():
    m = language_id.ByteTagger(["a", "b"])
    one = [bytes([97 + k % 5]) * n for k, n in enumerate([1, 127, 128, 129, 1000])]
    p = m.documents(one, segment=128, lanes=3)
    assert p.sum(1) == pytest.approx(np.ones(5), abs=1e-5)


def test_urls(spark):
    urls = {
        0: None, 1: "nothing", 2: "http://A.COM/x", 3: "https://b.example.com/en/1?q=/fr/", 4: "http://www.example.com/en/", 5: "http://x.net/es/1", 6: "http://net/fr/", 7: "http://xnet/fr/",
        8: "http://a.com?x", 9: "http://a.org#/en/", 10: "://", 11: "http://example.com/en",
    }
    pages = spark.createDataFrame([(i, u, 1) for i, u in urls.items()] + [(2, "http://A.COM/x", 1)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "id long, bad boolean")
    rows = url_filter.judge(pages, labels).collect()
    f = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == 13
    assert f[0] == ("", "", None, "allow") == f[1] and f[10] == ("", "", None, "allow")
    assert f[2] == ("a.com", "/x", "com/", "allow") and f[3] == ("b.example.com", "/en/1", "example.com/en/", "block")
    assert f[4][2:] == ("www.example.com/en/", "allow") and f[5][2:] == ("net/es/", "block") and f[6][2:] == ("net/fr/", "block")
    assert f[7] == ("xnet", "/fr/", None, "allow") and f[8] == ("a.com", "", None, "allow") and f[9] == ("a.org", "", None, "allow") and f[11][2] == "com/"


def test_mined_url_rules(spark):
    r = random.Random(4)
    rows, bad = [], {}
    for i in range(600):
        site, step = r.choice(["good", "spam"]), r.choice(["casino", "news"])
        rows.append((i, f"http://{site}.org/{step}/{r.randrange(99)}"))
        bad[i] = site == "spam" and step == "casino"
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in bad.items() if i < 400], "id long, bad boolean")
    found = got(url_filter.judge(pages, labels, support=0.05, confidence=0.9), "page_id", "verdict")
    assert all((found[i][0] == "block") == b for i, b in bad.items())


def test_url_rules_of_a_site_in_a_large_table(spark):
    """30 bad URLs of one site, and rules of two tokens, among so many labelled ones that they are no large part."""
    r = random.Random(9)
    rows = [(i, f"http://h{i % 400}.org/{r.choice(['a', 'b', 'c'])}/{i}", i % 7 == 0) for i in range(9000)]
    rows += [(9000 + i, f"http://www.spam.info/x/{i}", True) for i in range(30)]
    rows += [(9100 + i, f"http://two.info/{'casino' if i % 2 else 'news'}/{i}", bool(i % 2)) for i in range(60)]
    rows += [(9200 + i, f"http://one.info/{'casino' if i % 2 else 'wares'}/{i}", i % 5 == 0) for i in range(200)]
    pages = spark.createDataFrame([*((i, u) for i, u, _ in rows), (9900, "http://spam.info/new"), (9901, "http://www.spam.info/"), (9902, "http://two.info/casino/7"), (9903, "http://two.info/news/7")], "page_id long, url string")
    found = got(url_filter.judge(pages, spark.createDataFrame([(i, b) for i, _, b in rows], "id long, bad boolean")), "page_id", "verdict", "mined")
    assert all(found[i][0] == "block" for i in [*range(9000, 9030), 9900, 9901, 9902]) and found[9903][0] == "allow"
    assert found[9902][1] == 1.0 and all(found[i][0] == "allow" for i in range(9000))
    # every rule by brute force
    rules, tokens = defaultdict(lambda: [0, 0]), {}
    for i, u in ((x.page_id, x.t) for x in pages.select("page_id", url_filter.url_tokens(F.col("url")).alias("t")).collect()):
        tokens[i] = {frozenset(c) for k in range(1, len(u) + 1) for c in itertools.combinations(sorted(u), k)}
    for i, _, b in rows:
        for c in tokens[i]:
            rules[c][b] += 1
    good = {c: n[1] / sum(n) for c, n in rules.items() if n[1] >= 20 and wilson(n[1], sum(n)) >= 0.6}
    for i in (*range(0, 9000, 50), *range(9000, 9030), *range(9100, 9160), *range(9200, 9400), *range(9900, 9904)):
        assert found[i][1] == pytest.approx(max((good[c] for c in tokens[i] if c in good), default=None))


def wilson(bad, n, z=3.0):
    p = bad / n
    return (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)


def mined(spark, rows):
    d = spark.createDataFrame([(sorted(t), b) for t, b in rows], "tokens array<string>, bad boolean")
    return url_filter.mine(d), url_filter.mine(d).select("tokens", "confidence").distinct().collect()


def test_minimal_rules_against_all_itemsets(spark):
    r = random.Random(6)
    rows = []
    for k in range(500):
        t = {x for x in "abcdef" if r.random() < 0.5} | {"all"}
        rows.append((t, ({"a", "b"} <= t and r.random() < 0.97) or ("c" in t and {"d", "e"} <= t) or r.random() < 0.05))
    counts = defaultdict(lambda: [0, 0])
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                counts[c][b] += 1
    share = {c: n[1] / sum(n) for c, n in counts.items() if n[1] >= 20}
    want = {c: v for c, v in share.items() if wilson(counts[c][1], sum(counts[c])) >= 0.6 and all(share[p] < v for p in itertools.combinations(c, len(c) - 1) if p)}
    assert {tuple(x.tokens): x.confidence for x in mined(spark, rows)[1]} == pytest.approx(want) and ("a", "b") in want and ("c", "d", "e") in want


@pytest.mark.parametrize("bound", [None, (0, 0), (4, 0)])
def test_rules_do_not_depend_on_how_many_combinations_there_are(spark, monkeypatch, bound):
    """Rules of three and four tokens with little support, by FP-growth alone, without it, and by both."""
    if bound:
        monkeypatch.setattr(url_filter, "COMBINATIONS", bound[0])
        monkeypatch.setattr(url_filter, "COMBINATIONS_BESIDES", bound[1])
    r = random.Random(12)
    rows = []
    for _ in range(900):
        t = {x for x in "abcdefgh" if r.random() < 0.35} | {"all"} | ({"i"} if r.random() < 0.8 else set())
        rows.append((t, {"a", "b", "c"} <= t or ({"d", "e", "f", "i"} <= t and r.random() < 0.98) or r.random() < 0.1))
    counts = defaultdict(lambda: [0, 0])
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                counts[c][b] += 1
    share = {c: n[1] / sum(n) for c, n in counts.items() if n[1] >= 20}
    want = {c: v for c, v in share.items() if wilson(counts[c][1], sum(counts[c])) >= 0.6 and all(share[p] < v for p in itertools.combinations(c, len(c) - 1) if p)}
    assert {tuple(x.tokens): x.confidence for x in mined(spark, rows)[1]} == pytest.approx(want) and ("a", "b", "c") in want and max(map(len, want)) > 3


def test_urls_with_many_common_tokens(spark):
    """60 bad URLs of which each has all of 40 keys but one or two, that others have too: combinations would be 2**38."""
    r = random.Random(8)
    keys = [f"k{k}" for k in range(40)]
    rows = [({*keys, "www"} - set(r.sample(keys, 2)), True) for _ in range(60)] + [({k, "www"}, False) for k in keys for _ in range(40)]
    rows += [({"x", "y", "www"}, True) for _ in range(40)] + [({x, "www"}, False) for x in "xy" for _ in range(90)]
    found = {tuple(x.tokens): x.confidence for x in mined(spark, rows)[1]}
    assert found[("x", "y")] == 1.0 and sum(len(t) == 2 for t in found) > 500 and all(len(t) <= 3 for t in found)
    # keys of bad URLs only are rules by themselves, and no combination of them is needed
    only = [({*keys} - set(r.sample(keys, 2)), True) for _ in range(60)] + [({"z"}, False) for _ in range(60)]
    assert {len(x.tokens) for x in mined(spark, only)[1]} == {1}


def test_labels_that_do_not_depend_on_urls_make_no_rule(spark):
    r = random.Random(7)
    rows = [({f"h{r.randrange(60)}", f"p{r.randrange(12)}", f"q{r.randrange(9)}", "www"}, r.random() < 0.37) for _ in range(8000)]
    assert not mined(spark, rows)[1]


def test_a_long_url_is_judged_whole(spark):
    long = "http://h.org/" + "/".join(f"s{k}x" for k in "abcdefghij" * 400) + "?" + "&".join(f"k{k}=1" for k in range(3000))
    rows = [(i, f"http://h.org/{i}?last=1", True) for i in range(40)] + [(100 + i, f"http://h.org/{i}", False) for i in range(300)]
    pages = spark.createDataFrame([*((i, u) for i, u, _ in rows), (900, long + "&last=1"), (901, long)], "page_id long, url string")
    found = got(url_filter.judge(pages, spark.createDataFrame([(i, b) for i, _, b in rows], "id long, bad boolean")), "page_id", "verdict")
    assert found[900][0] == "block" and found[901][0] == "allow" and url_filter.judge(pages.limit(0), spark.createDataFrame([], "id long, bad boolean")).count() == 0


def links(docs, n, percent):
    sets = {}
    for i, t, *_ in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join(frame, docs, n, percent):
    found = got(jaccard_join.link(frame, words=n, percent=percent), "doc_id", "n_shingles", "component_id")
    assert found == links(docs, n, percent)


def test_jaccard_join_large_group_of_near_copies(spark):
    """Copies that are near to their base but not to each other, and so meet under the same signatures."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(1000, " ".join(base), "en", "s")]
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 6])):
            w[r.randrange(150)] = f"x{r.randrange(999)}"
        rows.append((i, " ".join(w), "en", "s"))
    assert got(jaccard_join.link(table(spark, rows), words=3, percent=90), "doc_id", "n_shingles", "component_id") == links(rows, 3, 90)


def test_jaccard_join_beyond_one_search(spark, monkeypatch):
    """Groups above the bounds go to finer signatures and then block by block with hubs."""
    monkeypatch.setattr(jaccard_join, "MOST_SETS", 30)
    monkeypatch.setattr(jaccard_join, "FIRST_HUBS", 8)
    monkeypatch.setattr(jaccard_join, "HUBS", 15)
    r = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[:45] + [f"y{i}"] * (i % 2) + [f"z{r.randrange(30)}" for _ in range(r.choice([0, 2, 4, 9]))]), "en", "s") for i in range(90)]
    rows += [(None, " ".join(base[:45]) + " q", "en", "s")]
    want = links(rows[:-1], 3, 80)
    found = got(jaccard_join.link(table(spark, rows), words=3, percent=80), "doc_id", "n_shingles", "component_id")
    assert {k: v for k, v in found.items() if k is not None} == want and found[None] == (44, want[0][1])


def test_null_ids_link_like_others(spark):
    r = random.Random(8)
    a, b = (" ".join(f"w{r.randrange(9999)}" for _ in range(40)) for _ in range(2))
    rows = [(5, a, "en", "s"), (None, a + " x", "en", "s"), (None, b, "en", "s"), (None, b + " y", "en", "s"), (None, None, "en", "s"), (None, "", "en", "s")]
    found = jaccard_join.link(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(5, 36, 5), (None, 37, 5), (None, 36, None), (None, 37, None), (None, 0, None), (None, 0, None)], key=repr)


def test_word_hashes_of_long_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(word_spans, "PIECE", 64)
    r = random.Random(9)
    texts = [None, "", "A b\tC", " ".join("".join(r.choice("abcXYZ") for _ in range(r.choice([1, 5, 20]))) for _ in range(200)), "x" * 300 + " y", "\n a", "é " * 50, "y " + "x" * 300]
    own = [jaccard_join.shingle_sets(pa.array([t]), 3)[0].tolist() for t in texts]
    assert [s.tolist() for s in jaccard_join.shingle_sets(pa.array(texts), 3)] == own
    assert [len(s) for s in own] == [len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if (w := words((t or "").lower())) else ()) for t in texts]
    low = [jaccard_join.shingle_sets(pa.array([t and t.lower()]), 3)[0].tolist() for t in texts]
    assert low == own


@pytest.mark.parametrize("shape", jaccard_join.SHAPES)
def test_partenum_guarantee(shape):
    r = np.random.default_rng(6)
    for percent in (60, 80, 90):
        bands = jaccard_join.Bands(percent, shape)
        for _ in range(60):
            n = int(r.integers(1, 200))
            a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) > 0.05], r.integers(0, 1 << 62, int(r.integers(0, 3))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                s, of = jaccard_join.signatures([a, b], bands)
                assert np.array_equal(a, b) or np.intersect1d(s[of == 0], s[of == 1]).size
                x, y = (np.frombuffer(jaccard_join.sketch(k), np.uint64) for k in (a, b))
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(k.reshape(-1, width), axis=0) for k in (x, y))
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102)]
    found = got(components(spark.createDataFrame(chain, "a long, b long")), "node", "component")
    assert found == {i: (0,) for i in range(41)} | {100: (100,), 101: (100,)}


def mixed(docs):
    size = {i: len(words(t)) for i, t, *_ in docs}
    by = defaultdict(list)
    for i, _, _, s in docs:
        by[s].append(i)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    n = {s: sum(size[i] for i in by[s]) for s in names}
    total, capped = sum(n.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left, w = total - sum(3 * n[s] for s in capped), sum(weight[s] for s in rest)
        new = {s for s in rest if 3 * n[s] * w <= left * weight[s]}
        if not new:
            return size, n, {s: 3.0 * n[s] if s in capped else left * weight[s] / w for s in names}
        capped |= new


def test_mixing(frame, docs):
    size, n, target = mixed(docs)
    found = got(mixing.mix(frame), "doc_id", "size", "source_size", "target", "taken")
    taken = Counter()
    for i, _, _, s in docs:
        assert found[i][:2] == (size[i], n[s]) and found[i][2] == pytest.approx(target[s])
        assert found[i][3] <= 3 * size[i] and (size[i] == 0 or found[i][3] % size[i] == 0)
        taken[s] += found[i][3]
    for s in n:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, _, _, x in docs if x == s)
    assert got(mixing.mix(frame.repartition(5)), "doc_id", "size", "source_size", "target", "taken") == found


def test_mixing_of_repeated_rows_and_empty_sources(spark):
    rows = [(1, "a b c", None, "x")] * 3 + [(2, None, None, "y"), (None, "d e", None, None)]
    found = mixing.mix(table(spark, rows)).collect()
    assert len(found) == 5 and {r.target for r in found if r.source_size == 0} == {0.0}


def near(a, b, k=2):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1] <= k


def mutate(r, s, k):
    s = list(s)
    for _ in range(k):
        at = r.randrange(len(s))
        r.choice([lambda: s.insert(at, r.choice("abé")), lambda: s.pop(at), lambda: s.__setitem__(at, r.choice("abé"))])()
    return "".join(s)


def test_edit_automaton(spark):
    r = random.Random(7)
    pairs = [(a, mutate(r, a, r.randint(0, 4)) if len(a) > 4 else a) for a in ("".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(250))]
    d = spark.createDataFrame(pairs, "x string, y string").select(line_dedup.within(F.col("x"), F.col("y")).alias("w"), (F.levenshtein("x", "y") <= 2).alias("l"))
    assert d.filter("w <> l").count() == 0


def lines_left(docs):
    first, out = {}, {}
    for i, t, *_ in sorted(docs):
        kept, exact, close = [], 0, 0
        for raw in (t or "").split("\n"):
            line = raw.strip(" \t\x0b\x0c\r")
            if len(line) < 20:
                kept.append(raw)
            elif line in first:
                exact += 1
            else:
                hit = any(near(line, x) for x in first)
                close += hit
                first[line] = i
                if not hit:
                    kept.append(raw)
        out[i] = (None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), exact, close)
    return out


def test_line_dedup(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(18, 40))) for _ in range(25)]
    rows = [(i, "\n".join(mutate(r, r.choice(base), r.choice([0, 0, 1, 2, 3, 5])) for _ in range(r.randint(0, 6))), "en", "s") for i in range(80)]
    rows += [(80, None, "en", None), (81, "", None, None), (82, "\n\n", None, None)]
    d = line_dedup.dedup_lines(table(spark, rows))
    assert got(d, "doc_id", "text", "n_lines", "n_exact", "n_near") == lines_left(rows)
    assert set(d.columns) >= {"id", "h", "hit", "label"}


@pytest.mark.parametrize(("few", "levels"), [(512, 2), (10, 2), (10, 0)])
def test_line_dedup_with_many_lines_under_one_entry(spark, monkeypatch, few, levels):
    """Lines that share a third of their text but are not near: judged at once, split into finer entries, or in rounds."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "LEVELS", levels)
    r = random.Random(9)
    rows = [(i, "x" * 20 + "".join(r.choice("abcdef") for _ in range(40)), "en", "s") for i in range(40)]
    rows += [(100 + i, mutate(r, rows[i][1], 1), "en", "s") for i in range(0, 40, 3)]
    assert got(line_dedup.dedup_lines(table(spark, rows)), "doc_id", "text", "n_lines", "n_exact", "n_near") == lines_left(rows)


def test_line_dedup_of_very_long_lines(spark):
    r = random.Random(10)
    long = "".join(r.choice("abcdef") for _ in range(30_000))
    rows = [(0, long, "en", "s"), (1, long[:9000] + "é" + long[9001:25_000] + long[25_001:], "en", "s"), (2, long[:9000] + "éàü" + long[9001:], "en", "s"), (3, long[5:], "en", "s")]
    found = got(line_dedup.dedup_lines(table(spark, rows)), "doc_id", "n_exact", "n_near")
    assert found == {0: (0, 0), 1: (0, 1), 2: (0, 0), 3: (0, 0)}


def base_figures(t):
    w = words(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    own = [x for x in (t or "").split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(own) - len(set(own)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(frame, docs):
    found = got(quality_rules.quality(frame), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in docs:
        assert found[i][:-1] == base_figures(t), i
        assert not (found[i][-1] and found[i][-2])


def test_quality_verdicts(spark):
    r = random.Random(10)
    good = [f"{a}{b}" for a in ("th", "re", "on", "st") for b in ("e", "ing", "er", "an")]
    rows = [(i, " ".join(r.choice(good) for _ in range(150)) + ".", "en", "s") for i in range(40)]
    rows += [(90, " ".join(r.choice(good).upper() + "!!" for _ in range(150)), "en", "s"), (91, " ".join(f"q{r.randrange(9999)}z" for _ in range(150)), "en", "s")]
    kept = got(quality_rules.quality(table(spark, rows)), "doc_id", "kept")
    assert all(kept[i][0] for i in range(40)) and not kept[90][0] and not kept[91][0]
    p, q = np.array([1.0, 2, 3]), np.array([2.0, 4, 6])
    assert quality_rules.distance(p, q) == pytest.approx(0, abs=1e-6) and quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_packing(frame, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(frame, capacity=256).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    total = 0
    for i, x, *_ in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 256)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    sizes = np.array([r.length for r in rows if r.length < 256])
    alone = int(packing.best_fit(sizes, 256).max()) + 1
    assert -(-total // 256) <= len(bins) == alone + sum(r.length == 256 for r in rows)


def test_ids_of_letters_come_from_the_model():
    import public_tokenizers

    own = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    whole, own.tokenizer = own.tokenizer, Watched(own.tokenizer)
    texts = ["The Straße, déjà VU. À CÔTÉ ÿes of\nmany words, (x) 12 a_b", None, "ŒUVRE İstanbul e\u0301t\u00e9 <|endoftext|> it's ª µm 日本 ÀÉÎ÷Õ×Þ"]
    ids, sizes = own.encode(pa.array(texts))
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    asked = {w for t in own.tokenizer.asked for w in t.split(packing.SEPARATOR)}
    assert "(x)" in asked and not asked & {"the", "straße", "Straße", "déjà", "vu", "À", "CÔTÉ", "many"}


def test_packing_tree(spark):
    """Small groups, so that underfull bins climb several levels; and pieces that never fit together."""
    r = random.Random(11)
    d = spark.createDataFrame([(i, r.randint(1, 100)) for i in range(3000)], "k long, length long")
    rows = packing.pack(d, capacity=100, group_items=100).collect()
    fill = Counter()
    for x in rows:
        fill[x.sequence_id] += x.length
    assert len(rows) == 3000 and max(fill.values()) <= 100
    assert len(fill) <= 1.06 * sum(x.length for x in rows) / 100
    big = packing.pack(d.withColumn("length", F.lit(60).cast("long")), capacity=100, group_items=100)
    assert big.select("sequence_id").distinct().count() == 3000
    sizes = np.array([60, 50, 50, 40])
    assert len(set(packing.best_fit(sizes, 100).tolist())) == 2


def removed(docs):
    seen, out = {}, {}
    for i, t, *_ in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = len(raw), sum(gone), sum(1 for p in range(len(raw)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest()
    return out


def test_repeats(frame, docs):
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    want = removed(docs)
    assert sum(w[1] for w in want.values())
    for block in (2000, 1 << 22):
        assert got(repeats.remove_repeats(frame, block_bytes=block, bucket_bytes=block), *columns) == want


def test_suffix_order():
    r = np.random.default_rng(12)
    raw = np.frombuffer(b"".join([b"abcab" * 30, bytes(r.integers(97, 99, 1500, dtype=np.uint8)), b"a" * 200, bytes(r.integers(97, 99, 200, dtype=np.uint8)) * 4]), np.uint8)
    order, head = repeats.sort_suffixes(repeats.words_at(raw), np.arange(len(raw) - 50))
    text = [raw[i : i + 50].tobytes() for i in order]
    assert text == sorted(text) and head[1:].tolist() == [a != b for a, b in zip(text, text[1:], strict=False)]


def test_exact_duplicates(spark, docs):
    rows = [*docs, (500, "a b\n", None, None), (501, "ab", None, None), (502, " a  b  ", None, None), (501, "ab", None, None), (None, "ab", None, None)]
    groups = defaultdict(list)
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t, *_ in rows:
        groups[key(t)].append((-len(t or ""), -1 if i is None else i))
    found = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    assert len(found) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in found:
        g = groups[key(text[r.doc_id])]
        assert (r.keep_id, r.group_size) == (None if min(g)[1] < 0 else min(g)[1], len(g))
        assert r.text_sha256 == hashlib.sha256(key(text[r.doc_id]).encode()).hexdigest()
    assert sum(r.kept for r in found) == len(groups)
    few = exact_dedup.exact_duplicates(table(spark, rows), max_bits=128)  # a full filter: every row is shuffled
    assert sorted(map(str, few.collect())) == sorted(map(str, found))


EMPTY = {
    "tokens": token_counts.count_tokens, "language": language_id.identify, "jaccard": jaccard_join.link, "mix": mixing.mix, "lines": line_dedup.dedup_lines,
    "quality": quality_rules.quality, "packing": packing.pack_documents, "repeats": repeats.remove_repeats, "exact": exact_dedup.exact_duplicates,
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", EMPTY)
def test_nulls_in_every_column_and_repeated_rows(spark, name):
    rows = [(None, None, None, None), (3, "one two three four five six", None, None), (3, "one two three four five six", None, None), (None, "one two three four five six", None, "s")]
    assert EMPTY[name](table(spark, rows)).count() >= 4


def test_empty_pages(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "id long, bad boolean")
    assert url_filter.judge(pages, labels).count() == 0
