"""Each corpus operator against a brute-force version, and through the rows of `cases`."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tests.llm import cases
from tokenizers import Tokenizer

from recordvol.llm import ann, exact_dedup, language_id, mixing, packing, quality, simhash, token_output, toxicity, url_filter
from recordvol.llm._common import stored
from recordvol.llm._common import followed
from recordvol.llm.components import components
from recordvol.llm.queries import tokenizer_file
from recordvol.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def library_ids(name, text):
    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


# 1 language ID


def test_language_held_out_accuracy(spark, real):
    found = language_id.identify(real, language_id.fit(real)).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_cases(spark, real):
    model = language_id.fit(real)
    found = language_id.identify(cases.docs(spark), model).collect()
    assert len(found) == 13
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 7} and all(r["score"] == 0 and not r["accepted"] for r in found if r["doc_id"] in und)
    kept = language_id.keep_identified(cases.docs(spark), model)
    assert kept.columns == cases.docs(spark).columns
    assert same_rows([r["doc_id"] for r in kept.collect()], [r["doc_id"] for r in found if r["accepted"]])
    foreign = cases.docs(spark, [(1, "Это предложение написано на другом языке", None, None)])
    assert not language_id.identify(foreign, model).first()["accepted"]


def test_language_without_labels_or_rows(spark):
    none = language_id.fit(cases.no_docs(spark))
    assert {r["lang_pred"] for r in language_id.identify(cases.docs(spark), none).collect()} == {"und"}
    assert language_id.identify(cases.no_docs(spark), none).count() == 0


def kneser_ney(counts):
    """Log probability of a word by the recursion over dictionaries."""
    edge, most = language_id.EDGE, language_id.ORDER
    tables = []
    for n in range(1, most + 1):
        seen = {}
        for w, times in counts.items():
            padded = edge + w + edge
            for i in range(max(1, n - 1), len(padded)):
                g = padded[i - n + 1 : i + 1]
                seen[g] = seen.get(g, 0) + times
        tables.append(seen)
    for n in range(1, most):
        before = {}
        for g in tables[n]:
            before[g[1:]] = before.get(g[1:], 0) + 1
        tables[n - 1] = {g: c if (n > 1 and g[0] == edge) or g not in before else before[g] for g, c in tables[n - 1].items()}

    def chance(g):
        n = len(g)
        if n == 0:
            return None
        table = tables[n - 1]
        values = list(table.values())
        one, two = values.count(1), values.count(2)
        discount = one / (one + 2 * two) if one and two else 0.5
        own = {x: c for x, c in table.items() if x[:-1] == g[:-1]}
        lower = chance(g[1:]) if n > 1 else language_id.UNSEEN
        if not own:
            return lower
        total = sum(own.values())
        return (max(own.get(g, 0) - discount, 0) if g in own else 0) / total + discount * len(own) / total * lower

    def word(w):
        padded = edge + w + edge
        return sum(np.log(chance(padded[max(0, i - most + 1) : i + 1])) for i in range(1, len(padded)))

    return word


def test_kneser_ney_against_the_recursion():
    counts = {"abab": 3, "abc": 2, "ba": 1, "cabbage": 1, "bag": 4, "a": 2}
    model, brute = language_id.train("x", counts), kneser_ney(counts)
    words = ["ab", "abab", "cab", "bagabc", "zebra", "g", "aaaaaaa"]
    assert np.allclose(language_id.word_scores(words, [model])[:, 1], [brute(w) for w in words], rtol=1e-5)
    assert language_id.word_scores(words, [model])[:, 0].tolist() == [len(w) + 1 for w in words]


# 2 and 9 tokens


def test_token_files_round_trip(spark):
    docs = cases.docs(spark)
    path = token_output.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), "joined", 2, 50_257)
    found = token_output.read_tokens(spark, path).orderBy("start").collect()
    want = {(r["doc_id"], crc(library_ids("byte_bpe_50k.json", r["text"]) + [2])) for r in docs.collect()}
    assert {(r["doc_id"], crc(np.frombuffer(r["ids"], "<u4"))) for r in found} == want and len(found) == 13
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == sorted(ids)
    empty = token_output.write_tokens(cases.no_docs(spark), tokenizer_file("byte_bpe_50k.json"), "joined", 2, 50_257)
    assert token_output.read_tokens(spark, empty).count() == 0


def test_byte_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = token_output.code(values)
        assert (token_output.decode(control, data, n) == values).all() and len(control) == -(-n // 4)


@pytest.mark.parametrize("capacity", [8, 2048])
def test_packing(spark, capacity):
    docs = cases.docs(spark)
    rows = packing.pack_sequences(docs, tokenizer_file("word_bpe_49k.json"), "dropped", 1, capacity).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], library_ids("word_bpe_49k.json", r["text"]) + [1])
    assert all(list(np.frombuffer(r["ids"], "<u4")) == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows)
    assert sum(r["length"] for r in rows) == sum(len(ids[r["doc_id"]]) for r in docs.collect())
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity and (n & (n - 1) == 0 or n > 0.97 * capacity) for n in bins.values())
    assert packing.pack_sequences(cases.no_docs(spark), tokenizer_file("word_bpe_49k.json"), "dropped", 1).count() == 0


# 3 toxicity


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(i, " ".join([*(word() for _ in range(30)), *(["vileword"] if i % 5 == 0 else [])]), "en", "s") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    docs = cases.docs(spark, rows)
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).where("held_out").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in found]) > 0.95
    assert len(model.places) < 1000
    odd = toxicity.score(cases.docs(spark), model).collect()
    assert len(odd) == 13 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(cases.no_docs(spark), model).count() == 0
    alone = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(docs, alone).collect()} == {0}


def test_ftrl_against_plain_loops():
    rng = random.Random(3)
    rows = [([rng.randrange(50) for _ in range(6)], rng.randrange(2)) for _ in range(300)]
    fast = toxicity.Ftrl()
    z, n, bias_z, bias_n = [0.0] * 50, [0.0] * 50, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((b + n**0.5) / a + l2)
    for places, label in rows:
        at, count = np.unique(places, return_counts=True)
        fast.learn(at, 1 + np.log(count), label)
        w = {i: weight(z[i], n[i], l1) for i in at.tolist()}
        bias = weight(bias_z, bias_n, 0.0) if bias_z else 0.0
        p = 1 / (1 + np.exp(-(sum(w[i] * (1 + np.log(places.count(i))) for i in w) + bias)))
        for i in w:
            g = (p - label) * (1 + np.log(places.count(i)))
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
            n[i] += g * g
        g = p - label
        bias_z, bias_n = bias_z + g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / a * bias, bias_n + g * g
    assert np.allclose(fast.weights()[:50], [weight(*x, l1) for x in zip(z, n)], atol=1e-9)
    assert np.isclose(fast.intercept(), weight(bias_z, bias_n, 0.0), atol=1e-9)


def test_toxicity_of_labels_without_documents(spark):
    docs = cases.docs(spark, [(i, "some words", "en", "s") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000, 1100)] + [(1, 0), (2, 0)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert {r["predicted"] for r in found} == {0} and all(r["score"] < 1e-6 for r in found)


# 4 URL filter


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.action if best else "allow"


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a+b.com", "/x(y"), Rule("block", "org", "/fr/se")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x#y", "http://example.net", "http://example.net/", "http://xexample.net/en/", "ftp://a.b.org/fr/secret", "http://org/fr/", "http://com.example.com/de/#a/b", "://net/", "http://x.a+b.com/x(yz", "http://ÄB.net/ü", "http://evil.com/a.net/", "http://a.net?b/c", "http://a.net#/en/"]


@pytest.mark.parametrize("inline", [100, 0])
def test_url_filter(spark, inline):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, token string")
    found = url_filter.judge(pages, RULES, inline=inline)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {i: verdict(u, RULES) for i, u in enumerate(URLS * 2)}
    assert url_filter.judge(pages.where("false"), RULES, inline=inline).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_pieces_of_classes():
    for n in range(5000):
        found = packing.cuts(n, 2048)
        assert sum(length for length, _ in found) == n
        assert all(0 < length <= 2048 // k and k * length >= 2048 - max(2048 // 64, k - 1) for length, k in found)
    assert np.mean([len(packing.cuts(n, 2048)) for n in range(2048)]) < 3.6


# 5 quality


def test_quality(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    good = lambda: " ".join(word() for _ in range(30)) + "."
    bad = lambda: " ".join(word() + "$$$" for _ in range(30))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", f"s{i % 3}") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in [*range(300), *range(9000, 9500)]], "doc_id long, quality int")
    pages = spark.createDataFrame([(i, f"https://{'a' if i % 4 else 'b'}.example.{'com' if i % 4 else 'net'}/x?y#z") for i in range(400)] + [(None, "x"), (3, None), (3, "http://z")], "page_id long, url string")
    docs = cases.docs(spark, rows)
    for given in (None, pages):
        table = stored(quality.features(docs, given), "features")
        model = quality.fit(table, labels)
        found = quality.score(table, model).collect()
        assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in found]) > 0.95
        assert (found[0]["metadata_weight"] > 0.05) == (given is not None)
        odd = quality.features(cases.docs(spark), given)
        assert quality.score(odd, model).count() == 13
        assert quality.score(quality.features(cases.no_docs(spark), given), model).count() == 0
    assert {r["score"] for r in quality.score(table, quality.fit(table, labels.where("false"))).collect()} == {0.5}
    assert {r["score"] for r in quality.score(table, quality.fit(table, labels.where("doc_id >= 9000"))).collect()} == {0.5}
    assert {r["score"] for r in quality.score(table, quality.fit(table, labels.where("quality = 1"))).collect()} == {1.0}


def test_quality_text_view_against_plain_counts():
    texts = ["The cat, the dog!! 12 a|b", None, "", "ÀB àb 3.5 $$$ x"]
    view = quality.text_view(pa.array(texts))
    mix = lambda x, n: (((x ^ (x >> 29)) * int(quality._A)) % 2**64 >> 33) % n

    def shape(t):
        t = regex.sub(r"\p{Lu}+", "A", t)
        t = regex.sub(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a", t)
        return regex.sub(r"[^\p{L}\p{N}]{2,}", "##", regex.sub(r"\p{N}+", "0", t))

    for row, text in zip(view, texts):
        for first, places, name in ((0, quality.WORDS, lambda t: regex.sub(r"[^\p{L}]+", "", t.lower())), (quality.WORDS, quality.SHAPES, shape)):
            h = [xxhash.xxh64_intdigest(name(t)) | 1 if name(t) else 0 for t in (text or "").split()]
            counts = np.zeros(places)
            for x in h:
                if x:
                    counts[mix(x * int(quality._B) % 2**64, places)] += 1
            for x, y in zip(h, h[1:]):
                if x and y:
                    counts[mix((x * int(quality._C) + y) % 2**64, places)] += 1
            want = np.log1p(counts) / max(np.linalg.norm(np.log1p(counts)), 1e-9)
            assert np.allclose(row[first : first + places], want, atol=1e-5)


def test_quality_hands_over_only_beyond_the_base_rate():
    prior = np.log(0.85 / 0.15)
    odds = np.array([prior + 0.5, prior + 1.5, prior + 2.5, 1.2, 0.1, -0.1, -3.0])
    good, bad = quality.surest(odds, np.arange(7), prior, 1, 5)
    assert good.tolist() == [2] and bad.tolist() == [6, 5]
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((300, 3)), rng.integers(0, 2, 300).astype(float)
    w = quality._logistic(x, y)
    slow = np.zeros(4)
    for _ in range(20000):  # plain gradient steps
        p = 1 / (1 + np.exp(-(x @ slow[:3] + slow[3])))
        slow -= 0.01 * np.append(x.T @ (p - y) + slow[:3], (p - y).sum())
    assert np.allclose(w, slow, atol=1e-3)


# 6 nearest neighbours


def test_neighbours_exact_when_few_and_odd_vectors_stay_out(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:120] = x[0]  # many copies
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)]
    odd = [(1000, None, "n"), (1050, [0.0] * 8, "n"), (1100, [float("nan")] + [1.0] * 7, "n"), (1150, [None] + [1.0] * 7, "n"), (1200, [1.0] * 3, "n"), (1250, [float("inf")] + [1.0] * 7, "n"), (None, [1.0] * 8, "n"), (1300, [], "n")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node string")
    got = {}
    for r in ann.neighbours(vectors, "vec_id % 50 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    y = x.astype(float)
    cos = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    assert sorted(got) == list(range(0, 300, 50))
    for q, found in got.items():
        order = [i for i in np.lexsort((np.arange(300), -np.round(cos[q], 9))) if i != q][:5]
        assert [i for _, i, _ in sorted(found)] == order
        assert np.allclose([s for _, _, s in sorted(found)], cos[q][order])
    assert ann.neighbours(vectors.where("false"), "true").count() == 0


def test_neighbours_of_any_magnitude_and_exact_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 6))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, [1e200, 1e-200, 1.0, 1e-300] * 10))]
    rows += [(100 + i, (x[0] * 2.0**i).tolist()) for i in range(-9, 0)] + [(100 + i, (x[0] * (i + 1)).tolist()) for i in range(10)]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0 or vec_id = 7").collect()
    near = {r["rank"]: (r["vec_id"], r["score"]) for r in found if r["query_id"] == 0}
    assert [near[i][0] for i in range(1, 6)] == [91, 92, 93, 94, 95] and {s for _, s in near.values()} == {1.0}
    assert all(abs(r["score"]) <= 1 for r in found) and len(found) == 10


def test_parts_hold_leaves_once():
    sizes = np.array([3, 0, 5, 12, 2, 2, 1])
    parts = ann.Parts.of(sizes, 5)
    assert parts.number.tolist() == [1, 1, 1, 3, 1, 1, 1]
    load = {}
    for first, n, size in zip(parts.first, parts.number, sizes):
        for p in range(first, first + n):
            load.setdefault(p, []).append(size / n)
    assert all(sum(x) <= 5 for x in load.values()) and all(len(load[p]) == 1 for p in range(parts.first[3], parts.first[3] + 3))


def test_neighbour_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.neighbours(vectors, "vec_id % 100 = 0").collect()
    cos = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    np.fill_diagonal(cos, -2)
    hits = sum(r["vec_id"] in np.argsort(-cos[r["query_id"]])[:5] for r in found)
    assert hits / (60 * 5) >= 0.9


# 7 exact dedup


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, bits):
    docs = cases.docs(spark)
    rows = docs.select("doc_id", "text").collect()
    same = {}
    for r in rows:
        same.setdefault(cases.normal(r["text"]), []).append(r["doc_id"])
    want = [(r["doc_id"], min((i for i in same[t] if i is not None), default=None), len(same[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [cases.normal(r["text"])]]
    found = exact_dedup.groups(docs, digest_bits=bits).collect()
    assert same_rows([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found], want)
    assert sum(r["kept"] for r in found) == len(same) and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    kept = exact_dedup.deduplicate(docs, digest_bits=bits)
    assert kept.columns == docs.columns
    assert same_rows([r["doc_id"] for r in kept.collect()], [r["doc_id"] for r in found if r["kept"]])
    assert exact_dedup.groups(cases.no_docs(spark)).count() == 0 and exact_dedup.deduplicate(cases.no_docs(spark)).count() == 0


# 8 SimHash


def test_simhash_cases(spark):
    docs = cases.docs(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [cases.fingerprint(r["text"]) for r in rows]
    linked = cases.smallest_linked(prints, [r["doc_id"] for r in rows], 2)
    found = simhash.near_duplicates(docs).collect()
    assert same_rows([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found], [(r["doc_id"], p, c) for r, p, c in zip(rows, prints, linked)])
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({(c, p if c is None else 0) for p, c in zip(prints, linked)})
    assert simhash.near_duplicates(cases.no_docs(spark)).count() == 0 and simhash.deduplicate(cases.no_docs(spark)).count() == 0


@pytest.mark.parametrize(("segments", "tile"), [(4, 1 << 15), (8, 5), (16, 1 << 15), (2, 20)])
def test_links_are_complete(spark, segments, tile):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:40]:
        for _ in range(3):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    roots = {r["node"] % 2**64: r["root"] for r in components(simhash.links(nodes, 2, segments, tile)).collect()}
    want = cases.smallest_linked(values, values, 2)
    groups, brute = {}, {}
    for v, w in zip(values, want):
        groups.setdefault(roots.get(v, ("alone", v)), set()).add(v)
        brute.setdefault(w, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(1000, 1201)}) == 1 and found[0] != found[1000]


@pytest.mark.parametrize("least", [1, 50, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_followed_is_a_join_whatever_is_hot(spark, how, least):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else 1 if i % 3 else i) for i in range(200)], "i long, k long")
    table = spark.createDataFrame([(k, -k) for k in [1, *range(3, 150)]], "k long, v long")
    got, want = followed(rows, table, "k", how, least), rows.join(table, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_components_of_a_large_star(spark):
    star = [(0, 1 + i) for i in range(3000)] + [(3000 + i, 3001 + i) for i in range(5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert len(found) == 3006 and set(found.values()) == {0}


# 10 mixing


def test_mixing(spark, real):
    rows = mixing.plan(real).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["copies"] <= 3
        s = by.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["size"] * r["copies"]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(by))}
    capped = set()
    while True:
        rest = total - sum(3 * by[s][0] for s in capped)
        share = rest / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in by if s not in capped and share * weights[s] > 3 * by[s][0]}
        if not over:
            break
        capped |= over
    for s, (size, taken, target) in by.items():
        assert target == pytest.approx(3 * size if s in capped else share * weights[s])
        assert abs(taken - target) <= max(0.02 * target, 400)
    again = mixing.plan(real.repartition(3)).collect()
    assert same_rows([(r["doc_id"], r["copies"]) for r in rows], [(r["doc_id"], r["copies"]) for r in again])


def test_mixing_levels_and_cases(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 50), "en", "big" if i % 3 else "small") for i in range(900)]
    docs = cases.docs(spark, rows)
    small = mixing.plan(docs, block=32).collect()
    for s in ("big", "small"):
        own = [r for r in small if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 60
    odd = mixing.plan(cases.docs(spark)).collect()
    assert len(odd) == 13 and {r["source"] for r in odd} == {None, "", "a", "b", "c"}
    mixed = mixing.mix(cases.docs(spark))
    assert mixed.columns == cases.docs(spark).columns
    assert mixed.count() == sum(r["copies"] for r in odd if r["size"])
    assert mixing.plan(cases.no_docs(spark)).count() == 0 and mixing.mix(cases.no_docs(spark)).count() == 0


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(7)
    chance, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    out, left = mixing.flight(chance, size, rng)
    assert len(left) <= 2 and set(np.unique(np.delete(out, left))) <= {0.0, 1.0}
    assert out.sum() == pytest.approx(chance.sum(), abs=1e-6) and (out * size).sum() == pytest.approx((chance * size).sum(), rel=1e-6)
