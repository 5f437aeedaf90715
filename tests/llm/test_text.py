"""Packing, leakage and encoding repair: brute force, round trips, certificates and edge cases."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.llm import encoding, leakage, packing, queries

# packing

SIZES = st.lists(st.integers(0, 40), min_size=1, max_size=60)


@given(SIZES)
@settings(max_examples=200, deadline=None)
def test_best_fit_and_bound(sizes):
    sizes = np.array(sizes)
    bins = packing.best_fit(sizes, 40)
    fill = np.bincount(bins, weights=sizes)
    used = int((fill > 0).sum())
    assert fill.max() <= 40 and packing.lower_bound(sizes, 40) <= max(used, 0) or sizes.sum() == 0
    assert packing.lower_bound(sizes, 40) >= -(-int(sizes.sum()) // 40)


def test_bound_knows_large_items():
    assert packing.lower_bound(np.array([21] * 7), 40) == 7
    assert packing.lower_bound(np.array([14, 14, 14]), 40) == 2
    assert packing.lower_bound(np.array([30, 30, 12, 12]), 40) == 3
    assert packing.lower_bound(np.zeros(5, dtype=int), 40) == 0


def exact_bins(sizes, capacity):
    best = len(sizes)

    def put(i, rest):
        nonlocal best
        if len(rest) >= best:
            return
        if i == len(sizes):
            best = len(rest)
            return
        for k, r in enumerate(rest):
            if r >= sizes[i]:
                put(i + 1, rest[:k] + (r - sizes[i],) + rest[k + 1 :])
        put(i + 1, (*rest, capacity - sizes[i]))

    put(0, ())
    return best


def test_bound_below_exact():
    rng = random.Random(1)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        exact = exact_bins(sizes, 20)
        assert packing.lower_bound(np.array(sizes), 20) <= exact <= len(np.unique(packing.best_fit(np.array(sizes), 20)))


def test_pack_whole_items_rounds_and_certificate(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(n)) for i, n in enumerate(rng.integers(0, 900, 4000))] + [(9000, 2048), (9001, 5000), (9002, 4096), (None, 5), (9003, None), (9004, 0), (9004, 0)]
    sizes = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint").withColumn("place", F.lit("clash"))
    out = packing.pack(sizes, partition_items=500).cache()
    fill = out.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0]
    assert fill == 2048
    back = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    want = {i: n for i, n in data if i is not None and n is not None}
    assert {r["doc_id"]: r["n"] for r in back.collect()} == want
    parts = {r["doc_id"]: r["parts"] for r in back.where("doc_id >= 9000").collect()}
    assert parts == {9000: 1, 9001: 3, 9002: 2, 9004: 2}
    one = packing.certificate(out).first()
    assert one["containers"] >= one["lower_bound"] and one["fill"] > 0.98
    assert one["containers"] <= one["lower_bound"] + 5


def test_pack_empty_and_sizes(spark):
    docs = spark.createDataFrame([(1, "Hello there, general."), (2, ""), (3, None), (None, "x"), (4, "ab " * 9000)], "doc_id bigint, text string")
    sizes = {r[0]: r[1] for r in packing.token_sizes(docs).collect()}
    assert sizes[1] == 5 and sizes[2] == sizes[3] == 0 and sizes[4] > 9000 and len(sizes) == 4
    none = packing.pack(packing.token_sizes(docs.limit(0)))
    assert none.count() == 0 and packing.certificate(none).first()["containers"] == 0


# leakage

WORDS = [f"w{i}" for i in range(90)]


def item_text(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(ids, item):
    """SHARE of the words in order in some stretch, by plain dynamic programming."""
    n, need = len(item), -(-2 * len(item) // 3)
    for s in range(len(ids)):
        part = ids[s : s + 2 * n]
        best = [0] * (n + 1)
        for x in part:
            last = 0
            for j in range(n):
                keep = best[j + 1]
                if x == item[j]:
                    best[j + 1] = max(best[j + 1], last + 1)
                else:
                    best[j + 1] = max(best[j + 1], best[j])
                last = keep
        if best[n] >= need:
            return True
    return False


def test_in_stretch_equals_brute_force():
    rng = random.Random(3)
    for k in range(60):
        item = [rng.randrange(12) for _ in range(rng.randint(3, 15))]
        kept = [x for x in item if rng.random() < 0.75]
        text = [rng.randrange(14) for _ in range(rng.randint(0, 20))]
        for x in kept:
            text += [x] + [rng.randrange(14) for _ in range(rng.choice([0, 0, 1, 2]))]
        ids = np.array(item)
        masks = {}
        for i, x in enumerate(item):
            masks[x] = masks.get(x, 0) | (1 << i)
        assert leakage.in_stretch(text, leakage.Item(k, ids, masks)) == brute(text, item)


def test_shown_text():
    text = "A<!-- x\ny -->b {{t|{{u}}|v}} [[Page|shown]] [[Plain]] '''bold''' c<ref name=a>no</ref>d<ref name=b/> <br/>e &amp; f&nbsp;g [http://x.y label]\n{| class=z\n|-\n! h || i\n|}"
    assert leakage.words(text) == ["ab", "shown", "plain", "bold", "c", "d", "e", "f", "g", "label", "h", "i"]
    assert leakage.words("") == [] and leakage.words("{{unclosed <ref>") == ["unclosed"]


def test_leaks_found_and_near_misses(spark):
    rng = random.Random(5)
    items = [(i, item_text(rng, 70)) for i in range(60)]
    noise = lambda n: item_text(rng, n)
    it = lambda i: items[i][1]
    docs = {
        1: noise(100) + it(3) + noise(50),
        2: noise(300) + it(4)[10:26] + noise(300),
        3: noise(300) + it(5)[10:25] + noise(300),
        4: noise(40) + [x if k % 4 else "changed" for k, x in enumerate(it(6))] + noise(40),
        5: [x if k % 2 else "changed" for k, x in enumerate(it(7))],
        6: it(8)[::-1],
        7: noise(20) + [y for x in it(9) for y in (x, "extra")] + noise(20),
        8: it(10) + noise(500) + it(11),
        9: [],
        10: noise(3000),
        11: [w.upper() for w in it(12)],
        12: it(13)[:40] + noise(400) + it(13)[40:],
    }
    rows_ = [(k, ", ".join(v)) for k, v in docs.items()] + [(13, None), (14, "")]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(900, None), (901, "..."), (902, " ".join(it(3)))], "item_id bigint, text string")
    got = {tuple(r) for r in leakage.leaked_items(df, held).collect()}
    assert got == {(1, 3), (1, 902), (2, 4), (4, 6), (7, 9), (8, 10), (8, 11), (11, 12), (12, 13)}
    assert leakage.leaked_items(df.limit(0), held).count() == 0 and leakage.leaked_items(df, held.limit(0)).count() == 0


def test_retrieval_has_full_recall():
    """Candidates against the exact criterion over all pairs, with edits of many kinds."""
    rng = random.Random(7)
    items = [(i, " ".join(item_text(rng, rng.randint(20, 130)))) for i in range(50)]
    index = leakage.Index(items)
    texts, want = [], set()
    for t in range(120):
        i = rng.randrange(50)
        words = items[i][1].split()
        rate = rng.choice([0, 0.1, 0.2, 0.3])
        edited = [rng.choice(WORDS) if rng.random() < rate else w for w in words if rng.random() > rate / 3]
        texts.append(" ".join(item_text(rng, rng.randint(0, 400)) + edited + item_text(rng, rng.randint(0, 100))))
    ids, starts = leakage.flatten([leakage.words(t) for t in texts], index)
    for t in range(len(texts)):
        own = ids[starts[t] : starts[t + 1] - 2].tolist()
        for d, item in enumerate(index.items):
            runs = any(tuple(own[a : a + 16]) == tuple(item.ids[b : b + 16]) for b in range(len(item.ids) - 15) for a in range(len(own) - 15) if own[a] == item.ids[b])
            if runs or leakage.in_stretch(own, item):
                want.add((t, d))
    assert set(leakage.leaks(texts, index)) == want and len(want) > 60


def test_leaks_without_rare_or_near_pairs():
    rng = random.Random(8)
    items = [(i, " ".join(item_text(rng, 70))) for i in range(40)]
    first = items[0][1].split()
    # A run that repeats two pairs, in an item whose other runs are rich; and two thirds, each word apart from the next.
    items.append((40, " ".join(["a", "b"] * 8 + item_text(rng, 50))))
    apart = [y for x in first[:47] for y in (x, "zz", "zz")][:-2]
    texts = [" ".join(["yy"] * 30 + ["a", "b"] * 8 + ["yy"] * 30), " ".join(["yy"] * 100 + apart + ["yy"] * 100), " ".join(["yy"] * 9 + ["a", "b"] * 7 + ["a"])]
    assert leakage.leaks(texts, leakage.Index(items)) == [(0, 40), (1, 0)]


def test_two_thirds_at_any_spacing_are_found():
    """40 of 60 words in order in exactly 120 words, in even, random and bunched spacings; one word less is none."""
    rng = random.Random(9)
    items = [(i, " ".join(item_text(rng, 60))) for i in range(30)] + [(30, " ".join(item_text(rng, 200))), (31, "a b c")]
    texts, want = [], set()
    for t in range(60):
        i = rng.randrange(30)
        w = items[i][1].split()
        kept = sorted(rng.sample(range(60), 40 if t % 2 else 39))
        if t < 6:
            kept = list(range(40 if t % 2 else 39))
        gaps = [k for k in range(118) if k % 3] if t < 6 else sorted(rng.sample(range(120), 120 - len(kept)))
        out, at = ["zz"] * 120, [k for k in range(120) if k not in set(gaps[: 120 - len(kept)])]
        for x, k in zip(kept, at):
            out[k] = w[x]
        texts.append(" ".join(["yy"] * rng.randrange(700) + out + ["yy"] * rng.randrange(300)))
        if t % 2:
            want.add((t, i))
    texts.append("one a two b")
    want.add((60, 31))
    assert set(leakage.leaks(texts, leakage.Index(items))) == want


@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=14), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=60), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_leaks_equal_brute_force(items, texts):
    index = leakage.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    want = {(t, d) for t, text in enumerate(texts) for d, item in enumerate(items) if item and brute(text, item)}
    assert set(leakage.leaks([" ".join(t) for t in texts], index)) == want


def test_many_and_long_items():
    rng = random.Random(10)
    wide = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(wide) for _ in range(rng.choice([3, 40, 90, 700])))) for i in range(300)]
    long = items[[len(t.split()) for _, t in items].index(700)]
    text = " ".join(w for k, w in enumerate(long[1].split()) if k % 4)
    assert leakage.leaks(["x " * 5000 + text, ""], leakage.Index(items)) == [(0, long[0])]


def test_answers_are_looked_for(spark):
    held = spark.createDataFrame([(1, "one two three four five six", "Six, seven"), (2, "red green blue", None)], "item_id bigint, text string, answer string")
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four five six"), (3, "Red green blue!")], "doc_id bigint, text string")
    got = {tuple(r) for r in leakage.leaked_answers(docs, held).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 2, None)}


# encoding

CLEAN = {
    "de": "Die größere Brücke führte früher über den schönen Fluss während jede Kirche größtenteils öffnete",
    "fr": "La rivière âgée traversa le château près de la forêt où l'école célèbre était située",
    "pl": "Szkoła leży wśród większa łąka gdzie źródło i kościół służył każda świątynia później",
    "ru": "Этот город пересекла широкая река где мост открыли после церковь и станция",
    "en": "The old “harbour” opened – later – beside the town’s “market” and some river",
}


def garbled(text, written, read):
    return text.encode(written).decode(read, errors="replace")


def corpus(spark):
    rng = random.Random(1)
    docs = []
    for i in range(700):
        w = CLEAN[rng.choice(list(CLEAN))].split()
        docs.append((i, f"s{i % 2}", " ".join(rng.choice(w) for _ in range(60))))
    bad = [
        ("utf-8", "cp1252", "fr"), ("utf-8", "latin-1", "de"), ("utf-8", "cp437", "pl"), ("utf-8", "cp1251", "ru"), ("utf-8", "mac_roman", "en"),
        ("cp1251", "cp1252", "ru"), ("cp1252", "mac_roman", "fr"), ("cp1250", "cp1252", "pl"), ("cp1252", "cp437", "de"), ("koi8-r", "cp1251", "ru"),
    ]
    truth = {}
    for k, (w, r, lang) in enumerate(bad):
        words = CLEAN[lang].split()
        text = " ".join(rng.choice(words) for _ in range(60))
        try:
            wrong = text.encode(w).decode(r)
        except UnicodeDecodeError:
            wrong = text.encode(w).decode("latin-1") if r == "cp1252" else garbled(text, w, r)
        truth[1000 + k] = text
        docs.append((1000 + k, "s0", CLEAN["en"] + " " + wrong + " " + CLEAN["en"]))
    docs.append((2000, "s1", "The sign Ã comes before Р in the list. ½ mile «â» 20 °C"))
    docs += [(2001, None, None), (2002, None, ""), (2003, None, "plain ASCII"), (2004, "s1", "The � mark"), (2005, "s0", "Ž" * 5000)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("gain", F.lit("clash")), truth


@pytest.fixture(scope="module")
def repaired(spark):
    df, truth = corpus(spark)
    return {r["doc_id"]: r for r in encoding.wrongly_decoded(df).collect()}, truth


def test_affected_documents_are_found(repaired):
    found, truth = repaired
    assert set(found) == set(truth) | {2004}


def test_texts_are_restored(repaired):
    found, truth = repaired
    exact = [i for i, t in truth.items() if found[i]["repaired"] == CLEAN["en"] + " " + t + " " + CLEAN["en"]]
    assert len(exact) >= 8


def test_double_decoding_is_undone(spark):
    df, _ = corpus(spark)
    twice = garbled(garbled("rivière château forêt", "utf-8", "latin-1"), "utf-8", "latin-1")
    more = spark.createDataFrame([(5000, "s0", twice, "")], "doc_id bigint, source string, text string, gain string")
    out = {r["doc_id"]: r["repaired"] for r in encoding.wrongly_decoded(df.unionByName(more)).collect()}
    assert out[5000] == "rivière château forêt"


@pytest.mark.parametrize("written, read, lang, share", [("cp1251", "cp1252", "ru", 9), ("cp1251", "cp1252", "ru", 1), ("utf-8", "cp1252", "fr", 1), ("cp1252", "mac_roman", "fr", 9)])
def test_source_that_is_always_misread(spark, written, read, lang, share):
    """A third of all rows misread alike, so that the garbled letters are frequent themselves, with `share` 1 more
    frequent than the right ones."""
    rng = random.Random(4)
    docs = []
    for i in range(600):
        language = lang if i % 3 == 0 else rng.choice([lang] * share + [*CLEAN])
        text = " ".join(rng.choice(CLEAN[language].split()) for _ in range(60))
        wrong = i % 3 == 0
        docs.append((i, "misread" if wrong else f"s{i % 2}", garbled(text, written, read) if wrong else text, text))
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, truth string")
    out = {r["doc_id"]: r["repaired"] for r in encoding.wrongly_decoded(df).collect()}
    assert set(out) == {i for i, *_ in docs if i % 3 == 0}
    assert sum(out[i] == truth for i, _, _, truth in docs if i in out) >= 180


def test_every_stretch_of_a_long_text_is_repaired(spark):
    df, _ = corpus(spark)
    right = " ".join(CLEAN["ru"].split()[:2])
    parts = [x for _ in range(20) for x in (CLEAN["de"] + " " + CLEAN["de"], right)]
    wrong = " ".join(garbled(x, "cp1251", "cp1252") if x == right else x for x in parts)
    more = spark.createDataFrame([(6000, "s0", wrong, "")], "doc_id bigint, source string, text string, gain string")
    out = {r["doc_id"]: r for r in encoding.wrongly_decoded(df.unionByName(more)).collect()}
    assert out[6000]["repaired"] == " ".join(parts) and len(out[6000]["swaps"]) > 12


def test_nothing_to_do(spark):
    df, _ = corpus(spark)
    assert encoding.wrongly_decoded(df.limit(0)).count() == 0
    assert encoding.wrongly_decoded(df.where("doc_id < 50")).count() == 0


def test_cipher_is_learned_from_bigrams_alone():
    """An unknown substitution of Russian letters, found without any start from their contexts."""

    rng = random.Random(2)
    vocabulary = CLEAN["ru"].lower().split() + "дом дорога вода гора лес поле ветер город народ слово дело время".split()
    text = " ".join(rng.choice(vocabulary) for _ in range(6000))
    size = len(encoding._classes()[1])
    u = encoding._units(text)
    counts = np.bincount(u[:-1] * size + u[1:], minlength=size * size)
    at = np.flatnonzero(counts)
    model = encoding.bigram_model(pd.DataFrame({"a": at // size, "b": at % size, "n": counts[at]}))
    letters = sorted(set(text) - {" "})
    hidden = rng.sample(letters, 6)
    targets = [chr(0x2500 + i) for i in range(6)]
    swap = {a: b for a, b in zip(hidden, targets)}
    garbled_text = "".join(swap.get(c, c) for c in text)
    triples = {}
    for x, y, z in zip(garbled_text, garbled_text[1:], garbled_text[2:]):
        if y in targets:
            triples[ord(x), ord(y), ord(z)] = triples.get((ord(x), ord(y), ord(z)), 0) + 1
    contexts = pd.DataFrame([(*k, n) for k, n in triples.items()], columns=["before", "symbol", "after", "n"])
    learned = encoding.maximize(contexts, model, rounds=20)
    right = sum(learned.get(ord(b)) == a for a, b in swap.items())
    assert right >= 4


@pytest.mark.parametrize(("written", "read", "lang"), [("iso8859_5", "cp1252", "ru"), ("cp1252", "cp1253", "fr"), ("cp852", "cp1252", "pl"), ("iso8859_2", "cp1253", "pl"), ("cp1251", "cp1256", "ru")])
def test_pair_of_pages_that_is_not_listed_is_proposed(spark, written, read, lang):
    """Documents misread by any pair of pages are found and come back letter by letter; the others stay."""
    rng = random.Random(11)
    docs, true = [], {}
    for i in range(900):
        own = lang if i < 60 else rng.choice(list(CLEAN))
        text = " ".join(rng.choice(CLEAN[own].split()) for _ in range(60))
        if i < 60:
            true[i] = text.encode(written, "ignore").decode(written)
            text = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in true[i].encode(written))
        docs.append((i, f"s{i % 3}", text))
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r["repaired"] for r in encoding.wrongly_decoded(df).collect()}
    assert set(got) <= set(true) and len(got) >= 0.9 * len(true)
    letters = [(a, b) for i, text in got.items() for a, b in zip(text, true[i]) if not b.isascii()]
    assert sum(a == b for a, b in letters) >= 0.98 * len(letters)


def test_learned_tables_are_never_worse_than_their_pages(spark):
    """Letters of ASCII are never learned, and no symbol leaves its page without many places that say so."""
    model = encoding.bigram_model(encoding.language_counts(corpus(spark)[0]).toPandas())
    start = encoding.code_page_table("cp1252", "cp1250")
    rng = random.Random(12)
    seen = {}
    for _ in range(300):
        w = " " + rng.choice(CLEAN[rng.choice(["de", "fr", "en"])].split()) + " "
        g = garbled(w, "cp1252", "cp1250")
        for x, y, z in zip(g, g[1:], g[2:]):
            if ord(y) in start:
                seen[ord(x), ord(y), ord(z)] = seen.get((ord(x), ord(y), ord(z)), 0) + 1
    seen.update({(ord("a"), ord("“"), ord("b")): 4, (ord("x"), ord("”"), ord("q")): 9, (ord(" "), ord("’"), ord("s")): 50})
    table = encoding.maximize(pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["before", "symbol", "after", "n"]), model, start)
    assert all(table[k] == v for k, v in start.items()) and not any(c.isascii() for c in table.values())


def test_clean_texts_propose_nothing(spark):
    assert encoding.propose(encoding.language_counts(corpus(spark)[0].select("source", "text").limit(0)).toPandas()) == ()
    rng = random.Random(13)
    texts = [(" ".join(rng.choice(CLEAN[own].split()) for _ in range(80)), "s") for own in CLEAN for _ in range(60)]
    counts = encoding.language_counts(spark.createDataFrame(texts, "text string, source string")).toPandas()
    assert encoding.propose(counts) == ()


# queries


def test_queries_are_registered(spark):
    assert {"p8_pack", "p9_found", "p10_found"} <= set(queries.QUERIES)


def test_queries_on_small_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "one two three")], "doc_id bigint, source string, text string")
    items = spark.createDataFrame([(7, "t", "one two three")], "item_id bigint, task string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "eval_items.parquet"))
    d = str(tmp_path)
    assert rows(queries.p9_found(spark, d)) == [(1, 7)] and rows(queries.p9_report(spark, d)) == [(7, "t", 1)]
    assert queries.p8_pack(spark, d).count() == 1 and queries.p8_certificate(spark, d).first()["lower_bound"] == 1
    assert queries.p10_found(spark, d).count() == 0 and queries.p10_repaired(spark, d).count() == 0
