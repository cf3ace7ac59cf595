"""Operators on documents: edge cases with defined results, and brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import common, decontaminate, langid, licenses, line_dedup, ngram_join, packing, quality
from brindle.llm.components import components
from brindle.llm.queries import tokenizer_path, vocabulary_path

SF = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- quality ---------------------------------------------------------------------------------


def brute_measure(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(w)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len({j for i, x in enumerate(w) if c[x] > 1 for j in range(i, i + 3)})


def test_measure_is_brute_force(spark):
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "\n", "é ", " ", "a b c ", "#", "\x0b", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert quality.measure(t) == brute_measure(t)
    assert quality.measure(None) == (0, 0, 0, 0, 0)


def test_quality_edges(spark, odd_docs):
    got = quality.assess(odd_docs).collect()
    assert len(got) == 11 and sum(r["kept"] for r in got if r["doc_id"] == 1) == 2
    by = {r["doc_id"]: r for r in got}
    assert by[3]["base_failed"] and by[4]["base_failed"] and by[7]["base_failed"] and not by[7]["kept"]
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert quality.assess(odd_docs.limit(0)).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(400)] + [(1000 + i, good if i % 10 else "short", f"h{i % 9}") for i in range(400)]
    got = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("kept and doc_id < 1000").count() == 0
    assert got.where("kept and doc_id >= 1000").count() == 360


# --- n-gram join -----------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split() if (t or "").isascii() else [x.decode().translate({c: c + 32 for c in range(65, 91)}).encode() for x in (t or "").encode().split()]
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a][1] & sets[b][1])
            if n and den * n >= num * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return {i: (len(s), least[find(a)]) for a, (i, s) in enumerate(sets)}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_join_is_brute_force(spark, k, num):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = []
    for _ in range(120):  # one large group around a base, of all degrees of likeness
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    common = " ".join(base[:25])
    texts += [common + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 90))) for _ in range(60)]
    texts += ["", None, "a b", "A B", "a", "a"] + texts[:5]
    giant = "g" * (2 << 20)  # one word, longer than what is split at once
    one = "a"
    for _ in range(10):  # two words of 1024 letters on which polynomials modulo a power of two agree
        one += one.translate(str.maketrans("ab", "ba"))
    texts += [giant, " " + giant, one, one.translate(str.maketrans("ab", "ba")), "\u00c4 x", "\u00e4 x", "x\u00a0y z", "x y z"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs_of(spark, texts), k, num, 100).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_words_do_not_depend_on_where_a_part_ends(monkeypatch):
    rng = random.Random(12)
    data = "".join(rng.choice(["ab", "Q", " ", "\n", "\u00e9", "\t\t", "long" * 9]) for _ in range(400)).encode()
    want = ngram_join.word_hashes(data)
    assert len(want) == len(data.split())
    for part in (1, 2, 7, 64):
        monkeypatch.setattr(ngram_join, "_PART", part)
        assert ngram_join.word_hashes(data).tolist() == want.tolist()


def test_hot_safe_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 1, None, None, *range(2, 40)]), rng.choice(["x", "x", None, "y"])) for i in range(2000)]
    left = spark.createDataFrame(rows, "id long, k int, s string")
    right = left.where("k is null or k % 3 <> 0").groupBy("k", "s").agg(F.count("*").alias("w"), F.max("id").alias("top")).withColumnsRenamed({"k": "rk", "s": "rs"})
    assert common._hot(right, F.xxhash64("rk", "rs"), "w")
    top = {(r["rk"], r["rs"]): r["top"] for r in right.collect()}
    on = [("k", "rk"), ("s", "rs")]
    got = common.hot_safe_join(left, right, on, "w", F.col("id"), ["top"]).collect()
    assert sorted((r["id"], r["top"] or -1) for r in got) == sorted((i, top.get((k, s), -1)) for i, k, s in rows)
    got = common.hot_safe_join(left, right, on, "w", F.col("id"), ["top"], how="inner").collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, k, s in rows if (k, s) in top)


def test_prefix_scheme_loses_nothing():
    rng = random.Random(5)
    hot = np.sort(np.asarray([rng.getrandbits(64) for _ in range(40)], np.uint64))
    counts = np.asarray([rng.randint(2, 5000) for _ in hot])
    for _ in range(300):
        n = rng.randint(5, 60)
        x = {int(v) for v in rng.sample(list(hot), rng.randint(0, 30))} | {rng.getrandbits(64) for _ in range(n)}
        y = set(x)
        for _ in range(rng.randint(0, 4)):
            y.discard(rng.choice(sorted(y)))
            y.add(rng.getrandbits(64))
        o = len(x & y)
        if 100 * o < 80 * len(x | y):
            continue
        (l1, p), (l2, q) = (ngram_join.prefix(np.sort(np.asarray(sorted(s), np.uint64)), hot, counts, 80, 100) for s in (x, y))
        assert len(set(p.tolist()) & set(q.tolist())) >= min(l1, l2)


def test_one_of_each(spark, odd_docs):
    out = ngram_join.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert ids == sorted((i is None, i or 0) for i in [1, 3, 4, 5, 6, 7, None, 9, 10])
    assert ngram_join.one_of_each(odd_docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["comp"]].add(r["node"])
    assert sorted(map(len, groups.values())) == [30, 41]


# --- packing ---------------------------------------------------------------------------------


def test_encoder_is_the_library(spark):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice(["a", "B", " ", "  ", "\n", "\n ", "é", "'s", "12", "!", "ß", "　", "½", "<|endoftext|>", "\t"]) for _ in range(rng.randint(0, 25)))
        want = tok.encode(t, add_special_tokens=False).ids
        assert list(np.frombuffer(enc.encode(t), "<u4")) == want, repr(t)


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 30))}
        used = Counter()
        for lengths, k in packing.plan(counts, 64):
            assert sum(lengths) <= 64 and k > 0
            for n in lengths:
                used[n] += k
        assert used == counts


def test_packing_round_trip(spark, odd_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(odd_docs, tokenizer_path()).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 2048
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    per = defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
    assert per.keys() == text.keys() and len(per[1]) == 2
    for i, pieces in per.items():
        ids = tok.encode(text[i] or "", add_special_tokens=False).ids + [0]
        if i == 1:
            pieces = pieces[:1]
        assert sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            own = np.asarray(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(own) == p["ids_crc32"]
    assert packing.pack(odd_docs.limit(0), tokenizer_path()).count() == 0


# --- language --------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    m = langid.Model(["a"], {"▁ab": 2, "▁a": 3, "b": 4, "c": 5, "bc": 6}, np.asarray([[0], [0.01], [0.2], [0.3], [0.1], [0.15], [0.25]]))
    want = 0.01 * 0 + (0.2 * 0.15) + 0.3 * (0.1 * 0.15 + 0.25)
    # the start sign alone is a letter without a piece, then a has none either
    want += 0.01 * 0.01 * (0.1 * 0.15 + 0.25)
    assert np.isclose(np.exp(m.forward(["abc"])[0, 0]), want)


def every_split(word, prob, lone):
    """Sum over all ways to cut a word into pieces, one by one."""
    if not word:
        return 1.0
    return sum(prob.get(word[:k], lone if k == 1 else 0.0) * every_split(word[k:], prob, lone) for k in range(1, len(word) + 1))


def test_forward_is_brute_force_at_any_length(monkeypatch):
    rng = random.Random(6)
    pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(20)} | {langid.START + "a", langid.START})
    table = np.asarray([[0, 0]] + [[rng.random() / 3, rng.random() / 3] for _ in range(len(pieces) + 1)])
    m = langid.Model(["x", "y"], {p: i + 2 for i, p in enumerate(pieces)}, table)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 5, 9, 11)]
    want = [[np.log(every_split(langid.START + w, {p: table[i + 2][j] for i, p in enumerate(pieces)}, table[1][j])) for j in (0, 1)] for w in words]
    assert np.allclose(m.forward(words), want)
    assert np.allclose([m.forward_long(w) for w in words], want)
    monkeypatch.setattr(langid, "LONG", 4)  # the same score whichever way a word goes
    assert np.allclose(m.forward(words), want) and np.allclose(m.word_rows(words), want)


def test_numbers_are_no_letters():
    m = langid.Model(["a"], {"x": 2}, np.asarray([[0], [0.1], [0.5]]))
    assert m.score(["\u00bd \u00b2 \u2460 12", "x", "\u0928\u092e\u0938\u094d\u0924\u0947"]) == [("und", 0.0), ("a", 1.0), ("a", 1.0)]
    assert langid.words_of("\u0928\u092e\u0938\u094d\u0924\u0947 a1b") == ["\u0928\u092e\u0938\u094d\u0924\u0947", "a", "b"]


def test_the_whole_vocabulary_is_used():
    v = langid.vocabulary(vocabulary_path())
    assert langid.longest(v) > 12 and len(v) > 22_000


def test_copies_teach_once_and_many_labels_are_no_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    rows = [("eins zwei drei vier", "de")] * 500 + [(f"one two three {w}", "en") for w in "abcdefgh"] + [(f"uno dos tres {w}", "es") for w in "abc"] + [("un deux", "fr")] + [(f"x{i}", f"l{i:02}") for i in range(40)]
    m = langid.train(spark.createDataFrame(rows, "text string, lang string"), vocabulary_path(), sample=4)
    assert len(m.langs) == 3 and "en" in m.langs and "es" in m.langs


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, vocabulary_path()).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() > 100 and got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_edges(spark, odd_docs):
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, vocabulary_path()).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[9]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")), vocabulary_path()).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), vocabulary_path()).count() == 0


# --- line dedup ------------------------------------------------------------------------------


def brute_dedup(rows):
    import hashlib

    chunks = {}
    for i, t in rows:
        own = []
        if t is not None and "\n" in t:
            lines = t.split("\n")
            h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
            first = 0
            for j in range(len(lines)):
                if j == len(lines) - 1 or (h[j] + (h[j - 1] if j else 0) * line_dedup.BASE) % line_dedup.DIVISOR == 0:
                    own.append((first, j, "\n".join(lines[first : j + 1])))
                    first = j + 1
        chunks[i] = own
    keeper = {}
    for i, _ in rows:
        for n, (a, b, body) in enumerate(chunks[i]):
            if b > a:
                keeper[body] = min(keeper.get(body, (i, n)), (i, n))
    out = {}
    for i, t in rows:
        if t is None or not chunks[i]:
            out[i] = t
            continue
        out[i] = "\n".join(body for n, (a, b, body) in enumerate(chunks[i]) if b == a or keeper[body] == (i, n))
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(8)
    lines = [f"line {i} of text" for i in range(40)]
    passage = [f"shared {i}" for i in range(12)]
    texts = [None, "", "one", "a\nb"]
    for _ in range(60):
        t = [rng.choice(lines) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(t))
            t[at:at] = passage
        texts.append("\n".join(t))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    want = brute_dedup(list(enumerate(texts)))
    assert got == want and sum(len(want[i] or "") < len(t or "") for i, t in enumerate(texts)) > 10


def brute_passages(rows, most):
    """Texts without the lines of runs of over `most` words that an earlier place holds."""
    seen, out = set(), {}
    for i, t in rows:
        lines = t.split("\n")
        gone = set()
        for a in range(len(lines)):  # an earlier start in the same text counts too
            fresh = []
            for b in range(a, len(lines)):
                run = "\n".join(lines[a : b + 1])
                if lines[a].split() and lines[b].split() and len(run.split()) > most:
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    fresh.append(run)
            seen |= set(fresh)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_line_dedup_removes_every_long_passage(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "DIVISOR", 1)  # each line a chunk of its own: passages only
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    shared = [[line(n) for n in sizes] for sizes in ([60], [26, 26], [9, 0, 30, 20], [17, 17, 17], [1] * 55, [50], [20, 30], [51, 3, 2])]
    texts = ["\n".join(s) for s in shared]
    for _ in range(40):
        t = [line(rng.choice([0, 3, 12, 70])) for _ in range(rng.randint(0, 4))]
        for s in rng.sample(shared, 2):
            at = rng.randint(0, len(t))
            t[at:at] = s
        texts.append("\n".join(t))
    texts += [texts[0], "\n".join([line(20), line(20)] * 1 + shared[3] * 3), "\n".join(shared[3][:2] * 4)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    want = brute_passages(list(enumerate(texts)), line_dedup.WORDS)
    assert got == want and want[len(shared) + 40] == ""


def test_nothing_of_a_long_copy_survives(spark):
    rng = random.Random(10)
    text = "\n".join(" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 20))) for _ in range(3000))
    got = {r["doc_id"]: r for r in line_dedup.remove(docs_of(spark, [text, text, "intro\n" + text, text + "\ntail"])).collect()}
    assert [got[i]["text"] for i in range(4)] == [text, "", "intro", "tail"]
    assert [got[i]["n_removed"] for i in range(4)] == [0, 3000, 3000, 3000]


def test_ranges_of_removed_lines_are_apart(spark):
    """However many runs repeat, a document's ranges hold each line once, so their expansion is bounded by its lines."""
    rng = random.Random(11)
    a, b = ([" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 20))) for _ in range(400)] for _ in range(2))
    texts = ["\n".join(a + b), "\n".join(a + b), "\n".join(["intro", *a, "between", "them", *b, "tail"])]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: [tuple(c) for c in r["cut"]] for r in line_dedup.repeated(docs.union(docs)).collect()}
    assert got == {1: [(1, 800)], 2: [(2, 401), (404, 803)]}


def test_no_name_clashes(spark):
    names = ["__d", "__h", "__cut", "__n_lines", "__n_removed", "__row", "__text", "__host", "__m", "__kept", "__v", "__k0", "__s", "__t", "__gone", "th", "h2", "w"]
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(12))
    docs = docs_of(spark, [text, text, None]).withColumns({"source": F.lit("a"), **{n: F.lit(n) for n in names}})
    bench = spark.createDataFrame([(1, "nothing of this kind is here at all in it")], "item_id long, text string")
    for out in (line_dedup.dedup(docs), quality.keep_good(docs), decontaminate.clean(docs, bench), ngram_join.one_of_each(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names)


def test_line_dedup_edges(spark, odd_docs):
    out = line_dedup.dedup(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 11
    assert line_dedup.dedup(odd_docs.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------------------------

ITEM = "A train leaves the old station at 10 km and then Anna walks along the river with Anna until night falls over the town"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("before it " + ITEM.replace("A train", "a train") + " and after it", True),
        (ITEM.replace("Anna", "Bert").replace("10", "77"), True),
        # changed in one place: the windows that hold one slot value do not contradict each other
        (ITEM.replace("walks along the river with Anna", "walks along the river with Carl"), True),
        ("Some other words that have nothing to do with it at all, and never did, as far as one can see", False),
        (ITEM.upper().lower(), True),
        (None, False),
        ("", False),
        ("A train leaves", False),
    ],
)
def test_templates(spark, text, hit):
    bench = spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string")
    r = decontaminate.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()[0]
    assert r["contaminated"] == hit
    assert (7 in r["item_ids"]) == r["contaminated"]


def test_inconsistent_slots_do_not_count(spark):
    item = "tell us why did Anna and also Anna go there again"
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = docs_of(spark, [item.replace("Anna", "Bert"), item.replace("also Anna", "also Carl")])
    assert [r["contaminated"] for r in decontaminate.scan(docs, bench).orderBy("doc_id").collect()] == [True, False]


def found_in(spark, item, texts):
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    return [r["contaminated"] for r in decontaminate.scan(docs_of(spark, texts), bench).orderBy("doc_id").collect()]


def test_copies_in_capitals_are_found(spark):
    item = "Which of the two trains leaves the old station first when the night falls over a town?"
    assert found_in(spark, item, ["Before it. " + item.upper() + " AND AFTER IT", "see " + item.title(), item.upper()[:30]]) == [True, True, False]


def test_short_items_are_found_in_longer_documents(spark):
    texts = ["He asked me then: Who wrote the long poem? Nobody knew it at all.", "Who wrote the long poem", "Who wrote the", "who wrote a long poem and more of the same words"]
    assert found_in(spark, "Who wrote the long poem?", texts) == [True, True, False, False]
    eight = "Which old river runs through the northern town?"
    assert found_in(spark, eight, ["Please see " + eight, "you may see Which old river runs", None]) == [True, False, False]
    assert found_in(spark, "- ?", ["some words - ? and more", "words"]) == [False, False]


def test_one_inconsistent_slot_does_not_clear_a_document(spark):
    item = "They say that Anna went to the market and bought some fresh bread there because on that day nobody else but Anna had time, while the quiet Bert and the loud Carl stayed at home"
    texts = [item.replace("but Anna", "but Dora"), item.replace("and the loud Carl", "and the loud Bert"), item.replace("Anna had", "Anna, had")]
    assert found_in(spark, item, texts) == [True, True, True]
    # the same name for two different ones, or with a comma in one place, within each window
    item = "we asked why did Anna then see Bert there"
    assert found_in(spark, item, ["we asked why did Carl then see Carl there"]) == [True]
    item = "then we asked Anna and also Anna about it"
    assert found_in(spark, item, ["then we asked Carl, and also Carl about it"]) == [True]


def test_items_dense_in_slots_are_found_when_copied(spark):
    item = "mix 5 kg 3 g 12 ml 7 dollars with Anna Bert Carl 44 km 9 days 2 hours 81 percent"
    texts = ["Before it we " + item + " and after it.", item.replace("5", "6").replace("12", "13").replace("7", "8").replace("Bert", "Emil").replace("9", "4")]
    assert found_in(spark, item, texts) == [True, False]


def test_a_name_that_begins_an_item_is_a_name(spark):
    item = "Anna has some apples and gives them away today"
    assert found_in(spark, item, ["We know that Bert has some apples and gives them away today", "We know that bert has some apples or gives them away today"]) == [True, False]


def brute_hits(item, text):
    """Whether a window of eight words (or all of a shorter item) of the item is in the text, case and outer punctuation aside."""
    words = lambda t: [w for w in (x.strip(".,!?:;\"'()-") for x in t.lower().split())]
    a, b = words(item), words(text)
    m = min(8, len(a))
    return any(a[i : i + m] == b[j : j + m] for i in range(len(a) - m + 1) for j in range(len(b) - m + 1))


def test_decontamination_is_brute_force_on_plain_words(spark):
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ado", "ine", "oru", "eth")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(n) for n in (2, 3, 5, 7, 8, 9, 14, 30, 60)]
    texts = [say(rng.randint(1, 40)) for _ in range(20)]
    for it in items:
        w = it.split()
        for _ in range(6):
            k, at = rng.randint(1, len(w)), 0
            at = rng.randint(0, len(w) - k)
            part = " ".join(w[at : at + k])
            texts.append(f"{say(rng.randint(0, 9))} {rng.choice([part, part.upper(), part.title(), part.replace(' ', ', ')])}! {say(rng.randint(0, 9))}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.scan(docs_of(spark, texts), bench).collect()}
    assert got == {i: [k for k, it in enumerate(items) if brute_hits(it, t)] for i, t in enumerate(texts)}


def test_edited_plants_are_found(spark):
    """Numbers and names changed throughout: at least nine of ten are found."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu"]) for _ in range(3))
    name = lambda: word().capitalize()
    items, texts = [], []
    for _ in range(40):
        w = [word() for _ in range(30)]
        places = rng.sample(range(2, 30), 4)
        old, new = [name() for _ in places], [name() for _ in places]
        other = list(w)
        for p, a, b in zip(places, old, new, strict=True):
            w[p], other[p] = a, b
        k = rng.randint(2, 29)
        items.append(" ".join([*w[:k], str(rng.randint(2, 99)), *w[k:]]))
        texts.append(" ".join(["It", "says", *other[:k], str(rng.randint(100, 999)), *other[k:], "now"]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.scan(docs_of(spark, texts), bench).collect()
    assert sum(r["doc_id"] in r["item_ids"] for r in got) >= 36
    assert decontaminate.scan(docs_of(spark, [" ".join(word() for _ in range(40)) for _ in range(40)]), bench).where("contaminated").count() == 0


def test_decontamination_edges(spark, odd_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.clean(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.clean(odd_docs, bench.limit(0)).count() == 11
    assert decontaminate.scan(odd_docs.limit(0), bench).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = bench.first()["text"]
    planted = docs.limit(5).withColumn("text", F.concat(F.lit("Intro of some words. "), F.lit(text), F.lit(" More words follow here.")))
    assert decontaminate.clean(planted, bench).count() == 0


# --- licenses --------------------------------------------------------------------------------


def test_license_bands_meet_the_promise():
    assert min(licenses.collision(n) for n in range(2, 5000)) > 0.97 and min(licenses.collision(n) for n in range(3, 5000)) > 0.99


def test_license_scan(spark, odd_docs):
    pad = " ".join(f"filler{i}" for i in range(37))
    texts = [f"{pad} {t} {pad}" for _, t in licenses.TEMPLATES] + [pad, None, "", "of the and use in the", "RELEASED UNDER\nTHE MIT LICENSE!"]
    got = [r["licenses"] for r in licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    for (name, _), found in zip(licenses.TEMPLATES, got, strict=False):
        assert name in found
    assert got[len(licenses.TEMPLATES) :] == [[], [], [], [], ["MIT"]]
    assert licenses.scan(odd_docs).count() == 11 and licenses.scan(odd_docs.limit(0)).count() == 0


def test_license_scan_is_brute_force(spark):
    """Templates with words changed here and there: all whose pairs are held to SHARE in some window are found, and nothing else."""
    rng = random.Random(14)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    templates = [(f"T{n}", say(n)) for n in (2, 3, 6, 20, 90, 400)]
    texts = []
    for _, t in templates:
        for share in (0, 0.03, 0.06, 0.1, 0.2, 0.5):
            w = [rng.choice(vocab) if rng.random() < share else x for x in t.split()]
            texts.append(f"{say(rng.randint(0, 60))} {' '.join(w)} {say(rng.randint(0, 60))}".strip())
    pairs = lambda w: {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
    want = []
    for t in texts:
        w, found = t.split(), []
        for lic, body in templates:
            need, width = pairs(body.split()), licenses.width_of(len(body.split()))
            starts = range(0, max(1, -(-(len(w) - width) // (width // 2)) * (width // 2) + 1), width // 2)
            if any(len(pairs(w[s : s + width]) & need) >= licenses.SHARE * len(need) for s in starts):
                found.append(lic)
        want.append(sorted(found))
    got = [r["licenses"] for r in licenses.scan(docs_of(spark, texts), templates).orderBy("doc_id").collect()]
    assert got == want and sum(map(len, want)) >= 20
    assert [r["licenses"] for r in licenses.scan(docs_of(spark, texts[:2]), []).collect()] == [[], []]
    assert [r["licenses"] for r in licenses.scan(docs_of(spark, ["one word", "x"]), [("S", "word")]).collect()] == [[], []]


def test_many_templates_need_no_text_search(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_SOUGHT", 0)
    texts = [f"some words before {t} and after" for _, t in licenses.TEMPLATES]
    got = [r["licenses"] for r in licenses.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert all(name in found for (name, _), found in zip(licenses.TEMPLATES, got, strict=True))


def test_fine_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((3, 3), (40, 44), (900, 1000), (9000, 8200)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 10], rng.integers(0, 1 << 63, max(0, m - n + n // 10)).astype(np.uint64)]))
        off = ngram_join.fine_off(ngram_join.fine_sketch(x, 90, 100), ngram_join.fine_sketch(y, 90, 100))
        assert off <= len(np.setxor1d(x, y))
        assert ngram_join.fine_off(ngram_join.fine_sketch(x, 90, 100), ngram_join.fine_sketch(x, 90, 100)) == 0
