"""Operators against libraries, brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import chat_format, components, decontaminate, lm_mixing, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, token_counts, toxicity
from kindred.llm.common import words_of
from kindred.llm.queries import QUERIES, model_path

SF = "/root/testdata/sf0.001"
TEXTS = st.text(alphabet=st.sampled_from(list("aeinrst  ▁thou\n.,0169é😀汉́ßXT\t-_#<>/\\:")), max_size=60)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(model_path())


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 12))
def test_transducer_counts_as_the_library(text, chunk):
    counter, library = _shared()
    assert counter.count(text) == counter.count(text, chunk) == len(library.encode(text))


def _shared(cache={}):  # noqa: B006
    if not cache:
        cache[0] = (token_counts.Counter(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path()), sentencepiece_codec.ChunkTable(model_path()))
    return cache[0][:2]


def test_state_maps_compose_associatively(counter):
    text = "▁the▁quick▁brown▁fox▁▁jumps▁over" + "unbroken" * 9
    cut = range(0, len(text), 4)

    def maps():
        return [counter.summarise(text[i : i + 4], text[max(0, i - 6) : i]) for i in cut]

    left, *rest = maps()
    for m in rest:
        left = counter.compose(left, m)
    *rest, right = maps()
    for m in rest[::-1]:
        right = counter.compose(m, right)
    scanned = counter.prefix_scan(maps())
    start = counter.machine.START
    assert counter.apply(left, start) == counter.apply(right, start) == counter.apply(scanned[-1], start)
    for i, m in zip(cut, scanned, strict=True):
        assert counter.apply(m, start)[1] == counter.machine.run(start, text[: i + 4])[1]


def test_state_maps_answer_for_entries_that_were_not_guessed(counter):
    states = [counter.machine.run(0, x)[0] for x in ("▁", "▁th", "▁wond", "e" * 20)]
    for chunk in ("erful", "e▁t", "ing▁of▁the"):
        m = counter.summarise(chunk, "x")
        assert [counter.apply(m, s)[1] for s in states] == [counter.machine.run(s, chunk)[1] for s in states]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_codec_is_the_library(text):
    library = _shared()[1]
    table = _table()
    found = table.entries(text)
    ids = library.encode(text)
    assert ",".join(map(str, ids)) == ",".join(e[0] for e in found)
    assert ids == [i for e in found for i in e[1]]


def _table(cache=[]):  # noqa: B006
    if not cache:
        cache.append(sentencepiece_codec.ChunkTable(model_path()))
    return cache[0]


def test_token_queries(spark, documents, library):
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        assert r["n_tokens"] == len(library.encode(documents[r["doc_id"]])) and r["n_bytes"] == len(documents[r["doc_id"]].encode())
    for r in QUERIES["op2_sentencepiece"](spark, SF).collect():
        ids = library.encode(documents[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encode_and_decode_tables(spark, documents):
    docs = spark.createDataFrame([(i, t) for i, t in list(documents.items())[:20]], "doc_id long, text string")
    back = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_ids(docs, model_path()), model_path())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(list(documents.items())[:20])


def test_quality_counts(spark, documents):
    for r in QUERIES["op3_quality_rules"](spark, SF).collect():
        text = documents[r["doc_id"]]
        words = words_of(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeat = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeat))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["base_failed"] == (len(words) < 10 or 100 * len(repeat) > 20 * len(words)) and not (r["kept"] and r["base_failed"])


def test_divergence():
    p, q = np.array([1.0, 1.0, 0]), np.array([0, 0, 2.0])
    assert quality_rules.js_distance(p, q) == 1 and quality_rules.js_distance(p, 3 * p) == 0


def _quality_by_hand(rows, options):
    """Distances and verdicts from plain dictionaries over all rows."""

    def distance(p, q):
        if not sum(p.values()) or not sum(q.values()):
            return 0.0
        sp, sq, total = sum(p.values()), sum(q.values()), 0.0
        for k in p.keys() | q.keys():
            x, y = p.get(k, 0) / sp, q.get(k, 0) / sq
            total += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v) / 2
        return math.sqrt(max(0.0, total))

    def classes(text):
        kinds = Counter()
        for c in text:
            kinds[0 if c in " \t\n\x0b\x0c\r" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in ".,;:!?'\"()-" else 5 if c.isascii() else 6 if ord(c) < 0x250 and c.isalpha() else 7] += 1
        return kinds

    chars, words = {}, {}
    for _, text, lang in rows:
        chars.setdefault(lang or "", Counter()).update(classes(text or ""))
        words.setdefault(lang or "", Counter()).update(words_of(text))
    out = {}
    for i, text, lang in rows:
        text, own, known = text or "", words_of(text), dict(sorted(words[lang or ""].items(), key=lambda x: (-x[1], x[0]))[: options.common_words])
        near = distance(classes(text), chars[lang or ""]) if len(text) >= options.guard_chars else None
        mine = Counter(w for w in own if w in known)
        far = (distance(mine, known) if mine else 1.0) if len(own) >= options.guard_words and known else None
        out[i] = (near, far)
    return out


@pytest.mark.parametrize("most", [128, 2])
def test_quality_distances_are_by_hand(spark, most):
    """The same whether a language's reference is sent or joined."""
    rng = random.Random(9)
    words = {lang: [_drawn(rng, "abcdeéßфñ" + lang, rng.randint(1, 6)) for _ in range(120)] for lang in ("en", "de", "fr", "xx", "")}
    rows = []
    for i in range(90):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang if i % 7 else "xx"]) for _ in range(rng.choice([3, 30, 90, 200]))) + rng.choice(["", " 123456789 !!! $$$" * 30]), lang or None))
    options = quality_rules.Options(max_languages=most)
    want = _quality_by_hand(rows, options)
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), options).collect()
    assert len(got) == len(rows) and any(not r["kept"] and not r["base_failed"] for r in got)
    for r in got:
        for x, y in zip((r["class_distance"], r["word_distance"]), want[r["doc_id"]], strict=True):
            assert (x is None and y is None) or abs(x - y) < 1e-9
        assert r["kept"] == (not r["base_failed"] and (want[r["doc_id"]][0] or 0) <= options.max_class_distance and (want[r["doc_id"]][1] or 0) <= options.max_word_distance)


def test_fingerprints_match_the_rule(documents):
    for text in list(documents.values())[:20]:
        words = words_of(text.translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash_dedup.fingerprint(simhash_dedup.shingles(text, 4)) == want


def _components(n, pairs):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_trie_join_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    x = base[rng.integers(0, 20, 200)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) * (rng.random(200) < 0.7).astype(np.uint64)
    x, k = np.unique(x), int(rng.integers(1, 8))
    turned = np.sort((x << np.uint64(32)) | (x >> np.uint64(32)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if int(x[i] ^ x[j]).bit_count() <= k]
    at = {int(v): i for i, v in enumerate(x)}
    found = []
    for leaves, back in ((x, lambda v: v), (turned, lambda v: (v << 32 | v >> 32) & (2**64 - 1))):
        for a, b in simhash_dedup.trie_join(leaves, len(leaves), k).edges:
            found += [(at[back(int(leaves[i]))], at[back(int(leaves[j]))]) for i, j in zip(a, b, strict=True)]
    assert set(map(tuple, map(sorted, found))) <= set(pairs)
    assert _components(len(x), found) == _components(len(x), pairs)


def test_near_duplicate_query(spark, documents):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op5_simhash_dedup"](spark, SF).collect()}
    ids = sorted(got)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (got[ids[i]][0] ^ got[ids[j]][0]).bit_count() <= 4]
    assert [got[i][1] for i in ids] == [ids[c] for c in _components(len(ids), pairs)]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    roots = components.connected_components(edges)
    assert roots.select("root").distinct().count() == 1 and roots.count() == 301


def test_near_copies_by_shingles(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(300)]
    near = [*words[:100], "changed", *words[101:]]
    far = [w if i % 9 else "other" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(near), " ".join(far), " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash_dedup.near_copies(docs).collect()} == {(1, 0), (2, 0)}


def test_near_copies_past_nearer_unlike_texts(spark):
    """Similar texts that hang together through unlike ones of nearer fingerprints, or share one with them, are found."""
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(300)]
    near = [*words[:100], "changed", *words[101:]]
    unlike = [[*words] for _ in range(3)]
    for w in unlike:
        rng.shuffle(w)
    texts = [unlike[0], words, unlike[1], near, unlike[2]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    # unlike texts of the same words share a fingerprint with the first of the similar two
    assert len({simhash_dedup.word_fingerprint(w) for w in texts[:3]}) == 1
    assert {(r["doc_id"], r["component_id"]) for r in simhash_dedup.near_copies(docs).collect()} == {(3, 1)}


def test_groups_of_near_unlike_texts_make_no_pairs(spark, monkeypatch):
    """Of a group whose fingerprints are all near and whose texts are mostly unlike, no table grows with its square."""
    rng = random.Random(8)
    base, n = [f"w{i % 40}" for i in range(400)], 300
    rng.shuffle(base)
    texts = []
    for i in range(n):
        words = [*base]
        for at in rng.sample(range(400), 14 if i % 10 else 4):
            words[at] = f"w{rng.randrange(40)}"
        texts.append(words)
    fps = [simhash_dedup.word_fingerprint(w) for w in texts]
    sets = [set(simhash_dedup.shingles(" ".join(w), 5)) for w in texts]
    near = [(x, y) for x, y in itertools.combinations(range(n), 2) if (fps[x] ^ fps[y]).bit_count() <= 7]
    want = _components(n, [(x, y) for x, y in near if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])])
    assert len(near) > 20_000 and 20 < sum(want[i] != i for i in range(n)) < n // 2
    made, write = [], simhash_dedup.materialise

    def counted(df, name="step"):
        made.append((write(df, name), name))
        return made[-1][0]

    monkeypatch.setattr(simhash_dedup, "materialise", counted)
    monkeypatch.setattr(components, "materialise", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash_dedup.near_copies(docs).collect()} == {(i, c) for i, c in enumerate(want) if i != c}
    assert max(df.count() for df, _ in made) <= 10 * n


@pytest.mark.parametrize("blocks", (None, 3))
def test_similar_links_connect_what_all_pairs_do(spark, monkeypatch, blocks):
    """In one unit or in pairs of blocks; clusters stay apart."""
    rng = np.random.default_rng(4)
    rows, sets = [], {}
    for i in range(90):
        own = rng.choice(60, int(rng.integers(1, 6)), replace=False)
        sets[i] = set(range(40)) - set(own.tolist())
        fp = int(rng.integers(0, 16))
        rows.append((i % 2, i, fp, np.array(sorted(sets[i]), np.uint64).tobytes()))
    if blocks:
        monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 8)
        monkeypatch.setattr(simhash_dedup, "BLOCKS", blocks)
    df = spark.createDataFrame(rows, "cluster long, least long, fp long, sh binary")
    got = [(r["a"], r["b"]) for r in simhash_dedup.similar_links(df, 2, 0.9).collect()]
    want = [(x, y) for (c, x, f, _), (d, y, g, _) in itertools.combinations(rows, 2) if c == d and (f ^ g).bit_count() <= 2 and len(sets[x] & sets[y]) >= 0.9 * len(sets[x] | sets[y])]
    assert {tuple(sorted(e)) for e in got} <= set(want) and len(got) < len(want)
    assert _components(90, got) == _components(90, want)


def test_sets_of_unlike_rows_are_not_sent_to_all_units(spark, monkeypatch):
    """Of a cluster of near fingerprints and unlike sets, units get a fraction of what all blocks' pairs of sets would be."""
    from pyspark.sql import GroupedData

    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**64, 200, dtype=np.uint64) for _ in range(300)]
    for a, b in ((3, 250), (250, 17), (40, 41)):
        sets[b] = np.append(sets[a][:190], sets[b][:5])
    rows = [(1, i, i % 2, np.unique(x).tobytes()) for i, x in enumerate(sets)]
    monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", 8)
    sent, apply = [], GroupedData.applyInArrow

    def counted(self, fn, schema):
        columns = [c for c, kind in self._df.dtypes if kind == "binary"]
        sent.append(sum(self._df.selectExpr(f"sum(length({c})) as n").first()["n"] or 0 for c in columns))
        return apply(self, fn, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    got = [(r["a"], r["b"]) for r in simhash_dedup.similar_links(spark.createDataFrame(rows, "cluster long, least long, fp long, sh binary"), 2, 0.8).collect()]
    want = [(x, y) for x, y in itertools.combinations(range(300), 2) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))]
    assert len(want) == 4 and _components(300, got) == _components(300, want)
    assert 0 < sum(sent) < 2 * sum(len(sh) for *_, sh in rows)


@pytest.mark.parametrize("seed", range(12))
def test_rows_of_similar_pairs_may_be_similar(seed):
    """Bitmaps keep every row of a pair that is similar, whatever the sizes, and few others."""
    rng = np.random.default_rng(seed)
    n, threshold = 60, (0.8, 0.3)[seed % 2]
    base = [rng.integers(0, 2**64, k, dtype=np.uint64) for k in (0, 1, 2, 15, 16, 17, 33, 128, 130, 600)]
    sets = []
    for _ in range(n):
        x = base[rng.integers(0, len(base))]
        sets.append(np.unique(np.append(x[rng.random(len(x)) > rng.choice([0, 0.05, 0.2, 0.7])], rng.integers(0, 2**64, int(len(x) * rng.choice([0, 0.1, 0.3])), dtype=np.uint64))))
    fps, cluster, part = rng.integers(0, 16, n).astype(np.uint64), rng.integers(0, 2, n), rng.integers(0, 2, n)
    bits = [np.frombuffer(simhash_dedup.bitmap(x, simhash_dedup.BITS_PER_HASH), np.uint64) for x in sets]
    size = np.array([len(x) for x in sets])
    for parts in (None, part):
        got = simhash_dedup.maybe_similar(fps, size, bits, 2, threshold, cluster, parts)
        want = np.zeros(n, bool)
        for x, y in itertools.combinations(range(n), 2):
            shared = len(np.intersect1d(sets[x], sets[y]))
            if cluster[x] == cluster[y] and (parts is None or part[x] != part[y]) and int(fps[x] ^ fps[y]).bit_count() <= 2 and shared and shared >= threshold * (size[x] + size[y] - shared):
                want[[x, y]] = True
        assert want.any() and not (want & ~got).any() and (threshold < 0.5 or not got.all())


@pytest.mark.parametrize("seed", range(8))
def test_bitmaps_never_rule_out_similar_sets(seed):
    rng = np.random.default_rng(seed)
    for size in (1, 3, 60, 64, 65, 500):
        every = np.unique(rng.integers(0, 2**64, 2 * size, dtype=np.uint64))
        for drop in (0, 1, size // 10, size // 5, size):
            a, b = every[: len(every) - drop], every[drop // 3 :]
            shared, union = len(np.intersect1d(a, b)), len(every)
            if len(a) and len(b) and shared >= 0.8 * union:
                assert simhash_dedup.may_agree(simhash_dedup.bitmap(a), len(a), simhash_dedup.bitmap(b), len(b), 0.8)
    a, b = (rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    assert not simhash_dedup.may_agree(simhash_dedup.bitmap(a), 500, simhash_dedup.bitmap(b), 500, 0.8)


def test_open_links_are_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    x = base[rng.integers(0, 12, 150)]
    for _ in range(5):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) * (rng.random(150) < 0.7).astype(np.uint64)
    x = np.unique(x)
    label, size = rng.integers(0, 40, len(x)), rng.integers(5, 9, len(x))
    rows = [(int(v), int(k) if k else None, int(n), int(n)) for v, k, n in zip(x.view(np.int64), label, size, strict=True)]
    fps = spark.createDataFrame(rows, "fp long, label long, least_size int, most_size int")
    want = {
        tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2)
        if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 7 and (a[1] != b[1] or a[1] is None) and min(a[2], b[2]) >= 0.8 * max(a[2], b[2])
    }
    got = [tuple(sorted((r["a"], r["b"]))) for r in simhash_dedup.open_links(fps, 7, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_chat_template_is_reversible(turns):
    text, spans = chat_format.format_turns(turns, trained=turns[0][0] if turns else "x")
    assert chat_format.read_turns(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == turns[0][0]]


def test_best_branch_of_a_tree(spark):
    rows = [("t", "r", None, 1.0), ("t", "a", "r", 5.0), ("t", "b", "r", 2.0), ("t", "c", "b", 9.0), ("t", "d", "c", 9.0), ("t", "x", "y", 50.0), ("t", "y", "x", 50.0), ("u", "s", "gone", None)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, score double")
    got = sorted((r["path"], r["rank"], r["back"], r["node"]) for r in chat_format.best_paths(df, 2).collect())
    assert got == [("a", 2, 0, "a"), ("a", 2, 1, "r"), ("d", 1, 0, "d"), ("d", 1, 1, "c"), ("d", 1, 2, "b"), ("d", 1, 3, "r"), ("s", 1, 0, "s")]


def test_chat_query(spark):
    said = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    awkward = r"\### Assistant: </turn> ok"
    by = {k: [(r["role"], r["text"]) for r in g] for k, g in itertools.groupby(said, lambda r: r["conv_id"])} | {-7: [("user", awkward), ("assistant", awkward)]}
    got = {r["conv_id"]: r for r in QUERIES["op6_chat_format"](spark, SF).collect()}
    assert got.keys() == by.keys()
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_base_secrets():
    text = 'é PassWord = "abc12345" token:short api_key=\'x.y/z+w=-_9\' AKIAABCDEFGHIJKL AKIASHORT ' + "0a" * 16 + " " + "0a" * 15
    assert [(k, text[a:b]) for k, a, b in secret_scan.base_spans(text)] == [("assign", 'PassWord = "abc12345'), ("assign", "api_key='x.y/z+w=-_9"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0a" * 16)]
    assert secret_scan.base_spans("paſſword=abc123456789") == []


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def _ordinary(words):
    return secret_scan.bigrams(Counter(map(secret_scan.classes_of, words)))


def test_grammar_inference_tells_formats_apart():
    rng = random.Random(1)
    hexes = [_drawn(rng, "0123456789abcdef", 40) for _ in range(200)]
    words = [_drawn(rng, "aeiounrstl", 20) for _ in range(200)] + [_drawn(rng, "0123456789", 16) for _ in range(200)]
    scanner = secret_scan.Scanner({"hex": hexes[:150]}, _ordinary(words[::2]), 150)
    assert min(map(scanner.score, hexes[150:])) > scanner.threshold > max(map(scanner.score, words[1::2]))
    text = f"see {hexes[-1][:30]} and {words[1]}"
    assert [(k, text[a:b]) for k, a, b in scanner.spans(text)[1]] == [("format", hexes[-1][:30])]


def test_unlabelled_credentials_are_found(spark):
    """Credentials of the formats that the base knows, planted without what makes the base see them."""
    rng = random.Random(6)
    words = [_drawn(rng, "aeiounrstlmdc", rng.randint(2, 14)) for _ in range(3000)] + [f"mail{i}.example.com" for i in range(9)] + ["2024-01-15", "555-0123-99", "10.20.30.40"]
    kinds = {
        "hex": (lambda: _drawn(rng, "0123456789abcdef", 40), lambda: _drawn(rng, "0123456789abcdef", rng.randint(12, 31))),
        "access": (lambda: "AKIA" + _drawn(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ASIA" + _drawn(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        "assign": (lambda: "secret: " + _drawn(rng, BASE64, 40), lambda: _drawn(rng, BASE64, 40)),
    }
    labelled, plain, planted = [], [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        made, bare = kinds[list(kinds)[i % 3]]
        if i % 4 == 0:
            text.insert(30, made() if i % 3 else "token=" + made())
        labelled.append(" ".join(text))
        plain.append(" ".join(rng.choice(words) for _ in range(60)))
        planted.append((" ".join(text[:20]) + " ", bare()))
    scanner = secret_scan.fit(spark.createDataFrame([(i, t) for i, t in enumerate(labelled + plain)], "doc_id long, text string"))
    found = 0
    for before, secret in planted:
        text = before + secret + " end"
        found += ("format", len(before), len(before) + len(secret)) in scanner.spans(text)[1]
    assert found >= 0.95 * len(planted)
    assert sum(len(scanner.spans(t)[1]) for t in plain) == 0


def test_candidates_are_what_base_spans_leave_of_runs():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["token=", "abcdefgh", "0123456789abcdef" * 2, " ", "AKIA" + "Q" * 14, "xyz", "secret:", "é"]) for _ in range(rng.randint(1, 9)))
        base = secret_scan.base_spans(text)
        free = [c.isascii() and (c.isalnum() or c in "+/_.=-") and not any(a <= i < b for _, a, b in base) for i, c in enumerate(text)] + [False]
        want, at = [], None
        for i, f in enumerate(free):
            if f and at is None:
                at = i
            elif not f and at is not None:
                want += [(at, i)] if i - at >= 8 else []
                at = None
        # a run shorter than eight characters with a base span inside is none, whatever is left of it
        assert list(secret_scan.candidates(text, base)) == want
    assert secret_scan.redacted("ab cd ef", [("x", 0, 4), ("y", 3, 5)]) == "[secret] ef"


def test_background_counts_every_ordinary_run(spark):
    texts = ["plainword otherword", "x" * 300 + " token=abcdefgh12", None, "plainword"]
    got = secret_scan.ordinary_bigrams(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert got == dict(_ordinary(["plainword", "otherword", "x" * 300, "plainword"]))


def test_merged_automaton_keeps_counts():
    runs = ["ab" * k for k in range(1, 6)] * 20
    a = secret_scan.Automaton(runs, 0.05)
    reach, todo = {0}, [0]
    while todo:
        for t, _ in a.arcs[todo.pop()].values():
            if t not in reach:
                reach.add(t)
                todo.append(t)
    assert sum(a.ends[s] for s in reach) == len(runs) and len(reach) < 11
    assert a.log2_likelihood("abab") > a.log2_likelihood("aabb")


def test_secret_query_keeps_base(spark, documents):
    for r in QUERIES["op7_secret_scan"](spark, SF).collect():
        base = secret_scan.base_spans(documents[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(",")) and r["n_hex"] == sum(k == "hex" for k, _, _ in base)


def _shingle_bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def _contaminated(docs, items, width=5):
    """Each text's most similar window of each item it is a near copy of: (text, item) -> (start, similarity)."""
    want = {}
    for d, words in enumerate(docs):
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        for k, item in enumerate(items):
            bag = _shingle_bag(item)
            n = bag.total()
            for s in range(max(1, len(grams) - n + 1)) if grams and not bag.keys().isdisjoint(grams) else ():
                window = Counter(grams[s : s + n])
                shared = (window & bag).total()
                similarity = shared / (window.total() + n - shared)
                if similarity >= 0.8 and similarity > want.get((d, k), (0, 0))[1] + 1e-12:
                    want[d, k] = (s, similarity)
    return want


def _found(spark, docs, items):
    df = spark.createDataFrame([(i, " ".join(w).upper() + ("!" if w else "")) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.contaminated(df, bench).collect()}


def test_contamination_is_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(15)] + [["w1"] * 12]
    docs = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if i % 2:
            passage = list(rng.choice(items))
            at = rng.randrange(len(passage))
            if i % 3 == 0:
                passage[at] = "edited"
            elif i % 5 == 0:
                passage.insert(at, "added")
            elif i % 7 == 0:
                del passage[at]
            elif i % 11 < 4:  # its parts in another order
                passage = passage[at:] + passage[:at]
            words[len(words) // 2 : len(words) // 2] = passage
        docs.append(words)
    want, got = _contaminated(docs, items), _found(spark, docs, items)
    assert got.keys() == want.keys() and len(want) > 40
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-5 for x in want)


def test_windows_of_any_place_have_the_fingerprint_of_their_shingles(spark):
    rng = random.Random(11)
    made = [[rng.choice("abcdefghij") for _ in range(n)] for n in (3, 5, 20, 90)]
    texts = [" ".join(w) for w in (*made, made[0] + made[2] + made[1] + made[3], made[3] + made[2] * 3)]
    items = spark.createDataFrame([(0, texts[2]), (1, texts[3])], "item_id long, text string")
    rows = decontaminate.with_shingles(items, "text").selectExpr("xxhash64(sh) as sig", "size(sh) as size", "sh")
    seeds = rows.selectExpr("explode(sh) as seed", "size").distinct()
    suspects = decontaminate.suspects_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), seeds, seeds.count())
    chunks = decontaminate.chunks_of(suspects, seeds, True)
    got = decontaminate.windows_of(chunks).join(suspects.select("row", "sh"), "row").select("sh", "start", "size", "fp", "n_own").collect()
    for r in got:
        window = r["sh"][r["start"] : r["start"] + r["size"]]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in window) > len(window))
        assert r["fp"] % 2**64 == want and r["n_own"] == len(window)
    assert len(got) > 100


def test_long_items_cost_no_more_than_their_length(spark):
    rng = random.Random(4)
    item = [f"v{rng.randrange(4000)}" for _ in range(5000)]
    doc = [f"v{rng.randrange(4000)}" for _ in range(300)] + [w if i % 400 else "edited" for i, w in enumerate(item)] + ["end"] * 50
    got = _found(spark, [doc, item[:4000], item[2500:] + item[:2500]], [item])
    assert {k: s for k, (s, _) in got.items()} == {(0, 0): 300, (2, 0): 0}


def test_block_max_index_is_exact():
    rng = random.Random(2)
    vectors = []
    for _ in range(300):
        v = {t: rng.random() for t in rng.sample(range(20), 3)}
        size = math.sqrt(sum(w * w for w in v.values()))
        vectors.append({t: w / size for t, w in v.items()})

    def arrays(v):
        return np.array(sorted(v)), np.array([v[t] for t in sorted(v)])

    index = toxicity.BlockMaxIndex([arrays(v) for v in vectors], 20, 16)
    for q in vectors[:60]:
        want = sorted((-round(sum(q.get(t, 0) * w for t, w in v.items()), 12), i) for i, v in enumerate(vectors))
        got = index.nearest(*arrays(q), 7)
        assert [(-round(s, 12), i) for i, s in got] == [x for x in want if x[0] < 0][: len(got)] and len(got) == 7
    assert index.nearest(np.zeros(0, np.int64), np.zeros(0), 3) == []


def test_search_reads_few_postings_of_frequent_terms(monkeypatch):
    """Neighbours stay exact, whatever is searched with them, and postings of terms that most examples have aren't read."""
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(640):
        terms = np.sort(np.concatenate([rng.choice(40, 30, replace=False), 40 + rng.choice(400, 4, replace=False)]))
        w = np.where(terms < 40, 0.2, 1.0) * rng.integers(1, 4, len(terms))
        vectors.append((terms, w / np.sqrt(w @ w)))
    vectors[500] = vectors[20]
    index = toxicity.BlockMaxIndex(vectors, 440, 32)
    whole = np.zeros((640, 440))
    for i, (terms, w) in enumerate(vectors):
        whole[i, terms] = w
    read, ranges = [], toxicity._ranges
    index.nearest(*vectors[0], 5)

    def counted(start, size):
        read.append(int(size.sum()))
        return ranges(start, size)

    monkeypatch.setattr(toxicity, "_ranges", counted)
    for (terms, w), score in zip(vectors[:50], index.by_frequent(vectors[:50]), strict=True):
        want = whole[:, terms] @ w
        got = index.nearest(terms, w, 5)
        assert got == index.nearest(terms, w, 5, score)
        assert np.allclose([s for _, s in got], np.sort(want)[::-1][:5], rtol=0, atol=1e-12) and all(abs(want[i] - s) < 1e-12 for i, s in got)
    assert [i for i, _ in index.nearest(*vectors[20], 2)] == [20, 500]
    assert sum(read) < 0.1 * 101 * sum(len(terms) for terms, _ in vectors) * 30 / 40


def test_toxicity_scores_are_brute_force(spark):
    """Each text's score from all pairs: TF-IDF of all terms, cosines, votes and the curve, by dictionaries."""
    rng = random.Random(3)
    plain, bad = [f"word{i}" for i in range(60)], ["scoundrel", "villainous", "rotten"]
    rows, marks = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(4, 40))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    options = toxicity.Options(max_examples=200, neighbours=5)
    model = toxicity.fit(docs, labels, options)
    label = dict(marks)
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    counts = {i: toxicity.count_terms(toxicity.terms_of(t)) for i, t in rows}
    contexts = {}
    for i, t in learned:
        words = ["", *t.split(), ""]
        for x, w, y in zip(words, words[1:], words[2:]):
            for term in toxicity.features_of(w):
                contexts.setdefault(term, set()).add((label[i], x, y))
    totals = [sum(sum(c[0] == y for c in found) for found in contexts.values()) for y in (0, 1)]
    n, df = len(learned), Counter(term for i, _ in learned for term in counts[i])

    def weight(term, c):
        n0, n1 = (sum(x[0] == y for x in contexts[term]) for y in (0, 1))
        above = math.log((n1 + 0.5) / (totals[1] + 1)) - math.log((n0 + 0.5) / (totals[0] + 1)) - 3 * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
        relevance = 0.02 + (max(0, above) ** 2 if n1 >= 3 else 0)
        return (1 + math.log(c)) * (math.log((1 + n) / (1 + df[term])) + 1) * relevance

    def vector(i):
        v = {t: weight(t, c) for t, c in counts[i].items() if t in df}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    vectors = {i: vector(i) for i, _ in rows}
    prior = (sum(label[i] for i, _ in learned) + 0.5) / (n + 1)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    a, b = model.curve
    for i, _ in rows:
        near = sorted(((sum(w * vectors[j].get(t, 0) for t, w in vectors[i].items()), j) for j, _ in learned), reverse=True)
        near = [x for x in near if x[0] > 0]
        if len(near) > 5 and near[4][0] - near[5][0] < 1e-9:
            continue
        total = sum(s for s, _ in near[:5])
        vote = (sum(s * label[j] for s, j in near[:5]) + prior) / (total + 1)
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-(a + b * toxicity.logit(vote)))), rel_tol=1e-6)
        assert got[i]["evidence"][0] == near[0][1] or near[0][0] - near[1][0] < 1e-9
    held = [r for r in got.values() if r["held_out"]]
    assert held and all(r["predicted"] == label[r["doc_id"]] for r in held)


def test_calibration_curve_is_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float)
    a, b = toxicity.fit_curve(x, y, np.ones(4000))
    assert abs(a - 0.5) < 0.2 and abs(b - 1.5) < 0.2


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op9_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    wrong = sum(r["predicted"] for r in rows if not r["toxic"])
    assert caught >= 0.85 * sum(r["toxic"] for r in rows) and wrong <= 0.02 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_huffman_code_is_a_prefix_code():
    code = lm_mixing.Code([5, 9, 12, 13, 16, 45])
    assert abs(sum(2.0 ** -int(n) for n in code.size) - 1) < 1e-12 and code.size[5] == 1


@pytest.mark.parametrize("part", (1, 7, 1 << 20))
def test_bits_of_parts_are_those_of_the_whole(monkeypatch, part):
    """Slots and values of words' bits, by hand, however many words are looked up at once."""
    monkeypatch.setattr(lm_mixing, "PART", part)
    rng = np.random.default_rng(2)
    head = [(f"w{i}".encode(), 400 - i) for i in range(60)]
    bits = lm_mixing.Bits(head, 20_000, lm_mixing.Options())
    texts = [[f"w{rng.integers(0, 70)}".encode() for _ in range(n)] for n in (1, 40, 2)]
    symbols, doc = bits.coded(texts)
    assert symbols.tolist() == [min(int(w[1:]), 60) for t in texts for w in t]
    owner, slots, value = bits.words(symbols, doc)
    mixed = lambda a, b: (x := (a ^ b) * 0x9E3779B97F4A7C15 % 2**64) ^ x >> 29
    at = 0
    for t in range(len(symbols)):
        one = int(symbols[t - 1]) + 1 if t and doc[t - 1] == doc[t] else 0
        two = int(symbols[t - 2]) + 1 if t > 1 and doc[t - 2] == doc[t] else 0
        h1 = mixed(one, 1)
        h2 = mixed(mixed(two, 2), h1)
        for i in range(bits.code.start[symbols[t]], bits.code.start[symbols[t]] + bits.code.size[symbols[t]]):
            node = int(bits.code.nodes[i])
            spread = node * 0xD6E8FEB86659FD93 % 2**64
            want = [node, *[(mixed(h, spread) >> 64 - bits.word_bits) + int(bits.offsets[k]) for k, h in ((1, h1), (2, h2))]]
            assert (owner[at], slots[:, at].tolist(), value[at]) == (t, want, bits.code.bits[i])
            at += 1
    assert at == len(owner)


def test_lm_query(spark, documents):
    counts = Counter(w for i, t in documents.items() if zlib.crc32(str(i).encode()) % 10 for w in lm_mixing.tokens_of(t))
    total, distinct = counts.total(), len(counts)
    rows = QUERIES["op10_lm_mixing"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        tokens = lm_mixing.tokens_of(documents[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert r["n_tokens"] == len(tokens) and r["train_tokens"] == total and r["score"] < 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_lm_beats_the_base_on_held_out_texts(spark):
    held = QUERIES["op10_lm_mixing"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_lm_tells_copies_apart(spark):
    """A text that another training text repeats costs far fewer bits than one that stands alone, held out or not."""
    rng = random.Random(12)
    vocabulary = [_drawn(rng, "abcdefghij", rng.randint(2, 8)) for _ in range(900)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(200)) for _ in range(300)]
    texts[:60] = texts[60:120]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_mixing.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    learned = {i for i in range(300) if zlib.crc32(str(i).encode()) % 10}
    twice = [i for i in range(120) if (i + 60 if i < 60 else i - 60) in learned]
    alone = range(120, 300)
    assert max(got[i] for i in twice) < 0.5 * min(got[i] for i in alone)
    assert any(i not in learned for i in twice) and any(i in learned for i in twice)


def test_lm_query_scores_are_mixed_by_hand(spark, documents):
    """The distributed passages, rare tokens and mixture against one pass in memory."""
    model_rows = QUERIES["op10_lm_mixing"](spark, SF).collect()
    cut = {}
    for i, t in documents.items():
        tokens = lm_mixing.tokens_of(t)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in tokens], np.uint64)
        cut[i] = lm_mixing.passages_of(hashes, np.zeros(len(tokens), np.int64), 16)[1].tolist()
    learned = Counter(h for i, found in cut.items() if zlib.crc32(str(i).encode()) % 10 for h in found)
    for r in model_rows:
        i = r["doc_id"]
        others = [learned[h] - (0 if r["held_out"] else cut[i].count(h)) for h in cut[i]]
        assert min(others) >= 0
        if all(others):  # every passage is a match: the score is at least that of the least weights
            assert r["score"] >= sum(math.log10(n / learned.total()) + math.log10(0.02) for n in others) - 1e-6


def test_matches_mix_by_posterior():
    assert lm_mixing.mix_matches([], []) == 0
    assert math.isclose(lm_mixing.mix_matches([-3.0], [None]), -3 + math.log10(0.98))
    assert math.isclose(lm_mixing.mix_matches([-3.0], [-1.0]), math.log10(0.02 * 0.1 + 0.98 * 0.001))
    hits = lm_mixing.mix_matches([-50.0] * 40, [-5.0] * 40)
    assert -5 * 40 - 10 < hits < -5 * 40


def test_passages_depend_on_words_only():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (400, 50, 70))
    whole = lm_mixing.passages_of(np.concatenate([b, a]), np.zeros(450, np.int64), 16)[1]
    other = lm_mixing.passages_of(np.concatenate([a, c]), np.zeros(470, np.int64), 16)[1]
    split = lm_mixing.passages_of(np.concatenate([a, c]), np.repeat([0, 1], [400, 70]), 16)[1]
    assert len(np.intersect1d(whole, other)) > 10 and len(np.intersect1d(split, other)) > 10


def test_lm_probabilities_of_next_words_sum_to_one():
    words = [b"a", b"b", b"c"]
    bits = lm_mixing.Bits([(w, 3) for w in words], 12, lm_mixing.Options(least_coded=1, vocabulary=3, word_bits=8, byte_bits=8))
    tables = lm_mixing.Tables(bits)
    tables.learn([[b"a", b"b", b"a"], [b"c"]])
    mixer = lm_mixing.Mixer(bits, tables.seen, dict.fromkeys(words, 3), 12, 3, 0)
    symbols = range(len(words) + 1)
    after = [mixer.word_costs(np.array([0, s]), np.array([0, 0]), 1)[1] for s in symbols]
    assert abs(sum(10**x for x in after) - 1) < 1e-5
