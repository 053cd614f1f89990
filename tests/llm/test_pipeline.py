"""The pipeline's rows against its stages' rules, worked out by other means."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import regex
import sentencepiece
from test_llm_operators import _contaminated

import corpus_pipeline
from kindred.llm import secret_scan, simhash_dedup, toxicity
from kindred.llm.common import lower_ascii, table, words_of
from kindred.llm.queries import model_path

SF = "/root/testdata/sf0.001"


def test_stage_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontaminate", "secret_scan", "sentencepiece"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def toxic(model, texts):
    """Ids of texts that all pairs of vectors call toxic."""
    space, index = model.space, model.space.index
    vectors = np.zeros((index.n, len(model.terms)))
    for term in range(len(model.terms)):
        for e in range(index.term_start[term], index.term_start[term + 1]):
            at = slice(index.entry_start[e], index.entry_start[e] + index.entry_size[e])
            vectors[index.example[at], term] = index.weight[at]
    found = set()
    for i, text in texts.items():
        terms, counts = model.numbers(toxicity.terms_of(text))
        _, weights = space.vector(terms, counts)
        cosine = vectors[:, terms] @ weights
        near = [k for k in np.argsort(-cosine, kind="stable")[: model.options.neighbours] if cosine[k] > 0]
        w = cosine[near] * space.rates[near] / space.rates.max()
        vote = (w @ space.labels[near] + model.options.smoothing * space.prior) / (w.sum() + model.options.smoothing)
        if model.curve[0] + model.curve[1] * math.log(vote / (1 - vote)) >= 0:
            found.add(i)
    return found


def representatives(docs):
    """The least id of each group of texts that are equal by words or similar by shingles, from all pairs."""
    sets = {i: (" ".join(words_of(lower_ascii(t))), set(simhash_dedup.shingles(t, 5))) for i, t in docs.items()}
    kept = {i: i for i in docs}

    def find(i):
        while kept[i] != i:
            i = kept[i]
        return i

    ids = sorted(docs)
    for x in range(len(ids)):
        for y in range(x):
            (wa, sa), (wb, sb) = sets[ids[x]], sets[ids[y]]
            if wa == wb or (len(sa & sb) >= 0.8 * len(sa | sb) and sa and sb):
                a, b = find(ids[x]), find(ids[y])
                kept[max(a, b)] = min(a, b)
    return {i for i in docs if find(i) == i}


def clean(docs, items):
    """Ids of texts without a near copy of an item, from all windows."""
    plain = lambda t: regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t.lower()).split()
    ids = list(docs)
    bad = {ids[d] for d, _ in _contaminated([plain(docs[i]) for i in ids], [plain(t) for t in items])}
    return set(ids) - bad


def test_run_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    bad = toxic(model, docs)
    docs = {i: t for i, t in docs.items() if i not in bad}
    docs = {i: docs[i] for i in representatives(docs)}
    docs = {i: docs[i] for i in clean(docs, [r["text"] for r in table(spark, SF, "benchmark").collect()])}
    scanner = secret_scan.fit(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = {}
    for i, t in docs.items():
        apart: list[list[int]] = []
        for _, start, end in scanner.spans(t)[1]:
            if apart and start < apart[-1][1]:
                apart[-1][1] = max(end, apart[-1][1])
            else:
                apart.append([start, end])
        shown = t
        for start, end in reversed(apart):
            shown = shown[:start] + "[secret]" + shown[end:]
        want[i] = hashlib.sha256(",".join(map(str, library.encode(shown))).encode()).hexdigest()
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i] != want[i] for i in want) == 0
