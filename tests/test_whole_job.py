"""Queries that once did less than the whole job, against brute force on small tables."""

import math
from collections import Counter, defaultdict

import pytest
import regex

from tidemark.plans import records

PAPERS = [
    ("paper-00-000000", "Prêt de titres", "Le prêt a expiré après l’échéance prévue."),
    ("paper-00-000001", "Доходность", "Месячная доходность после издержек; Σw and p₁ remain."),
    ("paper-00-000002", "市值", "动量 因子 收益 expiré"),
    ("paper-00-000003", None, "momentum spread shrinks after costs, доходность too"),
    ("paper-00-000100", "La доходность du prêt", "Restated revenue amendment naïve café"),
    ("paper-00-000200", "Borrow costs", None),
]


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


@pytest.fixture
def papers(spark, tmp_path):
    spark.createDataFrame(PAPERS, "paper_id string, title string, text string").coalesce(1).write.parquet(str(tmp_path / "corpus.parquet"))
    return str(tmp_path)


def indexed():
    """Term counts of each paper that has a text."""
    return {p: Counter(words("\n".join(x for x in (title, text) if x is not None))) for p, title, text in PAPERS if text is not None}


def idf(tfs):
    df = Counter(t for tf in tfs.values() for t in tf)
    return {t: math.log1p((len(tfs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}


def best(tfs, query, k=10):
    weights, mean = idf(tfs), sum(sum(tf.values()) for tf in tfs.values()) / len(tfs)
    scores = {p: sum(weights[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * sum(tf.values()) / mean)) for t in set(words(query)) if t in tf) for p, tf in tfs.items()}
    return sorted(((p, s) for p, s in scores.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[:k]


def test_index_holds_words_of_every_script(spark, papers):
    tfs = indexed()
    df, cf, weights = Counter(t for tf in tfs.values() for t in tf), sum(tfs.values(), Counter()), idf(tfs)
    got = {r["term"]: (r["df"], r["cf"], r["idf"]) for r in records.bm25_index_stats(spark, papers).collect()}
    assert got == {t: (df[t], cf[t], round(weights[t], 6)) for t in df}
    assert {"prêt", "доходность", "市值", "动量", "naïve"} <= got.keys()


def test_search_weighs_words_of_every_script(spark, papers):
    tfs, got = indexed(), defaultdict(list)
    for r in records.bm25_topk(spark, papers).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q, text in records.QUESTIONS:
        assert got[q] == [(p, pytest.approx(s, abs=1e-5)) for p, s in best(tfs, text)]


def test_titles_of_every_hundredth_paper_are_searched(spark, papers):
    tfs, got = indexed(), defaultdict(list)
    for r in records.bm25_topk(spark, papers).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    asked = records.QUESTIONS + [(p, title) for p, title, _ in PAPERS if p.endswith("00")]
    want = {q: [(p, pytest.approx(s, abs=1e-5)) for p, s in best(tfs, text)] for q, text in asked}
    assert got == {q: hits for q, hits in want.items() if hits} and {"paper-00-000000", "paper-00-000100"} <= got.keys()
    second = {q: (words(text) * 2)[1] for q, text in asked}
    relevant = {q: {p for p, tf in tfs.items() if w in tf} for q, w in second.items()}
    hits = {q: [p for p, _ in best(tfs, text)] for q, text in asked}
    answerable = [q for q in second if relevant[q]]
    metrics = records.retrieval_recall_mrr(spark, papers).first()
    assert metrics["n_answerable"] == len(answerable)
    assert metrics["recall"] == pytest.approx(sum(len(relevant[q] & set(hits[q])) / len(relevant[q]) for q in answerable) / len(answerable), abs=1e-6)
    assert metrics["mrr"] == pytest.approx(sum(next((1 / (i + 1) for i, p in enumerate(hits[q]) if p in relevant[q]), 0) for q in answerable) / len(answerable), abs=1e-6)
