import numpy as np
import pytest

from cliptide.llm import langid, quality
from cliptide.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    told = QUERIES["op2_language"](spark, SF).where("held_out")
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = told.join(lang, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows) and not any(r.rejected for r in rows)


def test_odd_texts(spark, odd, empty, sf_docs):
    model = langid.fit(sf_docs.select("doc_id", "text", "lang"))
    got = {(r.doc_id, r.n_letters): r for r in langid.identify(odd, model).collect()}
    assert len(got) == 11 and langid.identify(odd, model).count() == 12
    for (doc, letters), r in got.items():
        assert (r.lang_pred == "und") == (letters == 0) and 0 <= r.score <= 1
        assert letters or r.rejected
    assert got[8, got_letters(got, 8)].lang_pred in model.langs
    assert langid.identify(empty, model).count() == 0
    kept = langid.identified(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3, 5}.isdisjoint(r.doc_id for r in kept.select("doc_id").collect())


def got_letters(got, doc):
    return next(n for d, n in got if d == doc)


def test_nothing_to_learn_from(spark, odd):
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_unknown_script_is_rejected(spark, sf_docs):
    model = langid.fit(sf_docs.select("doc_id", "text", "lang"))
    rows = spark.createDataFrame([(1, "Это предложение написано на другом языке и другими буквами. " * 5)], "doc_id long, text string")
    assert langid.identify(rows, model).first().rejected


def test_probabilities_sum_to_one(spark, sf_docs):
    """After any context, the known characters and the unseen one share a probability of one."""
    model = langid.fit(sf_docs.select("doc_id", "text", "lang"))
    keys = np.array(sorted({int(k) for k in _keys(model)}), np.uint64)
    for head in ("xxx", " th", "der", "￿￿ "):
        base = np.uint64(sum(ord(c) << s for c, s in zip(head, (48, 32, 16))))
        p = np.exp(model.log_probs(base | keys).astype(float)).sum(axis=0)
        assert np.all(p < 1.001) and np.all(p > 0.9)


def _keys(model):
    # Hashes are one-way: the characters come from the letters of the test's own languages.
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêçàâîôûíóúñáï "
    return [ord(c) for c in letters if model.table[0].find(np.array([ord(c)], np.uint64))[0] >= 0]


def test_model_keeps_the_most_frequent_grams(sf_docs):
    small = langid.fit(sf_docs.select("doc_id", "text", "lang"), max_grams=500)
    assert len(small.table[-1].order) <= 500 * len(small.langs)


def test_kept_grams_have_the_probabilities_of_the_whole_model(sf_docs):
    docs = sf_docs.select("doc_id", "text", "lang")
    small, whole = langid.fit(docs, max_grams=500), langid.fit(docs)
    texts = [r.text for r in sf_docs.select("text").limit(100).collect()]
    every = np.unique(langid.grams(*langid.stream(texts)[:2])[0])
    kept = every[small.table[-1].find(every) >= 0]
    assert len(kept) > 500 and len(kept) < len(every)
    assert np.allclose(small.log_probs(kept), whole.log_probs(kept), atol=1e-5)
    assert np.allclose(small.unseen, whole.unseen, atol=1e-5)


def test_rare_and_short_languages_are_calibrated(spark, sf_docs, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 1)
    short = [(10_000 + i, f"Это короткое предложение номер {i}", "ru") for i in range(6)]
    model = langid.fit(sf_docs.select("doc_id", "text", "lang").union(spark.createDataFrame(short, "doc_id long, text string, lang string")))
    assert "ru" in model.langs and np.isfinite(model.limit).all()


def test_held_out_quality(spark):
    rows = QUERIES["op1_quality"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([g >= 0.7 for g in good]) > 0.97


def test_statistics_of_odd_texts(odd, empty):
    rows = {r.doc_id: r for r in quality.statistics(odd).collect()}
    for i in (1, 2):
        assert all(rows[i][s] == 0 for s in quality.STATS)
    assert rows[5].digits == pytest.approx(6 / 8) and rows[4].distinct_words == 1
    assert rows[8].log_words == pytest.approx(np.log1p(120_000))
    assert quality.statistics(empty).count() == 0 and quality.statistics(odd).count() == 12


def test_rules_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(4, 1), (5, 1), (None, 0), (6, None)], "doc_id long, label int")
    measured = quality.statistics(odd)
    for labels, want in ((none, 0.5), (one, 0.99)):
        assert {round(r.score, 6) for r in quality.score(measured, quality.fit(measured, labels)).collect()} == {want}


def test_tree_paths():
    told = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 2 > 0.25)\n    Predict: 1.0\n   Else (feature 2 <= 0.25)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0"
    a, c = quality.STATS[0], quality.STATS[2]
    assert quality.tree_rules(told) == [((a, True, 1.5),), ((a, True, 1.5), (c, False, 0.25)), ((a, True, 1.5), (c, True, 0.25)), ((a, False, 1.5),)]


def test_letters_beyond_the_first_plane():
    """They have keys of their own: none is taken for a letter of another script, and neighbours differ."""
    far = [chr(c) for c in range(0x20061, 0x20061 + 500)]
    chars, _, letters = langid.stream(["".join(far), "abc", "\U0001F600 \U0001D165"])
    own = chars[4:504]  # after the pads and a space
    assert len(set(own.tolist())) == 500 and own.min() >= 0xD800 and own.max() < 0xF900
    assert letters.tolist() == [500, 3, 0]


def test_without_labels_all_documents_stay(sf_docs):
    assert langid.identified(sf_docs, None).count() == sf_docs.count()
