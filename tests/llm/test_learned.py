"""Learned operators: held-out accuracy and exact parts."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.llm import langid, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def letters(spark):
    text = "you are a stupid idiot and a total loser with trash talk while the house is open and the water is cold "
    return toxicity.letter_model(spark.createDataFrame([(text * 40,)], "text string"))


@pytest.mark.parametrize("written,meant", [
    ("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("l0s3r", "loser"), ("tr@$h", "trash"), ("stuuuupid", "stupid"), ("i d i o t", "idiot")])
def test_decoding(letters, written, meant):
    assert toxicity.decode(written, letters) == meant


def test_plain_words_pass(letters):
    restorer = toxicity.Restorer(letters)
    assert restorer.marked("The house, is open!!! ||| 42 cold$$$").strip("^$").split("$^") == ["the", "house", "is", "open", "cold"]
    assert "^idiot$" in restorer.marked("an 1d10t!") and "^loser$" in restorer.marked("l o s e r")
    assert toxicity.restored_text("A l0s3r, i d i o t house.", letters) == "A loser, idiot house."


def test_hint_misses_nothing_to_restore():
    for word in ("1d10t", "st.u.p.i.d", "tr@sh", "stuuupid", "$tupid", "id1ot", "idi*t", "a$$", "i d i o t", "x.i.d.i.o.t"):
        assert toxicity.may_hide(f"some {word} there")
    assert not toxicity.may_hide("some plain words, there. and here?")


@pytest.mark.parametrize("written,meant", [
    ("!diot", "idiot"), ("+rash", "trash"), ("idio+", "idiot"), ("(rash", "crash"), ("stupi!", "stupil"), ("iidioott", "idiot"), ("a s s", "ass"),
    ("i   d   i   o   t", "idiot"), ("l   o   s", "los")])
def test_written_forms_reach_the_lattice(letters, written, meant):
    """Leading and trailing look-alikes, doubled letters, three spaced letters, wider blanks."""
    text = f"some {written} there"
    assert toxicity.may_hide(text)
    found = toxicity.Restorer(letters).marked(text)
    pieces = toxicity.Restorer(letters).word(written) if " " not in written else toxicity.decode(written, letters)
    assert pieces and f"^{pieces.split()[-1]}$" in found
    if meant in ("idiot", "trash"):
        assert pieces == meant


def test_brackets_and_marks_of_prose_stay(letters):
    assert toxicity.cores("(see)") == [] and toxicity.cores("house,") == [] and toxicity.cores("!!!") == [] and toxicity.cores("letter") == []


def test_viterbi_finds_the_cheapest_reading(letters):
    """Against every reading of short words, one by one."""
    import itertools

    for written in ("1d!", "i.d", "aa!", "$t*", "lll", "+r@", "a-s-s"):
        best = None
        for choice in itertools.product(*toxicity._options(written)):
            context, cost = "  ", 0.0
            for letters_, extra in choice:
                cost += extra
                for x in letters_:
                    cost += letters.cost(context, x)
                    context = context[1] + x
            total = cost + letters.cost(context, " ")
            text = "".join(x for x, _ in choice)
            if best is None or total < best[0] - 1e-12:
                best = (total, text)
        assert toxicity.decode(written, letters) == best[1].strip()


def test_letter_counts_cover_the_corpus(spark):
    docs = spark.createDataFrame([("ab c",), (None,), ("",), ("ab",)], "text string").repartition(3)
    counts = {(r.kind, r.slot): r.n for r in toxicity.letter_counts(docs).collect()}
    at = toxicity._hash(np.array([ord(c) for c in " ab"], dtype=np.uint64), 3)[0]
    assert counts[3, at] == 2


def test_toxicity_is_learned(spark):
    scores = queries.op9_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scores.join(labels, "doc_id").filter("held_out").select("score", "toxic").toPandas()
    rank = rows.score.rank().to_numpy()
    positive = rows.toxic.to_numpy() == 1
    auc = (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.94
    assert scores.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").isEmpty()


def test_languages_are_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op10_language_id(spark, SF).join(docs, "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.985


def test_undecided_texts(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 20, "en"), (2, "der Hund liegt auf der Matte " * 20, "de")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (6, "½ ② Ⅳ ٣ ²"), (4, "the mat"), (5, "der Hund")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, model).collect()}
    assert [got[k] for k in (1, 2, 3, 6)] == [("und", 0.0)] * 4
    assert (got[4][0], got[5][0]) == ("en", "de")


def test_language_filter_grows_with_its_ngrams(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLOTS", 64)
    docs = spark.createDataFrame([(i, f"{'ab' if i % 2 else 'xy'}{'cdefghij'[i % 8]}kl mno", "en" if i % 2 else "de") for i in range(400)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.slots.shape[1] > 64 and (model.false_rate <= langid.FILL**langid.PROBES).all()
    assert {r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in langid.identify(docs, model).collect()} == {True}
    for words in (1, 2, 20):
        most = langid.most_grams(words)
        size = langid.slots_for(most, words)
        assert size * langid.FILL >= langid.PROBES * most and 8 * size * words <= langid.FILTER_BYTES


def test_language_keeps_its_most_frequent_ngrams_beyond_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 20 + "rare words here " * 6, "en"), (2, "der Hund liegt auf der Matte " * 20, "de")],
                                 "doc_id long, text string, lang string")
    everything = langid.kept_grams(langid.gram_counts(docs), 10**9).groupBy("lang").count().collect()
    few = langid.kept_grams(langid.gram_counts(docs), 30)
    counts = {(r.lang, r.gram): r.n for r in langid.gram_counts(docs).collect()}
    for lang, n in ((r.lang, r["count"]) for r in few.groupBy("lang").count().collect()):
        mine = {r.gram for r in few.filter(F.col("lang") == lang).collect()}
        assert 0 < n <= 30 < {r.lang: r["count"] for r in everything}[lang]
        rest = [counts[lang, r.gram] for r in langid.kept_grams(langid.gram_counts(docs), 10**9).filter(F.col("lang") == lang).collect() if r.gram not in mine]
        assert max(rest) <= min(counts[lang, g] for g in mine)


def test_filter_against_plain_sets(spark):
    """Counts, languages of an n-gram and shares against dictionaries; the filter may only add false positives."""
    texts = [(i, f"{'sol luna mar' if i % 2 else 'sun moon sea'} {'abc'[i % 3] * 2} shared", "es" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    plain: dict = {}
    for _, text, lang in texts:
        low = f" {text} "
        for n in langid.SIZES:
            for k in range(len(low) - n + 1):
                plain[lang, low[k : k + n]] = plain.get((lang, low[k : k + n]), 0) + 1
    totals = {x: sum(v for (lang, _), v in plain.items() if lang == x) for x in ("en", "es")}
    rate = {k: v / totals[k[0]] for k, v in plain.items()}
    held = {k for k, v in plain.items() if v >= langid.LEAST and rate[k] >= langid.SHARE * max(rate.get((x, k[1]), 0) for x in totals)}
    model = langid.learn(docs)
    for gram in {g for _, g in plain}:
        hashed = langid.mix(np.array([_gram(gram)], dtype=np.uint64))
        mask = int(model.masks(hashed, 0)[0])
        for i, lang in enumerate(model.languages):
            assert (mask >> i & 1) or (lang, gram) not in held
    asked = [t for _, t, _ in texts[:6]]
    part, n = langid.shares(model, asked)
    for row, text in enumerate(asked):
        grams = [f" {text} "[k : k + m] for m in langid.SIZES for k in range(len(text) + 3 - m)]
        assert n[row] == len(grams)
        for i, lang in enumerate(model.languages):
            assert abs(part[row, i] - sum((lang, g) in held for g in grams) / len(grams)) < 0.02


def _gram(gram: str) -> int:
    total = len(gram)
    for i, c in enumerate(gram):
        total = (total + ord(c)) * int(langid._STEP[i]) % 2**64
    return total


def test_filter_returns_all_languages_of_a_gram():
    grams, owner = langid.gram_hashes(["abc", "", "a1b"])
    assert np.bincount(owner, minlength=3).tolist() == [4 + 3 + 2, 1, 4 + 3 + 2]
    assert set(grams[owner == 0]) & set(grams[owner == 2])
