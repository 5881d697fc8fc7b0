"""Language models against plain Kneser-Ney in dictionaries, and held-out accuracy on the driver's documents."""

import math
import os
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import language_id as li

WORDS = {"en": "the of and to in that it was for on are with his they at be this from have or by one had not but what all were when".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass über".split(), "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой ещё".split()}


def texts(n, seed, words=12):
    pick = random.Random(seed)
    return [(i, " ".join(pick.choices(WORDS[lang], k=pick.randint(1, words))) + pick.choice([".", "!", " 12", ""]), lang) for i in range(n) for lang in [pick.choice(sorted(WORDS))]]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)


def letters(text):
    kinds = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return " " + "".join(w + " " for w in kinds.split(" ") if w)


class Plain:
    def __init__(self, texts):
        counts = [None, *(Counter() for _ in range(4))]
        for t in texts:
            s = "  " + letters(t)
            counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
        for k in (3, 2, 1):
            counts[k].update(g[1:] for g in counts[k + 1])
        self.counts = counts
        self.total = [None, *(Counter() for _ in range(4))]
        self.types = [None, *(Counter() for _ in range(4))]
        for k in range(1, 5):
            for g, n in counts[k].items():
                self.total[k][g[:-1]] += n
                self.types[k][g[:-1]] += 1
        ones = [None, *(Counter(c.values()) for c in counts[1:])]
        self.discount = [None, *(o[1] / (o[1] + 2 * o[2]) if o[1] + o[2] else 0.5 for o in ones[1:])]

    def p(self, gram, alphabet, k=4):
        if k == 0:
            return 1 / (alphabet + 1)
        g = gram[4 - k :]
        below = self.p(gram, alphabet, k - 1)
        if not self.total[k][g[:-1]]:
            return below
        share = (self.counts[k][g] - self.discount[k]) / self.total[k][g[:-1]] if self.counts[k][g] else 0.0
        return share + self.discount[k] * self.types[k][g[:-1]] / self.total[k][g[:-1]] * below

    def entropy(self, text, alphabet):
        s = "  " + letters(text)
        grams = [s[i - 3 : i + 1] for i in range(3, len(s))]
        return -sum(math.log(self.p(g, alphabet)) for g in grams) / len(grams)


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_cross_entropy_against_plain_models(spark):
    rows = texts(200, 1)
    models = li.train(frame(spark, rows))
    assert models.languages == ["de", "en", "ru"]
    plain = {x: Plain([t for i, t, lang in rows if lang == x and not out(i)]) for x in models.languages}
    alphabet = len({c for m in plain.values() for c in m.counts[1]})
    assert models.alphabet == alphabet
    asked = [t for _, t, _ in texts(40, 2)] + ["Der UND the", "żółw", "x", "été", "中文 the"]
    got, count, lettered = models.cross_entropies(asked)
    want = np.array([[plain[x].entropy(t, alphabet) for x in models.languages] for t in asked])
    assert lettered.all() and np.allclose(got, want, rtol=1e-5) and count[0] == len(letters(asked[0])) - 1


def test_rare_runs_count_where_tasks_cannot_hold_them(spark):
    """Scores with tables of 300 runs a task are those of all runs."""
    rows = texts(200, 1) + [(500, None, "en"), (501, "żółw 中文", "de"), (502, "12", "ru"), (503, " ".join(WORDS["de"] * 3000), "de"), (None, "the", None), (503, "again", "de")]
    docs = frame(spark, rows)
    few, every = li.train(docs, most=300), li.train(docs)
    assert few.whole is not None and every.whole is None and 0 < len(few.frequent.hashes) <= 100
    got, want = (sorted(li.predict(docs, m).collect(), key=str) for m in (few, every))
    assert [(r.doc_id, r.lang_pred, r.rejected) for r in got] == [(r.doc_id, r.lang_pred, r.rejected) for r in want] and len(got) == len(rows)
    assert np.allclose([(r.score, r.cross_entropy) for r in got], [(r.score, r.cross_entropy) for r in want], rtol=1e-5)


def test_probabilities_add_up_to_one(spark):
    models = li.train(frame(spark, texts(150, 4)), most=300)  # rare runs are left out
    plain = Plain([t for i, t, lang in texts(150, 4) if not out(i)])
    alphabet = sorted(plain.counts[1])
    assert len(models.runs[3].hashes) < len(plain.counts[4])
    for context in (" th", "the", "ver", "zzz"):
        grams = np.array([[*map(ord, context), ord(c)] for c in alphabet], dtype=np.uint32)
        whole = np.exp(models.log_probability(grams)).sum(axis=0)
        unseen = 1 - whole  # for a character that no language has
        grams[:, 3] = 0x1F600
        assert np.allclose(unseen, np.exp(models.log_probability(grams[:1]))[0], atol=1e-4)


def test_held_out_texts_are_never_learned_from(spark):
    rows = texts(120, 5)
    other = [(i, ("qqq " * 9 if out(i) else t), ("xx" if out(i) else lang)) for i, t, lang in rows]
    one, two = (li.train(frame(spark, r)) for r in (rows, other))
    assert one.languages == two.languages and all((a.hashes == b.hashes).all() and np.allclose(a.value, b.value) for a, b in zip(one.runs, two.runs, strict=True)) and one.curve == two.curve


def test_the_query_with_edge_cases(spark, tmp_path):
    rows = texts(300, 6, 30)
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 - 34 !?", "en"), (1003, "́́", "en"), (1004, "the of and", None), (None, "der die und", "ru"), (1005, " ".join(WORDS["ru"] * 20000), "ru"), (1006, "x", "en"), (1006, "x", "en")]
    docs = frame(spark, rows + odd).withColumn("GRAM", F.lit("clash")).withColumn("n", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = li.op13_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows + odd)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.lang_pred in (*WORDS, "und") and r.held_out == (r.doc_id is not None and out(r.doc_id))
    assert [by_id[i][0].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 4 and all(by_id[i][0].score == 0 for i in (1000, 1001, 1002, 1003))
    assert by_id[1004][0].lang_pred == "en" and by_id[None][0].lang_pred == "de" and by_id[1005][0].lang_pred == "ru" and len(by_id[1006]) == 2
    right = [by_id[i][0].lang_pred == lang for i, _, lang in rows if out(i)]
    assert sum(right) / len(right) > 0.97


def test_far_texts_are_rejected(spark):
    models = li.train(frame(spark, texts(400, 7, 40)))
    lang, score, _, rejected = models.predict(["zxq wkx qqz xzx kkw zzq " * 10, "the of and to in that it was for on are with his they at be"])
    assert rejected.tolist() == [True, False] and lang[1] == "en" and score[1] > 0.9


def test_curve_and_usual_ranges_come_from_every_text(spark):
    """More texts than a sample of 2000 held, rows of one id among them: as a plain fit over all of them gives."""
    rows = [(i if i % 50 else 7, t, lang) for i, t, lang in texts(3500, 8, 6)]
    models = li.train(frame(spark, rows))
    learned = [(t, lang) for i, t, lang in rows if not out(i)]
    lead, low, margin, n = models.best(*models.cross_entropies([t for t, _ in learned]))
    own = np.array([models.languages.index(lang) for _, lang in learned])
    right = own == lead
    assert len(learned) > 2500 and 0 < right.sum() < len(learned)
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    ridge = 1e-3 * np.diag([margin.std() ** 2, 1.0])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ w)
    assert np.allclose(models.curve, w, rtol=1e-5)
    for i in range(len(models.languages)):
        mine = right & (own == i)
        mean = np.average(low[mine], weights=n[mine])
        assert np.allclose(models.usual[i], [mean, max(1.0, np.sqrt(((low[mine] - mean) ** 2 * n[mine]).mean()))], rtol=1e-5)


def test_measuring_once_is_training_and_predicting(spark):
    docs = frame(spark, [*texts(200, 9), (900, None, "en"), (901, "the of", None), (None, "der", "de"), (902, "12", "ru")])
    for most in (300, li.RUNS):
        got, want = (sorted(df.collect(), key=str) for df in (li.identify(docs, most), li.predict(docs, li.train(docs, most))))
        assert [(r.doc_id, r.lang_pred, r.held_out, r.rejected) for r in got] == [(r.doc_id, r.lang_pred, r.held_out, r.rejected) for r in want]
        assert np.allclose([(r.score, r.cross_entropy) for r in got], [(r.score, r.cross_entropy) for r in want], rtol=1e-7)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "the of", None), (2, "der", None)])
    assert [(r.lang_pred, r.score) for r in li.predict(docs, li.train(docs)).collect()] == [("und", 0.0)] * 2
    none = frame(spark, [])
    assert li.predict(none, li.train(none)).collect() == []
    lone = frame(spark, [(i, "the of and it", "en") for i in range(8)])
    assert {r.lang_pred for r in li.predict(lone, li.train(lone)).collect()} == {"en"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.op13_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    known = [r for r in rows if r.lang_pred != "und"]
    assert len(known) > 150 and sum(r.lang_pred == r.lang for r in known) / len(known) > 0.97
