import random

import numpy as np

from plenaria.llm import reading_level as L

EASY = ["Das Haus ist groß.", "Wir gehen heute.", "Es ist gut so.", "Er hat Zeit."]
HARD = ["Die Zuständigkeitsvoraussetzungen, soweit die Rechtsmittelbelehrung unbeschadet der Verwaltungsvorschriften entgegensteht, bedürfen der Genehmigungsfähigkeitsprüfung;", "nach Maßgabe der Durchführungsbestimmungen, die den Beteiligungsverfahren zugrunde liegen, richtet sich die Nichterfüllungsfolge."]


def document(rng, share):
    return " ".join(rng.choice(HARD if rng.random() < share else EASY) for _ in range(20))


def tables(spark, n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        level = 1 + i % 4
        docs.append((i, document(rng, (level - 1) / 3 * 0.9 + rng.random() * 0.05), "x", 5))
        labels += [(i, "g1", level), (i, "g1", level)]
    docs += [(n, None, "x", 5), (n + 1, "", "x", 5), (n + 2, "kurz " * 29, "x", 5), (n + 3, "!!! ???", "x", 5)]
    labels += [(None, "g", 1), (n, "g", None), (n + 1, "g", 7), (10**9, "g", 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, n long"), spark.createDataFrame(labels, "doc_id long, grader string, level int")


def test_held_out_accuracy_and_defined_cases(spark):
    docs, labels = tables(spark)
    docs = L.featured(docs)
    model = L.fit_levels(docs, labels.where("doc_id % 8 < 4 OR doc_id IS NULL"))
    got = {r.doc_id: r.level for r in L.reading_levels(docs, model).collect()}
    assert set(got) == set(range(400)) and set(got.values()) <= {1, 2, 3, 4}
    odd = [k for k in got if k % 8 >= 4]
    assert np.mean([got[k] == 1 + k % 4 for k in odd]) > 0.9
    again = {r.doc_id: r.level for r in L.reading_levels(docs.repartition(5), L.fit_levels(docs.repartition(3), labels.where("doc_id % 8 < 4"))).collect()}
    assert np.mean([again[k] == got[k] for k in got]) > 0.99


def test_without_grades_and_without_rows(spark):
    docs, labels = tables(spark, 8)
    docs = L.featured(docs)
    model = L.fit_levels(docs, labels.limit(0))
    assert [r.level for r in L.reading_levels(docs, model).collect()] == [None] * 8
    model = L.fit_levels(docs.limit(0), labels)
    assert L.reading_levels(docs.limit(0), model).count() == 0


def test_the_bound_on_graded_documents(spark):
    docs, labels = tables(spark, 200)
    model = L.fit_levels(L.featured(docs), labels, graded=100)
    assert model.fitted


def test_isotonic_and_ranker():
    borders, values = L.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0]))
    assert borders.tolist() == [1.0, 2.0, 4.0] and values.tolist() == [1.0, 2.5, 4.0]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    w = L.fit_ranker(x, np.floor(x @ np.array([1, 2, 0, 0, 0]) + 5))
    s = x @ w
    assert np.corrcoef(s, x @ np.array([1, 2, 0, 0, 0]))[0, 1] > 0.98
