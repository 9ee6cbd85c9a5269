import random

from plenaria.llm import mixing as M

DDL = "doc_id long, text string, lang string, source string, tokens string"


def documents(spark):
    data = [(i, "wort " * 10, "de" if i % 2 else "FR-fr", "Big " if i < 90 else " small", "x") for i in range(100)]
    data += [(200, None, "de", "small", "x"), (201, "", None, "small", "x"), (202, "wort", "de", None, "x"), (203, "wort", "de", "  ", "x"), (204, "wort", "it", "other", "x")]
    return spark.createDataFrame(data, DDL)


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shortage_goes_to_siblings_first():
    tree = M.Node("r", 1, 0, [M.Node("a", 0.5, 0, [M.Node("a1", 1, 10), M.Node("a2", 1, 100)]), M.Node("b", 0.5, 0, [M.Node("b1", 1, 100)])])
    assert M.fill(tree, 100) == 0
    a, b = tree.children
    assert (a.budget, b.budget) == (50, 50) and [c.budget for c in a.children] == [10, 40]
    tree = M.Node("r", 1, 0, [M.Node("a", 0.5, 10), M.Node("b", 0.5, 100)])
    assert M.fill(tree, 200) == 90 and [c.budget for c in tree.children] == [10, 100]


def test_a_shortage_stays_in_its_language_and_domain_first():
    """Source a is short; its French goes to the French sources of its domain, its German to the German ones."""
    sums = {("a", "fr"): 90, ("a", "de"): 10, ("b", "fr"): 1000, ("c", "de"): 1000, ("d", "fr"): 1000}
    wanted = {"a": (0.4, 1), "b": (0.2, 1), "c": (0.2, 1), "d": (0.2, 1)}
    domains = {"a": "x", "b": "x", "c": "x", "d": "y"}
    root = M.tree(sums, wanted, domains)
    assert abs(root.weight - 1) < 1e-9 and [(n.name, round(n.weight, 9)) for n in root.children] == [("x", 0.8), ("y", 0.2)]
    assert M.fill(root, 1000) == 0
    got = {k: round(n.budget, 6) for k, n in M.leaves(root).items()}
    assert got == {("a", "fr"): 90, ("a", "de"): 10, ("b", "fr"): 470, ("c", "de"): 230, ("d", "fr"): 200}
    # without the languages, or without the domains, others would have taken it
    flat = M.tree({("a", "und"): 100, ("b", "und"): 1000, ("c", "und"): 1000, ("d", "und"): 1000}, wanted, domains)
    M.fill(flat, 1000)
    assert {k[0]: round(n.budget, 6) for k, n in M.leaves(flat).items()} == {"a": 100, "b": 350, "c": 350, "d": 200}
    one = M.tree(sums, wanted, {})
    M.fill(one, 1000)
    assert {k: round(n.budget, 6) for k, n in M.leaves(one).items()} == {("a", "fr"): 90, ("a", "de"): 10, ("b", "fr"): 335, ("c", "de"): 230, ("d", "fr"): 335}
    apart = M.tree(sums, wanted, dict(zip("abcd", "abcd", strict=True)))
    M.fill(apart, 1000)
    assert {k: round(n.budget, 6) for k, n in M.leaves(apart).items()} == {("a", "fr"): 90, ("a", "de"): 10, ("b", "fr"): 300, ("c", "de"): 300, ("d", "fr"): 300}


def test_short_sources_come_from_the_filled_tree():
    """For random trees, a source's budget is under its target just if it can't reach it with all repeats."""
    rng = random.Random(3)
    for _ in range(300):
        names = [f"s{k}" for k in range(rng.randint(1, 6))]
        sums = {(s, lang): rng.randint(0, 90) for s in names for lang in rng.sample(["de", "fr", "it"], rng.randint(0, 3))}
        raw = [rng.random() for _ in names]
        wanted = {s: (w / sum(raw), rng.randint(1, 4)) for s, w in zip(names, raw, strict=True)}
        total, root = sum(sums.values()), M.tree(sums, wanted, {s: rng.choice("xyz") for s in names})
        M.fill(root, float(total))
        for s, (weight, repeats) in wanted.items():
            own = sum(n for (x, _), n in sums.items() if x == s)
            budget = sum(n.budget for (x, _), n in M.leaves(root).items() if x == s)
            assert budget <= own * repeats + 1e-6
            assert (budget < weight * total - M.ROUNDING) == (own * repeats < weight * total - M.ROUNDING), (sums, wanted)


def test_report_and_mix(spark):
    sizes = M.sized(documents(spark))
    assert sizes.where("source = 'small'").count() == 12 and sizes.where("doc_id IN (202, 203)").count() == 0
    t = targets(spark, ("BIG", 0.6, 1), ("small", 0.2, 3), ("small", 0.2, 1), ("none", 0.0, 2))
    report = {r.source: r for r in M.mix_report(sizes, t).collect()}
    assert report["small"].short and not report["big"].short and report["none"].available_tokens == 0 and not report["none"].short
    mixed = M.mix(sizes, t).collect()
    copies = {r.doc_id: r.copies for r in mixed}
    assert all(copies[i] == 3 for i in range(90, 100)) and max(copies.values()) == 3 and 204 not in copies
    assert sorted(mixed) == sorted(M.mix(sizes.repartition(3), t).collect())
    total = sum(r.tokens for r in sizes.collect())
    assert sum(r.tokens * r.copies for r in mixed) <= total
    shares = {r.source: r.actual_share for r in M.mix_shares(M.mix(sizes, t), t).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["none"] == 0


def test_documents_without_tokens_are_not_repeated_more_often(spark):
    data = [(1, "wort wort", "de", "a", ""), (2, "", "de", "a", ""), (3, None, "de", "a", ""), (4, "wort " * 50, "de", "b", ""), (5, "", "fr", "c", ""), (6, "", "fr", "d", "")]
    sizes = M.sized(spark.createDataFrame(data, DDL))
    mixed = {r.doc_id: r.copies for r in M.mix(sizes, targets(spark, ("a", 0.5, 2), ("b", 0.5, 1), ("c", 0.0, 1), ("d", 0.0, 0))).collect()}
    assert mixed[1] == mixed[2] == mixed[3] == 2 and mixed.get(4, 1) == 1 == mixed.get(5, 1) and 6 not in mixed


def test_empty(spark):
    sizes = M.sized(documents(spark).limit(0))
    t = targets(spark, ("big", 1.0, 1), (None, 0.5, 1))
    assert [r.short for r in M.mix_report(sizes, t).collect()] == [False]
    assert M.mix(sizes, t).count() == 0 and M.mix_report(sizes, t.limit(0)).count() == 0
