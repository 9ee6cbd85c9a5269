import random
from types import SimpleNamespace

from plenaria.llm import quota_sample as Q
from plenaria.llm import stable_sample as S
from plenaria.llm.flow import Network

DDL = "speech_id string, country string, date string, delivered_at timestamp, speech_text string, words int"


def deliveries(spark, n, times=1, start=0):
    data = [(f"s{i}", "France", f"20{18 + i % 8}-01-0{1 + i % 9}", None, "mot " * (40 + i % 300), i) for i in range(start, n)] * times
    random.Random(n).shuffle(data)
    return spark.createDataFrame(data, DDL)


def ids(df):
    return sorted(r.speech_id for r in df.collect())


def test_stable_under_order_partitions_and_growth(spark):
    small, large = deliveries(spark, 2000), deliveries(spark, 5000, 2)
    one = ids(S.stable_sample(small, ["country"]))
    assert one == ids(S.stable_sample(small.repartition(7), ["country"])) and len(one) == len(set(one))
    grown = ids(S.stable_sample(large, ["country"]))
    assert set(one) < set(grown) and len(grown) == len(set(grown))
    assert 400 < len(grown) < 600
    assert set(grown) < set(ids(S.stable_sample(large, ["country"], rate=0.2)))


def test_bounds_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "F", None, None, None, 1), ("", None, None, None, None, 1), ("a", None, "x", None, None, 1), ("a", "F", None, None, None, 1)], DDL)
    assert ids(S.stable_sample(df, ["country", "date"], rate=1)) == ["", "a"]
    assert ids(S.stable_sample(df, ["country"], rate=0)) == []
    assert ids(S.stable_sample(df.limit(0), ["country"])) == []


def test_flow_is_cheapest():
    net = Network()
    a, b = net.arc("s", "a", 3, 5), net.arc("s", "b", 2, 1)
    net.arc("a", "t", 2), net.arc("b", "t", 9)
    assert net.send("s", "t", 10) == 4 and (net.flow(a), net.flow(b)) == (2, 2)


TARGETS = "target_id int, country string, period_group string, min_words int, max_words int, target_share double, min_rows int"


def targets(spark, *data):
    return spark.createDataFrame(data, TARGETS)


def test_quotas_and_shortfall(spark):
    speeches = deliveries(spark, 1000)
    rows = Q.eligible(speeches)
    t = targets(spark, (1, "France", "control", 40, 99, 0.5, 1), (2, "France", "post", None, None, 0.5, 1), (3, "Italy", "post", None, None, 0.0, 2))
    report = {r.target_id: r for r in Q.quota_report(rows, t).collect()}
    assert (report[1].asked, report[2].asked, report[3].asked) == (50, 50, 2)
    assert report[3].shortfall == 2 and report[3].available == 0
    assert report[1].shortfall == 0 and report[1].available == rows.where("period_group = 'control' AND words BETWEEN 40 AND 99").count()
    sample = Q.quota_sample(rows, t)
    got = ids(sample)
    assert len(got) == len(set(got)) == 100 == sum(r.quota for r in report.values())
    assert got == ids(Q.quota_sample(rows.repartition(5), t))
    cells = {r.cell: r.n for r in sample.groupBy("cell").count().withColumnRenamed("count", "n").collect()}
    assert cells == {"1": report[1].quota, "2": report[2].quota}


def test_overlapping_targets_and_ties(spark):
    rows = Q.eligible(deliveries(spark, 300))
    t = targets(spark, (2, None, None, None, None, 0.5, 0), (1, "France", None, None, None, 0.5, 0))
    report = Q.quota_report(rows, t).collect()
    assert sum(r.quota for r in report) == 30 and all(r.shortfall == 0 for r in report)


def test_slack_alone_and_beside_other_targets():
    """Two targets over one cell of 30 rows: either could have what it asks, both together can't; the third lacks rows of its own."""
    row = lambda t, share, least: SimpleNamespace(target_id=t, share=share, min_rows=least)
    report, quota = Q.quotas({"1,2": 30, "3": 4}, [row(1, "0", 20), row(2, "0", 25), row(3, "0", 10)], 340)
    by = {r[0]: r[1:] for r in report}
    assert [by[t][3] for t in (1, 2, 3)] == [0, 0, 6]
    assert by[1][4] + by[2][4] == 15 and by[3][4] == 6
    assert by[1][2] + by[2][2] + by[3][2] == 34 == sum(quota.values()) and quota["3"] == 4


def test_eligibility(spark):
    data = [("a", "fr", "01.02.2022", None, "mot " * 40, 0), ("b", "FR", None, None, "mot " * 40, 0), ("c", "France", "31.02.2022", None, "mot " * 40, 0),
            ("d", "France", "2022-01-01", None, "mot " * 39, 99), ("e", "France", "20220101", None, None, 99), (None, "France", "2022-01-01", None, "mot " * 50, 0)]
    got = Q.eligible(spark.createDataFrame(data, DDL)).collect()
    assert [(r.speech_id, r.country, r.period_group, r.words) for r in got] == [("a", "France", "transition", 40)]


def test_empty_tables(spark):
    rows = Q.eligible(deliveries(spark, 10)).limit(0)
    t = targets(spark, (1, "France", "control", None, None, 1.0, 3))
    assert [tuple(r) for r in Q.quota_report(rows, t).collect()] == [(1, 3, 0, 0, 3, 3)]
    assert Q.quota_sample(rows, t).count() == 0
    assert Q.quota_report(rows, t.limit(0)).count() == 0
