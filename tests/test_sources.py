"""Readers and sinks on small files: labelled CSV and TSV sets, rules, reports, splits, preview, quantiles."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import labels, payload, rules
from tidewire.operators import detect, metrics, signals
from tidewire.sources import tables


def test_labelled_csv_imputes_means(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y,class\n1,2.0,a,good\n2,,b,bad\n3,4.0,,good\n")
    got = tables.labelled_csv(spark, str(tmp_path), drop=("id",)).collect()
    assert [r.x for r in got] == [2.0, 3.0, 4.0] and [r.label for r in got] == ["good", "bad", "good"] and "id" not in got[0].asDict()


def test_connection_sets_have_codes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,tcp,http,5,normal,20\n1,udp,dns,6,neptune,11\n2,tcp,dns,7,smurf,3\n")
    got = tables.connection_set(spark, str(tmp_path), ["duration", "protocol_type", "service", "src_bytes", "label", "difficulty"]).orderBy("duration").collect()
    assert [(r.protocol_type, r.service, r.label) for r in got] == [(0, 1, 0), (1, 0, 1), (0, 0, 1)] and "difficulty" not in got[0].asDict()


def test_attack_sets_lose_what_leaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,proto,rate,attack_cat,label\n1,tcp,Infinity,Normal,0\n2,udp,2.5,Fuzzers,1\n")
    got = tables.attack_set(spark, str(tmp_path)).orderBy("label").collect()
    assert set(got[0].asDict()) == {"proto", "rate", "label"} and [(r.proto, r.rate, r.label) for r in got] == [(0, 0.0, 0), (1, 2.5, 1)]


def test_labelled_tsv_with_pairs_and_logits(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("label\ttext_a\ttext_b\tlogits\n1\tone\ttwo\t0.5 0.25\n0\tx\ty\t1 2\n")
    got = tables.labelled_tsv(spark, str(tmp_path)).orderBy("label").collect()
    assert [(r.label, r.text_a, r.text_b, r.logits) for r in got] == [(0, "x", "y", [1.0, 2.0]), (1, "one", "two", [0.5, 0.25])]


def test_rules_are_read_and_odd_conditions_never_hold(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("rules:\n  - id: one\n    pattern: '(?i)drop'\n    severity: high\n    category: web\n    description: udp thing\n  - id: two\n    pattern: '.*'\n    severity: low\n    category: net\n    condition: \"re.match('x', payload)\"\n")
    own = rules.load_rules(str(tmp_path))
    assert [r.id for r in own] == ["one", "two"]
    df = spark.createDataFrame([("DROP it, drop", "udp"), ("fine", "tcp")], "p string, protocol string")
    got = [r.matches for r in rules.match_rules(df, "p", own, "protocol", strict_reference=True).collect()]
    assert [[(m.rule_id, m.confidence) for m in x] for x in got] == [[("one", pytest.approx(0.5 + 0.2 * 2 / 5 + 0.1))], []]


@pytest.mark.parametrize(("text", "want"), [
    ("len(payload) > 3", True), ("1 < n < 5", True), ("1 < n < 2", False), ("abs(float(value) - expected) > threshold", True), ("not flag", True), ("missing > 1", False), ("missing > 1 or n == 3", True), ("n in [1, 3]", True), ("n not in [1, 3]", False),
    ("re.match('B', payload)", False), ("re.match('aB', payload, re.I)", True), ("not re.match('bc', payload)", True), ("re.search('b.d', payload)", True), ("re.fullmatch('abc', payload)", False), ("re.match('a', payload, re.X)", False), ("re.match('a', missing)", False), ("payload.lower() == 'x'", False), ("n ==", False), ("n / 0 > 1", False), ("[n][0] > 1", False), ("sum(n) > 1", False),
])
def test_rule_conditions(spark, text, want):
    df = spark.createDataFrame([("abcdef", 3, "9.5", 2.0, 1.0, False)], "payload string, n int, value string, expected double, threshold double, flag boolean")
    assert df.select(rules.condition(text, df.columns)).first()[0] is want


def test_rules_that_use_re_hold_unless_strict(spark):
    own = [r for r in rules.RULES if r.id == "http_invalid_method"]
    df = spark.createDataFrame([("get it", "BREW"), ("get it", "get"), ("get it", None), ("none", "BREW")], "p string, method string")
    assert [[m.rule_id for m in r.matches] for r in rules.match_rules(df, "p", own).collect()] == [["http_invalid_method"], [], [], []]
    assert not any(r.matches for r in rules.match_rules(df, "p", own, strict_reference=True).collect())


def test_rule_sets_are_edited_and_selected():
    own = rules.selected(rules.RULES, [rules.Rule("new", "x", "high", "web")], ("xss_script",), "web", "high")
    assert [r.id for r in own] == ["sql_injection", "path_traversal", "file_inclusion", "new"] and len(rules.RULES) == 28


def test_reports_splits_and_previews(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, "a b"), ("test", 0, "c d")], "split string, label int, text_a string")
    tables.write_splits(df, str(tmp_path / "sets"))
    assert spark.read.csv(str(tmp_path / "sets/unlabelled"), sep="\t", header=True).columns == ["text_a"]
    assert {r.split for r in spark.read.csv(str(tmp_path / "sets/labelled"), sep="\t", header=True).collect()} == {"train", "test"}
    tables.write_report(df, str(tmp_path / "report"), by=("split",), kind="csv")
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 2
    shown = tables.preview(spark.createDataFrame([(1.23456789, None), (2.0, "x")], "v double, t string"), ["v", "t", "none"], 5).collect()
    assert {(r.v, r.t, r.total) for r in shown} == {(1.234568, "", 2), (2.0, "x", 2)}


def test_quantiles_narrow_to_the_values_asked_for(spark):
    random.seed(5)
    values = sorted(random.choice([random.gauss(0, 1), 0.25, 7.0]) for _ in range(20_000))
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    for q in (0.0, 0.03, 0.5, 0.94, 1.0):
        at = (len(values) - 1) * q
        want = values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at))
        assert metrics.exact_quantile(df, "x", q, most=500) == pytest.approx(want) and metrics.exact_quantile(df, "x", q) == pytest.approx(want)
    assert metrics.exact_quantile(df.limit(0), "x", 0.5) is None


def test_byte_features_of_known_payloads(spark):
    df = spark.createDataFrame([(bytearray(b"aab\0\0\xff"),), (bytearray(),), (None,)], "p binary")
    got = [r.f for r in df.select(payload.byte_features(F.col("p")).alias("f")).collect()]
    assert (got[0].length, got[0].unique, got[0].min, got[0].max, got[0].median, got[0].zero_runs, got[0].full_runs, got[0].longest_run) == (6, 4, 0, 255, 97.0, 1, 1, 2)
    assert got[0].entropy == pytest.approx(1.9182958) and got[0].null_ratio == pytest.approx(1 / 3) and got[1] == got[2] and set(got[1].asDict().values()) == {0.0}


def test_labels_and_coercion(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"), "x", [104, 105])], "b binary, s string, a array<int>")
    raw = [payload.coerced(F.col(c), k) for c, k in (("b", "binary"), ("s", "string"), ("a", "array"))]
    r = df.select(*[x.alias(f"r{i}") for i, (x, _) in enumerate(raw)], *[t.alias(f"t{i}") for i, (_, t) in enumerate(raw)]).first()
    assert (bytes(r.r0), bytes(r.r1), bytes(r.r2), r.t0, r.t1, r.t2) == (b"a\xffb", b"x", b"hi", "ab", "x", "")
    own = spark.createDataFrame([("3.0",), ("3",), (" walk ",), (None,)], "v string")
    assert [r[0] for r in own.select(labels.mapped_label(F.col("v"), {"3": "sit"})).collect()] == ["sit", "sit", "walk", None]


def test_detection_uses_fitted_models(spark):
    random.seed(2)
    rows = [(f"k{i}", "drop table from x where 1" if i % 4 == 0 else "hello there") for i in range(200)]
    df = rules.match_rules(spark.createDataFrame(rows, "key string, text string"), "text")
    row = payload.byte_statistics(F.col("text"))
    known = spark.createDataFrame([(f"k{i}", float(i % 4 == 0)) for i in range(0, 120)], "key string, label double")
    run = lambda labels, trees: {r.key: r for r in detect.detect(df, "key", lambda d: d.withColumns({f"f_{k}": v for k, v in row.items()}), [f"f_{k}" for k in row], labels, trees=trees).collect()}
    got = run(known, 10)
    assert len(got) == 200 and all((got[f"k{i}"].proba > 0.5) == (i % 4 == 0) for i in range(200)) and got["k0"].final_score > got["k1"].final_score
    assert {r.proba for r in run(known.limit(0), 5).values()} == {0.5}


def test_correlation_and_convolution(spark):
    signal = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 1, 2, 0, 0])], "capture_id long, bin long, value double")
    templates = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 2.0)], "label string, bin long, value double")
    norm = (5**0.5) * (5**0.5)
    got = {r.lag: r.correlation * norm for r in signals.cross_correlation(signal, templates).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {-1: 0.0, 0: 2.0, 1: 5.0, 2: 2.0, 3: 0.0, 4: 0.0}
    turned = {r.lag: round(r.correlation * norm, 6) for r in signals.cross_correlation(signal, templates, flip=True).collect()}
    assert turned == {-1: 0.0, 0: 1.0, 1: 4.0, 2: 4.0, 3: 0.0, 4: 0.0}
    wide = signals.signal_features(signal, templates, ["t"])
    assert wide.count() == 1 and len(wide.columns) > 45


@pytest.mark.parametrize(("text", "want"), [
    ('[["a", " b "], [], ["c"]]', [["a", "b"], ["c"]]), ('{"sequences": [], "normal_sequences": [{"sequence": ["a", ""]}, {"actions": ["b", "c"]}, {"other": ["d"]}]}', [["a"], ["b", "c"]]),
    ('{"actions": {"1": "walk", "2": " sit "}, "training_sequences": [[1, 2.0, "3", "x"]]}', [["walk", "sit", "3", "x"]]), ('{"action_map": {"s": "step"}, "normal_templates": [{"sequence": ["s"]}]}', [["step"]]),
    ("{}", None), ("no json", None), ('{"sequences": [["q", "7"]]}', [["q", "jump"]]),
])
def test_task_files_of_json(spark, text, want):
    known = F.create_map(F.lit("7"), F.lit("jump"))
    assert spark.createDataFrame([(text,)], "t string").select(tables.task_sequences_json(F.col("t"), known)).first()[0] == want


def test_default_tasks(spark):
    own = lambda *x: sorted(r.seq for r in tables.default_tasks(spark.createDataFrame([(v,) for v in x], "label string")).collect())
    assert own("hello", "walk", "step", "sit") == [["hello", "walk", "step"]] and own("walk", "step", "jump", "hello") == [["hello", "jump"], ["hello", "walk", "step"], ["walk", "step", "jump"]]
    assert own("b", "a", None) == [["a", "b"]] and own() == []
