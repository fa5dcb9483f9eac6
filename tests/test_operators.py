"""Operators on hand-made rows: captures, rules, conformance, outliers, sequences, streams."""

import math
import random
import time
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.functions import net, payload, rules
from tidewire.operators import conformance, corpora, forests, metrics, motion, outliers, profiles, windows
from tidewire.sources import capture, tables
from tidewire.sources.tables import latest_tasks, task_sequences, task_sequences_json
from tidewire.streaming import live


def record(order, seconds, fraction, frame):
    return struct.pack(order + "IIII", seconds, fraction, len(frame), len(frame)) + frame


def udp(src, dst, sport, dport, body, vlan=False):
    ip = bytes([0x45, 0, *struct.pack(">H", 28 + len(body)), 0, 0, 0, 0, 64, 17, 0, 0, *src, *dst])
    return b"\xff" * 12 + (b"\x81\x00\x00\x01" if vlan else b"") + b"\x08\x00" + ip + struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def test_captures_of_all_kinds(spark, tmp_path):
    frame, tagged, other = udp([10, 0, 0, 1], [8, 8, 8, 8], 5000, 53, b"hello"), udp([10, 0, 0, 2], [10, 0, 0, 3], 9, 1900, b"x", True), b"\xff" * 12 + b"\x08\x06" + b"\0" * 28
    for label, order, magic, fraction in (("a", "<", b"\xd4\xc3\xb2\xa1", 7), ("b", ">", b"\xa1\xb2\x3c\x4d", 7000)):
        (tmp_path / label).mkdir()
        body = magic + b"\0" * 20 + record(order, 1, fraction, frame) + record(order, 2, 0, other) + record(order, 3, 0, tagged)
        (tmp_path / label / "one.pcap").write_bytes(body + (b"\1\2\3" if label == "b" else b""))
    (tmp_path / "a" / "bad.pcap").write_bytes(b"nothing")
    frames = capture.read_captures(spark, str(tmp_path))
    rows = capture.decode_headers(frames.where("status = 'ok'")).withColumn("label", capture.capture_label(F.col("capture_id"))).orderBy("label", "idx").collect()
    assert [(r.label, r.idx, r.ts_us, r.src, r.dst, r.proto, r.src_port, r.port, r.payload and bytes(r.payload)) for r in rows[:3]] == [("a", 1, 1000007, "10.0.0.1", "8.8.8.8", 17, 5000, 53, b"hello"), ("a", 2, 2000000, None, None, None, None, 0, None), ("a", 3, 3000000, "10.0.0.2", "10.0.0.3", 17, 9, 1900, b"x")]
    assert rows[3].ts_us == 1000007 and len(rows) == 6
    counts = {r.capture_id.rsplit("/", 2)[-2] + r.capture_id[-8:]: (r.frames, r.bad, r.truncated, r.vlan) for r in capture.capture_counters(frames).collect()}
    assert counts == {"aone.pcap": (3, 0, 0, 1), "abad.pcap": (0, 1, 0, 0), "bone.pcap": (3, 0, 1, 1)}


@pytest.mark.parametrize(("ip", "scope"), [("10.1.2.3", "private"), ("127.0.0.1", "private"), ("169.254.1.1", "private"), ("0.0.0.0", "private"), ("250.0.0.1", "private"), ("172.32.0.1", "public"), ("100.64.0.1", "public"), ("224.0.0.1", "multicast"), ("192.0.0.9", "public"), ("8.8.8.8", "public"), ("1.2.3", "invalid"), ("256.1.1.1", "invalid")])
def test_scopes(spark, ip, scope):
    assert spark.range(1).select(net.ip_scope(F.lit(ip))).first()[0] == scope


def test_payload_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("aab",)], "t string").select(payload.byte_entropy(F.col("t")).alias("e"), payload.longest_run(F.col("t")).alias("r"), payload.hex_pairs(F.col("t"), 2).alias("h"))
    assert [(round(r.e, 9), r.r, r.h) for r in df.collect()][1:] == [(0.0, 0, "00 00"), (0.918295834, 2, "61 61")]


def test_rules_and_conditions(spark):
    own = [rules.Rule("multi", "a.b", "low", "x"), rules.Rule("long", ".*", "high", "x", condition="len(payload) > 5 and protocol == 'udp'"), rules.Rule("missing", ".*", "critical", "x", condition="nothing_here > 3")]
    df = spark.createDataFrame([("A\nb a\tb", "udp"), ("ab", "udp"), (None, "tcp")], "text string, protocol string")
    # .* is found twice in each of the two lines; the name of no protocol is found in every description, a name in none of these.
    for protocol, want in (("protocol", [("long", 0.96), ("multi", 0.54)]), (None, [("long", 1.0), ("multi", 0.64)])):
        got = [[(m.rule_id, m.confidence) for m in r.matches] for r in rules.match_rules(df, "text", own, protocol).collect()]
        assert got == [want, [], []]


def test_groups_name_scans(spark):
    rows = [("1.1.1.1", "9.9.9.9", p, 60, 1.0, 0.0) for p in range(1, 12)] + [("1.1.1.1", "224.0.0.251", 5353, 90, 1.0, 0.0), ("1.1.1.1", "5.5.5.5", 0, 90, 7.5, 0.0)]
    out = profiles.final_verdict(profiles.rule_verdict(profiles.group_hints(profiles.connection_groups(spark.createDataFrame(rows, "src string, dst string, port int, size int, entropy double, interval double")))))
    got = {r.dst: (r.is_risk, r.verdict_source, r.hints) for r in out.collect()}
    assert got == {"9.9.9.9": (True, "rule", ["many_ports", "public", "small_packets"]), "224.0.0.251": (False, "rule", []), "5.5.5.5": (False, "default", ["public", "high_entropy"])}


def steps(spark, sequences):
    return spark.createDataFrame([(f"s{i}", p, a) for i, s in enumerate(sequences) for p, a in enumerate(s)], "seq_id string, pos int, action string")


def test_conformance_statuses(spark):
    train = steps(spark, [["stand", "walk", "jump", "sit"]] * 5 + [["stand", "turn", "sit"]] * 3)
    templates = conformance.as_sequences(train).select("seq").distinct().withColumn("template_id", F.when(F.size("seq") == 4, 1).otherwise(2).cast("long"))
    codes = conformance.label_codes(train)
    coded = conformance.coded(templates.withColumn("seq_id", F.col("template_id").cast("string")), codes).select("template_id", "seq", "text")
    tests = steps(spark, [["stand", "walk", "jump", "sit"], ["stand", "walk", "walk", "jump", "sit"], ["stand", "walk", "jump"], ["stand", "turn", "turn", "turn", "sit"], ["stand", "fly", "sit"]])
    sequences = conformance.coded(conformance.as_sequences(tests), codes)
    aligned = conformance.align_best(sequences, coded, conformance.rank_templates(sequences, coded))
    analysis = conformance.transition_analysis(tests, conformance.transition_matrix(train), conformance.context_transitions(train))
    hard = analysis.where("decision = 'ANOMALY'").select("seq_id")
    status = conformance.sequence_status(aligned, sequences, coded, ["sit"], ["walk", "turn"], hard, conformance.repeat_violations(tests, conformance.max_repeats(train, 1)))
    assert {r.seq_id: r.status for r in status.collect()} == {"s0": "NORMAL", "s1": "UNKNOWN_VALIDITY", "s2": "ANOMALY", "s3": "ANOMALY", "s4": "ANOMALY"}
    ops = {r.seq_id: [o.op for o in r.operations] for r in aligned.collect()}
    assert ops["s0"] == ["match"] * 4 and ops["s2"][-1] == "missing" and "extra" in ops["s1"]


def test_forest_ranks_planted_outliers(spark):
    random.seed(1)
    rows = [(i, random.gauss(0, 1), random.gauss(0, 1)) for i in range(600)] + [(1000 + i, 9.0 + i, -9.0) for i in range(6)]
    got = outliers.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], contamination=0.05, trees=40).collect()
    lowest = {r.id for r in sorted(got, key=lambda r: r.score)[:6]}
    assert lowest == {1000 + i for i in range(6)} and 0.03 < sum(r.label == -1 for r in got) / len(got) < 0.07


def test_metrics_of_known_rows(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.5), (0, 1, 0.4)], "truth int, pred int, score double")
    assert metrics.auc(df).first()[0] == pytest.approx(0.625)
    assert metrics.best_threshold(df).first().threshold == 0.9 or metrics.best_threshold(df).first().f1 == pytest.approx(2 / 3)
    assert metrics.binary_scores(df).first().accuracy == 0.5


def test_sessions_and_short_runs(spark):
    df = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate([(0, "a"), (5, "a"), (6, "b"), (30, "a"), (31, "a")])], "key int, idx int, t long, kind string")
    assert [r.session for r in windows.sessions(df, ["key"], "t", "idx", 10).orderBy("idx").collect()] == [0, 0, 0, 1, 1]
    kept = windows.suppress_repeats(df, ["key"], "t", "kind", 6).collect()
    assert {r.kind: r.kept for r in kept} == {"a": [0, 30], "b": [6]}


def test_splits_and_masks(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    split = corpora.hash_split(df, "k", {"train": 0.8, "valid": 0.1, "test": 0.1}).groupBy("split").count().collect()
    assert sum(r["count"] for r in split) == 1000 and {r.split for r in split} == {"train", "valid", "test"}
    tokens = spark.createDataFrame([(i, p, f"t{p}") for i in range(20) for p in range(40)], "id int, pos int, token string")
    masked = corpora.mask_tokens(tokens)
    assert masked.where("masked").count() == 20 * 6 and masked.where("NOT masked AND shown != token").count() == 0
    assert corpora.learn_merges(spark.createDataFrame([("abab",), ("abc",)], "token string"), 2) == [("a", "b"), ("ab", "ab")]


def test_sequences_of_text_and_json(spark):
    lines = spark.createDataFrame([("# note",), ("a -> b, c",), (" ",), ("x→y",)], "value string")
    assert [r.seq for r in task_sequences(lines).collect()] == [["a", "b", "c"], ["x", "y"]]
    assert spark.range(1).select(task_sequences_json(F.lit('{"templates": [["a"], ["b", "c"]]}'))).first()[0] == [["a"], ["b", "c"]]


def test_task_log_keeps_first_date_and_last_report(spark):
    rows = [(1, 1, 10, 10, "run", "r1"), (1, 2, 20, 20, "done", None), (2, 3, 5, 5, "run", None)]
    got = {r.id: (r.status, r.created_at, r.report) for r in latest_tasks(spark.createDataFrame(rows, "id int, seq int, created_at int, updated_at int, status string, report string")).collect()}
    assert got == {1: ("done", 10, "r1"), 2: ("run", 5, None)}


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, i * 30, 50 + i, "up" if i % 2 else "down", k) for i, k in enumerate("aabbbac")], "capture_id long, ms long, size long, direction string, kind string").withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000)).drop("ms")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.counted(live.read_landing(spark, str(tmp_path / "in"), rows.schema))
    query = live.tumbling_features(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.window.start, r.pkt_count, r.byte_count) for r in rows.groupBy(F.window("ts", "100 milliseconds"), "capture_id").agg(F.count(F.lit(1)).alias("pkt_count"), F.sum("size").alias("byte_count")).collect()}
    assert {(r.window.start, r.pkt_count, r.byte_count) for r in spark.table("tumbling").collect()} == want
    query = live.action_history(live.read_landing(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("history").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert [r.history for r in spark.table("history").collect()] == [["a", "b", "a", "c"]]


def test_pieces_spans_and_three_way_pairs(spark):
    tokens = spark.createDataFrame([(1, 0, "unable"), (1, 1, "zz"), (1, 2, "able")], "id int, pos int, token string")
    got = {r.pos: r.pieces for r in corpora.split_words(tokens, ["un", "able", "##able"]).collect()}
    assert got == {0: ["un", "##able"], 1: ["[UNK]"], 2: ["able"]}
    many = spark.createDataFrame([(i, p, "t") for i in range(40) for p in range(100)], "id int, pos int, token string")
    assert 0.08 < corpora.mask_spans(many).agg(F.avg(F.col("masked").cast("double"))).first()[0] < 0.2
    sentences = spark.createDataFrame([(i, p, f"s {i} of {p}") for i in range(30) for p in range(4)], "id int, pos int, text string")
    kinds = {r.kind: r["count"] for r in corpora.three_way_pairs(sentences).groupBy("kind").count().collect()}
    assert set(kinds) == {"random", "next", "reordered"} and sum(kinds.values()) == 90


def test_task_steps_pick_valid_templates(spark):
    from tidewire.operators import signals

    samples = spark.createDataFrame([("a1", "a", "AAAA"), ("a2", "a", "AAAB"), ("b1", "b", "BBBB")], "sample string, label string, text string")
    graph = conformance.adjacency(spark.createDataFrame([(["a", "b"],)], "seq array<string>"))
    limits = spark.createDataFrame([("a", 0.3), ("b", 0.3)], "best string, threshold double")
    got = signals.score_task_steps(steps(spark, [["a", "b"], ["b", "a"]]), samples, signals.medoid_templates(samples), graph, limits).collect()
    rows = {(r.seq_id, r.pos): r for r in got}
    assert rows["s0", 0].valid and rows["s0", 0].best == "a" and not rows["s0", 0].anomaly
    assert rows["s0", 1].best == "b" and rows["s0", 1].similarity == 1.0 and not rows["s0", 1].anomaly
    assert not rows["s1", 0].valid and rows["s1", 0].anomaly and rows["s1", 1].best is None


def test_leave_one_out_rebuilds_the_templates(spark):
    from tidewire.operators import signals

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    random.seed(4)
    own = [(f"s{i:02}", "abc"[i % 3], "".join(random.choice("VCPE") for _ in range(random.randrange(3, 9)))) for i in range(24)] + [("t", "d", "VVVVV")]
    near = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    want = {}
    for sample, _, text in own:
        scores = []
        for label in "abcd":
            rest = [r for r in own if r[1] == label and r[0] != sample]
            if rest:
                medoid = min(rest, key=lambda r: (-round(sum(near(r[2], o[2]) for o in rest) / len(rest), 9), r[0]))  # noqa: B023
                scores.append((-near(text, medoid[2]), label, medoid[0]))
        want[sample] = min(scores)[1:]
    df = spark.createDataFrame(own, "sample string, label string, text string")
    got = {r.sample: (r.best, r.template) for r in signals.leave_one_out_templates(df).collect()}
    assert got == want
    assert any(r.best != got[r.sample][0] for r in signals.leave_one_out(df).collect())


def _folded(runs, least):
    """The definition read literally: the first short run goes into the one before it (the first of all into the next), from the start again each time."""
    runs, changed = [list(r) for r in runs], True
    while changed and len(runs) > 1:
        changed = False
        for i, r in enumerate(runs):
            if r[1] - r[0] < least:
                t = runs[i - 1 if i else i + 1]
                t[0], t[1], t[3], t[4] = min(t[0], r[0]), max(t[1], r[1]), (t[3] + r[3]) / 2, t[4] + r[4]
                del runs[i]
                changed = True
                break
    out = []
    for r in runs:
        if out and out[-1][2] == r[2]:
            out[-1][0], out[-1][1], out[-1][3], out[-1][4] = min(out[-1][0], r[0]), max(out[-1][1], r[1]), (out[-1][3] + r[3]) / 2, out[-1][4] + r[4]
        else:
            out.append(r)
    return out


def test_short_runs_fold_as_defined(spark):
    random.seed(3)
    assert [r[:3] for r in windows.fold_short_runs([[0, 9, "a", 1.0, 1], [10, 11, "b", 0.0, 1], [12, 40, "c", 1.0, 1]], 5)] == [[0, 11, "a"], [12, 40, "c"]]
    rows = []
    for key in range(60):
        at = 0.0
        for _ in range(random.randrange(1, 9)):
            end = at + random.choice([0.5, 1, 2, 4, 8])
            rows.append((key, at, end, random.choice("ab"), random.random(), random.randrange(1, 4)))
            at = end
    got = windows.merge_short_runs(spark.createDataFrame(rows, "key int, first double, last double, label string, confidence double, windows long"), ["key"], 3).orderBy("key", "first").collect()
    want = [(key, *r) for key in range(60) for r in _folded([list(r[1:]) for r in rows if r[0] == key], 3)]
    assert [tuple(r[:4]) + (round(r[4], 9), r[5]) for r in got] == [tuple(r[:4]) + (round(r[4], 9), r[5]) for r in want]


def test_control_payloads_of_known_bytes(spark):
    good = lambda kind, n: bytes([kind, 9, 0, 0]) + (n - 12).to_bytes(4, "little") + bytes(n - 8)
    rows = [(good(1, 212), "ok"), (good(1, 52), "ok"), (good(4, 16), "ok"), (good(6, 380), "ok"), (good(4, 17), "unexpected_payload_len"), (good(7, 16), "invalid_msg_type"), (b"\x04\x08" + good(4, 16)[2:], "invalid_sub_type"), (good(4, 16) + b"x", "data_len_mismatch"), (b"\x04\x09", "payload_short"), (None, "not_udp")]
    got = spark.createDataFrame([(p, s) for p, s in rows], "p binary, want string").select("want", capture.control_status(F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_flow_sets_keep_their_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Flow ID, Source IP, Dur, Label\nx,1.2.3.4,1.5,BENIGN\ny,1.2.3.5,Infinity,DDoS\n")
    got = tables.flow_set(spark, str(tmp_path)).orderBy("Dur").collect()
    assert [(r.Dur, r.label) for r in got] == [(0.0, 1), (1.5, 0)] and got[0].asDict().keys() == {"Dur", "label"}


def test_many_labels_have_codes_of_their_own(spark):
    labels = spark.createDataFrame([(f"label {i}",) for i in range(400)], "action string")
    codes = conformance.label_codes(labels)
    assert codes.select("code").distinct().count() == 400 and codes.where("length(code) <> 1 OR code = '?'").count() == 0
    seqs = spark.createDataFrame([("a", [f"label {i}" for i in range(400)]), ("b", [f"label {i}" for i in range(399)] + ["other"])], "seq_id string, seq array<string>")
    two = {r.seq_id: r.text for r in conformance.coded(seqs, codes).collect()}
    assert len(two["a"]) == 400 and sum(x != y for x, y in zip(two["a"], two["b"], strict=True)) == 1


def _steps(sequences):
    return [(f"{i}", pos, action) for i, seq in enumerate(sequences) for pos, action in enumerate(seq)]


def test_next_actions_back_off(spark):
    train = spark.createDataFrame(_steps([["a", "b", "c"], ["a", "b", "d"], ["b", "a"]]), "seq_id string, pos int, action string")
    m = conformance.fit_model(train)
    asked = spark.createDataFrame([("known", ["a", "b"], "x"), ("first", [], "x"), ("odd", ["z"], "x"), ("last", ["z", "a"], "x"), ("ruled", ["a", "b"], "y")], "id string, history array<string>, scenario string")
    rules = spark.createDataFrame([("y", [], ["c"])], "scenario string, allowed array<string>, forbidden array<string>")
    got = conformance.predict_next(asked, m["contexts"], m["matrix"], m["starts"], rules)
    by = {}
    for r in got.orderBy("id", "rank").collect():
        by.setdefault(r.id, []).append((r["rank"], r.action, r.probability))
    assert by["known"] == [(1, "c", 0.5), (2, "d", 0.5)] and by["ruled"] == [(2, "d", 0.5)] and "odd" not in by
    assert [a for _, a, _ in by["first"]] == ["a", "b"] and [a for _, a, _ in by["last"]] == ["b", "__END__"]


def test_models_are_saved_and_read(spark, tmp_path):
    train = spark.createDataFrame(_steps([["a", "b", "c"], ["a", "b", "c"], ["b", " a ", " "]]), "seq_id string, pos int, action string")
    fitted = conformance.fit_model(train, margin=1, least=1.0)
    conformance.save_model(fitted, str(tmp_path / "m"))
    again = conformance.load_model(spark, str(tmp_path / "m"))
    for name, part in fitted.items():
        assert sorted(map(str, part.collect())) == sorted(map(str, again[name].collect()))
    assert {r.action: r.most for r in again["repeats"].collect()} == {"a": 2, "b": 2, "c": 2}
    assert [r.seq for r in again["templates"].orderBy("template_id").collect()] == [["a", "b", "c"], ["b", "a"]] and {r.action for r in again["critical"].collect()} == {"a", "b"}


def test_readers_see_whole_models_while_one_is_published(spark, tmp_path):
    from tidewire.sources import models

    folder, table = str(tmp_path / "m"), lambda v: {"a": spark.range(v).toDF("n"), "b": spark.createDataFrame([(str(v), v)], "label string, v int")}
    with pytest.raises(FileNotFoundError):
        models.load(spark, folder)
    assert models.publish(table(3), folder, {"of": 3}) == 1
    old, value = models.load(spark, folder)
    store = models._Store(spark, folder)
    seen = []
    publish = models._Store.publish
    try:  # a reader just before the switch sees the old model, whole
        models._Store.publish = lambda self, number, text: (seen.append(models.load(spark, folder)[1]), publish(self, number, text))[1]
        assert models.publish(table(5), folder, {"of": 5}, split=("b",)) == 2
    finally:
        models._Store.publish = publish
    new, now = models.load(spark, folder)
    assert seen == [{"of": 3}] and (value, now) == ({"of": 3}, {"of": 5}) and old["a"].count() == 3 and new["a"].count() == 5 and new["b"].columns == ["label", "v"]
    assert not store.publish(2, "{}") and store.numbers() == [2, 1]  # a number is given once
    for v in (6, 7):
        models.publish(table(v), folder)
    assert store.numbers() == [4, 3, 2] and models.load(spark, folder, number=3)[0]["a"].count() == 6
    with pytest.raises(FileNotFoundError):
        models.load(spark, folder, number=1)
    with pytest.raises(KeyError):
        models.load(spark, folder, ("c",))
    version = store.manifest(4)["version"]
    spark.range(1).toDF("n").write.mode("append").parquet(f"{folder}/versions/{version}/a")
    with pytest.raises(ValueError, match="rows of its manifest"):
        models.load(spark, folder)


def test_accepted_reviews_are_learned(spark, tmp_path):
    folder = str(tmp_path / "m")
    train = spark.createDataFrame(_steps([["a", "b"], ["a", "c"]]), "seq_id string, pos int, action string")
    reviews = spark.createDataFrame([(["a", "d"], True), (["x"], False), (["a", "b"], True)], "seq array<string>, accepted boolean")
    conformance.save_model(conformance.fit_model(train), folder)
    conformance.refit_accepted(spark, folder, train, reviews)
    model = conformance.load_model(spark, folder, ("templates", "graph", "reviews"))
    assert sorted(r.seq for r in model["templates"].collect()) == [["a", "b"], ["a", "c"], ["a", "d"]]
    assert {r.action: r.successors for r in model["graph"].collect()}["a"] == ["b", "c", "d"]
    assert {tuple(r.seq): r.status for r in model["reviews"].collect()} == {("a", "b"): "accepted", ("a", "d"): "accepted", ("x",): "pending"}
    conformance.refit_accepted(spark, folder, train, spark.createDataFrame([(["x"], True)], "seq array<string>, accepted boolean"))
    model = conformance.load_model(spark, folder, ("templates", "reviews"))
    assert sorted(r.seq for r in model["templates"].collect()) == [["a", "b"], ["a", "c"], ["a", "d"], ["x"]] and {r.status for r in model["reviews"].collect()} == {"accepted"}


def test_hybrid_tokens_have_places(spark):
    import re

    from tidewire.operators import corpora

    texts = ["GET /a?b=1 HTTP/1.1", "", None, "  él  SELECT², script", "x" * 3000, "GETGET GET\n_é_"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", corpora.hybrid_tokens(F.col("t")).alias("h")).collect():
        want = [(x, m.start()) for m in re.finditer(r"\w+|[^\w\s]", texts[r.i] or "") for x in ([256 + corpora.HYBRID.index(m[0])] if m[0] in corpora.HYBRID else [b + 4 for b in m[0].encode()])][:1024]
        assert list(zip(r.h.ids, r.h.starts, strict=True)) == want


def test_forest_draws_from_all_rows_and_cuts_all_scores(spark):
    from tidewire.operators import detect, outliers

    df = spark.range(60_000).select(F.col("id"), (F.col("id") % 1000).cast("double").alias("a"), F.when(F.col("id") >= 59_990, 1e6).otherwise(F.col("id") % 7).cast("double").alias("b"))
    forest = outliers.fit_forest(df, "id", ["a", "b"], trees=60, rows=64, seed=3)
    sizes = [r["size"] for r in forest.where("node = 0").collect()]
    assert len(sizes) == 60 and min(sizes) > 48 and max(sizes) == 64
    few = spark.range(50).select("id", F.col("id").cast("double").alias("a"))
    assert [r["size"] for r in outliers.fit_forest(few, "id", ["a"], trees=5).where("node = 0").collect()] == [50] * 5
    rows = df.withColumn("matches", F.array().cast("array<struct<rule_id:string,severity:string,category:string,confidence:double>>"))
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(200)], "id long, label double")
    got = detect.detect(rows, "id", lambda x: x, ["a", "b"], labels, trees=10, outliers=0.02)
    flagged = {r.id for r in got.where("anomaly = 1").select("id").collect()}
    assert len(flagged) <= 0.02 * 60_000 and set(range(59_990, 60_000)) <= flagged


def test_chain_states(spark):
    rows = spark.createDataFrame([("s", []), ("n", ["x"]), ("p", ["a", "q", "b"]), ("t", ["a", "b", "c"]), ("d", ["a", "e"])], "seq_id string, seq array<string>")
    got = {r.seq_id: (r.matched, r.last, r.next, r.state) for r in conformance.longest_valid_chain(rows, {"a": ["b", "e"], "b": ["c"]}, ["a"], ["c"]).collect()}
    assert got == {"s": (0, None, ["a"], "START"), "n": (0, None, ["a"], "NO_MATCH"), "p": (2, "b", ["c"], "IN_PROGRESS"), "t": (3, "c", [], "TERMINAL"), "d": (2, "e", [], "DEAD_END")}


def test_statuses_of_known_sequences(spark):
    """Sixteen sequences checked against a model of three templates: exact ones, tolerable ones, unknown ones and anomalies."""
    a, b, c = ["stand", "wave", "walk", "stop"], ["stand", "walk", "turn", "walk", "stop"], ["stand", "sit", "stop"]
    cases = [
        (a, "NORMAL"), (b, "NORMAL"), (c, "NORMAL"), (["stand", "walk", "stop"], "NORMAL_WITH_TOLERANCE"), (["stand", "jump", "walk", "stop"], "NORMAL_WITH_TOLERANCE"), (["stand", "wave", "turn", "stop"], "UNKNOWN_VALIDITY"), (["stand", "walk", "sit", "walk", "stop"], "UNKNOWN_VALIDITY"),
        (["wave", "walk", "stop"], "ANOMALY"), (["stand", "wave", "walk"], "ANOMALY"), (a + ["stand"], "ANOMALY"), (["stand", "wave", "walk", "walk", "walk", "stop"], "ANOMALY"), (["sit", "stop"], "ANOMALY"), (["stand", "sit"], "ANOMALY"), (["stop", "stand"], "ANOMALY"), (["walk"], "ANOMALY"), (["stand", "sit", "stop", "wave"], "ANOMALY"),
    ]
    train = spark.createDataFrame(_steps([a, a, b, c]), "seq_id string, pos int, action string")
    m = conformance.fit_model(train, least=1.0)
    critical = sorted(r.action for r in m["critical"].collect())
    assert critical == ["stand", "stop"]
    steps = spark.createDataFrame(_steps([s for s, _ in cases]), "seq_id string, pos int, action string")
    codes = conformance.label_codes(train.select("action").union(steps.select("action")))
    seqs = conformance.coded(conformance.as_sequences(steps), codes)
    templates = conformance.coded(m["templates"].select(F.col("template_id").cast("string").alias("seq_id"), "seq"), codes).select(F.col("seq_id").cast("long").alias("template_id"), "seq", "text")
    aligned = conformance.align_best(seqs, templates, conformance.rank_templates(seqs, templates, 1))
    none = steps.limit(0).select("seq_id")
    got = conformance.sequence_status(aligned, seqs, templates, critical, ["wave"], none, conformance.repeat_violations(steps, m["repeats"]))
    assert [(cases[int(r.seq_id)][0], r.status) for r in got.orderBy(F.col("seq_id").cast("int")).collect()] == cases


def test_spans_follow_each_other_and_fill_the_number_to_mask(spark):
    rng = random.Random(4)
    for n in (1, 7, 40, 200):
        masked = corpora.span_masks(n, [rng.random() for _ in range(n)], [rng.random() for _ in range(n)], 0.15, 0.2, 10)
        assert len(masked) == n and sum(masked) <= max(1, round(n * 0.15)) and (n < 40 or sum(masked) > 0)
    # Spans of three from the start (draws for a length of 3); by order the second comes first, then nothing fits but the rest.
    total = 1 - 0.8**10
    draw = (1 - 0.8**2.5) / total
    assert corpora.span_masks(9, [draw] * 9, [0.5, 0, 0, 0.1, 0, 0, 0.9, 0, 0], 0.4, 0.2, 10) == [False] * 3 + [True] * 3 + [False] * 3
    df = spark.createDataFrame([("x", i, f"t{i}") for i in range(100)], "id string, pos int, token string")
    got = corpora.mask_spans(df, length=50).orderBy("pos").collect()
    assert [r.token for r in got] == [f"t{i}" for i in range(100)] and {r.block for r in got} == {0, 1} and 4 <= sum(r.masked for r in got) <= 16


def test_basic_tokens_of_known_texts(spark):
    df = spark.createDataFrame([("Ünïcode, “Yes”\u0000!\u4e2da1\tb\u200b",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(corpora.basic_tokens(F.col("t"))).collect()] == [["unicode", ",", "“", "yes", "”", "!", "中", "a1", "b"], [], None]


def test_extra_trees_learn_and_leave_out(spark):
    rng = random.Random(1)
    rows = [(f"s{i}", i % 2 * 3 + rng.gauss(0, 1), rng.gauss(0, 1), "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "sample string, x double, y double, label string")
    model, labels = forests.fit_extra_trees(df.where("sample < 's5'"), "sample", ["x", "y"], "label", trees=20)
    got = forests.predict_extra_trees(df, model, labels, ["x", "y"]).collect()
    assert labels == ["a", "b"] and sum(r.predicted == r.label for r in got) > 70 and all(0.5 <= r.confidence <= 1 for r in got)
    out = forests.leave_one_out_report(df.limit(30), "sample", ["x", "y"], "label", trees=15).collect()
    assert len(out) == 30 and sum(r.predicted == r.label for r in out) > 22
    assert [r.predicted for r in forests.leave_one_out_report(df.limit(1), "sample", ["x"], "label").collect()] == [None]
    # A sample that alone has its label can't be told when it is held out.
    odd = spark.createDataFrame([("a", 0.0, "p"), ("b", 0.1, "p"), ("c", 9.0, "q")], "sample string, x double, label string")
    assert {r.sample: r.predicted for r in forests.leave_one_out_report(odd, "sample", ["x"], "label").collect()}["c"] == "p"


def _all_paths(text, templates, transcript=None):
    """The best total over all segmentations, by trying them."""
    import math as m

    n, least, most = len(text), max(2, int(min(len(t) for _, t, _ in templates) * 0.45)), max(3, int(max(len(t) for _, t, _ in templates) * 1.75))

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, x, b, i)
        return row[-1]

    def _step(row, x, b, i):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        return new

    def go(at, s):
        out = [0.0] if at > 0 and at >= n - most and (transcript is None or s == len(transcript)) else []
        for end in range(at + least, min(n, at + most) + 1):
            for label, t, mean in templates:
                ratio = (end - at) / max(mean, 1.0)
                if 0.45 <= ratio <= 1.85 and (transcript is None or (s < len(transcript) and transcript[s] == label)):
                    rest = go(end, s + 1)
                    if rest is not None:
                        out.append(1 - lev(text[at:end], t) / max(end - at, len(t), 1) - abs(m.log(ratio)) * 0.12 - 0.02 + rest)
        return max(out) if out else None

    return go(0, 0)


def test_best_path_against_all_segmentations(spark):
    rng = random.Random(9)
    templates = [("a", "ABAB", 4.0), ("b", "CCD", 3.0), ("a", "ABBA", 4.0)]
    total = lambda path: sum(sim - abs(math.log((end - first) / max(mean, 1.0))) * 0.12 - 0.02 for (label, first, end, sim) in path for mean in [{"a": 4.0, "b": 3.0}[label]])
    for _ in range(25):
        text = "".join(rng.choice(["ABAB", "CCD", "ABBA", "A", "D"]) for _ in range(3))[:11]
        for script in (None, ["a", "b"]):
            path, want = motion.best_path(text, templates, script), _all_paths(text, templates, script)
            if want is None or (script is None and want < 0):
                assert path == [(*max(((1 - _edits(text, t) / max(len(text), len(t)), label) for label, t, _ in templates), key=lambda x: x[0])[::-1][:1], 0, len(text), pytest.approx(max(1 - _edits(text, t) / max(len(text), len(t)) for _, t, _ in templates)))]
                continue
            assert total(path) == pytest.approx(want)
            assert all(x[2] == y[1] for x, y in zip(path[:-1], path[1:], strict=True)) and (script is None or not path or [p[0] for p in path] == script)
    assert motion.best_path("", templates) == [] and motion.best_path("A", templates) == [("a", 0, 1, 0.25)]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_prefix_distances_by_bit_vectors():
    import numpy as np

    rng = random.Random(12)
    for size in (1, 3, 63, 64, 65, 130):
        text, template = "".join(rng.choice("ABC") for _ in range(90)), "".join(rng.choice("ABCD") for _ in range(size))
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (text, template)]
        got = motion.prefix_distances(codes[0], np.arange(0, 90, 7), codes[1], 40)
        for i, first in enumerate(range(0, 90, 7)):
            for k in range(1, min(40, 90 - first) + 1):
                assert got[k - 1, i] == _edits(text[first : first + k], template)


def test_long_texts_are_segmented_in_blocks(monkeypatch):
    rng = random.Random(2)
    templates = [("a", "ABAB" * 6, 24.0), ("b", "CCDA" * 5, 20.0), ("c", "BBBD" * 8, 32.0)]
    labels = [rng.choice("abc") for _ in range(4000)]
    text = "".join({t[0]: t[1] for t in templates}[x] for x in labels)
    began = time.perf_counter()
    path = motion.best_path(text, templates)
    assert len(text) > 90_000 and time.perf_counter() - began < 20
    assert [p[0] for p in path] == labels and path[-1][2] == len(text) and all(p[3] == 1.0 for p in path)
    want = motion.best_path(text[:600], templates)
    monkeypatch.setattr(motion, "STARTS", 7)
    assert motion.best_path(text[:600], templates) == want


def test_motion_training_and_dispatch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for label, shape in (("walk", [1, 9, 1, 9]), ("sit", [5, 5, 1, 1])):
        for s in range(4):
            rows += [(label, f"{label}{s}", i, float(shape[i % 4] * 100 + rng.random())) for i in range(16)]
    df = spark.createDataFrame(rows, "label string, sample string, window_idx long, bytes double")
    model, found = motion.train_motion(df, ["bytes"], 3)
    assert {r.best for r in found["scores"].where("label = 'walk'").collect()} == {"walk"} and found["thresholds"].count() == 2
    motion.publish_motion(model, found, str(tmp_path / "published"))
    again, tables = motion.load_motion(spark, str(tmp_path / "published"))
    assert (again.columns, again.means, again.deviations, again.centers) == (model.columns, model.means, model.deviations, model.centers)
    assert set(tables) == set(found) and all(sorted(map(str, tables[k].collect())) == sorted(map(str, found[k].collect())) for k in ("templates", "thresholds", "sequences"))
    motion.write_training(found, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/windows")).count() == len(rows) and spark.read.parquet(str(tmp_path / "run/manifest")).agg(F.sum("samples")).first()[0] == 8
    one = {r.label: r.text for r in found["sequences"].where("sample IN ('walk0', 'sit0')").collect()}
    texts = spark.createDataFrame([("c", one["walk"] + one["sit"] + one["walk"])], "capture_id string, text string")
    got = motion.segment_captures("dp", texts, found).orderBy("first").collect()
    assert got[0].label == "walk" and "sit" in {r.label for r in got} and {r.status for r in got} <= {"NORMAL", "ANOMALY"}
    assert [r.label for r in motion.segment_captures("scripted", texts, found, ["walk", "sit", "walk"]).orderBy("first").collect()] == ["walk", "sit", "walk"]
    assert motion.segment_captures("scan", texts, found, least=2.0).count() > 0
    active = spark.createDataFrame([("c", 0, len(one["walk"]))], "capture_id string, first int, last int")
    assert [(r.label, r.similarity) for r in motion.segment_captures("activity", texts, found, activity=active).collect()] == [("walk", 1.0)]
    commands = spark.createDataFrame([("c", 1, "up"), ("c", 2, "up"), ("c", 3, "down")], "capture_id string, idx long, label string")
    assert [(r.label, r.first, r.last) for r in motion.segment_captures("command", texts, found, commands=commands).orderBy("first").collect()] == [("up", 1, 3), ("down", 3, 4)]
    for bad in ("none", "scripted"):
        with pytest.raises(ValueError):
            motion.segment_captures(bad, texts, found)


def test_explanations_name_violations(spark):
    checked = spark.createDataFrame([("a", 1, 2, 1, "ANOMALY"), ("b", 1, 0, 1, "NORMAL")], "seq_id string, template_id long, distance int, allowed int, status string")
    why = spark.createDataFrame([("a", 3, "second"), ("a", 1, "first")], "seq_id string, at int, reason string")
    got = {r.seq_id: r for r in conformance.explain(checked, why).collect()}
    assert got["a"].text.endswith("; at 1: first; at 3: second") and got["a"].decision.asDict() == {"valid": False, "status": "ANOMALY", "action": "reject", "violations": 2} and got["b"].decision.action == "accept"
    assert conformance.status_summary(checked).first().asDict() == {"sequences": 2, "normal": 1, "normal_with_tolerance": 0, "unknown_validity": 0, "anomaly": 1, "valid": 1}


def test_correlation_by_blocks_equals_plain_sums(spark):
    import numpy as np

    from tidewire.operators import signals

    rng = random.Random(5)
    captures = {c: [rng.choice([0, 0, rng.randrange(-900, 900)]) for _ in range(n)] for c, n in (("x", 300), ("y", 41), ("z", 1))}
    templates = {"a": [rng.random() for _ in range(17)], "b": [1.0], "c": [rng.random() for _ in range(90)]}
    signal = spark.createDataFrame([(c, i, v) for c, own in captures.items() for i, v in enumerate(own) if v or i in (0, len(own) - 1)], "capture_id string, bin int, value int")
    model = spark.createDataFrame([(t, i, v) for t, own in templates.items() for i, v in enumerate(own)], "label string, bin int, value double")
    for flip in (False, True):
        for lags in (1 << 16, 64, 7):
            got = {}
            for r in signals.cross_correlation(signal, model, flip, lags).collect():
                got[r.capture_id, r.label, r.lag] = r.correlation
            want = {}
            for c, x in captures.items():
                for t, y in templates.items():
                    y = np.array(y[::-1] if flip else y)
                    x = np.array(x, dtype=float)
                    for k, v in enumerate(np.correlate(x, y, "full") / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()) + 1e-9)):
                        want[c, t, k - len(y) + 1] = v
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_features_that_vary_and_tell_are_kept(spark):
    from tidewire.operators import outliers

    rng = random.Random(7)
    rows = [(float(i % 2), float(i % 2) * 9 + rng.random(), rng.random(), 5.0, 3.0 + (i == 0) * 0.001, float(i % 2) * 3 + 2 * rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "label double, tells double, noise double, constant double, nearly double, hints double")
    names = ["noise", "tells", "constant", "nearly", "hints"]
    got = outliers.prepared(df, names, "label", 2).select("label", "tells", "hints", "features").collect()
    middle = {c: sorted(r[i] for r in rows) for i, c in ((1, "tells"), (5, "hints"))}
    for r in got:
        assert len(r.features) == 2
    # Both kept columns move with those that tell, in their order, scaled about the median.
    for place, c in ((0, "tells"), (1, "hints")):
        pairs = sorted((r[c], r.features[place]) for r in got)
        assert [p[1] for p in pairs] == sorted(p[1] for p in pairs) and min(abs(p[1]) for p in pairs) < 1.0
        assert pairs[0][1] < 0 < pairs[-1][1] and middle[c][0] == pairs[0][0]


def test_models_find_what_is_planted(spark):
    from tidewire.operators import outliers

    rng = random.Random(11)
    blobs = [(i, *(c + rng.gauss(0, 0.1) for c in center), k) for k, center in enumerate([(1.0, 50.0), (40.0, 2.0), (300.0, 300.0)]) for i in range(k * 40, k * 40 + 40)]
    df = spark.createDataFrame(blobs, "id long, a double, b double, k int")
    letters = outliers.cluster_symbols(df, ["a", "b"], 3).select("k", "symbol").distinct().collect()
    assert len(letters) == 3 and {r.symbol for r in letters} == {"A", "B", "C"}
    far = outliers.mahalanobis(df.where("k < 2").unionByName(spark.createDataFrame([(999, 1.0, 2.0, 9)], df.schema)), ["a", "b"]).orderBy(F.desc("distance")).first()
    assert far.id == 999
    train = spark.createDataFrame([(i, float(i % 2), [i % 2 * 4.0 + rng.random(), rng.random()]) for i in range(120)], "id long, label double, v array<double>")
    from pyspark.ml.functions import array_to_vector

    train = train.withColumn("features", array_to_vector("v"))
    scores = {r.id: r.proba for r in outliers.ensemble_scores(train.where("id < 80"), train.where("id >= 80"), {k: m for k, m in outliers.classifiers(2, 2).items()}, "id").collect()}
    assert all((p > 0.5) == (i % 2 == 1) for i, p in scores.items()) and len(scores) == 40
    names = [n for n, _ in outliers.importances(outliers.action_classifiers(20)["forest"].fit(outliers.balanced(train, "label")), ["tells", "noise"])]
    assert names == ["tells", "noise"]


def test_merges_of_a_round_are_those_of_one_after_the_other(spark, monkeypatch):
    import collections

    from tidewire.operators import corpora

    def one_by_one(words, merges):
        words, out = [(list(w), n) for w, n in words.items()], []
        while len(out) < merges:
            pairs = collections.Counter()
            for parts, n in words:
                for x, y in zip(parts, parts[1:]):
                    pairs[x, y] += n
            if not pairs:
                break
            best = min(pairs, key=lambda p: (-pairs[p], p))
            out.append(best)
            for k, (parts, n) in enumerate(words):
                own, i = [], 0
                while i < len(parts):
                    if tuple(parts[i : i + 2]) == best:
                        own.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        own.append(parts[i])
                        i += 1
                words[k] = (own, n)
        return out

    rng = random.Random(3)
    rounds = []
    cut = corpora.checkpointed
    monkeypatch.setattr(corpora, "checkpointed", lambda df: (rounds.append(1), cut(df))[1])
    for letters, size, merges in (("abcdefghijklmnop", 400, 120), ("ab", 60, 40), ("abc", 5, 1000)):
        words = collections.Counter()
        stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
        for _ in range(size):
            words["".join(rng.choice(stems) for _ in range(rng.randrange(1, 4)))] += rng.randrange(1, 50)
        rows = [(w,) for w, n in words.items() for _ in range(n)]
        rounds.clear()
        assert corpora.learn_merges(spark.createDataFrame(rows, "token string"), merges) == one_by_one(words, merges)
        if merges == 120:
            assert len(rounds) < merges / 2
