"""Identity rules, classifiers, dead letters."""

import json

from pyspark.sql import functions as F

from causalspark.functions import classify as K, scalar as C
from causalspark.sources import alerts as A, records
from tests.conftest import rows


def test_tenant_keys(make):
    df = make.frame([("a::x",), ("a|x",), ("x",)], "k string")
    tenant, raw = C.split_tenant_key(F.col("k"))
    assert [tuple(r) for r in df.select(tenant, raw).collect()] == [("a", "x"), ("a", "x"), (None, "x")]


def test_resource_ids(make):
    df = make.frame([("Pod", "u1", "ns", "p"), ("Node", "", "", "n1"), ("Pod", None, "ns", "p")],
                    "kind string, uid string, ns string, name string")
    got = [r[0] for r in df.select(C.resource_id(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["pod:u1", "node::n1", "pod:ns:p"]
    parsed = C.parse_rid(F.col("r"))
    out = make.frame([("pod:ns:p",), ("pod:u1",), ("a:b:c:d",)], "r string").select(*[parsed[k] for k in ("kind", "uid", "ns", "name")])
    assert [tuple(r) for r in out.collect()] == [("Pod", None, "ns", "p"), ("Pod", "u1", None, None), (None,) * 4]


def test_log_severity_layers(make):
    lines = [("x", "error"), ("E0123 10:00:00.123 boom", None), ("[warn] hot", None),
             ("Traceback (most recent call last)", None), ("it failed", None), ("all good", None), ("[debug] failed", None)]
    df = make.frame(lines, "line string, level string")
    got = [r[0] for r in df.select(K.log_severity(F.col("line"), F.col("level"), F.lit(None).cast("string"))).collect()]
    assert got == ["ERROR", "ERROR", "WARNING", "ERROR", "WARNING", "INFO", "DEBUG"]


def test_unwrap_two_levels(make):
    inner = json.dumps({"message": "deep"})
    df = make.frame([("plain",), (inner,), (json.dumps({"log": inner}),), ('{"other": 1}',)], "m string")
    assert [r[0] for r in df.select(records.unwrap(F.col("m"))).collect()] == ["plain", "deep", "deep", '{"other": 1}']


def test_fields_of_inner_records_are_merged(make):
    inner = json.dumps({"message": "deep", "level": "error", "trace": {"id": 7}, "list": [1, 2], "none": None})
    lines = [("plain",), (json.dumps({"log": inner, "level": "info", "stream": "stderr"}),), ('{"other": 1}',), ("{broken",), ("[1]",), ("",), (None,),
             (json.dumps({"message": "m", "log": "kept too", "n": 1.5}),), (json.dumps({"message": None, "log": "l"}),), ("{}",),
             (json.dumps({"message": "{\"message\": \"{\\\"message\\\": 1}\"}"}),)]
    df = records.merge_record(make.frame(lines, "message string").withColumn("log", F.lit(None).cast("string")))
    got = [(r.line, None if r.text is None else json.loads(r.text)) for r in df.select("line", F.to_json("fields").alias("text")).collect()]
    assert got == [
        ("plain", None), ("deep", {"level": "error", "trace": {"id": 7}, "list": [1, 2], "none": None, "stream": "stderr"}),
        ('{"other": 1}', {"other": 1}), ("{broken", None), ("[1]", None), ("", None), ("", None),
        ("m", {"log": "kept too", "n": 1.5}), ("l", {"message": None}), ("{}", {}), ('{"message": 1}', {})]


def test_level_inside_the_line_counts(make):
    raw = make.frame([("k1", 1, "a", json.dumps({"message": "all good", "level": "error"}), "info"), ("k2", 1, "a", "all good", "warn"),
                      ("k3", 1, "a", json.dumps({"message": "all good"}), "warn")], "key string, t long, client_id string, message string, level string")
    for c in ("log", "severity", "pod_uid", "pod_namespace", "pod_name"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    raw = raw.withColumn("kubernetes", F.struct(F.lit("u").alias("pod_uid")))
    assert [r[0] for r in records.normalize_logs(raw).select("severity").collect()] == ["ERROR", "WARNING", "WARNING"]


def test_dead_letters_leave_good_rows_alone(make):
    good = {"client_id": "a", "metadata": {"uid": "u1"}, "reason": "OOMKilled", "type": "Warning",
            "eventTime": "2024-01-01T00:00:00Z", "involvedObject": {"kind": "Pod", "namespace": "n", "name": "p"}}
    late = dict(good, eventTime="", lastTimestamp="2024-01-01T00:00:05Z", metadata={"uid": ""})
    values = [("k1", json.dumps(good)), ("k2", json.dumps(late)), ("k3", "{oops"), ("k4", json.dumps({"reason": "x"})),
              ("k5", json.dumps(dict(good, eventTime="yesterday")))]
    raw = make.frame([(k, v, 1) for k, v in values], "key string, value string, timestamp long")
    ok, dead = records.normalize_events(raw)
    assert rows(ok, "eid", "severity", "abstract_type", "t") == [
        ("k2", "WARNING", "MEMORY_OOM", 1704067205000000), ("u1", "WARNING", "MEMORY_OOM", 1704067200000000)]
    assert sorted(r[0] for r in dead.select("error").collect()) == ["bad timestamp", "malformed record", "malformed record"]


def test_alert_labels_win_over_common_ones(spark):
    hook = spark.sql("""SELECT 'firing' AS status, 'r' AS receiver, 'g' AS groupKey, map('job', 'j') AS groupLabels,
        map('namespace', 'n', 'alertname', 'common') AS commonLabels, map('summary', 's') AS commonAnnotations,
        array(named_struct('status', 'firing', 'labels', map('alertname', 'KubePodCrashLooping', 'pod', 'p'), 'annotations',
        cast(map() AS map<string,string>), 'startsAt', '', 'endsAt', '', 'fingerprint', '')) AS alerts""")
    a = A.explode_alerts(hook)
    e = A.alerts_to_events(a).collect()[0]
    assert (e.reason, e.s_kind, e.s_name, e.s_ns, e.message, e.fault_type, e.severity) == (
        "KubePodCrashLooping", "Pod", "p", "n", "s", "pod_restart", "WARNING")
    assert a.select(A.stable_key(F.col("fingerprint"), F.lit(""), F.col("labels"))).collect()[0][0] == "j|n|j"


def test_service_suffix_is_generalized(make):
    df = make.frame([("api-7d9f8c6b5d",), ("api-v2",), ("x-123456789",)], "s string")
    assert [r[0] for r in df.select(K.service_pattern(F.col("s"))).collect()] == ["api-*", "api-v2", "x-*"]
