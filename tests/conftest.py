import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from causalspark.session import get_session
    s = get_session("causalspark-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.streaming.statefulOperator.stateRebalancing.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


T0 = 1_700_000_000_000_000


@pytest.fixture(scope="session")
def make(spark):
    """Builders of small engine tables."""
    from pyspark.sql import functions as F

    class Make:
        def episodes(self, rows):
            """rows: (eid, seconds, reason, name[, severity, etype, message, client, kind, ns])"""
            full = []
            for r in rows:
                eid, sec, reason, name, *rest = r
                d = ["ERROR", "k8s.event", f"{reason} message", "a", "Pod", "ns"]
                sev, etype, msg, client, kind, ns = list(rest) + d[len(rest):]
                full.append((client, eid, T0 + int(round(sec * 1_000_000)), etype, sev, reason, msg, kind, ns, name,
                             f"{kind.lower()}:{ns}:{name}", "svc-" + name, "n1"))
            df = spark.createDataFrame(full, "client_id string, eid string, t long, etype string, severity string, reason string, "
                                             "message string, s_kind string, s_ns string, s_name string, rid string, service string, node string")
            return df.withColumn("event_time", F.timestamp_micros("t"))

        def edges(self, rows, client="a"):
            """rows: (src, dst, type)"""
            return spark.createDataFrame([(client, s, d, t, f"edge:{s}->{d}") for s, d, t in rows],
                                         "client_id string, src string, dst string, type string, id string")

        def frame(self, rows, schema):
            return spark.createDataFrame(rows, schema)

    return Make()


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
