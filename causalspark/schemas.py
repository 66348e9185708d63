"""Schemas of the JSON payloads that arrive on topics."""

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
STRING_MAP = T.MapType(_S, _S)


def _struct(**fields):
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TOPIC = _struct(key=_S, value=_S, topic=_S, timestamp=_L, offset=_L)
SUBJECT = _struct(kind=_S, uid=_S, ns=_S, name=_S)

CLUSTER_EVENT = _struct(
    client_id=_S, metadata=_struct(uid=_S, name=_S, namespace=_S, creationTimestamp=_S),
    reason=_S, message=_S, type=_S, eventTime=_S, firstTimestamp=_S, lastTimestamp=_S,
    source=_struct(component=_S, host=_S),
    involvedObject=_struct(kind=_S, uid=_S, namespace=_S, name=_S, labels=STRING_MAP))

RESOURCE_CHANGE = _struct(
    op=_S, at=_S, client_id=_S, cluster=_S, kind=_S, uid=_S, namespace=_S, name=_S,
    labels=STRING_MAP, node=_S, image=_S, replicas=T.IntegerType())
EDGE_CHANGE = T.StructType([T.StructField(n, _S) for n in
                            ("op", "at", "client_id", "cluster", "id", "from", "to", "type")])
ALERT = _struct(status=_S, labels=STRING_MAP, annotations=STRING_MAP, startsAt=_S, endsAt=_S,
                fingerprint=_S)
ALERT_WEBHOOK = _struct(
    status=_S, receiver=_S, groupKey=_S, groupLabels=STRING_MAP, commonLabels=STRING_MAP,
    commonAnnotations=STRING_MAP, alerts=T.ArrayType(ALERT))
LOG = _struct(client_id=_S, timestamp=_S, message=_S, log=_S, level=_S, severity=_S, pod_uid=_S,
              pod_namespace=_S, pod_name=_S, kubernetes=_struct(pod_uid=_S))
HEARTBEAT = _struct(client_id=_S, t=_L, status=_S)
TARGET_CHANGE = _struct(op=_S, at=_S, client_id=_S, cluster=_S, labels=STRING_MAP, scrapeUrl=_S, health=_S, lastScrape=_S, lastError=_S)
RULE_CHANGE = _struct(op=_S, at=_S, client_id=_S, cluster=_S, group=_S, rule=_S, type=_S, labels=STRING_MAP, annotations=STRING_MAP, expr=_S)
