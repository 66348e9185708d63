"""Rule sets as plain rows, and the compiler that turns them into column expressions.

Every rule set here can be replaced by the caller: operators take the rows as an argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# They must equal the published behaviour for results to match.
# ---------------------------------------------------------------------------

# cause match, effect match, score. "~x" means "contains x". First match wins.
BATCH_DOMAIN_RULES = [
    ("OOMKilled", ["BackOff", "Failed", "Killing"], 0.95),
    ("OOMKilled", ["Evicted"], 0.90),
    ("MemoryPressure", ["OOMKilled", "Evicted"], 0.88),
    ("DiskPressure", ["Evicted", "Failed"], 0.85),
    ("PIDPressure", ["Failed", "BackOff"], 0.82),
    ("~ImagePull", ["Failed", "BackOff"], 0.90),
    ("ImagePullBackOff", ["Failed"], 0.92),
    ("ErrImagePull", ["ImagePullBackOff"], 0.93),
    ("InvalidImageName", ["~ImagePull"], 0.88),
    ("RegistryUnavailable", ["~ImagePull"], 0.87),
    ("Unhealthy", ["Killing", "Failed", "BackOff"], 0.88),
    ("ProbeWarning", ["Unhealthy"], 0.85),
    ("LivenessProbe", ["Killing", "BackOff"], 0.87),
    ("ReadinessProbe", ["Unhealthy"], 0.83),
    ("FailedScheduling", ["Pending", "Failed"], 0.90),
    ("Unschedulable", ["FailedScheduling"], 0.88),
    ("NodeAffinity", ["FailedScheduling", "Pending"], 0.86),
    ("Taints", ["FailedScheduling", "Pending"], 0.85),
    ("InsufficientResources", ["FailedScheduling"], 0.89),
    ("FailedMount", ["Failed", "ContainerCreating"], 0.88),
    ("VolumeFailure", ["FailedMount", "Failed"], 0.87),
    ("FailedAttachVolume", ["FailedMount"], 0.90),
    ("VolumeNotFound", ["FailedMount", "Failed"], 0.86),
    ("NetworkNotReady", ["Failed", "Pending"], 0.85),
    ("FailedCreatePodSandBox", ["Failed", "BackOff"], 0.87),
    ("CNIFailed", ["NetworkNotReady"], 0.88),
    ("IPAllocationFailed", ["Failed", "Pending"], 0.86),
    ("DNSConfigForming", ["Failed", "BackOff"], 0.82),
    ("Error", ["BackOff", "Failed", "CrashLoopBackOff"], 0.87),
    ("Completed", ["BackOff"], 0.75),
    ("CrashLoopBackOff", ["Failed"], 0.85),
    ("~Exit", ["BackOff", "Failed"], 0.80),
    ("FailedCreate", ["Failed", "BackOff"], 0.84),
    ("Forbidden", ["Failed", "FailedCreate"], 0.88),
    ("Unauthorized", ["Failed", "Forbidden"], 0.87),
    ("InvalidConfiguration", ["Failed", "BackOff"], 0.86),
    ("ConfigMapNotFound", ["Failed", "BackOff"], 0.85),
]
BATCH_DOMAIN_DEFAULT = 0.30

STREAM_REASON_RULES = [
    ("KubePodCrashLooping", ["KubePodNotReady"], 0.85),
    ("NodeClockNotSynchronising", ["PrometheusMissingRuleEvaluations"], 0.85),
    ("KubePodNotReady", ["KubePodCrashLooping"], 0.80),
    ("KubePodCrashLooping", ["KubePodCrashLooping"], 0.75),
    ("~OOMKilled", ["~CrashLoop"], 0.95),
    ("~ImagePull", ["~FailedScheduling"], 0.90),
    ("~NodeNotReady", ["~Evicted"], 0.90),
]
STREAM_DOMAIN_DEFAULT = 0.40

# cause match, window in minutes. First match wins.
ADAPTIVE_WINDOWS = [
    (["OOMKilled", "Killing", "Error"], 2),
    (["~ImagePull"], 5),
    (["FailedScheduling", "FailedMount"], 15),
]
ADAPTIVE_WINDOW_DEFAULT = 10
ADAPTIVE_WINDOW_MAX = 15

ABSTRACT_TYPES = {
    "Pulling": "POD_IMAGE_PULL", "Pulled": "POD_IMAGE_PULLED", "Created": "POD_CREATED",
    "Started": "POD_STARTED", "Killing": "POD_KILLING", "Failed": "POD_FAILED",
    "BackOff": "POD_BACKOFF", "CrashLoopBackOff": "POD_CRASH_LOOP", "OOMKilled": "MEMORY_OOM",
    "Evicted": "POD_EVICTED", "FailedScheduling": "SCHEDULING_FAILED",
    "FailedMount": "VOLUME_MOUNT_FAILED", "FailedCreatePodSandBox": "NETWORK_SETUP_FAILED",
    "NetworkNotReady": "NETWORK_NOT_READY", "Unhealthy": "HEALTH_CHECK_FAILED",
    "ProbeWarning": "PROBE_WARNING", "NodeNotReady": "NODE_NOT_READY", "NodeReady": "NODE_READY",
    "RegisteredNode": "NODE_REGISTERED", "FailedDiscovery": "SERVICE_DISCOVERY_FAILED",
    "UpdatedEndpoints": "ENDPOINTS_UPDATED",
}
ABSTRACT_TYPE_PARTS = [
    (["OOM", "OutOfMemory"], "MEMORY_OOM"), (["CPU"], "CPU_HIGH"),
    (["Disk", "Volume"], "DISK_ISSUE"), (["Network", "Connection"], "NETWORK_ISSUE"),
    (["Timeout"], "TIMEOUT"), (["Crash"], "POD_CRASH_LOOP"),
]
EVENT_TYPE_SEVERITY = {"Normal": "INFO", "Warning": "WARNING", "Error": "ERROR"}
ERROR_REASON_PARTS = ["OOM", "Crash", "Failed", "Error", "Evicted"]
WARNING_REASON_PARTS = ["BackOff", "Unhealthy", "Probe"]

ALERT_TYPES = {
    "KubePodCrashLooping": "pod_restart", "KubePodNotReady": "pod_failed",
    "KubeNodeNotReady": "service_down", "KubeNodeUnreachable": "service_down",
    "KubeMemoryOvercommit": "memory_high", "KubeCPUOvercommit": "cpu_high",
    "KubePersistentVolumeFillingUp": "disk_high",
    "KubeDeploymentReplicasMismatch": "deployment", "KubeJobFailed": "pod_failed",
    "KubeContainerOOMKilled": "oom_kill", "HighErrorRate": "error_rate_high",
    "HighLatency": "latency_high", "ServiceDown": "service_down",
    "DatabaseConnectionFailed": "network_error",
}
ALERT_TYPE_PARTS = [
    (["crash", "restart"], "pod_restart"), (["memory", "oom"], "memory_high"),
    (["cpu"], "cpu_high"), (["disk", "volume"], "disk_high"),
    (["network", "connection"], "network_error"), (["error"], "error_rate_high"),
    (["latency", "slow"], "latency_high"), (["node", "service"], "service_down"),
]

CLUSTER_REASON_TYPES = {
    "BackOff": "pod_restart", "Failed": "pod_failed", "Killing": "pod_failed",
    "Unhealthy": "health_check_failed", "FailedScheduling": "deployment",
    "FailedMount": "disk_high", "OOMKilling": "oom_kill", "Evicted": "pod_failed",
    "FailedKillPod": "pod_failed", "NodeNotReady": "service_down", "NodeReady": "custom",
    "RegisteredNode": "custom", "FailedCreateEndpoint": "network_error",
    "FailedAttachVolume": "disk_high", "Warning": "error_rate_high",
}
FAULT_TYPES = {
    "POD_CRASH_LOOP": "pod_restart", "POD_FAILED": "pod_failed", "POD_BACKOFF": "pod_restart",
    "MEMORY_OOM": "oom_kill", "MEMORY_HIGH": "memory_high", "CPU_HIGH": "cpu_high",
    "DISK_HIGH": "disk_high", "HEALTH_CHECK_FAILED": "health_check_failed",
    "SERVICE_DOWN": "service_down", "NODE_NOT_READY": "service_down",
    "NETWORK_NOT_READY": "network_error", "NETWORK_SETUP_FAILED": "network_error",
    "POD_EVICTED": "pod_failed", "SCHEDULING_FAILED": "pod_failed",
    "VOLUME_MOUNT_FAILED": "config_change",
}

LOG_ERROR_PATTERNS = [
    ("exception", "EXCEPTION"), ("error", "ERROR"), ("fatal", "FATAL"), ("panic", "PANIC"),
    ("timeout", "TIMEOUT"), (r"connection\s+refused", "CONNECTION_REFUSED"),
    (r"out\s+of\s+memory", "OOM"), (r"null\s+pointer", "NULL_POINTER"),
    (r"failed\s+to", "OPERATION_FAILED"), (r"cannot\s+connect", "CONNECTION_ERROR"),
]
LOG_LEVELS = {
    "TRACE": "DEBUG", "DEBUG": "DEBUG", "INFO": "INFO", "WARN": "WARNING", "WARNING": "WARNING",
    "ERROR": "ERROR", "FATAL": "CRITICAL", "CRITICAL": "CRITICAL", "PANIC": "CRITICAL",
}

# category, alternatives; an alternative is a list of terms that must all occur.
HIGH_SIGNAL_LOGS = [
    ("pod_failure", [["crashloopbackoff"], ["back-off restarting failed container"],
                     ["oom killed"], ["oomkilled"], ["exit code"], ["exited with code"],
                     ["container died"], ["pod evicted"]]),
    ("image", [["imagepullbackoff"], ["errimagepull"], ["failed to pull image"],
               ["image not found"], ["manifest unknown"], ["unauthorized", "registry"]]),
    ("health_check", [["readiness probe failed"], ["liveness probe failed"],
                      ["startup probe failed"], ["probe timeout"], ["health check failed"]]),
    ("network", [["connection refused"], ["connection reset"], ["connection timeout"],
                 ["i/o timeout"], ["dial tcp", "timeout"], ["no route to host"],
                 ["network unreachable"], ["dns lookup failed"], ["could not resolve"],
                 ["unable to connect"], ["deadline exceeded"]]),
    ("resource", [["out of memory"], ["disk full"], ["no space left"],
                  ["too many open files"], ["resource exhausted"], ["quota exceeded"],
                  ["cpu throttling"], ["eviction threshold"]]),
    ("crash", [["panic:"], ["fatal error"], ["segfault"], ["segmentation fault"],
               ["core dumped"], ["stack overflow"], ["null pointer"], ["assertion failed"]]),
    ("database", [["database", "connection failed"], ["database", "connection lost"],
                  ["database", "query timeout"], ["database", "deadlock"],
                  ["database", "duplicate key"], ["database", "constraint violation"],
                  ["database", "too many connections"], ["database", "connection pool"]]),
    ("security", [["certificate", "expired"], ["certificate", "invalid"],
                  ["certificate", "verify failed"], ["certificate", "untrusted"],
                  ["tls handshake", "failed"], ["authentication failed"],
                  ["permission denied"]]),
    ("storage", [["failed to mount"], ["volume", "failed"], ["persistentvolume", "error"],
                 ["failed to attach"], ["io error"]]),
    ("api", [["500"], ["502"], ["503"], ["504"], ["internal server error"], ["bad gateway"],
             ["service unavailable"], ["gateway timeout"]]),
]
LOG_REASONS = [
    (["crashloopbackoff"], "LOG_CRASHLOOP"), (["readiness probe failed"], "LOG_READINESS_FAIL"),
    (["liveness probe failed"], "LOG_LIVENESS_FAIL"),
    (["imagepullbackoff", "errimagepull"], "LOG_IMAGE_PULL_FAIL"),
    (["oom killed", "oomkilled"], "LOG_OOM_KILLED"), (["panic:"], "LOG_PANIC"),
]

FAULT_CAUSALITY = {
    ("cpu_high", "pod_restart"): 0.8, ("memory_high", "oom_kill"): 0.9,
    ("oom_kill", "pod_restart"): 0.95, ("disk_high", "pod_failed"): 0.7,
    ("pod_restart", "service_down"): 0.8, ("pod_failed", "service_down"): 0.9,
    ("service_down", "latency_high"): 0.7, ("network_error", "latency_high"): 0.75,
    ("service_down", "error_rate_high"): 0.8, ("config_change", "pod_restart"): 0.6,
    ("deployment", "pod_restart"): 0.5, ("config_change", "service_down"): 0.65,
    ("health_check_failed", "pod_restart"): 0.7, ("health_check_failed", "service_down"): 0.75,
    ("cpu_high", "latency_high"): 0.6, ("memory_high", "latency_high"): 0.5,
}
FAULT_CAUSALITY_DEFAULT = 0.1

# symptom, causes that count as correct (equal, or contained without case).
EXPECTED_CAUSES = {
    "BackOff": ["OOMKilled", "Error", "Failed"],
    "CrashLoopBackOff": ["OOMKilled", "ImagePullBackOff", "Error"],
    "Evicted": ["NodeNotReady", "OutOfmemory", "DiskPressure"],
    "FailedScheduling": ["ImagePullBackOff", "InsufficientCPU", "InsufficientMemory"],
    "Unhealthy": ["ProbeFailure", "ReadinessProbe", "LivenessProbe"],
    "FailedMount": ["VolumeBindingFailed", "PVCNotFound"],
    "NetworkNotReady": ["CNIError", "PodNetworkError"],
}

NORMAL_REASONS = [
    "Pulled", "Created", "Started", "Scheduled", "Completed", "SuccessfulCreate",
    "SuccessfulDelete", "Killing", "SawCompletedJob", "LOG_INFO",
]

# text parts, type, action, confidence, priority
RECOMMENDATIONS = [
    (["oom", "memory", "oomkilled"], "resource_adjustment", "Increase memory limits", 0.9, "high"),
    (["cpu", "throttl"], "resource_adjustment", "Adjust CPU limits", 0.85, "high"),
    (["crash", "backoff"], "investigation",
     "Investigate application logs and startup issues", 0.8, "high"),
    (["imagepull", "image", "pull"], "configuration", "Fix image pull configuration", 0.9, "high"),
    (["liveness", "readiness", "probe"], "configuration", "Review health check probes",
     0.75, "medium"),
    (["disk", "volume", "storage"], "resource_adjustment",
     "Check storage and volume configuration", 0.8, "high"),
    (["network", "connection", "timeout"], "investigation",
     "Investigate network connectivity", 0.7, "medium"),
]
RECOMMENDATION_DEFAULT = ("investigation", "Review incident details and logs", 0.5)

KEYWORD_WEIGHTS = {
    "oom": 1.0, "killed": 0.9, "crash": 0.9, "fail": 0.8, "error": 0.8, "fatal": 1.0,
    "panic": 0.9, "timeout": 0.7, "refused": 0.7, "memory": 0.8, "cpu": 0.7, "disk": 0.7,
    "quota": 0.6, "limit": 0.6, "network": 0.7, "connection": 0.6, "dns": 0.6, "pod": 0.5,
    "service": 0.5, "deployment": 0.5, "node": 0.6, "pending": 0.4, "crashloop": 1.0,
    "backoff": 0.7, "evicted": 0.8, "imagepull": 0.7, "caused": 0.9, "because": 0.8,
    "due": 0.8, "result": 0.7, "triggered": 0.8,
}
KEYWORD_DIMENSIONS = 384
KEYWORD_STRIDE = 17
STOP_WORDS = ["what", "is", "the", "a", "an", "caused", "by", "show", "me", "find", "all",
              "related", "to"]

# command part, base level. First match wins.
ACTION_LEVELS = [
    ("kubectl get", "low"), ("kubectl describe", "low"), ("kubectl logs", "low"),
    ("kubectl top", "low"), ("kubectl delete pod", "medium"),
    ("kubectl rollout restart", "medium"), ("kubectl edit", "medium"),
    ("kubectl patch", "medium"), ("kubectl annotate", "medium"), ("kubectl label", "medium"),
    ("kubectl scale", "high"), ("kubectl autoscale", "high"),
    ("kubectl set resources", "high"), ("kubectl apply", "high"),
    ("kubectl delete deployment", "critical"), ("kubectl delete service", "critical"),
    ("kubectl delete namespace", "critical"), ("kubectl delete pvc", "critical"),
]
ACTION_TYPE_LEVELS = {
    "investigation": "low", "analyze": "low", "diagnose": "low", "pod_restart": "medium",
    "config_fix": "medium", "resource_scale": "high", "apply_changes": "high",
}
CRITICAL_NAME_PARTS = ["db", "database", "postgres", "mysql", "redis", "kafka", "rabbitmq"]

# operation, warning and critical limit in milliseconds
SLA_LIMITS_MS = {
    "message_processing": (500, 2000), "rca_compute": (200, 1000), "graph_query": (100, 500),
}


# ---------------------------------------------------------------------------
# Compilers
# ---------------------------------------------------------------------------

def matches(col: Column, pattern: str) -> Column:
    """Equality, or containment for a pattern that starts with ``~``."""
    return F.contains(col, F.lit(pattern[1:])) if pattern.startswith("~") else col == pattern


def matches_any(col: Column, patterns: list[str]) -> Column:
    exact = [p for p in patterns if not p.startswith("~")]
    tests = [col.isin(exact)] if exact else []
    tests += [matches(col, p) for p in patterns if p.startswith("~")]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def first_match(branches: list[tuple[Column, object]], default) -> Column:
    """Ordered CASE: the first true condition gives the value. Null conditions do not match."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    if not branches:
        return as_col(default)
    out = F.when(branches[0][0], as_col(branches[0][1]))
    for cond, value in branches[1:]:
        out = out.when(cond, as_col(value))
    return out.otherwise(as_col(default))


def pair_score(cause: Column, effect: Column, rules, default: float, extra=()) -> Column:
    """Score of a (cause, effect) pair by a rule set; ``extra`` branches come after the rows."""
    branches = [(matches(cause, c) & matches_any(effect, e), score) for c, e, score in rules]
    return first_match(branches + list(extra), default)


def lookup(col: Column, table: dict, default: Column) -> Column:
    """Small constant map as an expression, so that no join is needed."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), default)


def contains_any(col: Column, parts: list[str]) -> Column:
    out = F.contains(col, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(col, F.lit(part))
    return out


def contains_alternatives(col: Column, alternatives: list[list[str]]) -> Column:
    out = None
    for terms in alternatives:
        test = F.contains(col, F.lit(terms[0]))
        for term in terms[1:]:
            test = test & F.contains(col, F.lit(term))
        out = test if out is None else out | test
    return out
