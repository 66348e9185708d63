"""Classifiers for events, logs and alerts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import blank_to_null


def event_severity_by_reason(reason: Column, message: Column, event_type: Column) -> Column:
    low = F.lower(message)
    liveness = F.contains(low, F.lit("liveness"))
    return R.first_match([
        (reason.isin("OOMKilled", "CrashLoopBackOff", "Error"), "FATAL"),
        ((reason == "Failed") & F.contains(low, F.lit("pod")), "FATAL"),
        (reason.isin("FailedScheduling", "FailedMount", "FailedAttachVolume"), "ERROR"),
        (reason.isin("ImagePullBackOff", "ErrImagePull", "InvalidImageName"), "ERROR"),
        (reason.isin("ImageGCFailed", "FailedCreatePodContainer"), "ERROR"),
        (reason.isin("Unhealthy", "ProbeWarning") & liveness, "ERROR"),
        (reason.isin("NodeNotReady", "NodePressure", "Evicted", "OOMKilling"), "ERROR"),
        (reason.isin("BackOff", "Unhealthy", "ProbeWarning"), "WARNING"),
        (reason.isin("FailedKillPod", "NetworkNotReady"), "WARNING"),
    ], F.upper(F.coalesce(event_type, F.lit("NORMAL"))))


def abstract_type(reason: Column) -> Column:
    parts = R.first_match([(R.contains_any(reason, p), v) for p, v in R.ABSTRACT_TYPE_PARTS], "CUSTOM")
    return R.lookup(reason, R.ABSTRACT_TYPES, parts)


def event_severity(event_type: Column, reason: Column) -> Column:
    guessed = R.first_match([(R.contains_any(reason, R.ERROR_REASON_PARTS), "ERROR"),
                             (R.contains_any(reason, R.WARNING_REASON_PARTS), "WARNING")], "INFO")
    return R.lookup(event_type, R.EVENT_TYPE_SEVERITY, guessed)


def normalized_severity(event_type: Column) -> Column:
    """Cluster event type (Normal, Warning, other) to severity."""
    kind = F.lower(F.coalesce(event_type, F.lit("")))
    return (F.when(kind.isin("normal", ""), "INFO").when(kind == "warning", "WARNING")
            .otherwise(F.upper(event_type)))


def service_of(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit("app")), F.try_element_at(labels, F.lit("k8s-app")))


def log_severity(message: Column, level: Column, severity: Column, low: Column | None = None) -> Column:
    """Structured level, then glog prefix, then text prefix; a later layer overrides an earlier
    one. Keywords only raise what is still INFO."""
    low = F.lower(message) if low is None else low
    lv, sv = F.upper(level), F.upper(severity)
    structured = R.first_match([
        (lv.isin("DEBUG", "TRACE"), "DEBUG"), (lv.isin("WARN", "WARNING"), "WARNING"),
        (lv.isin("ERROR", "CRITICAL"), "ERROR"), (lv.isin("FATAL", "PANIC", "EMERGENCY"), "FATAL"),
        (level.isNotNull(), "INFO"),
        (sv.isin("WARN", "WARNING"), "WARNING"), (sv.isin("ERROR", "CRITICAL"), "ERROR"),
        (sv.isin("FATAL", "PANIC"), "FATAL")], "INFO")
    glog = F.regexp_extract(message, r"^([IWEF])\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+", 1)
    prefixed = R.first_match([(glog == "I", "INFO"), (glog == "W", "WARNING"),
                              (glog == "E", "ERROR"), (glog == "F", "FATAL")], structured)
    starts = lambda *p: F.rlike(low, F.lit("^(" + "|".join(p) + ")"))
    texted = R.first_match([
        (starts("debug:", r"\[debug\]"), "DEBUG"), (starts("info:", r"\[info\]"), "INFO"),
        (starts("warn:", "warning:", r"\[warn\]"), "WARNING"),
        (starts("error:", r"\[error\]", "err:"), "ERROR"),
        (starts("fatal:", r"\[fatal\]", "panic:"), "FATAL")], prefixed)
    info = texted == "INFO"
    return R.first_match([
        (info & R.contains_any(low, ["exception", "traceback", "stack trace"]), "ERROR"),
        (info & R.contains_any(low, ["fatal error", "panic", "segfault"]), "FATAL"),
        (info & R.contains_any(low, ["failed", "failure", "cannot"]), "WARNING")], texted)


def log_error_type(message: Column) -> Column:
    return R.first_match([(F.rlike(message, F.lit("(?i)" + p)), v)
                          for p, v in R.LOG_ERROR_PATTERNS], F.lit(None).cast("string"))


def stack_trace(message: Column) -> Column:
    """First ten ``at`` lines of a Java trace; the whole message of a Python one."""
    lines = F.filter(F.split(message, "\n"), lambda x: F.startswith(F.trim(x, F.lit(" \t\r")), F.lit("at ")))
    java = (F.contains(message, F.lit("at ")) & R.contains_any(message, ["Exception", "Error"])
            & (F.size(lines) > 0))
    return (F.when(java, F.array_join(F.slice(lines, 1, 10), "\n"))
            .when(F.contains(message, F.lit("Traceback (most recent call last)")), message))


def log_level(message: Column, level: Column) -> Column:
    given = R.lookup(F.upper(F.trim(level)), R.LOG_LEVELS, F.lit("INFO"))
    guessed = R.first_match([(F.rlike(message, F.lit("(?i)(fatal|critical|panic)")), "CRITICAL"),
                             (F.rlike(message, F.lit("(?i)error")), "ERROR"),
                             (F.rlike(message, F.lit("(?i)(warn|warning)")), "WARNING")], "INFO")
    return F.when(blank_to_null(level).isNotNull(), given).otherwise(guessed)


def high_signal_category(severity: Column, low: Column) -> Column:
    """Why a log line is kept: its severity, or the first category of terms it contains.

    ``low`` is the lower-cased line as a column of its own, so that it is worked out once and
    not once per term.
    """
    branches = [(F.upper(severity).isin("ERROR", "FATAL"), "severity")]
    branches += [(R.contains_alternatives(low, alts), name) for name, alts in R.HIGH_SIGNAL_LOGS]
    return R.first_match(branches, F.lit(None).cast("string"))


def log_reason(severity: Column, low: Column) -> Column:
    sev = F.upper(severity)
    branches = [(R.contains_any(low, parts), name) for parts, name in R.LOG_REASONS]
    branches += [(sev == "FATAL", "LOG_FATAL"), (sev == "ERROR", "LOG_ERROR"),
                 (sev.isin("WARNING", "WARN"), "LOG_WARNING")]
    return R.first_match(branches, "LOG_INFO")


def client_log_level(message: Column) -> Column:
    return R.first_match([(R.contains_any(message, ["ERROR", "error", "Error"]), "ERROR"),
                          (R.contains_any(message, ["FATAL", "fatal", "Fatal"]), "FATAL"),
                          (R.contains_any(message, ["WARN", "warn", "Warning"]), "WARN")], "INFO")


def alert_type(name: Column) -> Column:
    low = F.lower(name)
    fuzzy = R.first_match([(R.contains_any(low, p), v) for p, v in R.ALERT_TYPE_PARTS], "custom")
    return R.lookup(name, R.ALERT_TYPES, fuzzy)


def alert_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("critical", "warning", "info"), low).otherwise("warning")


def cluster_event_type(reason: Column, event_type: Column) -> Column:
    other = F.when(event_type == "Warning", "error_rate_high").otherwise("custom")
    return R.lookup(reason, R.CLUSTER_REASON_TYPES, other)


def cluster_event_severity(event_type: Column) -> Column:
    return (F.when(event_type == "Warning", "warning").when(event_type == "Error", "critical")
            .otherwise("info"))


def fault_type(abstract: Column) -> Column:
    return R.lookup(F.upper(abstract), R.FAULT_TYPES, F.lit("custom"))


def service_pattern(service: Column) -> Column:
    """A last name part of nine or more characters is a generated suffix."""
    return F.regexp_replace(service, "-[^-]{9,}$", "-*")


def signature(kind: Column, service: Column, severity: Column, threshold: Column | None = None) -> Column:
    parts = [kind, service_pattern(service), severity]
    return F.concat_ws("|", *parts, *([threshold] if threshold is not None else []))


def pattern_accepts(kind, service, severity, p_kind, p_service, p_severity) -> Column:
    """Does an event satisfy an abstract pattern (a trailing ``*`` is a wildcard)?"""
    prefix = F.substring_index(p_service, "*", 1)
    named = F.when(F.endswith(p_service, F.lit("*")), F.startswith(service, prefix)).otherwise(
        service == p_service)
    return (kind == p_kind) & (severity == p_severity) & named


def message_category(message: Column) -> Column:
    return R.first_match([
        (R.contains_any(message, ["Database"]), "Database Errors"),
        (R.contains_any(message, ["timeout"]), "Timeout Errors"),
        (R.contains_any(message, ["HTTP"]), "HTTP Errors"),
        (R.contains_any(message, ["exception", "Exception"]), "Exceptions"),
        (R.contains_any(message, ["Failed", "failed"]), "Operation Failures")], "Other")
