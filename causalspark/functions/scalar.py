"""Scalar column expressions: identities, text shaping, rounding, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
MINUTE_US = 60 * MICROS
HOUR_US = 3600 * MICROS
DAY_US = 24 * HOUR_US


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def joined(separator: str, *parts) -> Column:
    """Parts as one key. A null is an empty part, so that no part moves to another's place."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def round_to(c: Column, digits: int = 3) -> Column:
    """Half-up rounding spelled out, so that every engine gives the same bits."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def split_tenant_key(key: Column) -> tuple[Column, Column]:
    """``tenant::raw`` first, then ``tenant|raw``; otherwise no tenant."""
    double, single = F.instr(key, "::"), F.instr(key, "|")
    tenant = F.when(double > 0, F.substring_index(key, "::", 1)).when(
        single > 0, F.substring_index(key, "|", 1))
    raw = (F.when(double > 0, F.substr(key, double + 2))
           .when(single > 0, F.substr(key, single + 1)).otherwise(key))
    return tenant, raw


def resource_id(kind: Column, uid: Column, ns: Column, name: Column) -> Column:
    kind = F.lower(kind)
    return (F.when(F.coalesce(uid, F.lit("")) != "", F.concat(kind, F.lit(":"), uid))
            .when(F.coalesce(ns, F.lit("")) == "", F.concat(kind, F.lit("::"), name))
            .otherwise(F.concat(kind, F.lit(":"), ns, F.lit(":"), name)))


def canonical_id(kind: Column, ns: Column, name: Column) -> Column:
    """Identity that does not depend on the uid: ``kind:ns:name`` or ``kind::name``."""
    return F.concat(F.lower(kind), F.lit(":"), F.coalesce(ns, F.lit("")), F.lit(":"), name)


def parse_rid(rid: Column) -> dict[str, Column]:
    """``kind:uid`` or ``kind:ns:name``; any other number of parts gives nulls."""
    parts = F.split(F.lower(F.trim(rid)), ":")
    n = F.size(parts)
    return {
        "kind": F.when(n.isin(2, 3), canonical_kind(parts[0])),
        "uid": F.when(n == 2, F.get(parts, F.lit(1))),
        "ns": F.when(n == 3, F.get(parts, F.lit(1))),
        "name": F.when(n == 3, F.get(parts, F.lit(2))),
    }


def canonical_kind(kind: Column) -> Column:
    clean = F.lower(F.trim(kind))
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.substr(clean, F.lit(2)))


def safe_name(c: Column, prefix: str, empty: str) -> Column:
    """Letters, digits and underscores, starting with a letter (else the prefix is added)."""
    clean = F.regexp_replace(F.trim(c), r"[^\p{L}\p{Nd}_]", "_")
    return (F.when(clean == "", F.lit(prefix + empty))
            .when(F.rlike(clean, F.lit(r"^\p{L}")), clean)
            .otherwise(F.concat(F.lit(prefix), clean)))


def safe_label(c: Column) -> Column:
    return safe_name(c, "L_", "Unknown")


def safe_relation(c: Column) -> Column:
    return safe_name(F.upper(c), "R_", "REL")


def labels_kv(m: Column) -> Column:
    return F.array_sort(F.transform(F.map_entries(m),
                                    lambda e: F.concat_ws("=", e["key"], e["value"])))


def edge_id(src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), src, F.lit("->"), dst)


def preview(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def search_text(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[blank_to_null(p) for p in parts])


def text_time(t: Column) -> Column:
    """ISO text with microseconds from epoch microseconds."""
    return F.date_format(F.timestamp_micros(t), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


SEVERITY_ORDER = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "FATAL": 4}


def severity_rank(c: Column) -> Column:
    return (F.when(c == "FATAL", 4).when(c == "ERROR", 3).when(c == "WARNING", 2)
            .when(c == "INFO", 1).otherwise(0))


def severity_name(rank: Column) -> Column:
    return (F.when(rank >= 4, "FATAL").when(rank == 3, "ERROR").when(rank == 2, "WARNING")
            .when(rank == 1, "INFO").otherwise("DEBUG"))


def confidence_band(c: Column) -> Column:
    return (F.when(c >= 0.9, "0.90-1.00 (High)").when(c >= 0.7, "0.70-0.89 (Medium-High)")
            .when(c >= 0.5, "0.50-0.69 (Medium)").when(c >= 0.3, "0.30-0.49 (Low-Medium)")
            .otherwise("0.00-0.29 (Low)"))


def gap_band(minutes: Column) -> Column:
    return (F.when(minutes < 1, "< 1 min").when(minutes < 5, "1-5 min")
            .when(minutes < 15, "5-15 min").when(minutes < 60, "15-60 min").otherwise("> 1 hour"))


def is_failure(sev: Column) -> Column:
    return sev.isin("ERROR", "FATAL")
