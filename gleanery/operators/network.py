"""Network findings: protocols, issues, ports, hosts, and hosts with their ports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.catalog import _HOST, _PORT, NETWORK_ISSUES, PROTOCOLS, SENSITIVE_PORTS, SERVICES
from . import detect as D

LOCAL_NETS = ("127.", "192.168.", "10.")


def protocols(docs: DataFrame, **columns: str) -> DataFrame:
    return D.present(docs, PROTOCOLS, "network_protocols", **columns)


def issues(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, category, rule, line, context) of the security rules."""
    return D.smells(docs, NETWORK_ISSUES, "network_security_issues", **columns)


def port_values() -> Column:
    """Valid ports of the prepared text as they stand there, distinct."""
    return F.filter(D.matches(_PORT), lambda p: p.try_cast("int").between(0, 65535))


def host_values() -> Column:
    return D.matches(_HOST)


def is_outside(host: Column) -> Column:
    """Whether a host is an address that isn't of a local net."""
    local = F.lit(False)
    for net in LOCAL_NETS:
        local = local | host.startswith(net)
    return host.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") & ~local


def service_of(port: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SERVICES.items() for x in kv))
    return F.coalesce(table[port], F.lit("Unknown Service"))


PORT_RANGES = ((0, 1023, "well known"), (1024, 49151, "registered"), (49152, 65535, "dynamic"))


def port_range(port: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, kind in PORT_RANGES:
        out = F.when(port.between(lo, hi), F.lit(kind)).otherwise(out)
    return out


def endpoint_rows(hosts_: Column, ports_: Column) -> Column:
    """(host, port) pairs that both stand in the text, without overlap, in either order."""
    after = lambda a, b: F.call_function("locate", b, F.col("text"), F.call_function("locate", a, F.col("text")) + F.length(a)) > 0

    def of_host(h: Column) -> Column:
        near = F.filter(ports_, lambda p: after(h, p) | after(p, h))
        return F.transform(near, lambda p: F.struct(h.alias("host"), p.cast("int").alias("port")))

    return T.distinct(F.flatten(F.transform(hosts_, of_host)))


def ports(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, value, port)"""
    rows = F.transform(port_values(), lambda p: F.struct(p.alias("value"), p.cast("int").alias("port")))
    return D.each(docs, rows, "value", **columns)


def sensitive_ports(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, port, service): ports that one wouldn't want to be open."""
    found = ports(docs, **columns).where(F.col("port").isin(*SENSITIVE_PORTS))
    return found.select("id", "port", service_of(F.col("port")).alias("service"))


def hosts(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, host, outside): ``outside`` marks an address that isn't of a local net."""
    rows = F.transform(host_values(), lambda h: F.struct(h.alias("host"), is_outside(h).alias("outside")))
    return D.each(docs, rows, "host", **columns)


def endpoints(docs: DataFrame, **columns: str) -> DataFrame:
    """(id, host, port): pairs of a text in which both stand, without overlap, in either order."""
    rows = T.bound(F.struct(host_values().alias("h"), port_values().alias("p")), lambda s: endpoint_rows(s["h"], s["p"]))
    return D.each(docs, rows, "host", **columns)


def entries() -> Column:
    """All of the above as findings of the prepared text."""
    number = lambda p: p.cast("int")

    def configured(s: Column) -> Column:
        h, p = s["h"], s["p"]
        return F.flatten(
            F.array(
                F.transform(p, lambda v: D.finding("network_ports", v)),
                F.transform(h, lambda v: D.finding("network_hosts", v)),
                F.transform(endpoint_rows(h, p), lambda e: D.finding("network_endpoints", F.concat_ws(":", e["host"], e["port"].cast("string")))),
                F.transform(F.filter(h, is_outside), lambda v: D.finding("network_security_issues", F.concat(F.lit("Address outside local nets: "), v))),
                F.transform(
                    F.filter(p, lambda v: number(v).isin(*SENSITIVE_PORTS)),
                    lambda v: D.finding(
                        "network_security_issues", F.concat(F.lit("Sensitive port "), number(v).cast("string"), F.lit(" ("), service_of(number(v)), F.lit(")"))
                    ),
                ),
            )
        )

    return F.concat(
        D.present_entries(PROTOCOLS, "network_protocols"),
        D.smell_entries(NETWORK_ISSUES, "network_security_issues"),
        T.bound(F.struct(host_values().alias("h"), port_values().alias("p")), configured),
    )


def script_entries() -> Column:
    """Protocols and issues of scripts, whatever the case of the letters."""
    return F.concat(
        D.present_entries([_any_case(d) for d in PROTOCOLS], "network_protocols"),
        D.smell_entries([_any_case(d) for d in NETWORK_ISSUES], "network_security_issues"),
    )


def _any_case(d: D.Detector) -> D.Detector:
    return d if "i" in d.flags else replace(d, flags=d.flags + "i")


def findings(docs: DataFrame, **columns: str) -> DataFrame:
    """All of the above as (id, category, value), distinct within a row."""
    return D.each(docs, T.distinct(entries()), "category", **columns)
