"""Fixed values of the telemetry data model: vocabularies and rule tables."""

SIGNAL_KINDS = ("metric", "log", "trace", "event", "alert", "profile")
LOG_SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
SPAN_STATUSES = ("OK", "ERROR", "UNSET")
EDGE_RELATIONS = ("contains", "hosts", "calls", "same_as", "routes")
ENTITY_KINDS = ("service", "pod", "node", "container", "db", "mq", "host", "cluster", "external")
FAULT_CATEGORIES = ("resource", "network", "runtime", "middleware", "code", "config", "dependency", "unknown")

#: Which kinds of entity a relation admits at its two ends; same_as admits all.
RELATION_SIDES = {
    "contains": (("cluster", "node", "host", "service", "pod"), ("pod", "container")),
    "hosts": (("cluster", "node", "host"), ("service", "pod", "container", "db", "mq", "external")),
    "calls": (("service", "external", "container", "host"), ("service", "external", "db", "mq")),
    "routes": (("cluster", "node", "host", "external", "service"), ("service", "pod", "container", "external")),
}

#: symbol: (dimension, numerator, denominator, largest measurement)
UNITS = {
    "ns": ("time", 1, 10**9, None), "us": ("time", 1, 10**6, None), "ms": ("time", 1, 10**3, None),
    "s": ("time", 1, 1, None), "min": ("time", 60, 1, None), "h": ("time", 3600, 1, None),
    "By": ("bytes", 1, 1, None), "KiBy": ("bytes", 1024, 1, None), "MiBy": ("bytes", 1024**2, 1, None), "GiBy": ("bytes", 1024**3, 1, None),
    "rps": ("rate", 1, 1, None), "QPS": ("rate", 1, 1, None), "TPS": ("rate", 1, 1, None), "rps/min": ("rate", 1, 60, None),
    "1": ("ratio", 1, 1, 1), "%": ("ratio", 1, 100, 100), "count": ("count", 1, 1, None), "core": ("cores", 1, 1, None), "mcore": ("cores", 1, 1000, None),
}

#: Share of cases that miss out when a kind of signal is absent.
KIND_WEIGHTS = {"metric": 0.928, "log": 0.562, "trace": 0.43, "event": 0.194, "alert": 0.05, "profile": 0.02}
#: Kinds of signal that an evaluation target needs.
TARGET_KINDS = {
    "openrca-1.0": ("metric", "trace"), "openrca-2.0": ("metric", "trace"), "rcaeval-re1": ("metric",),
    "rcaeval-re2": ("metric", "log", "trace"), "rcaeval-re3": ("metric", "log", "trace"), "rca100": ("metric", "log", "trace", "event", "alert"),
    "aiops2025": ("metric", "log", "trace"), "cloud-opsbench": ("metric", "log", "trace"), "itbench": ("metric", "log", "trace"),
}

#: Ordered: the first category with a matching keyword wins.
CATEGORY_KEYWORDS = (
    ("middleware", ("database", "db", "redis", "kafka", "mq", "queue", "cache", "sql", "mysql", "postgres", "lag")),
    ("network", ("network", "latency", "delay", "loss", "partition", "bandwidth", "dns", "packet", "drop", "net")),
    ("resource", ("cpu", "memory", "mem", "disk", "stress", "capacity", "oom", "saturation", "leak")),
    ("runtime", ("pod", "kill", "crash", "restart", "evict", "container", "panic")),
    ("code", ("exception", "error", "bug", "null", "stack", "throw", "logic", "regex", "backtracking")),
    ("config", ("config", "setting", "env", "yaml", "property", "mismatch")),
    ("dependency", ("dependency", "upstream", "downstream", "third-party", "sdk", "library")),
)

STOP_WORDS = (
    "a an the and or but if then than that this these those is are was were be been being of to in on at for with from by as it its their there here "
    "over under after before during while no not so such into onto out up down again once both each all any"
).split()

#: Patterns of personal data and secrets.
SENSITIVE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b1[3-9]\d{9}\b",
    r"\b(?:\d{17}[\dXx]|\d{15})\b",
    r"\b(?:sk|ghp|github_pat)[-_][A-Za-z0-9]{16,}\b",
)

#: Header names that mean a field, compared in lower case without white space and _ - . @
COLUMN_ALIASES = {
    "timestamp": ("time", "timestamp", "ts", "datetime", "time_stamp", "@timestamp", "date"),
    "service": ("service", "service.name", "service_name", "svc", "cmdb_id", "app", "application", "pod", "host"),
    "pod_name": ("pod_name", "podname", "k8s_pod_name", "k8s.pod.name"),
    "node_name": ("node_name", "nodename", "k8s_node_name", "k8s.node.name"),
    "metric_name": ("metric", "metric_name", "kpi_name", "name", "metricname", "indicator"),
    "metric_value": ("value", "val", "metric_value"),
    "log_body": ("message", "msg", "body", "log", "content", "line", "text"),
    "severity": ("severity", "level", "sev", "log_level", "loglevel"),
    "trace_id": ("trace_id", "traceid", "trace"),
    "span_id": ("span_id", "spanid", "span"),
    "parent_span_id": ("parent_span_id", "parentspanid", "parent_span", "parentspan"),
    "span_name": ("span_name", "spanname", "operation", "operation_name"),
    "duration_ms": ("duration_ms", "durationms", "duration", "latency_ms", "latency"),
    "status": ("status", "status_code", "statuscode"),
}
