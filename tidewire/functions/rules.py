"""Payload rules as data, compiled to Columns: one projection for all rules, no join."""

from __future__ import annotations

import ast
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
#: Score of a match by severity.
SEVERITY_SCORES = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str
    category: str
    description: str = ""
    condition: str = ""
    name: str = ""


# Identifiers, patterns, severities, categories and conditions of the rule set.
RULES = [
    Rule("sql_injection", r"(select|union|insert|update|delete|drop|create|alter).*from.*where", "high", "web", "SQL注入攻击模式"),
    Rule("xss_script", r"<script[^>]*>.*</script>", "high", "web", "XSS脚本注入"),
    Rule("xss_onload", r"onload\s*=", "medium", "web", "XSS事件注入"),
    Rule("command_injection", r"(;|\|\||&&|exec|system|eval|shell_exec)", "critical", "web", "命令注入"),
    Rule("path_traversal", r"(\.\./|\.\.|%2e%2e/|%2e%2e%5c)", "high", "web", "路径遍历"),
    Rule("file_inclusion", r"(include|require).*http://|ftp://", "high", "web", "远程文件包含"),
    Rule("ldap_injection", r"\(\*\)|\(&\)|\(\|\)|\(!\)", "medium", "web", "LDAP注入"),
    Rule("robot_command_injection", r"(move|turn|stop|execute).*;", "critical", "custom", "机器人命令注入"),
    Rule("sensor_data_tampering", r"(sensor|imu|gps).*\d+\.\d+", "high", "custom", "传感器数据篡改", condition="abs(float(value) - expected) > threshold"),
    Rule("mavlink_injection", r"fe\d\d", "high", "custom", "MAVLink协议注入"),
    Rule("ros_topic_hijack", r"/\w+/\w+", "medium", "custom", "ROS话题劫持"),
    Rule("dds_attack", r"rtps|dds", "medium", "custom", "DDS协议攻击"),
    Rule("cyber_rt_anomaly", r"cyber|apollo", "high", "custom", "Cyber RT异常"),
    Rule("industrial_protocol_exploit", r"(modbus|dnp3|iec104|opc).*write", "critical", "custom", "工业协议利用"),
    Rule("c2_beacon", r"(beacon|heartbeat|checkin)", "high", "network", "C2信标通信"),
    Rule("dns_tunneling", r"[a-z0-9]{50,}\.", "medium", "network", "DNS隧道"),
    Rule("icmp_tunnel", r".*", "medium", "network", "ICMP隧道", condition="len(payload) > 100"),
    Rule("port_scan", r".*", "low", "network", "端口扫描", condition="tcp_flags == 'S' and not tcp_ack"),
    Rule("syn_flood", r".*", "medium", "network", "SYN洪水攻击", condition="tcp_flags == 'S' and not tcp_ack"),
    Rule("udp_flood", r".*", "medium", "network", "UDP洪水攻击", condition="protocol == 'udp' and len(payload) > 1000"),
    Rule("malware_signature", r"(trojan|virus|worm|backdoor)", "critical", "network", "恶意软件签名"),
    Rule("tcp_invalid_flags", r".*", "medium", "protocol", "无效TCP标志组合", condition="tcp_flags in ['URG+PSH+FIN', 'SYN+FIN', 'SYN+RST']"),
    Rule("http_invalid_method", r"^(get|post|put|delete|head|options|patch|trace|connect)", "low", "protocol", "无效HTTP方法", condition="not re.match(r'^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT)', method, re.I)"),
    Rule("dns_long_query", r".*", "medium", "protocol", "DNS查询过长", condition="len(dns_query) > 253"),
    Rule("tls_heartbeat_overflow", r".*", "high", "protocol", "TLS心跳溢出", condition="tls_type == 24 and tls_length > 16384"),
    Rule("modbus_invalid_function", r".*", "medium", "protocol", "无效Modbus功能码", condition="modbus_function not in [1, 2, 3, 4, 5, 6, 15, 16]"),
    Rule("mqtt_large_packet", r".*", "low", "protocol", "MQTT包过大", condition="len(payload) > 268435455"),
    Rule("can_invalid_id", r".*", "medium", "protocol", "无效CAN ID", condition="can_id > 0x7FF and can_id < 0x80000000"),
]


def load_rules(folder: str) -> list[Rule]:
    """Rules of the YAML files of a folder; needs a YAML parser to be installed. A rule set is a small dimension."""
    import yaml

    found = []
    for path in sorted(Path(folder).glob("*.y*ml")):
        for r in (yaml.safe_load(path.read_text()) or {}).get("rules", []):
            found.append(Rule(str(r["id"]), r.get("pattern", ""), r.get("severity", "low"), r.get("category", ""), r.get("description", ""), r.get("condition", ""), r.get("name", "")))
    return found


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.id, r.pattern, r.severity, r.category, r.description, r.condition) for r in rules], "id string, pattern string, severity string, category string, description string, condition string")


def selected(rules: list[Rule], changes: list[Rule] = (), removed: tuple[str, ...] = (), category: str | None = None, severity: str | None = None) -> list[Rule]:
    """The rules with those of `changes` replaced or added and those of `removed` left out, of one category or severity if given."""
    by = {r.id: r for r in (*rules, *changes)}
    return [r for r in by.values() if r.id not in removed and category in (None, r.category) and severity in (None, r.severity)]


def update_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The rules with those of the same id replaced and new ones added."""
    return rules.join(changes.select("id"), "id", "left_anti").unionByName(changes)


class _Condition(ast.NodeVisitor):
    """A condition in the rule language as a Column; a name that no column has makes what it is part of null, and so the condition false.

    The language: names, numbers, texts, lists, not, and, or, comparisons (chained ones too), + - * /, len, abs, float, int, str, bool, and
    re.match, re.search and re.fullmatch of a constant pattern, with re.I. strict: without the functions of re, which the original's
    evaluator refuses, so that rules with them never hold.
    """

    def __init__(self, columns: list[str], aliases: dict[str, str], strict: bool):
        self.columns, self.aliases, self.strict = columns, aliases, strict

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Name(self, node):
        name = self.aliases.get(node.id, node.id)
        return F.col(name) if name in self.columns else F.lit(None)

    def visit_Constant(self, node):
        return F.lit(node.value)

    def visit_List(self, node):
        return [x.value for x in node.elts]

    visit_Tuple = visit_List

    def visit_UnaryOp(self, node):
        value = self.visit(node.operand)
        return ~value.cast("boolean") if isinstance(node.op, ast.Not) else -value

    def visit_BinOp(self, node):
        left, right = self.visit(node.left), self.visit(node.right)
        return {ast.Add: lambda: left + right, ast.Sub: lambda: left - right, ast.Mult: lambda: left * right, ast.Div: lambda: F.try_divide(left, right)}[type(node.op)]()

    def visit_BoolOp(self, node):
        parts = [self.visit(v).cast("boolean") for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out

    def visit_Compare(self, node):
        sides, out = [self.visit(x) for x in (node.left, *node.comparators)], None
        for left, right, op in zip(sides[:-1], sides[1:], node.ops, strict=True):
            tests = {ast.Eq: lambda: left == right, ast.NotEq: lambda: left != right, ast.Gt: lambda: left > right, ast.GtE: lambda: left >= right, ast.Lt: lambda: left < right, ast.LtE: lambda: left <= right, ast.In: lambda: left.isin(right), ast.NotIn: lambda: ~left.isin(right)}  # noqa: B023
            own = tests[type(op)]()
            out = own if out is None else out & own
        return out

    def visit_Call(self, node):
        if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "re" and not self.strict:
            pattern, text, flags = node.args[0].value, self.visit(node.args[1]), node.args[2:]
            if any(not (isinstance(f, ast.Attribute) and f.attr in ("I", "IGNORECASE")) for f in flags):
                raise ValueError("unsupported flags")
            form = {"match": r"\A(?:%s)", "search": "(?:%s)", "fullmatch": r"\A(?:%s)\z"}[node.func.attr]
            return text.rlike(("(?iu)" if flags else "") + form % pattern)
        value = self.visit(node.args[0])
        return {"len": F.length, "abs": F.abs, "float": lambda c: c.try_cast("double"), "int": lambda c: c.try_cast("long"), "str": lambda c: c.cast("string"), "bool": lambda c: c.cast("boolean")}[node.func.id](value)

    def generic_visit(self, node):
        raise ValueError(f"unsupported in a rule condition: {ast.dump(node)}")


def condition(text: str, columns: list[str], aliases: dict[str, str] | None = None, strict: bool = False) -> Column:
    """Whether a condition holds; one that doesn't parse or asks for more than the language holds nowhere, as its rule can't be judged."""
    try:
        own = _Condition(columns, aliases or {}, strict).visit(ast.parse(text, mode="eval"))
    except (ValueError, SyntaxError, KeyError, AttributeError, TypeError, IndexError):
        return F.lit(False)
    return F.coalesce(own.cast("boolean"), F.lit(False))


def _count_anything(text: Column) -> Column:
    """How often .* is found in a text: each line with text gives two (itself and the empty end), each empty one gives one."""
    return F.regexp_count(text, F.lit("\n")) + 1 + F.regexp_count(text, F.lit("[^\n]+"))


def match_rules(df: DataFrame, payload: str, rules: list[Rule] = RULES, protocol: str | None = None, aliases: dict[str, str] | None = None, strict_reference: bool = False) -> DataFrame:
    """Adds matches: (rule_id, severity, category, confidence) of each rule that holds, the most severe first.

    Matching ignores case and lets . take line breaks; counting doesn't let it. Null payloads are empty. The pattern of
    anything isn't matched. protocol is a column whose text, found in a rule's description, raises the confidence; without the
    column, or where it is null, the empty name is found in every description. strict_reference: conditions with re functions never hold, as in the original.
    """
    text, names = F.coalesce(F.col(payload), F.lit("")), {"payload": payload, **(aliases or {})}
    found = []
    for i, r in enumerate(rules):
        anything = r.pattern in ("", ".*")
        hit = F.lit(True) if anything else text.rlike(f"(?isd){r.pattern}")
        holds = condition(r.condition, df.columns, names, strict_reference) if r.condition else F.lit(True)
        count = F.least(_count_anything(text) if anything else F.regexp_count(text, F.lit(f"(?id){r.pattern}")), F.lit(5)) if r.pattern else F.lit(0)
        named = F.when(F.lower(F.lit(r.description)).contains(F.coalesce(F.col(protocol), F.lit(""))), 0.1).otherwise(0.0) if protocol else F.lit(0.1)
        confidence = F.least(F.lit(1.0), 0.5 + 0.2 * count / 5 + (0.3 if r.condition else 0.0) + named)
        found.append(F.when(hit & holds, F.struct(F.lit(-SEVERITIES[r.severity]).alias("order"), F.lit(i).alias("i"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.round(confidence, 6).alias("confidence"))))
    sorted_ = F.array_sort(F.array_compact(F.array(*found)))
    return df.withColumn("matches", F.transform(sorted_, lambda m: F.struct(m["rule_id"].alias("rule_id"), m["severity"].alias("severity"), m["category"].alias("category"), m["confidence"].alias("confidence"))))


def fuse_scores(df: DataFrame, classifier: Column, sequence: Column, anomaly: Column) -> DataFrame:
    """Adds rule_score, final_score, threat_level and fused_confidence from matches and three model scores."""
    severity = F.coalesce(F.array_max(F.transform("matches", lambda m: F.coalesce(*[F.when(m["severity"] == k, F.lit(v)) for k, v in SEVERITY_SCORES.items()], F.lit(0.0)))), F.lit(0.0))
    parts = [F.col("rule_score"), classifier, sequence, anomaly]
    mean = (parts[0] + parts[1] + parts[2] + parts[3]) / 4
    variance = sum(((p - mean) * (p - mean) for p in parts[1:]), (parts[0] - mean) * (parts[0] - mean)) / 4
    score = parts[0] * 0.25 + parts[1] * 0.30 + parts[2] * 0.30 + parts[3] * 0.15
    level = F.when(F.col("final_score") >= 0.8, "CRITICAL").when(F.col("final_score") >= 0.6, "HIGH").when(F.col("final_score") >= 0.4, "MEDIUM").when(F.col("final_score") >= 0.2, "LOW").otherwise("SAFE")
    out = df.withColumn("rule_score", severity).withColumn("final_score", score)
    return out.withColumns({"threat_level": level, "fused_confidence": 0.6 / (1 + variance) + 0.4 * F.least(F.size("matches") / 3.0, F.lit(1.0))})


def three_threshold_decision(rule: Column, ml: Column, combined: Column) -> Column:
    """MALICIOUS above the rule (.8) or model (.7) threshold or the combined one (.75), SUSPICIOUS above half of it, else NORMAL."""
    score = 0.4 * rule + 0.3 * ml + 0.3 * combined
    return F.when((rule >= 0.8) | (ml >= 0.7) | (score >= 0.75), "MALICIOUS").when(score >= 0.375, "SUSPICIOUS").otherwise("NORMAL")


def detection_summary(detected: DataFrame, key: str) -> DataFrame:
    """Counts, means, shares of unsafe and high rows, and the row of the highest score, ties to the least key."""
    level = F.col("threat_level")
    return detected.agg(
        F.count(F.lit(1)).alias("packets"), F.round(F.avg("final_score"), 6).alias("mean_score"), F.round(F.avg((level != "SAFE").cast("double")), 6).alias("unsafe_ratio"), F.round(F.avg(level.isin("HIGH", "CRITICAL").cast("double")), 6).alias("high_ratio"), F.sum(F.size("matches")).alias("rule_hits"),
        F.min_by(key, F.struct(-F.col("final_score"), F.col(key))).alias("max_key"), F.round(F.max("final_score"), 6).alias("max_score"),
    )


def top_rules(detected: DataFrame, k: int = 10) -> DataFrame:
    return detected.select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "rule_id").limit(k)


def fuse_branches(payload: Column, traffic: Column, motion: Column, motion_status: Column, signal: Column, signal_confidence: Column, mode: str = "report", least: float = 0.5) -> dict[str, Column]:
    """label, status and reason of a capture from the labels of its branches (null where a branch has none).

    The payload's label counts, else the traffic profile's, else the motion's with its status. A signal label of at least the
    given confidence takes over (signal_primary), or makes the capture an ANOMALY where it differs from the motion's (disagree); in any
    other mode it is reported beside them.
    """
    first = F.when(payload.isNotNull(), "amnar_payload_primary").when(traffic.isNotNull(), "traffic_profile_fallback").otherwise("motion_only")
    label, status = F.coalesce(payload, traffic, motion), F.when(payload.isNotNull() | traffic.isNotNull(), "NORMAL").otherwise(motion_status)
    sure = signal.isNotNull() & (F.coalesce(signal_confidence, F.lit(0.0)) >= least)
    if mode == "signal_primary":
        return {"label": F.when(sure, signal).otherwise(label), "status": F.when(sure, "NORMAL").otherwise(status), "reason": F.when(sure, "signal_primary").otherwise(first)}
    if mode == "disagree":
        against = sure & ~signal.eqNullSafe(motion)
        return {"label": label, "status": F.when(against, "ANOMALY").otherwise(status), "reason": F.when(against, "signal_disagrees_with_motion").otherwise(first)}
    return {"label": label, "status": status, "reason": F.when(signal.isNotNull(), "reported_side_by_side").otherwise(first)}
