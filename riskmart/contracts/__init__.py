"""Data contracts as files, and what follows from them: a feed's schema, expectations of its rows, rules on shares and drift, freshness, gaps and volumes.

A contract is an ODCS document in JSON (or in YAML, where a YAML reader is installed); the feeds' own lie beside this module. A column's rules say what a row must meet to be kept
(`present`, `timestamp`, `positive`, `accepted` with its values, `pattern`); the document's rules are about tables (`share` of bad rows, `distribution`, `freshness`, `gap`,
`volume`). A rule of another kind is an error, not ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart.functions.columns import matches

_KINDS = {"string", "timestamp", "number", "integer", "boolean"}
#: Name of an expectation, and the condition, for a column and the rule's other entries.
_COLUMN_RULES: dict[str, tuple[str, Callable[[str, dict], Column]]] = {
    "present": ("present", lambda c, rule: F.col(c).isNotNull()),
    "timestamp": ("valid", lambda c, rule: F.col(c).try_cast("timestamp_ntz").isNotNull()),
    "positive": ("positive", lambda c, rule: F.col(c).try_cast("decimal(18,2)") > 0),
    "accepted": ("accepted", lambda c, rule: F.col(c).isin(rule["validValues"])),
    "pattern": ("matching", lambda c, rule: matches(c, rule["pattern"])),
}
_TABLE_RULES = {"share", "distribution", "freshness", "gap", "volume"}


@dataclass(frozen=True)
class Contract:
    name: str
    columns: dict[str, str]  # with their logical types
    key: tuple[str, ...]
    row_rules: tuple[tuple[str, dict], ...]  # (column, rule)
    rules: tuple[dict, ...]
    service: dict[str, object]  # latency, frequency, retention as they are stated

    @property
    def ddl(self) -> str:
        """Of what arrives: all fields are text."""
        return ", ".join(f"{c} string" for c in self.columns)

    def expectations(self) -> dict[str, Column]:
        return {f"{c}_{_COLUMN_RULES[rule['rule']][0]}": _COLUMN_RULES[rule["rule"]][1](c, rule) for c, rule in self.row_rules}

    def of_kind(self, kind: str) -> list[dict]:
        return [r for r in self.rules if r["rule"] == kind]

    def shares(self) -> dict[str, dict[str, tuple[str, str, float]]]:
        """By model: rule, with the condition of bad rows, of the rows it is about, and the limit."""
        out: dict[str, dict[str, tuple[str, str, float]]] = {}
        for r in self.of_kind("share"):
            out.setdefault(r["model"], {})[r["name"]] = (r["bad"], r["of"], float(r["mustBeLessThan"]))
        return out

    def freshness(self) -> tuple[timedelta, timedelta] | None:
        """After which age of the newest row to warn, and to fail."""
        for r in self.of_kind("freshness"):
            return timedelta(**{r["unit"]: r["warn"]}), timedelta(**{r["unit"]: r["error"]})
        return None


def compiled(document: dict) -> Contract:
    """A document's contract; ValueError for what it can't mean."""
    if document.get("kind") != "DataContract" or len(document.get("schema", [])) != 1:
        raise ValueError("not a contract with one schema")
    properties = document["schema"][0]["properties"]
    if odd := [p["name"] for p in properties if p.get("logicalType") not in _KINDS]:
        raise ValueError(f"{document['name']}: no such types: {odd}")
    row_rules = [(p["name"], r) for p in properties for r in p.get("quality", [])]
    if odd := [r["rule"] for _, r in row_rules if r["rule"] not in _COLUMN_RULES] + [r["rule"] for r in document.get("quality", []) if r["rule"] not in _TABLE_RULES]:
        raise ValueError(f"{document['name']}: no such rules: {odd}")
    service = {s["property"]: (s["value"], s.get("unit")) for s in document.get("slaProperties", [])}
    return Contract(document["name"], {p["name"]: p["logicalType"] for p in properties}, tuple(p["name"] for p in properties if p.get("primaryKey")), tuple(row_rules), tuple(document.get("quality", [])), service)


def read(path: str | Path) -> Contract:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: no YAML reader is installed") from e
        return compiled(yaml.safe_load(text))
    return compiled(json.loads(text))


_HERE = Path(__file__).parent
#: The feeds' own contracts, by feed.
CONTRACTS: dict[str, Contract] = {c.name: c for c in map(read, sorted(_HERE.glob("*.json")))}
