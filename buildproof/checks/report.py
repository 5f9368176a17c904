"""A run as JSON, JUnit XML or an HTML page."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from dataclasses import asdict

from .estate import Estate
from .runner import Run

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def as_json(run: Run) -> str:
    return json.dumps(asdict(run), indent=2, default=str, ensure_ascii=False)


def as_junit(run: Run, suite: str = "build") -> str:
    root = ET.Element("testsuite", name=suite, tests=str(len(run.results)), failures=str(run.summary["fail"]), errors=str(run.summary["error"]), skipped=str(run.summary["skip"]))
    for r in run.results:
        case = ET.SubElement(root, "testcase", classname=r.family, name=f"{r.id} {r.name}", time=f"{r.duration_ms / 1000:.3f}")
        text = _CONTROL.sub("�", f"{r.observed} (expected: {r.expected})" if r.expected else r.observed)
        tag = {"FAIL": "failure", "ERROR": "error", "SKIP": "skipped"}.get(r.status)
        if tag:
            ET.SubElement(case, tag, message=text)
        elif r.status == "WARN":
            ET.SubElement(case, "system-out").text = text
    return ET.tostring(root, encoding="unicode")


def as_html(run: Run, title: str = "Build report") -> str:
    e = html.escape
    rows = "".join(f"<tr class='{r.status.lower()}'><td>{e(r.id)}</td><td>{e(r.name)}</td><td>{e(r.severity)}</td><td>{e(r.status)}</td><td>{e(r.observed)}</td><td>{e(r.expected)}</td></tr>" for r in run.results)
    left = ", ".join(run.coverage["left_out"]) or "none"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}: {run.verdict}</h1><p>Families left out: {e(left)}</p><table><tr><th>Check</th><th>Name</th><th>Severity</th><th>Status</th><th>Observed</th><th>Expected</th></tr>{rows}</table></body></html>"


def estate_as_json(estate: Estate) -> str:
    rows = [{"path": w.path, "verdict": estate.verdict_of(w.path), "error": estate.errors.get(w.path), "results": [asdict(r) for r in w.results or []]} for w in estate.workbooks]
    return json.dumps({"mode": estate.mode, "verdict": estate.verdict, "workbooks": rows, "results": [asdict(r) for r in estate.results]}, indent=2, default=str, ensure_ascii=False)


def estate_as_junit(estate: Estate) -> str:
    """A suite per workbook, and one for the estate as a whole."""
    root = ET.Element("testsuites")
    for name, results, error in [*((w.path, w.results or [], estate.errors.get(w.path)) for w in estate.workbooks), ("estate", estate.results, None)]:
        counts = {s: str(sum(r.status == s for r in results)) for s in ("FAIL", "ERROR", "SKIP")}
        suite = ET.SubElement(root, "testsuite", name=name, tests=str(len(results) + bool(error)), failures=counts["FAIL"], errors=str(int(counts["ERROR"]) + bool(error)), skipped=counts["SKIP"])
        if error:
            ET.SubElement(ET.SubElement(suite, "testcase", classname="estate", name="run"), "error", message=_CONTROL.sub("\ufffd", error))
        for r in results:
            case = ET.SubElement(suite, "testcase", classname=r.family, name=f"{r.id} {r.name}")
            if tag := {"FAIL": "failure", "ERROR": "error", "SKIP": "skipped"}.get(r.status):
                ET.SubElement(case, tag, message=_CONTROL.sub("\ufffd", r.observed))
    return ET.tostring(root, encoding="unicode")


def estate_as_html(estate: Estate, title: str = "Estate report") -> str:
    e = html.escape
    rows = "".join(f"<tr class='{estate.verdict_of(w.path).lower()}'><td>{e(w.path)}</td><td>{estate.verdict_of(w.path)}</td><td>{sum(r.status == 'FAIL' for r in w.results or [])}</td><td>{e(estate.errors.get(w.path, ''))}</td></tr>" for w in estate.workbooks)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}: {estate.verdict}</h1><table><tr><th>Workbook</th><th>Verdict</th><th>Failures</th><th>Broke off</th></tr>{rows}</table></body></html>"
