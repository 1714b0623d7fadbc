"""The HTML report."""

from __future__ import annotations

from ..functions.text import escape_html

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.card{display:inline-block;border:1px solid #ccc;border-radius:6px;padding:1em;margin:.3em}"


def _number(x: object, default: float = 0.0, low: float = 0.0, high: float = 100.0) -> float:
    try:
        return max(low, min(high, float(x)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def duration(ms: object) -> str:
    """A time of one hour at most."""
    seconds = _number(ms, high=3_600_000.0) / 1000
    return f"{seconds:.2f} s" if seconds < 60 else f"{int(seconds // 60)} min {int(seconds % 60)} s"


def _table(head: list[str], rows: list[list]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{escape_html('' if c is None else str(c))}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{escape_html(h)}</th>' for h in head)}</tr>{cells}</table>"


def render(report: dict, max_issues: int = 50, max_advice: int = 10) -> str:
    """Score, metrics, columns, the first issues and pieces of advice."""
    score, summary = report.get("score", {}), report.get("summary", {})
    cards = "".join(f'<div class="card"><b>{escape_html(k.title())}</b><br>{_number(score.get(k)):.0f}</div>' for k in ("overall", "completeness", "validity", "uniqueness", "consistency"))
    facts = [["Rows", summary.get("totalRows")], ["Valid rows", summary.get("validRows")], ["Invalid rows", summary.get("invalidRows")], ["Grade", score.get("grade")], ["Time", duration(summary.get("processingTimeMs"))]]
    columns = [[c["column"], c["detected_type"], c["null_percent"], c["unique_count"]] for c in report.get("columns", [])]
    issues = [[i["rowNumber"], i["column"], i["issueType"], i["severity"], i["message"]] for i in report.get("issues", [])[:max_issues]]
    advice = "".join(f"<li><b>{escape_html(r['title'])}</b> ({escape_html(r['priority'])}): {escape_html(r['description'])}. {escape_html(r['action'])}.</li>" for r in report.get("recommendations", [])[:max_advice])
    return (
        f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Data quality</title><style>{STYLE}</style></head><body><h1>Data quality</h1>{cards}"
        f"<h2>Summary</h2>{_table(['Metric', 'Value'], facts)}<h2>Columns</h2>{_table(['Column', 'Type', 'Missing %', 'Distinct'], columns)}"
        f"<h2>Issues</h2>{_table(['Row', 'Column', 'Type', 'Severity', 'Message'], issues)}<h2>Recommendations</h2><ul>{advice}</ul></body></html>"
    )
