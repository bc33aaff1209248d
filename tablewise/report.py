"""Reports of a result: sections of facts, notes and tables, and four renderers."""

from __future__ import annotations

import html as markup
import sys
from dataclasses import dataclass, field

from .results import ComparisonResult
from .settings import ReportSettings

TITLE = "Table Comparison Report"
_SHORT, _LONG, _NAMES = 30, 80, 20


@dataclass
class Share:
    """A share to draw as a bar."""

    of: float


@dataclass
class Grid:
    head: list[str]
    rows: list[list]
    right: set[int] = field(default_factory=set)  # columns aligned to the right
    title: str = ""


@dataclass
class Section:
    title: str
    facts: list[tuple[str, str]] = field(default_factory=list)
    grids: list[Grid] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    kind: str = "note"  # of the notes: note, warning, error


def percent(x: float) -> str:
    if not 0 < x < 1:
        return "0%" if x <= 0 else "100%"
    return "<0.01%" if x < 0.0001 else f"{x:.2%}"


def duration(s: float) -> str:
    if s >= 60:
        return f"{s // 60:.0f}m {s % 60:.0f}s"
    return f"{s:.2f} s" if s >= 1 else f"{s * 1000:.0f} ms"


def shown(value, limit: int) -> str:
    if value is None:
        return "null"
    if isinstance(value, float):
        return "NaN" if value != value else format(value, ".6g")
    text = " ".join(str(value).splitlines())
    return text if len(text) <= limit else f"{text[: limit - 3]}..."


def listed(names: list[str]) -> str:
    more = len(names) - _NAMES
    return ", ".join(names[:_NAMES]) + (f" (+{more} more)" if more > 0 else "")


def verdict(r: ComparisonResult) -> tuple[str, str, str]:
    """(kind, headline, detail)."""
    if r.aborted:
        return "error", "COMPARISON ABORTED", "The rows could not be compared."
    if r.is_match:
        return "ok", "IDENTICAL", "Same rows, same values and same columns."
    return "differs", "DIFFERENCES FOUND", "; ".join(r.differences()) + "."


def sections(r: ComparisonResult, s: ReportSettings, everything: bool) -> list[Section]:
    left, right, limit = r.left_name, r.right_name, _LONG if everything else _SHORT
    out = []
    if r.fatal_errors:
        out.append(Section("Errors", notes=r.fatal_errors, kind="error"))
    if r.warnings:
        out.append(Section("Warnings", notes=r.warnings, kind="warning"))
    rows, columns = r.rows, r.columns
    if not r.aborted:
        of = lambda n: [percent(n / rows.common), Share(n / rows.common)] if rows.common else ["", ""]
        lines = [
            ["In common", f"{rows.common:,}", "", ""],
            ["  equal", f"{rows.matched:,}", *of(rows.matched)],
            ["  different", f"{rows.mismatched:,}", *of(rows.mismatched)],
        ]
        counts = ((f"Only in {left}", rows.left_only), (f"Only in {right}", rows.right_only), (f"Total in {left}", rows.left_total), (f"Total in {right}", rows.right_total))
        out.append(Section("Rows", grids=[Grid(["", "Rows", "% of common", ""], lines + [[k, f"{n:,}", "", ""] for k, n in counts], {1, 2})]))
    section = Section("Columns", facts=[("Compared", f"{len(columns.compared):,}")])
    for name, own in ((left, columns.left_only), (right, columns.right_only)):
        section.facts.append((f"Only in {name}", f"{len(own):,}"))
        if own:
            section.notes.append(f"Only in {name}: {listed(own)}")
    section.facts.append(("Different types, skipped", f"{len(columns.type_mismatches):,}"))
    if columns.type_mismatches:
        section.grids.append(Grid(["Column", f"Type in {left}", f"Type in {right}"], [[t.column, t.left, t.right] for t in columns.type_mismatches]))
    out.append(section)
    if r.column_stats:
        some = r.column_stats if everything else r.column_stats[: s.max_columns]
        grid = Grid(["Column", "Type", "Differences", "% of common", ""], [[c.column, c.dtype, f"{c.mismatches:,}", percent(c.rate), Share(c.rate)] for c in some], {2, 3})
        hidden = len(r.column_stats) - len(some)
        out.append(Section("Differences by column", grids=[grid], notes=[f"{hidden} more columns differ; HTML and JSON list them all."] if hidden else []))
    elif rows.mismatched and not r.execution.column_details_computed:
        out.append(Section("Differences by column", notes=["Not computed (column_details=False)."]))
    if r.samples and (everything or s.max_sample_columns):
        some = r.samples if everything else r.samples[: s.max_sample_columns]
        grids = [Grid(t.headers, [[shown(v, limit) for v in row] for row in t.rows], title=f"{t.column}: {len(t.rows)} of {t.total_mismatches:,} differing rows") for t in some]
        hidden = len(r.samples) - len(some)
        out.append(Section("Samples", grids=grids, notes=[f"Samples of {hidden} more columns are left out."] if hidden else []))
    e = r.execution
    facts = [("Method", f"{e.path} ({e.path_reason})")] if e.path else []
    facts.append(("Windows", f"{e.windows}" + (f" of about {e.rows_per_window:,} rows" if e.rows_per_window else "")))
    facts += [("Column details", "computed" if e.column_details_computed else "skipped"), ("Total time", duration(e.total_seconds))]
    if e.timings:
        facts.append(("By phase", ", ".join(f"{k} {duration(v)}" for k, v in e.timings.items())))
    if e.engine_version:
        facts.append(("Spark", e.engine_version))
    return [*out, Section("Execution", facts=facts)]


def _head(r: ComparisonResult) -> list[tuple[str, str]]:
    return [("Compared", f"{r.left_name} vs {r.right_name}"), ("Key", ", ".join(r.join_columns)), ("Generated", f"{r.created_at:%Y-%m-%d %H:%M:%S} UTC")]


# -- text ---------------------------------------------------------------------


def _text(r: ComparisonResult, s: ReportSettings) -> str:
    rich = s.style == "unicode" or s.style == "auto" and _prints("─█░", sys.stdout)
    line, full, empty = ("─", "█", "░") if rich else ("-", "#", ".")
    out = [TITLE, line * s.width, *_aligned(_head(r))]
    _, headline, detail = verdict(r)
    out += ["", f"[{headline}] {detail}"]
    for section in sections(r, s, False):
        out += ["", section.title, line * len(section.title), *_aligned(section.facts)]
        for grid in section.grids:
            out += ["", grid.title] if grid.title else []
            out += _grid(grid, s.width, line, full, empty)
        out += [f"{'' if section.kind == 'note' else '! '}{n}" for n in section.notes]
    text = "\n".join(out)
    return text if rich else text.encode("ascii", "replace").decode()


def _aligned(facts) -> list[str]:
    wide = max((len(k) for k, _ in facts), default=0)
    return [f"{k:<{wide}}  {v}" for k, v in facts]


def _grid(grid: Grid, width: int, line: str, full: str, empty: str, bar: int = 16) -> list[str]:
    def cell(v):
        if isinstance(v, Share):
            n = round(min(1, max(0, v.of)) * bar)
            return full * max(n, v.of > 0) + empty * (bar - max(n, v.of > 0))
        return str(v)

    lines = [grid.head, *[[cell(v) for v in row] for row in grid.rows]]
    wide = [max(len(x) for x in column) for column in zip(*lines)]
    while sum(wide) + 2 * (len(wide) - 1) > width and max(wide) > 8:
        wide[wide.index(max(wide))] -= 1
    fit = lambda x, n: x if len(x) <= n else x[: max(1, n - 3)] + "..."[: max(0, n - 1)]
    made = ["  ".join(f"{fit(x, n):>{n}}" if i in grid.right else f"{fit(x, n):<{n}}" for i, (x, n) in enumerate(zip(row, wide))).rstrip() for row in lines]
    return [made[0], line * min(width, sum(wide) + 2 * (len(wide) - 1)), *made[1:]]


# -- markdown and html --------------------------------------------------------


def _markdown(r: ComparisonResult, s: ReportSettings) -> str:
    safe = lambda v: (percent(v.of) if isinstance(v, Share) else str(v)).replace("|", "\\|")
    _, headline, detail = verdict(r)
    out = [f"# {TITLE}", "", *[f"- **{k}:** {v}" for k, v in _head(r)], "", f"> **{headline}** {detail}"]
    for section in sections(r, s, False):
        out += ["", f"## {section.title}", "", *[f"- **{k}:** {v}" for k, v in section.facts]]
        for grid in section.grids:
            rule = ["---:" if i in grid.right else "---" for i in range(len(grid.head))]
            out += ["", *([f"**{grid.title}**", ""] if grid.title else []), *["| " + " | ".join(map(safe, row)) + " |" for row in [grid.head, rule, *grid.rows]]]
        out += ["", *[f"- {n}" for n in section.notes]] if section.notes else []
    return "\n".join(out) + "\n"


_STYLE = """
:root{color-scheme:light dark}body{font:15px/1.5 system-ui,sans-serif;max-width:64rem;margin:2rem auto;padding:0 1rem}
table{border-collapse:collapse;margin:.6rem 0}td,th{padding:.25rem .7rem;border-bottom:1px solid #8884;text-align:left;white-space:pre-wrap}
.r{text-align:right}.bar{background:#8883;width:9rem;height:.6rem}.bar i{display:block;height:100%;background:#d9822b}
.verdict{padding:.7rem 1rem;border-left:6px solid}.ok{border-color:#2a9d4e}.differs{border-color:#d9822b}.error{border-color:#d33}
@media(prefers-color-scheme:dark){body{background:#16181c;color:#e4e6ea}}
"""


def _html(r: ComparisonResult, s: ReportSettings) -> str:
    e = lambda v: markup.escape(str(v))
    cell = lambda v: f'<div class="bar"><i style="width:{min(1, max(0, v.of)) * 100:.1f}%"></i></div>' if isinstance(v, Share) else e(v)
    pairs = lambda facts: "<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in facts) + "</table>" if facts else ""
    kind, headline, detail = verdict(r)
    out = [f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{TITLE}</title><style>{_STYLE}</style></head><body><h1>{TITLE}</h1>', pairs(_head(r))]
    out.append(f'<p class="verdict {kind}"><b>{e(headline)}</b> {e(detail)}</p>')
    for section in sections(r, s, True):
        out += [f"<h2>{e(section.title)}</h2>", pairs(section.facts)]
        for grid in section.grids:
            side = lambda i, g=grid: ' class="r"' if i in g.right else ""
            out.append((f"<h3>{e(grid.title)}</h3>" if grid.title else "") + "<table><tr>" + "".join(f"<th{side(i)}>{e(h)}</th>" for i, h in enumerate(grid.head)) + "</tr>")
            out += ["<tr>" + "".join(f"<td{side(i)}>{cell(v)}</td>" for i, v in enumerate(row)) + "</tr>" for row in grid.rows]
            out.append("</table>")
        out += ["<ul>" + "".join(f"<li>{e(n)}</li>" for n in section.notes) + "</ul>"] if section.notes else []
    return "\n".join([*out, "</body></html>"])


# -- output -------------------------------------------------------------------

RENDERERS = {"text": _text, "markdown": _markdown, "html": _html, "json": lambda r, s: r.to_json()}


def _prints(text: str, stream) -> bool:
    try:
        text.encode(getattr(stream, "encoding", None) or "utf-8")
    except UnicodeEncodeError:
        return False
    return True


def emit(result: ComparisonResult, settings: ReportSettings | None = None) -> str:
    """Render, save if a path is given (its folders are made), and print."""
    s = settings or ReportSettings()
    text = RENDERERS[s.resolved_format()](result, s)
    if s.save_path:
        s.save_path.parent.mkdir(parents=True, exist_ok=True)
        with open(s.save_path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    if s.print_output:
        encoding = getattr(sys.stdout, "encoding", None) or "utf-8"
        print(text if _prints(text, sys.stdout) else text.encode(encoding, "replace").decode(encoding))
    return text
