"""HTML and terminal reports of a run. These are for people: what they show is bounded."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from .results import FLAT, flat, most_different, status

SHOWN = {"files": 10, "rows": 15, "diffs": 5, "lines": 12, "tables": 5, "samples": 2, "all_samples": 8}
VERBOSE = {"files": 10, "rows": 15, "diffs": 5, "lines": 12, "tables": 10, "samples": 5, "all_samples": 20}
LINE = 70


def format_bytes(n: float | None) -> str | None:
    """In bytes or the largest unit that isn't more; the last is GB, however many they are."""
    if n is None:
        return None
    if n < 1024:
        return f"{n:.0f} B"
    for unit in ("KB", "MB", "GB"):
        n /= 1024
        if n < 1024 or unit == "GB":
            return f"{n:.1f} {unit}"


def cut_path(path: str, width: int = 40) -> str:
    """The end of a long path."""
    return path if len(path) <= width else "..." + path[len(path) - width + 3 :]


def cut_value(value: str, width: int = 30) -> str:
    return value if len(value) <= width else value[: width - 3] + "..."


def bar(score: float, cells: int = 10) -> str:
    full = round(min(1.0, max(0.0, score)) * cells)
    return "█" * full + "░" * (cells - full)


def grade(score: float) -> str:
    return "good" if score >= 0.9 else "fair" if score >= 0.5 else "poor"


def table(head: list[str], rows: list[list[str]]) -> str:
    wide = [max(len(str(r[i])) for r in [head, *rows]) for i in range(len(head))]
    out = ["  ".join(str(x).ljust(w) for x, w in zip(r, wide)).rstrip() for r in [head, *rows]]
    return "\n".join([out[0], "  ".join("-" * w for w in wide), *out[1:]])


def snippet(diff: str, lines: int = SHOWN["lines"]) -> list[str]:
    """The first lines of a diff after its header, long ones cut."""
    body = [x for x in diff.split("\n")[2:] if x]
    out = [x if len(x) <= LINE else x[: LINE - 3] + "..." for x in body[:lines]]
    return out + [f"... {len(body) - lines} more lines"] * (len(body) > lines)


def mismatch_lines(r, limits: dict = SHOWN) -> list[str]:
    """What differs between two tables: rows, columns, counts in percent of matched rows, samples."""
    delta = r.file2_row_count - r.file1_row_count
    out = [f"rows {r.file1_row_count} and {r.file2_row_count} ({delta:+d}), matched {r.common_records}, only left {r.only_in_file1}, only right {r.only_in_file2}"]
    for side, cols in (("left", r.columns_only_in_file1), ("right", r.columns_only_in_file2)):
        if cols:
            out.append(f"columns only {side}: {', '.join(cols)}")
    left = limits["all_samples"]
    for m in sorted(r.field_mismatches or [], key=lambda m: -m.mismatch_count):
        share = 100 * m.mismatch_count / r.common_records if r.common_records else 0.0
        out.append(f"{m.column_name}: {m.mismatch_count} mismatches ({share:.1f}% of matched)")
        for s in m.sample_mismatches[: min(limits["samples"], left)]:
            left -= 1
            out.append(f"    [{cut_value(s.key)}] {cut_value(s.value1)!r} -> {cut_value(s.value2)!r}")
    return out


def terminal(results: DataFrame, stats: dict, verbose: bool = False) -> str:
    """Summary, a table of pairs, the least similar pairs, snippets and errors as text."""
    lim = VERBOSE if verbose else SHOWN
    out = [table(["measure", "value"], [[k, f"{v:.4f}" if isinstance(v, float) else v] for k, v in stats.items() if v is not None])]
    rows = results.orderBy("similarity_score", "file1_path", "file2_path").limit(lim["rows"]).collect()
    out.append(table(["left", "right", "type", "similarity", "status"], [
        [cut_path(r.file1_path), cut_path(r.file2_path), r.type, f"{bar(r.similarity_score)} {100 * r.similarity_score:.1f}% {grade(r.similarity_score)}", "error" if r.type == "Error" else "identical" if r.identical else "modified"]
        for r in rows
    ]))
    for name in ("modified", "identical", "error"):
        some = results.where(status() == name)
        n = some.count()
        if n:
            first = some.orderBy("similarity_score", "file1_path", "file2_path").limit(lim["files"]).collect()
            out.append("\n".join([f"{name}: {n}", *(f"  {r.file1_path} | {r.file2_path}" + (f" | {r.error}" if r.error else "") for r in first), *["  ..."] * (n > lim["files"])]))
    for r in most_different(results.where("type = 'Text'"), lim["diffs"]).collect():
        out.append("\n".join([f"{r.file1_path} | {r.file2_path}: common {r.common_lines}, only left {r.only_in_file1}, only right {r.only_in_file2}", *snippet(r.detailed_diff or "", lim["lines"])]))
    for r in most_different(results.where("type = 'Structured'"), lim["tables"]).collect():
        out.append("\n".join([f"{r.file1_path} | {r.file2_path}", *mismatch_lines(r, lim)]))
    return "\n\n".join(out)


_HERE = "@pairs@"
_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Comparison</title><style>
body{{font:14px/1.4 system-ui,sans-serif;margin:2em;color:#222}} .cards{{display:flex;gap:1em;flex-wrap:wrap}}
.card{{border:1px solid #ccc;border-radius:6px;padding:.6em 1em}} .card b{{display:block;font-size:1.6em}}
table{{border-collapse:collapse;width:100%;margin-top:1em}} td,th{{border-bottom:1px solid #ddd;padding:.3em .5em;text-align:left}}
th{{cursor:pointer}} .good{{color:#17692f}} .fair{{color:#8a6100}} .poor{{color:#a11}} dialog{{width:80%}} pre{{white-space:pre-wrap}}
</style></head><body><h1>Comparison</h1><div class="cards">{cards}</div><h2>Run</h2><table>{run}</table>
<h2>Pairs</h2><input id="q" placeholder="filter"><table id="t"><thead><tr>{head}</tr></thead><tbody></tbody></table>{note}
<dialog id="d"><pre></pre><form method="dialog"><button>close</button></form></dialog>
<script type="application/json" id="data">{data}</script><script>
const rows=JSON.parse(document.getElementById("data").textContent),body=document.querySelector("#t tbody"),cols={cols};
let by=null,up=1;
function draw(){{const q=document.getElementById("q").value.toLowerCase();body.textContent="";
 let r=rows.filter(x=>cols.some(c=>String(x[c]).toLowerCase().includes(q)));
 if(by!==null)r=[...r].sort((a,b)=>{{const x=a[by],y=b[by],n=Number(x)-Number(y);return up*(x!==""&&y!==""&&!isNaN(n)?n:String(x).localeCompare(String(y)))}});
 for(const x of r){{const tr=body.insertRow();for(const c of cols)tr.insertCell().textContent=x[c];
  tr.cells[4].className=x.similarity_score>=.9?"good":x.similarity_score>=.5?"fair":"poor";
  tr.onclick=()=>{{document.querySelector("#d pre").textContent=x.detail;document.getElementById("d").showModal()}}}}}}
document.querySelectorAll("#t th").forEach((h,i)=>h.onclick=()=>{{up=by===cols[i]?-up:1;by=cols[i];draw()}});
document.getElementById("q").oninput=draw;draw();
</script></body></html>
"""


def write_html(results: DataFrame, stats: dict, path: str, artifacts: str | None = None) -> None:
    """A page with the summary, the run and all pairs, the least similar first, which can be
    sorted, filtered and opened. Pairs are streamed into the page, one partition at a time."""
    cols = list(FLAT)
    keep = flat(results, "*").orderBy(F.col("similarity").asc(), "file1_path", "file2_path")
    pairs = max(1, stats.get("pairs_compared", 0))
    cards = "".join(
        f'<div class="card"><b>{stats.get(k, 0)}</b>{label} ({round(100 * stats.get(k, 0) / pairs)}%)</div>'
        for k, label in (("identical_pairs", "identical"), ("different_pairs", "different"), ("error_pairs", "errors"))
    ) + f'<div class="card"><b>{100 * stats.get("average_similarity", 0):.1f}%</b>average similarity</div>'
    shown = stats | {k: format_bytes(stats[k]) for k in ("peak_memory_usage_bytes", "total_data_processed_bytes") if stats.get(k) is not None} | ({"artifacts": artifacts} if artifacts else {})
    run = "".join(f"<tr><td>{html.escape(k)}</td><td>{html.escape(str(v))}</td></tr>" for k, v in shown.items() if v is not None)
    page = _PAGE.format(
        cards=cards, run=run, head="".join(f"<th>{c}</th>" for c in cols), cols=json.dumps(cols),
        note="", data=_HERE,
    )
    before, after = page.split(_HERE)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(before + "[")
        for n, r in enumerate(keep.toLocalIterator()):
            whole = r["whole"]
            detail = "\n".join(mismatch_lines(whole, VERBOSE)) if whole.type == "Structured" else whole.error or whole.detailed_diff or ""
            f.write("," * (n > 0) + json.dumps({c: r[c] for c in cols} | {"detail": detail}, ensure_ascii=False).replace("<", "\\u003c"))
        f.write("]" + after)
