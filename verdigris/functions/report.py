"""Text and LaTeX from small collected tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

#: Characters that LaTeX needs escaped.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
METRIC_HEADS = {"image_auroc": "Image AUROC", "pixel_auroc": "Pixel AUROC", "image_aupr": "Image AP", "pixel_aupr": "Pixel AP", "aupro": "AUPRO"}


def escape_latex(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in str(text))


def number(value, digits: int = 3, missing: str = "--") -> str:
    """Fixed digits, minus zero written as zero."""
    if value is None or value != value:
        return missing
    return f"{round(value, digits) + 0.0:.{digits}f}"


def marks(cells: Mapping[str, float | None], *, exclude: Sequence[str] = ("oracle",), digits: int = 3, higher_is_better: bool = True) -> dict[str, str]:
    """The SQL rule of ranked marks for one row: a cell's mark is its dense rank among the row's rounded values, 1 best and 2 second.

    Excluded and missing cells are out of the ranking, and a row with a single cell left has nothing to rank."""
    sign = -1 if higher_is_better else 1
    ranking = {k: sign * round(v, digits) for k, v in cells.items() if k not in exclude and number(v, missing="") != ""}
    place = {v: i for i, v in enumerate(sorted(set(ranking.values())))}
    names = ("best", "second") if len(ranking) > 1 else ()
    return {k: names[place[v]] for k, v in ranking.items() if place[v] < len(names)}


def _styled(text: str, mark: str | None) -> str:
    return rf"\textbf{{{text}}}" if mark == "best" else rf"\underline{{{text}}}" if mark == "second" else text


def pivot(rows: Sequence[Mapping], value: str, index: str) -> tuple[list, list[str], list[str], dict]:
    """(index values, metrics, selectors, cells) of long rows; duplicates are averaged, first appearance orders metrics and selectors."""
    names, metrics, selectors, sums = [], [], [], {}
    for r in rows:
        for seen, v in ((names, r[index]), (metrics, r["metric"]), (selectors, r["selector"])):
            if v not in seen:
                seen.append(v)
        if r[value] is not None:
            sums.setdefault((r[index], r["metric"], r["selector"]), []).append(r[value])
    return sorted(names), metrics, selectors, {k: sum(v) / len(v) for k, v in sums.items()}


def _mean(values: Sequence[float | None]) -> float | None:
    there = [v for v in values if v is not None]
    return sum(there) / len(there) if there else None


def format_table(rows: Sequence[Mapping], *, value: str = "value", index: str = "category", digits: int = 3) -> str:
    """Fixed-width text, a block for each metric."""
    names, metrics, selectors, cells = pivot(rows, value, index)
    out = []
    for m in metrics:
        wide = max(len(str(n)) for n in [*names, index])
        heads = [max(len(s), digits + 4) for s in selectors]
        out.append(f"{m}\n" + f"{index:<{wide}}  " + "  ".join(f"{s:>{w}}" for s, w in zip(selectors, heads, strict=True)))
        out += [f"{n!s:<{wide}}  " + "  ".join(f"{number(cells.get((n, m, s)), digits):>{w}}" for s, w in zip(selectors, heads, strict=True)) for n in names]
    return "\n".join(out)


def latex_head(selector: str, labels: Mapping[str, str] | None = None) -> str:
    """A column's head: its label as it is, else its escaped name, on two lines where it names a metric at a query."""
    if selector in (labels or {}):
        return labels[selector]
    metric, at, query = escape_latex(selector).partition("@")
    return rf"\shortstack{{{metric}\\@{query}}}" if at else metric


def grid_tabular(grid: Mapping[str, Mapping[str, float | None]], *, digits: int = 3, corner: str = "", rank: str | None = "rows", exclude: Sequence[str] = ("oracle",), higher_is_better: bool = True, column_labels: Mapping[str, str] | None = None, row_labels: Mapping[str, str] | None = None, rules_before: Sequence[str] = (), position: str = "t") -> str:
    """A tabular of a prebuilt grid, ranked within rows, columns or not at all."""
    columns = list(dict.fromkeys(c for r in grid.values() for c in r))
    style: dict[tuple[str, str], str] = {}
    if rank == "rows":
        style = {(r, c): m for r, cells in grid.items() for c, m in marks(cells, exclude=exclude, digits=digits, higher_is_better=higher_is_better).items()}
    elif rank == "columns":
        style = {(r, c): m for c in columns for r, m in marks({r: cells.get(c) for r, cells in grid.items()}, exclude=exclude, digits=digits, higher_is_better=higher_is_better).items()}
    label = lambda names, x: latex_head(x, names) if names is column_labels else (names or {}).get(x, escape_latex(x))
    lines = [rf"\begin{{tabular}}[{position}]{{l{'r' * len(columns)}}}", r"\toprule", " & ".join([corner, *[label(column_labels, c) for c in columns]]) + r" \\", r"\midrule"]
    for r, cells in grid.items():
        if r in rules_before:
            lines.append(r"\midrule")
        lines.append(" & ".join([label(row_labels, r), *[_styled(number(cells.get(c), digits), style.get((r, c))) for c in columns]]) + r" \\")
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}"])


def latex_float(tabulars: Sequence[str], *, caption: str = "", label: str = "", vertical: bool = False, gap: str = r"\quad") -> str:
    """A table float of tabulars side by side or stacked."""
    body = ("\n\n\\medskip\n\n" if vertical else f"\n{gap}\n").join(tabulars)
    tail = [rf"\caption{{{caption}}}"] * bool(caption) + [rf"\label{{{label}}}"] * bool(label)
    return "\n".join([r"\begin{table}[t]", r"\centering", body, *tail, r"\end{table}"])


def metric_grid(rows: Sequence[Mapping], metric: str, *, value: str = "value", index: str = "category", mean_row: bool = True) -> dict[str, dict[str, float | None]]:
    names, _, selectors, cells = pivot([r for r in rows if r["metric"] == metric], value, index)
    grid = {n: {s: cells.get((n, metric, s)) for s in selectors} for n in names}
    if mean_row and grid:
        grid["mean"] = {s: _mean([grid[n][s] for n in names]) for s in selectors}
    return grid


def latex_table(rows: Sequence[Mapping], *, value: str = "value", index: str = "category", metrics: Sequence[str] | None = None, digits: int = 3, higher_is_better: bool = True, mean_row: bool = True, caption: str = "", label: str = "", vertical: bool = False, selector_labels: Mapping[str, str] | None = None) -> str:
    """A float with a tabular for each metric: best bold, second underlined, the mean of the cells last."""
    metrics = list(metrics) if metrics is not None else list(dict.fromkeys(r["metric"] for r in rows))
    tabulars = [grid_tabular(metric_grid(rows, m, value=value, index=index, mean_row=mean_row), digits=digits, corner=METRIC_HEADS.get(m, escape_latex(m)), higher_is_better=higher_is_better, column_labels=selector_labels or {}, rules_before=("mean",)) for m in metrics]
    return latex_float(tabulars, caption=caption, label=label, vertical=vertical)


def latex_panels(panels: Mapping[str, Sequence[Mapping]], metric: str, *, value: str = "value", index: str = "category", digits: int = 3, caption: str = "", label: str = "") -> str:
    """Panels beside each other, ranked each for itself, over the union of their rows."""
    grids = {title: metric_grid(rows, metric, value=value, index=index) for title, rows in panels.items()}
    names = sorted({n for g in grids.values() for n in g if n != "mean"}) + ["mean"]
    full = [grid_tabular({n: g.get(n, {}) for n in names}, digits=digits, corner=escape_latex(title), rules_before=("mean",)) for title, g in grids.items()]
    return latex_float(full, caption=caption, label=label)


def format_progress(rows: Sequence[Mapping]) -> str:
    return "\n".join(f"{r['class']:<12} {r['severity']:<10} {r['have']:>6} / {r['target']:<6} {'done' if not r['need'] else 'need ' + str(r['need'])}" for r in rows)


def plan_markdown(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows]])
