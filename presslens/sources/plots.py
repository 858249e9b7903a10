"""Pictures of plot-ready tables, as SVG and HTML text. Such tables have a row a source or a word; larger ones are refused."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

MAX_POINTS = 20_000
COLOURS = "#4477aa #ee6677 #228833 #ccbb44 #66ccee #aa3377 #bbbbbb".split()


def _rows(df: DataFrame) -> list:
    got = df.limit(MAX_POINTS + 1).collect()
    if len(got) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} points")
    return got


def _save(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def scatter_svg(df: DataFrame, x: str, y: str, path: str, label: str | None = None, group: str | None = None, title: str = "", side: int = 800) -> None:
    """Points with labels, coloured by group; rows without a place are left out."""
    points = [(r[x], r[y], r[label] if label else None, r[group] if group else 0) for r in _rows(df) if r[x] is not None and r[y] is not None]
    xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
    place = lambda v, vs: 40 + (side - 80) * (v - min(vs)) / ((max(vs) - min(vs)) or 1)
    names = sorted({p[3] for p in points}, key=str)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{side}" height="{side}" font-family="sans-serif" font-size="10">', f'<text x="40" y="20" font-size="14">{html.escape(title)}</text>']
    for a, b, name, kind in points:
        px, py = place(a, xs), side - place(b, ys)
        out.append(f'<circle cx="{px:.1f}" cy="{py:.1f}" r="4" fill="{COLOURS[names.index(kind) % len(COLOURS)]}"/>')
        if name is not None:
            out.append(f'<text x="{px + 6:.1f}" y="{py + 3:.1f}">{html.escape(str(name))}</text>')
    _save("\n".join([*out, "</svg>"]), path)


def word_cloud_html(df: DataFrame, word: str, weight: str, path: str, title: str = "") -> None:
    """Words in the order of their weights, larger with the root of the weight."""
    words = sorted(((r[weight] or 0, r[word]) for r in _rows(df) if r[word] is not None), key=lambda w: (-w[0], w[1]))
    top = max((w for w, _ in words), default=1) or 1
    spans = [f'<span style="font-size:{10 + 38 * (max(w, 0) / top) ** 0.5:.0f}px">{html.escape(x)}</span>' for w, x in words]
    _save(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><p>{' '.join(spans)}</p>", path)
