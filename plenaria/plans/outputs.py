"""What a study writes: JSON lines and Parquet by Spark, small tables, figures and reports by the driver."""

from __future__ import annotations

import csv
import html
import io
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a table written by the driver may have.
TABLE_ROWS = 10_000
# Colours of the lines.
COLOURS = ("#3569a8", "#d45e36", "#32876b", "#8b62a9", "#d09b27", "#4b8e9d")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; nulls are written. The commit protocol makes it whole or absent."""
    df.select(sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """Parquet by country and year, so that later reads open only what they ask for. df: a speech table with day."""
    from pyspark.sql import functions as F

    # rebalanced by the adaptive planner: small partitions are merged, a hot country's year is split over several files
    df.withColumn("year", F.year("day")).hint("rebalance", "country", "year").write.mode("overwrite").partitionBy("country", "year").parquet(path)


def put(path: str | Path, text: str) -> None:
    """Write a file so that it is never seen half written."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    pending = path.with_suffix(path.suffix + ".tmp")
    pending.write_text(text, encoding="utf-8")
    os.replace(pending, path)


def put_json(path: str | Path, value: object) -> None:
    put(path, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


def small_rows(df: DataFrame, order: list[str]) -> list[dict]:
    """The ordered rows of a result table; more than TABLE_ROWS are an error, as they'd be no result table."""
    rows = [r.asDict() for r in df.orderBy(*order).limit(TABLE_ROWS + 1).collect()]
    if len(rows) > TABLE_ROWS:
        raise ValueError("too many rows for a table; write it with Spark")
    return rows


def put_csv(path: str | Path, rows: list[dict]) -> None:
    """A header of the first row's keys and the rows; an empty line if there are none."""
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, list(rows[0]), lineterminator="\n", extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)
    put(path, out.getvalue() or "\n")


def line_chart(rows: list[dict], title: str, share: str, width: int = 920, height: int = 440) -> str:
    """SVG of a share over the periods, a line per country."""
    left, top, right, bottom = 70, 45, width - 25, height - 70
    countries, periods = list(dict.fromkeys(r["country"] for r in rows)), sorted({r["period"] for r in rows}) or ["no data"]
    ceiling = max(0.05, min(1.0, 1.15 * max((r[share] for r in rows), default=0.0)))
    x = lambda k: left + (right - left) * k / max(1, len(periods) - 1)
    y = lambda v: bottom - (bottom - top) * min(max(v, 0.0), ceiling) / ceiling
    words = lambda px, py, text, size=11, **more: f'<text x="{px:.1f}" y="{py:.1f}" font-family="sans-serif" font-size="{size}"' + "".join(f' {k.replace("_", "-")}="{v}"' for k, v in more.items()) + f">{html.escape(text)}</text>"
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', '<rect width="100%" height="100%" fill="white"/>', words(left, 25, title, 18, font_weight="bold")]
    for k in range(6):
        v = ceiling * k / 5
        parts += [f'<line x1="{left}" x2="{right}" y1="{y(v):.1f}" y2="{y(v):.1f}" stroke="#ddd"/>', words(left - 10, y(v) + 4, f"{v:.1%}", text_anchor="end")]
    thin = max(1, len(periods) // 10)
    parts += [words(x(k), height - 40, p, 10, text_anchor="middle") for k, p in enumerate(periods) if k % thin == 0 or k == len(periods) - 1]
    for n, country in enumerate(countries):
        colour = COLOURS[n % len(COLOURS)]
        points = sorted((periods.index(r["period"]), r[share]) for r in rows if r["country"] == country)
        line = " ".join(f"{x(k):.1f},{y(v):.1f}" for k, v in points)
        parts.append(f'<polyline points="{line}" fill="none" stroke="{colour}" stroke-width="2"/>')
        parts += [f'<circle cx="{x(k):.1f}" cy="{y(v):.1f}" r="3" fill="{colour}"/>' for k, v in points]
        parts += [f'<line x1="{left + 135 * n}" x2="{left + 135 * n + 18}" y1="{height - 15}" y2="{height - 15}" stroke="{colour}" stroke-width="3"/>', words(left + 135 * n + 24, height - 11, country)]
    return "\n".join([*parts, "</svg>"]) + "\n"


def review_packet(rows: list[dict], most: int = 1500) -> str:
    """Markdown of verified records for a reader, each with its status and the begin of its text."""
    parts = ["# Records to review\n"]
    for r in rows:
        parts.append(f"## {r['speech_id']}\n\n{r.get('country', '')}, {r.get('date', '')}, {r.get('speaker_name', '')} — **{r['status']}**\n\n{r.get('source_url', '')}\n\n> {str(r.get('text') or '')[:most]}\n")
    return "\n".join(parts)
