"""Curves as SVG files: risk over coverage, accuracy over coverage, reliability."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from .store import write_text

COLOURS = ("#1b6ca8", "#c8553d", "#3c8d5a", "#7d5ba6", "#b8860b", "#4d4d4d")


def chart(title: str, x: str, y: str, lines: dict[str, list[tuple[float, float]]], diagonal: bool = False) -> str:
    """Lines over the unit square; points without a number are left out."""
    w, h, edge = 480, 360, 48
    at = lambda a, b: f"{edge + a * (w - 2 * edge):.1f},{h - edge - b * (h - 2 * edge):.1f}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" font-family="sans-serif" font-size="11">', f'<text x="{w / 2}" y="20" text-anchor="middle" font-size="13">{escape(title)}</text>']
    for i in range(6):
        v = i / 5
        (x0, y0), (x1, y1) = at(v, 0).split(","), at(0, v).split(",")
        out.append(f'<line x1="{x0}" y1="{y0}" x2="{x0}" y2="{at(v, 1).split(",")[1]}" stroke="#e4e4e4"/><text x="{x0}" y="{float(y0) + 15:.1f}" text-anchor="middle">{v:.1f}</text>')
        out.append(f'<line x1="{x1}" y1="{y1}" x2="{at(1, v).split(",")[0]}" y2="{y1}" stroke="#e4e4e4"/><text x="{float(x1) - 6:.1f}" y="{float(y1) + 4:.1f}" text-anchor="end">{v:.1f}</text>')
    if diagonal:
        out.append(f'<polyline points="{at(0, 0)} {at(1, 1)}" fill="none" stroke="#999" stroke-dasharray="4 3"/>')
    for i, (name, points) in enumerate(lines.items()):
        colour = COLOURS[i % len(COLOURS)]
        kept = [(a, b) for a, b in points if a is not None and b is not None and a == a and b == b]
        out.append(f'<polyline points="{" ".join(at(a, min(max(b, 0), 1)) for a, b in kept)}" fill="none" stroke="{colour}" stroke-width="1.6"/>')
        out.append(f'<text x="{w - edge + 4}" y="{edge + 13 * i}" fill="{colour}">{escape(name)}</text>')
    out.append(f'<text x="{w / 2}" y="{h - 10}" text-anchor="middle">{escape(x)}</text><text x="14" y="{h / 2}" transform="rotate(-90 14 {h / 2})" text-anchor="middle">{escape(y)}</text></svg>')
    return "\n".join(out) + "\n"


def write_figures(spark: SparkSession, folder: str, pooled: DataFrame, reliability: DataFrame, most_points: int = 400) -> list[str]:
    """Three files from the tables of a benchmark: pooled (model, coverage, risk), reliability (model, bin, n, confidence, accuracy).

    A curve is thinned to about most_points points before it leaves Spark; its
    first and last stay.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("model").orderBy("coverage")
    n = F.count("*").over(Window.partitionBy("model"))
    thin = pooled.withColumn("i", F.row_number().over(w)).withColumn("n", n).where((F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / most_points)) == 0) | (F.col("i") == 1) | (F.col("i") == F.col("n")))
    risk: dict[str, list] = {}
    for r in thin.orderBy("model", "coverage").collect():
        risk.setdefault(r["model"], []).append((r["coverage"], r["risk"]))
    bins: dict[str, list] = {}
    for r in reliability.where("n > 0").orderBy("model", "bin").collect():
        bins.setdefault(r["model"], []).append((r["confidence"], r["accuracy"]))
    made = {
        "risk_coverage.svg": chart("Risk over coverage", "coverage", "risk", risk),
        "coverage_accuracy.svg": chart("Accuracy over coverage", "coverage", "accuracy", {k: [(a, None if b is None else 1 - b) for a, b in v] for k, v in risk.items()}),
        "reliability.svg": chart("Reliability", "confidence", "accuracy", bins, diagonal=True),
    }
    for name, text in made.items():
        write_text(spark, text.rstrip("\n"), f"{folder}/{name}")
    return list(made)
