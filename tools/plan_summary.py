"""Summarise the physical plan of every registered query (for PLANS.md).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagelane.plans import catalog  # noqa: E402
from pagelane.session import build_session  # noqa: E402


def summarise(plan: str) -> dict:
    scans = re.findall(r"Scan parquet [^\n]*\n(?:[^\n]*\n)*?ReadSchema: (struct<[^\n]*>)", plan)
    pushed = re.findall(r"PushedFilters: (\[[^\n]*\])", plan)
    tables = re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/([a-z]+)\.parquet\]", plan)
    return {
        "tables": tables,
        "read_schema": scans,
        "pushed": [p for p in pushed if p != "[]"],
        "exchanges": len(re.findall(r"^\(\d+\) Exchange", plan, re.M)),
        "broadcast": len(re.findall(r"^\(\d+\) BroadcastExchange", plan, re.M)),
        "joins": sorted(set(re.findall(r"^\(\d+\) (\w*Join)", plan, re.M))),
        "python": bool(re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython", plan)),
        "aggregates": len(re.findall(r"^\(\d+\) \w*Aggregate", plan, re.M)),
        "windows": len(re.findall(r"^\(\d+\) Window", plan, re.M)),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    print("# PLANS\n")
    print(f"Physical plans of the registered queries at `{sf_dir}` (before AQE re-planning), summarised by "
          "`tools/plan_summary.py`. `spread()` is off: scans keep their splits.\n")
    print("| Query | Tables (ReadSchema columns) | Pushed filters | Exchanges | Broadcasts | Joins | Aggregates | Windows | Python |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(catalog.QUERIES.items()):
        df = fn(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        s = summarise(plan)
        cols = []
        for t, rs in zip(s["tables"], s["read_schema"]):
            n = len(re.findall(r"[a-z_]+:", rs))
            cols.append(f"{t} ({n})")
        print(f"| `{name}` | {', '.join(cols)} | {'; '.join(s['pushed']) or '—'} | {s['exchanges']} | {s['broadcast']} | "
              f"{', '.join(s['joins']) or '—'} | {s['aggregates']} | {s['windows']} | {'yes' if s['python'] else 'no'} |")
    spark.stop()


if __name__ == "__main__":
    main()
