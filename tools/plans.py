"""Summarise the physical plan of each headline query: exchanges (with keys), broadcasts,
window partitioning, and each scan's pruned schema and pushed filters."""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def summarise(plan: str) -> dict:
    ex = re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning\([^)]*\))", plan)
    win = re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan)
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\].*?PushedFilters: \[([^\]]*)\].*?ReadSchema: ([^\n]*)",
                       plan, re.S)
    return {"exchanges": sorted(set(ex)), "n_exchange": len(ex), "n_broadcast": plan.count("BroadcastExchange"),
            "window_partitions": sorted(set(win)), "scans": sorted(set((s[2][:160], s[1][:120]) for s in scans))}


def main(sf_dir: str, names: list[str]) -> None:
    from hydroframe.session import local_session
    from hydroframe.plans.queries import REGISTRY
    from bench import HEADLINE
    spark = local_session()
    for name in names or HEADLINE:
        df = REGISTRY[name](spark, sf_dir)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"### {name}\n")
        print(f"- exchanges: {s['n_exchange']} ({', '.join(s['exchanges'])})")
        print(f"- broadcast exchanges: {s['n_broadcast']}")
        print(f"- window partition keys: {'; '.join(s['window_partitions']) or 'none'}")
        for schema, pushed in s["scans"]:
            print(f"- scan `{schema}` pushed: [{pushed}]")
        print()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
