"""Join trees from PostgreSQL's EXPLAIN (FORMAT JSON): hash joins over scans; conditions come from the query."""

from __future__ import annotations

from millrace.plans.sqlfront import Bound, Tree, UnsupportedSql

THROUGH = ("Aggregate", "Gather", "Gather Merge", "Materialize", "Sort")
SCANS = ("Seq Scan", "Index Only Scan", "Index Scan", "Bitmap Heap Scan")


def join_tree(plan: dict, bound: Bound) -> Tree:
    """The child under a Hash node is the build side."""
    node = plan.get("Plan", plan)
    kind = node["Node Type"]
    if kind in THROUGH or kind == "Hash":
        return join_tree(node["Plans"][0], bound)
    if kind in SCANS:
        if "Alias" in node:
            if node["Alias"] not in bound.tables:
                raise UnsupportedSql(f"unknown alias {node['Alias']}")
            return node["Alias"]
        found = [a for a, t in bound.tables.items() if t == node["Relation Name"]]
        if len(found) != 1:
            raise UnsupportedSql(f"{node['Relation Name']} is used {len(found)} times and has no alias")
        return found[0]
    if kind != "Hash Join":
        raise UnsupportedSql(f"not a hash join: {kind}")
    left, right = node["Plans"]
    hashed = [x["Node Type"] == "Hash" for x in (left, right)]
    if sum(hashed) != 1:
        raise UnsupportedSql("exactly one side of a hash join is hashed")
    return join_tree(left, bound), join_tree(right, bound), hashed[0]
