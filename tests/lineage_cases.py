"""Small tables of annotated sequences, and plain-Python versions of what the engine computes."""

import itertools

from lineagrid.functions.distance import levenshtein

SCHEMA = "sequence_id string, v_gene string, j_gene string, cdr3 string, v_mutations string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def partition(df, field="lineage"):
    """The sets of ids that share a lineage."""
    groups = {}
    for r in df.collect():
        groups.setdefault(r[field], set()).add(r["sequence_id"])
    return {frozenset(g) for g in groups.values()}


def pair_score(a, b, bonus=0.35, multiplier=2.0):
    germline = (10 if a[1] != b[1] else 0) + (5 if a[2] != b[2] else 0)
    x, y = a[3], b[3]
    distance = sum(p != q for p, q in zip(x, y)) if len(x) == len(y) else levenshtein(x, y)
    muts = [{m for m in (r[4] or "").split("|") if m} for r in (a, b)]
    shared = len(muts[0] & muts[1])
    return max(germline + (distance + abs(len(x) - len(y)) * multiplier - shared * bonus) / max(min(len(x), len(y)), 1), 0.001)


def single_linkage(rows, cutoff, together):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if together(a, b) and a[3] and b[3] and pair_score(a, b) <= cutoff:
            root[find(a[0])] = find(b[0])
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), set()).add(r[0])
    return {frozenset(g) for g in groups.values()}


def average_linkage(rows, cutoff, together):
    """Closest pair of clusters first, until none is within the cutoff."""
    clusters = [[r] for r in rows]
    while True:
        best = None
        for i, j in itertools.combinations(range(len(clusters)), 2):
            if all(together(a, b) for a in clusters[i] for b in clusters[j]):
                scores = [pair_score(a, b) for a in clusters[i] for b in clusters[j]]
                mean = sum(scores) / len(scores)
                if mean <= cutoff and (best is None or mean < best[0]):
                    best = (mean, i, j)
        if best is None:
            return {frozenset(r[0] for r in c) for c in clusters}
        _, i, j = best
        clusters[i] += clusters.pop(j)


def components(edges):
    """The sets of nodes that edges join."""
    groups = {}
    for a, b in edges:
        both = groups.get(a, {a}) | groups.get(b, {b})
        groups.update({n: both for n in both})
    return {frozenset(g) for g in groups.values()}
