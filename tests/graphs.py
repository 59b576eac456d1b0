"""Small graphs and plain-Python answers to compare with."""

from vertexloom import EDGE_SCHEMA, VERTEX_SCHEMA, PropertyGraph


def make_graph(spark, ids, pairs, **options):
    """Graph from vertex ids and (src, dst) pairs, without properties."""
    vertices = [(None, "test", i, "node", []) for i in ids]
    edges = [
        (None, "test", f"edge_{n}", "link", [], src, dst)
        for n, (src, dst) in enumerate(pairs)
    ]
    return PropertyGraph(
        spark.createDataFrame(vertices, VERTEX_SCHEMA),
        spark.createDataFrame(edges, EDGE_SCHEMA),
        **options,
    )


def as_dict(df):
    key, value = df.columns
    rows = [(row[key], row[value]) for row in df.collect()]
    assert len(rows) == len({k for k, _ in rows}), "an id occurs more than once"
    return dict(rows)


def inner_pairs(ids, pairs):
    known = set(ids)
    return [(s, d) for s, d in pairs if s in known and d in known]


def weak_components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, d in inner_pairs(ids, pairs):
        a, b = sorted((root(s), root(d)))
        parent[b] = a
    return {i: root(i) for i in ids}


def strong_components(ids, pairs):
    """By two depth-first passes, without recursion."""
    out, back = {i: [] for i in ids}, {i: [] for i in ids}
    for s, d in inner_pairs(ids, pairs):
        out[s].append(d)
        back[d].append(s)

    def visit(start, links, seen):
        finished, stack = [], [(start, iter(links[start]))]
        seen.add(start)
        while stack:
            node, following = stack[-1]
            for x in following:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(links[x])))
                    break
            else:
                stack.pop()
                finished.append(node)
        return finished

    seen, order = set(), []
    for i in ids:
        if i not in seen:
            order += visit(i, out, seen)
    seen, result = set(), {}
    for i in reversed(order):
        if i not in seen:
            members = visit(i, back, seen)
            result.update(dict.fromkeys(members, min(members)))
    return result


def page_ranks(ids, pairs, reset=0.15, rounds=10, tol=None):
    pairs = inner_pairs(ids, pairs)
    out = {i: 0 for i in ids}
    for s, _ in pairs:
        out[s] += 1
    rank = {i: 1.0 for i in ids}
    n = 0
    while True:
        got = {i: 0.0 for i in ids}
        for s, d in pairs:
            got[d] += rank[s] / out[s]
        new = {i: reset + (1 - reset) * got[i] for i in ids}
        moved = max(abs(new[i] - rank[i]) for i in ids)
        rank, n = new, n + 1
        if (tol is None and n == rounds) or (tol is not None and moved <= tol):
            break
    scale = len(rank) / sum(rank.values())
    return {i: r * scale for i, r in rank.items()}
