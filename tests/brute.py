"""Straightforward single-process versions of the graph operators, for small fixtures."""

from collections import defaultdict, deque

ORDER = {"retweeted": 3, "replied_to": 2, "quoted": 1, None: 0}


def closure(posts, root):
    """Ids reached from a root through references, and the reference rows of the reached posts."""

    def outward(p):
        return [r for r in p["referenced_tweets"] or [] if (r["author"] or {}).get("id") != p["author"]["id"]]

    reached, frontier = set(), {root}
    while frontier:
        near = {
            p["id"]
            for p in posts
            if outward(p) and any(r["id"] in frontier for r in p["referenced_tweets"] or [])
        }
        frontier = near - reached
        reached |= near
    refs = [
        (r["id"], p["id"], r["type"], (r["author"] or {}).get("id"), r["created_at"], p["author"]["id"], p["created_at"])
        for p in posts
        if p["id"] in reached
        for r in outward(p)
        if r["created_at"] is not None
    ]
    return reached, refs


def nodes(posts, root, refs):
    own = next(p for p in posts if p["id"] == root)
    best = {}
    for source, target, kind, s_author, s_time, t_author, t_time in refs:
        for pid, author, time, k in ((source, s_author, s_time, None), (target, t_author, t_time, kind)):
            if pid not in best or ORDER[k] > ORDER[best[pid][2]]:
                best[pid] = (author, time, k)
    out = {pid: (a, t, k or "other") for pid, (a, t, k) in best.items() if pid != root}
    out[root] = (own["author"]["id"], own["created_at"], "original")
    return out


def tree(root, found, refs, network):
    """Edges with loose parts linked to the root; ``network`` is a set of (source, target) authors."""
    edges = set()
    for pid, (author, time, kind) in found.items():
        if kind == "replied_to":
            edges |= {(s, t) for s, t, *_ in refs if t == pid}
        elif kind in ("retweeted", "quoted"):
            earlier = [
                (u_time, u) for u, (u_author, u_time, _) in found.items() if (u_author, author) in network and u_time < time
            ]
            if earlier:
                edges.add((max(earlier)[1], pid))
    for part in components(found, edges):
        if root not in part:
            heads = [p for p in part if not any(t == p for _, t in edges)]
            if heads:
                edges.add((root, min(heads, key=lambda p: (found[p][1], p))))
    return edges


def components(vertices, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    left, out = set(vertices), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            v = todo.pop()
            part.add(v)
            todo += [w for w in near[v] if w not in part and w not in todo]
        left -= part
        out.append(part)
    return out


def distances(start, edges, directed=True):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    dist, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    return dist


def curves(root, found, edges):
    """time -> (size, depth, breadth, virality) after all posts of that time."""
    depth = {v: -1 for v in found}
    depth.update(distances(root, edges))
    between = {v: distances(v, edges, directed=False) for v in found}
    out = {}
    for time in sorted({t for _, t, _ in found.values()}):
        seen = [v for v in found if found[v][1] <= time]
        levels = [depth[v] for v in seen]
        total = sum(between[a].get(b, 0) for a in seen for b in seen)
        out[time] = (
            len(seen),
            max(levels),
            max(levels.count(x) for x in set(levels)),
            round(total / len(seen) ** 2, 9),
        )
    return out
