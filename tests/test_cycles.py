from __future__ import annotations

import itertools
import random


from weft.operators import communities, cycles, graph


def reach(edges):
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    full = {}
    for start in out:
        seen, stack = set(), [start]
        while stack:
            for x in out[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        full[start] = seen
    return full


def made(seed: int, n: int, m: int):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}")


def test_groups_of_mutual_reach_and_ranks(spark):
    for edges in (made(1, 40, 60), made(2, 60, 70) + [(100, 101), (101, 102)], [(1, 1), (2, 3)], [(i, i + 1) for i in range(9)] + [(9, 0)]):
        full = reach(edges)
        root = {x: min([x, *(y for y in full[x] if x in full[y])]) for x in full}
        assert {r.node: r.root for r in cycles.mutual(frame(spark, edges)).collect()} == root
        rank = {x: 0 for x in set(root.values())}
        for _ in rank:
            for a, b in edges:
                if root[a] != root[b]:
                    rank[root[b]] = max(rank[root[b]], rank[root[a]] + 1)
        assert {r.node: r.rank for r in cycles.condensed_ranks(frame(spark, edges)).collect()} == {x: rank[root[x]] for x in full}
    assert cycles.mutual(frame(spark, [(1, 2)]).limit(0)).count() == 0


def plain_back(edges):
    """Edges to open nodes of a recursive search of each group, in the order of ids."""
    full = reach(edges)
    inner = sorted({(a, b) for a, b in edges if a != b and a in full[b]})
    out: dict = {}
    for a, b in inner:
        out.setdefault(a, []).append(b)
    state, back = {}, set()

    def visit(x):
        state[x] = 1
        for y in out.get(x, []):
            if state.get(y) == 1:
                back.add((x, y))
            elif y not in state:
                visit(y)
        state[x] = 2

    for x in sorted(out):
        if x not in state:
            visit(x)
    return back


def test_turned_edges_leave_no_cycle(spark):
    for seed, n, m in ((3, 30, 60), (4, 12, 60), (5, 50, 55)):
        edges = made(seed, n, m)
        got = cycles.without_cycles(frame(spark, edges)).collect()
        assert {(r.src, r.dst) for r in got} == set(edges) and len(got) == len(set(edges))
        assert {(r.src, r.dst) for r in got if r.turned and r.src != r.dst} == plain_back(edges)
        assert all(r.turned for r in got if r.src == r.dst)
        for rows in (got, cycles.without_cycles(frame(spark, edges), searched=3).collect()):
            turned = [(r.dst, r.src) if r.turned else (r.src, r.dst) for r in rows if r.src != r.dst]
            assert all(x not in y for x, y in reach(turned).items())
    texts = [(f"n{a}", f"n{b}") for a, b in made(6, 9, 20)]
    assert {(r.src, r.dst) for r in cycles.without_cycles(frame(spark, texts, "string")).where("turned AND src <> dst").collect()} == plain_back(texts)


def plain_labels(nodes, edges, hub):
    near = {x: [] for x in nodes}
    for a, b in sorted(e for e in edges if e[0] != e[1]):
        near[a].append(b)
    for a, b in sorted(e for e in edges if e[0] != e[1]):
        near[b].append(a)
    label = {x: x for x in nodes}
    for _ in range(14):
        before = dict(label)
        for x in sorted(nodes):
            votes = {}
            for y in near[x]:
                votes[label[y]] = votes.get(label[y], 0) + (0.06 if y in hub else 1) / len(near[y]) ** 0.5
            best, most = label[x], -1
            for name in sorted(votes):
                if votes[name] > most + 1e-9:
                    best, most = name, votes[name]
            label[x] = best
        if label == before:
            break
    return label


def clustered(seed: int):
    rng = random.Random(seed)
    edges = [(10 * c + rng.randrange(9), 10 * c + rng.randrange(9)) for c in range(7) for _ in range(22)]
    edges += [(10 * rng.randrange(7) + rng.randrange(9), 10 * rng.randrange(7) + rng.randrange(9)) for _ in range(9)]
    return edges + [(0, x) for x in range(0, 69, 2)] + [(200, 201), (201, 202)]


def test_labels_against_a_plain_loop(spark):
    for seed in (1, 2):
        edges = clustered(seed)
        nodes = sorted({x for e in edges for x in e} | {500})
        table = spark.createDataFrame([(x,) for x in nodes], "id long")
        hub = {r.id for r in graph.hubs(table, frame(spark, edges)).collect()}
        assert hub
        found = communities.communities(table, frame(spark, edges))
        got = {r.id: r.community for r in found.collect()}
        assert got == plain_labels(nodes, edges, hub) and got[500] == 500
        after = {r.id: (r.root, r.community) for r in communities.merged(found, frame(spark, edges)).collect()}
        sizes = {}
        for root, c in after.values():
            sizes.setdefault(root, {}).setdefault(c, 0)
            sizes[root][c] += 1
        assert all(n >= 5 or len(of) == 1 for of in sizes.values() for n in of.values())
        assert all(len({after[x][1] for x in nodes if got[x] == c}) == 1 for c in set(got.values()))


def test_contraction_takes_the_strongest_tie():
    sizes = {1: 1, 2: 2, 3: 9, 4: 6, 5: 3}
    ties = {1: {2: 4, 3: 4}, 2: {1: 4, 3: 1, 4: 2}, 3: {1: 4, 2: 1}, 4: {2: 2, 5: 1}, 5: {4: 1}}
    # 1 goes to the larger of two it is tied to alike, 2 follows its strongest tie there, 5 has one.
    assert communities.contracted(dict(sizes), ties) == {1: 3, 2: 3, 3: 3, 4: 4, 5: 4}


def test_core_of_areas(spark):
    nodes = [(i, f"a{i % 4}") for i in range(24)]
    edges = [(0, 1), (0, 2), (0, 3), (5, 4), (5, 6), (8, 12), (8, 9), (9, 8), (7, 7), (20, 21), (20, 22), (1, 2)]
    table = spark.createDataFrame(nodes, "id long, area string")
    none = spark.createDataFrame([], "id long")
    far = {x: {b % 4 for a, b in itertools.chain(edges, [(b, a) for a, b in edges]) if a == x and b % 4 != x % 4} for x, _ in nodes}
    expected = {(x, len(v)) for x, v in far.items() if len(v) >= 2}
    assert {tuple(r) for r in communities.core(table, frame(spark, edges), none).collect()} == expected
    hub = spark.createDataFrame([(0,)], "id long")
    assert 0 not in {r.id for r in communities.core(table, frame(spark, edges), hub).collect()}
    assert communities.core(table.where("id < 12"), frame(spark, edges), none).count() == 0


def test_search_outwards_from_the_best_connected(spark):
    edges = made(11, 40, 45)
    nodes = sorted({x for e in edges for x in e} | {900})
    near = {x: set() for x in nodes}
    count = {x: 0 for x in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
            count[a] += 1
            count[b] += 1
    order, seen = [], set()
    for start in sorted(nodes, key=lambda x: (-count[x], x)):
        if start not in seen:
            seen.add(start)
            queue = [(start, start, 0)]
            while queue:
                x, root, level = queue.pop(0)
                order.append((root, x, level))
                for y in sorted(near[x] - seen, key=lambda x: (-count[x], x)):
                    seen.add(y)
                    queue.append((y, root, level + 1))
    got = communities.breadth_first(spark.createDataFrame([(x,) for x in nodes], "id long"), frame(spark, edges)).collect()
    ranked = sorted(got, key=lambda r: (-count[r.root], r.root, r.level, r.nth))
    assert [(r.root, r.id, r.level) for r in ranked] == order
