"""SQL that states walks by their md5 draws: one recursion a kind, a step a round."""

from __future__ import annotations

#: A number in [0, 1) drawn from the parts, as operators.graph.uniform draws it.
def draw(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5({' || '.join(repr('|') + ' || ' + p for p in parts).replace(repr('|'), repr(f'{seed}|'), 1)}), 1, 13))::BIGINT / 4503599627370496.0)"


def _race(seed: int, weight: str, *parts: str) -> str:
    return f"(-ln(greatest({draw(seed, *parts)}, 1e-16)) / ({weight}))"


def asked(n: int, first: int, least: int, most: int, seed: int = 42) -> str:
    """asked(graph, walk, want) for graphs(graph)."""
    return f"asked AS (SELECT graph, walk, CAST({least} + floor({draw(seed, 'graph', 'walk', repr('length'))} * {most - least + 1}) AS INT) AS want FROM graphs, (SELECT unnest(range({first}, {first + n})) AS walk))"


def walk_graph(seed: int = 42) -> str:
    """places, begin: nodes with successors in drawn order, and where chains may start, of ge(graph, src, dst, weight)."""
    return f"""places AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY u, id) - 1 AS rank, count(*) OVER (PARTITION BY graph) AS n FROM (SELECT graph, id, {draw(seed, 'graph', 'id')} AS u FROM (SELECT DISTINCT graph, src AS id FROM ge))),
begin AS (SELECT *, least(n, greatest(3, n // 3)) AS few FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY surplus DESC, u, id) - 1 AS rank, count(*) OVER (PARTITION BY graph) AS n
  FROM (SELECT graph, id, sum(s) AS surplus, {draw(seed, 'graph', 'id')} AS u FROM (SELECT graph, src AS id, 1 AS s FROM ge UNION ALL SELECT graph, dst, -1 FROM ge) GROUP BY graph, id)))"""


def chains(asked: str = "asked", seed: int = 42) -> str:
    """chain(graph, walk, path) of ``asked``(graph, walk, want); a recursion."""
    race = _race(seed, "e.weight", "c.graph", "c.walk", "len(c.path)", "e.dst")
    jump = f"floor({draw(seed, 'c.graph', 'c.walk', 'len(c.path)', repr('jump'))} * p.n)"
    return f"""c(graph, walk, want, path) AS (
  SELECT a.graph, a.walk, a.want, [b.id] FROM {asked} a JOIN begin b ON b.graph = a.graph AND b.rank = floor({draw(seed, 'a.graph', 'a.walk', repr('start'))} * b.few)
  UNION ALL
  SELECT graph, walk, any_value(want), list_append(any_value(path), coalesce(arg_min(dst, r) FILTER (dst IS NOT NULL), arg_min(far, k))) FROM (
    SELECT c.*, e.dst, {race} AS r, NULL AS far, NULL AS k FROM c JOIN ge e ON e.graph = c.graph AND e.src = c.path[-1] AND NOT list_contains(c.path, e.dst) WHERE len(c.path) < c.want
    UNION ALL
    SELECT c.*, NULL, NULL, p.id, (p.rank - {jump} + p.n) % p.n FROM c JOIN places p ON p.graph = c.graph AND NOT list_contains(c.path, p.id) WHERE len(c.path) < c.want) GROUP BY graph, walk
), chain AS (SELECT graph, walk, arg_max(path, len(path)) AS path FROM c GROUP BY graph, walk)"""


def dags(asked: str = "asked", seed: int = 42, merge: float = 0.25, branch: float = 0.3, widest: int = 3) -> str:
    """dag(graph, walk, nodes, steps) of ``asked``(graph, walk, want); a recursion."""
    of = ("graph", "walk", "round")
    pick = _race(seed, "1.0 / (x.depth + 1)", *of, repr("pick"), "x.id")
    t = {k: _race(seed, "e.weight", "h.graph", "h.walk", "h.round", repr(k), "e.dst") for k in "abc"}
    at = lambda tag: draw(seed, *of, repr(tag))
    fresh, deeper = "known IS NULL", "known > depth AND NOT taken"
    return f"""d(graph, walk, want, round, nodes, steps) AS (
  SELECT a.graph, a.walk, a.want, 0, [{{'id': p.id, 'depth': 0, 'open': true}}], CAST([] AS STRUCT(src BIGINT, dst BIGINT)[]) FROM {asked} a JOIN places p ON p.graph = a.graph AND p.rank = floor({draw(seed, 'a.graph', 'a.walk', repr('start'))} * p.n)
  UNION ALL
  SELECT graph, walk, want, round + 1,
    list_concat([{{'id': x.id, 'depth': x.depth, 'open': x.open AND x.id <> src}} FOR x IN nodes], [{{'id': y, 'depth': depth + 1, 'open': true}} FOR y IN new]),
    list_concat(steps, [{{'src': src, 'dst': y}} FOR y IN list_concat(new, CASE WHEN merging THEN [into_] ELSE [] END)])
  FROM (SELECT *, CASE WHEN merging OR n_fresh = 0 THEN [] WHEN n_fresh > 1 AND {at('branch')} < {branch}
      THEN (CASE WHEN a = b THEN [a] ELSE [a, b] END || CASE WHEN {at('two')} < 0.5 OR c = a OR c = b THEN [] ELSE [c] END)[1:least({widest}, want - len(nodes))] ELSE [a] END AS new
    FROM (SELECT *, into_ IS NOT NULL AND {at('merge')} < {merge} AS merging FROM (
      SELECT graph, walk, any_value(want) AS want, round, any_value(nodes) AS nodes, any_value(steps) AS steps, any_value(src) AS src, any_value(depth) AS depth,
        count(*) FILTER (dst IS NOT NULL AND {fresh}) AS n_fresh, arg_min(dst, ra) FILTER ({deeper}) AS into_, arg_min(dst, ra) FILTER ({fresh}) AS a, arg_min(dst, rb) FILTER ({fresh}) AS b, arg_min(dst, rc) FILTER ({fresh}) AS c
      FROM (SELECT h.*, e.dst, {t['a']} AS ra, {t['b']} AS rb, {t['c']} AS rc, [x.depth FOR x IN h.nodes IF x.id = e.dst][1] AS known, list_contains(h.steps, {{'src': h.src, 'dst': e.dst}}) AS taken
        FROM (SELECT *, pick.id AS src, pick.depth AS depth FROM (SELECT *, list_min([{{'u': {pick}, 'id': x.id, 'depth': x.depth}} FOR x IN nodes IF x.open]) AS pick FROM d WHERE len(nodes) < want AND round < 3 * want) WHERE pick IS NOT NULL) h
        LEFT JOIN ge e ON e.graph = h.graph AND e.src = h.src) GROUP BY graph, walk, round)))
), dag AS (SELECT graph, walk, arg_max(nodes, round) AS nodes, arg_max(steps, round) AS steps FROM d GROUP BY graph, walk),
dag_path AS (SELECT graph, walk, [y.id FOR y IN list_sort([{{'depth': x.depth, 'i': i, 'id': x.id}} FOR x, i IN nodes])] AS path, steps FROM dag)"""


def alike(a: str, b: str, most: float) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"({a} = {b} OR {both} / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) > {most})"


def spread(first: str, branching: int, most: int, seed: int = 42, unvisited: bool = False) -> str:
    """bfs(sample, pos, id): what a queue reaches from ``first``(sample, id) over e(src, dst), a level a round."""
    fresh = "AND NOT list_contains(r.got, e.dst)" if unvisited else ""
    return f"""r(sample, got, low) AS (
  SELECT sample, [id], 0 FROM {first}
  UNION ALL
  SELECT sample, got || new[1:{most} - len(got)], len(got) FROM (
    SELECT sample, got, list(dst ORDER BY at_, dst) AS new FROM (
      SELECT sample, any_value(got) AS got, dst, min({{'p': p, 'n': n}}) AS at_ FROM (
        SELECT r.sample, r.got, r.p, e.dst, row_number() OVER (PARTITION BY r.sample, e.src ORDER BY {draw(seed, 'r.sample', 'e.src', 'e.dst')}, e.dst) AS n
        FROM (SELECT *, unnest(range(low + 1, len(got) + 1)) AS p FROM r WHERE len(got) < {most}) r JOIN (SELECT DISTINCT src, dst FROM e WHERE src <> dst) e ON e.src = r.got[r.p] {fresh})
      WHERE n <= {branching} AND NOT list_contains(got, dst) GROUP BY sample, dst) GROUP BY sample, got) WHERE len(new) > 0
), whole AS (SELECT sample, arg_max(got, len(got)) AS got FROM r GROUP BY sample), bfs AS (SELECT sample, unnest(range(len(got))) AS pos, unnest(got) AS id FROM whole)"""


def by_depth(first: str, branching: int, most: int, seed: int = 42) -> str:
    """dfs(sample, pos, id): depth first with a stack from ``first``(sample, id) over e(src, dst), a node a round."""
    return f"""s(sample, path, stack, k) AS (
  SELECT sample, CAST([] AS BIGINT[]), [id], 0 FROM {first}
  UNION ALL
  SELECT sample, CASE WHEN old THEN path ELSE list_append(path, src) END, rest || CASE WHEN old THEN [] ELSE coalesce(more, []) END, k + 1 FROM (
    SELECT sample, k, any_value(path) AS path, any_value(rest) AS rest, any_value(src) AS src, any_value(list_contains(path, src)) AS old, list(dst ORDER BY n) FILTER (dst IS NOT NULL AND n <= {branching}) AS more FROM (
      SELECT s.*, e.dst, row_number() OVER (PARTITION BY s.sample ORDER BY {draw(seed, 's.sample', 's.src', 'e.dst')}, e.dst) AS n
      FROM (SELECT *, stack[-1] AS src, stack[:-2] AS rest FROM s WHERE len(stack) > 0 AND len(path) < {most} AND k < {most * (branching + 1)}) s LEFT JOIN (SELECT DISTINCT src, dst FROM e WHERE src <> dst) e ON e.src = s.src) GROUP BY sample, k)
), whole AS (SELECT sample, arg_max(path, k) AS path FROM s GROUP BY sample), dfs AS (SELECT sample, unnest(range(len(path))) AS pos, unnest(path) AS id FROM whole)"""
