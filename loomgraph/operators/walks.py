"""Walks over a weighted graph edges(src, dst, weight), drawn by md5 so that reruns agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import leaving, uniform


def _draw(seed: int, *parts):
    return uniform(F.lit(str(seed)), *[p.cast("string") for p in parts])


def numbered(nodes: DataFrame, *order, buckets: int = 256) -> DataFrame:
    """(graph, id, rank, n) of nodes(graph, id, u, ...): ranks from 0 within each graph, by ``order`` (columns), then by the draw ``u``, then by id;
    n is the number of the graph's nodes. Places are counted by bucket, so that no task orders all nodes of a large graph."""
    keys = [f"o{k}" for k in range(len(order))]
    x = nodes.select("graph", "id", "u", F.floor(F.col("u") * buckets).alias("b"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    each = x.groupBy("graph", *keys, "b").agg(F.count("*").alias("k"))  # a row a bucket
    along = Window.partitionBy("graph").orderBy(*keys, "b")
    before = each.select("graph", *keys, "b", (F.sum("k").over(along) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("graph")).alias("n"))
    at = F.row_number().over(Window.partitionBy("graph", *keys, "b").orderBy("u", "id")) - 1
    return x.join(before, ["graph", *keys, "b"]).select("graph", "id", (F.col("before") + at).cast("long").alias("rank"), "n")


def asked(graphs: DataFrame, first: int, n: int, least: int, most: int, seed: int = 42) -> DataFrame:
    """(graph, walk, want): ``n`` walks of each graph, numbered from ``first``, and the drawn number of nodes each wants."""
    w = graphs.select("graph", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))).alias("walk"))
    return w.withColumn("want", (least + F.floor(_draw(seed, F.col("graph"), F.col("walk"), F.lit("length")) * (most - least + 1))).cast("int"))


def _places(edges, seed: int, table, degrees: DataFrame | None = None) -> DataFrame:
    """(graph, id, rank, n): nodes with successors, in drawn order."""
    out = edges.select("graph", F.col("src").alias("id")).distinct() if degrees is None else degrees.where("out_degree > 0").select("graph", "id")
    return table(numbered(out.withColumn("u", _draw(seed, F.col("graph"), F.col("id")))))


def starts(edges, seed: int, degrees: DataFrame | None = None) -> DataFrame:
    """(graph, id, rank, n): all nodes of edges(graph, src, dst), most edges out over in first."""
    if degrees is None:
        ends = edges.select("graph", F.col("src").alias("id"), F.lit(1).alias("s")).unionAll(edges.select("graph", "dst", F.lit(-1)))
        n = ends.groupBy("graph", "id").agg(F.sum("s").alias("surplus"))
    else:
        n = degrees.where("out_degree + in_degree > 0").select("graph", "id", (F.col("out_degree") - F.col("in_degree")).alias("surplus"))
    n = n.withColumn("u", _draw(seed, F.col("graph"), F.col("id")))
    return numbered(n, -F.col("surplus"))


def _landed(walks: DataFrame, places: DataFrame, seed: int, tries: int) -> DataFrame:
    """(graph, walk, id): for each walk the first unvisited place from a drawn rank on, so no walk meets all places."""
    n = places.where("rank = 0").select("graph", "n")
    at = walks.join(n, "graph").withColumn("first", F.floor(_draw(seed, F.col("graph"), F.col("walk"), F.size("path"), F.lit("jump")) * F.col("n")))
    tried = at.select("graph", "walk", "path", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(tries).cast("long"), F.col("n") - 1))).alias("probe"))
    found = tried.withColumn("rank", (F.col("first") + F.col("probe")) % F.col("n")).drop("n").join(places.select("graph", "id", "rank"), ["graph", "rank"]).where(~F.array_contains("path", F.col("id")))
    return found.groupBy("graph", "walk").agg(F.min_by("id", "probe").alias("id"))


#: Walks up to which edges come to them, not they to edges.
BROADCAST_ROWS = 100_000


def _few(walks: DataFrame) -> DataFrame:
    """Walks that are sent to all tasks, so that a step shuffles no edges, where they are few."""
    return F.broadcast(walks) if walks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else walks


def _edges_to_walk(edges, table, unique: bool):
    """Each pair once; ``unique`` edges are so, and are read as they are, and so are those that a function gives."""
    if callable(edges):
        return lambda ids: edges(ids).where("weight > 0 and src <> dst").select(F.lit(0).cast("long").alias("graph"), "src", "dst", "weight")
    e = edges.where("weight > 0 and src <> dst").select("graph", "src", "dst", "weight")
    return e if unique else table(e.groupBy("graph", "src", "dst").agg(F.max("weight").alias("weight")))


def chains(edges, walks: DataFrame, most: int, table, seed: int = 42, unique: bool = False, degrees: DataFrame | None = None) -> DataFrame:
    """(graph, walk, path): self-avoiding walks over edges(graph, src, dst, weight) for walks(graph, walk, want), want at most ``most``.

    A walk starts at one of the third of its graph's nodes, three at least, with the most edges out over in. The next node is
    an unvisited successor, by weight (exponential race). At a dead end the walk jumps to an unvisited node that has
    successors, and ends if there is none. Edges of no weight are not walked; a graph without edges has no walks.

    Edges may be a function of the nodes where walks are (see graph.leaving), of graph 0, with degrees(graph, id, in_degree, out_degree)."""
    e = _edges_to_walk(edges, table, unique)
    places = _places(e, seed, table, degrees)
    begin = starts(e, seed, degrees).where(F.col("rank") < F.greatest(F.lit(3), F.floor(F.col("n") / 3)))
    few = F.least("n", F.greatest(F.lit(3), F.floor(F.col("n") / 3)))
    drawn = walks.join(begin.where("rank = 0").select("graph", few.alias("few")), "graph").withColumn("rank", F.floor(_draw(seed, F.col("graph"), F.col("walk"), F.lit("start")) * F.col("few")))
    state = table(drawn.join(begin.select("graph", "rank", "id"), ["graph", "rank"]).select("graph", "walk", "want", F.array("id").alias("path")))
    ended = []
    for step in range(1, most):
        going = state.where((F.size("path") == step) & (F.col("want") > step))
        ended.append(state.where((F.size("path") < step) | (F.col("want") <= step)))
        race = -F.log(F.greatest(_draw(seed, F.col("graph"), F.col("walk"), F.lit(step), F.col("dst")), F.lit(1e-16))) / F.col("weight")
        here = going.withColumn("src", F.element_at("path", -1))
        near = leaving(e, here).join(_few(here), ["graph", "src"]).where(~F.array_contains("path", F.col("dst")))
        near = table(near.groupBy("graph", "walk").agg(F.min_by("dst", F.struct(race, "dst")).alias("id")))
        far = _landed(going.join(near, ["graph", "walk"], "left_anti"), places, seed, most)
        state = table(going.join(near.unionAll(far), ["graph", "walk"], "left").select("graph", "walk", "want", F.when(F.col("id").isNull(), F.col("path")).otherwise(F.concat("path", F.array("id"))).alias("path")))
        if state.isEmpty():
            break
    return reduce(DataFrame.unionAll, [*ended, state]).select("graph", "walk", "path")


def _of_one(edges, degrees: DataFrame | None) -> tuple:
    """Edges and degrees of graph 0."""
    zero = F.lit(0).cast("long").alias("graph")
    return edges if callable(edges) else edges.select(zero, "src", "dst", "weight"), degrees if degrees is None else degrees.select(zero, "id", "in_degree", "out_degree")


def chain_walks(spark: SparkSession, edges, n_walks: int, length: int, table, seed: int = 42, least: int | None = None, unique: bool = False, degrees: DataFrame | None = None) -> DataFrame:
    """(walk, path): ``chains`` of one graph edges(src, dst, weight), of ``length`` nodes or a drawn number from ``least`` on."""
    one = spark.range(1).select(F.col("id").alias("graph"))
    w = asked(one, 0, n_walks, length if least is None else least, length, seed)
    edges, degrees = _of_one(edges, degrees)
    return chains(edges, w, length, table, seed, unique, degrees).select("walk", "path")


def walk_edges(walks: DataFrame, edges) -> DataFrame:
    """(walk, pos, src, dst): consecutive nodes of a walk that an edge joins."""
    steps = walks.select("walk", F.posexplode(F.arrays_zip(F.col("path").alias("src"), F.slice("path", 2, F.greatest(F.size("path"), F.lit(1))).alias("dst"))).alias("pos", "s"))
    steps = steps.select("walk", F.col("pos").cast("long").alias("pos"), "s.src", "s.dst").where("dst is not null")
    return leaving(edges, steps).select("src", "dst").join(_few(steps), ["src", "dst"]).distinct().select("walk", "pos", "src", "dst")


NODE = "array<struct<id:bigint,depth:int,open:boolean>>"
STEP = "array<struct<src:bigint,dst:bigint>>"


def dags(edges, walks: DataFrame, most: int, table, seed: int = 42, merge: float = 0.25, branch: float = 0.3, widest: int = 3, unique: bool = False, degrees: DataFrame | None = None) -> DataFrame:
    """(graph, walk, nodes, steps): walks with an active frontier over edges(graph, src, dst, weight) for walks(graph, walk, want), nodes with their depths, steps as edges taken.

    In each round a walk takes an open node, drawn with weight 1/(depth + 1), which then closes. By chance it merges into a
    visited successor that lies deeper (so walks have no cycles), or branches to two or three drawn successors (the same may be
    drawn twice), else it goes on to one, by weight. A walk ends at ``want`` nodes, without open nodes, or after three rounds a node. Edges may be a function, as for ``chains``."""
    e = _edges_to_walk(edges, table, unique)
    places = _places(e, seed, table, degrees)
    key, of = ["graph", "walk"], [F.col("graph"), F.col("walk")]
    begun = walks.join(places.where("rank = 0").select("graph", "n"), "graph").withColumn("rank", F.floor(_draw(seed, *of, F.lit("start")) * F.col("n"))).drop("n").join(places.select("graph", "rank", "id"), ["graph", "rank"])
    state = table(begun.select(*key, "want", F.array(F.struct("id", F.lit(0).alias("depth"), F.lit(True).alias("open"))).cast(NODE).alias("nodes"), F.array().cast(STEP).alias("steps")))
    ended = []
    for round_ in range(3 * most):
        race = lambda tag, id_, weight: -F.log(F.greatest(_draw(seed, *of, F.lit(round_), F.lit(tag), id_), F.lit(1e-16))) / weight  # noqa: E731, B023
        open_ = F.filter("nodes", lambda x: x["open"])
        pick = F.array_min(F.transform(open_, lambda x: F.struct(race("pick", x["id"], 1.0 / (x["depth"] + 1)).alias("u"), x["id"].alias("id"), x["depth"].alias("depth"))))
        going = (F.size("nodes") < F.col("want")) & (F.lit(round_) < 3 * F.col("want")) & F.exists("nodes", lambda x: x["open"])
        ended.append(state.where(~going))
        here = state.where(going).withColumn("pick", pick).withColumn("src", F.col("pick.id"))
        drawn = [race(t, F.col("dst"), F.col("weight")).alias(t) for t in ("a", "b", "c")]
        known = F.get(F.transform(F.filter("nodes", lambda x: x["id"] == F.col("dst")), lambda x: x["depth"]), F.lit(0))
        near = leaving(e, here).join(_few(here), ["graph", "src"]).select(*key, "dst", *drawn, known.alias("known"), F.col("pick.depth").alias("depth"), F.array_contains("steps", F.struct(F.col("src"), F.col("dst"))).alias("taken"))
        fresh, deeper = F.col("known").isNull(), (F.col("known") > F.col("depth")) & ~F.col("taken")
        best = lambda t, ok: F.min(F.when(ok, F.struct(F.col(t).alias("u"), F.col("dst").alias("dst"))))["dst"]
        got = near.groupBy(*key).agg(F.count_if(fresh).alias("n_fresh"), best("a", deeper).alias("into"), *[best(t, fresh).alias(t) for t in ("a", "b", "c")])
        at = lambda tag: _draw(seed, *of, F.lit(round_), F.lit(tag))  # noqa: E731, B023
        none = F.array().cast("array<bigint>")
        room = F.col("want") - F.size("nodes")
        many = F.when(at("two") < 0.5, F.array("a", "b")).otherwise(F.array("a", "b", "c"))
        merging = F.col("into").isNotNull() & (at("merge") < merge)
        new = F.when(merging | F.coalesce(F.col("n_fresh") == 0, F.lit(True)), none).when((F.col("n_fresh") > 1) & (at("branch") < branch), F.slice(F.array_distinct(many), F.lit(1), F.least(F.lit(widest), room))).otherwise(F.array("a"))
        j = here.join(got, key, "left").withColumn("new", new).withColumn("into", F.when(merging, F.col("into"))).withColumn("depth", F.col("pick.depth"))
        closed = F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), x["depth"].alias("depth"), (x["open"] & (x["id"] != F.col("src"))).alias("open")))
        added = F.transform("new", lambda x: F.struct(x.alias("id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("open")))
        taken = F.transform(F.concat("new", F.when(F.col("into").isNotNull(), F.array("into")).otherwise(none)), lambda x: F.struct(F.col("src").alias("src"), x.alias("dst")))
        state = table(j.select(*key, "want", F.concat(closed, added).cast(NODE).alias("nodes"), F.concat("steps", taken).cast(STEP).alias("steps")))
        if state.isEmpty():
            break
    return reduce(DataFrame.unionAll, [*ended, state]).select(*key, "nodes", "steps")


def dag_walks(spark: SparkSession, edges, n_walks: int, length: int, table, seed: int = 42, merge: float = 0.25, branch: float = 0.3, widest: int = 3, least: int | None = None, unique: bool = False, degrees: DataFrame | None = None) -> DataFrame:
    """(walk, nodes, steps): ``dags`` of one graph edges(src, dst, weight), of up to ``length`` nodes or a drawn number from ``least`` on."""
    one = spark.range(1).select(F.col("id").alias("graph"))
    w = asked(one, 0, n_walks, length if least is None else least, length, seed)
    edges, degrees = _of_one(edges, degrees)
    return dags(edges, w, length, table, seed, merge, branch, widest, unique, degrees).select("walk", "nodes", "steps")


def dag_layers(walks: DataFrame) -> DataFrame:
    """(walk, depth, nodes, parallel): the nodes of each depth of dag_walks."""
    n = walks.select("walk", F.explode("nodes").alias("n")).select("walk", "n.depth", "n.id")
    return n.groupBy("walk", "depth").agg(F.array_sort(F.collect_list("id")).alias("nodes")).withColumn("parallel", F.size("nodes") > 1)


def dag_facts(walks: DataFrame) -> DataFrame:
    """(walk, n_nodes, n_edges, n_layers, n_parallel, widest, n_merges): merges count every edge into a node that has several."""
    layers = dag_layers(walks).groupBy("walk").agg(F.count("*").alias("n_layers"), F.count_if("parallel").alias("n_parallel"), F.max(F.size("nodes")).cast("long").alias("widest"))
    into = walks.select("walk", F.explode("steps").alias("s")).groupBy("walk", "s.dst").agg(F.count("*").alias("k")).groupBy("walk").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("n_merges"))
    w = walks.select("walk", F.size("nodes").cast("long").alias("n_nodes"), F.size("steps").cast("long").alias("n_edges"))
    return w.join(layers, "walk").join(into, "walk", "left").withColumn("n_merges", F.coalesce("n_merges", F.lit(0)).cast("long"))


def in_order(nodes) -> Column:
    """Nodes of a frontier walk in an order that no step goes against: by depth, then as they were reached."""
    ordered = F.array_sort(F.transform(nodes, lambda x, i: F.struct(x["depth"].alias("depth"), i.alias("i"), x["id"].alias("id"))))
    return F.transform(ordered, lambda x: x["id"])


def dag_sequence(walks: DataFrame) -> DataFrame:
    """(walk, path) of ``dag_walks``."""
    return walks.select("walk", in_order("nodes").alias("path"))


def _alike(a, b, most: float):
    """Paths that are the same, or whose node sets have a Jaccard similarity above ``most``."""
    both = F.size(F.array_intersect(a, b))
    return (a == b) | (both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both) > most)


def valid_walks(walks: DataFrame, least: int, most: int, alike: float, table, greedy) -> DataFrame:
    """(walk, path) of least to most nodes that are no duplicates: the same path, or node sets of a Jaccard similarity above ``alike`` with one kept before.

    Sets of a similarity above t share one of their rarest n - ceil(t * n) + 1 nodes, so walks meet at those alone and a node
    that most walks pass brings no pairs together."""
    w = table(walks.where(F.size("path").between(least, most)).select("walk", "path"))
    n = w.select("walk", F.explode(F.array_distinct("path")).alias("id"), F.size(F.array_distinct("path")).alias("n"))
    often = n.groupBy("id").agg(F.count("*").alias("k"))
    ranked = n.join(often, "id").withColumn("at", F.row_number().over(Window.partitionBy("walk").orderBy("k", "id")))
    few = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * alike - 1e-9) + 1).select("walk", "id")
    pairs = few.withColumnRenamed("walk", "src").join(few.withColumnRenamed("walk", "dst"), "id").where("src < dst").select("src", "dst").distinct()
    of = lambda end: w.select(F.col("walk").alias(end), F.col("path").alias(f"p_{end}"))
    pairs = pairs.join(of("src"), "src").join(of("dst"), "dst").where(_alike(F.col("p_src"), F.col("p_dst"), alike)).select("src", "dst")
    kept = greedy(pairs, w.select(F.col("walk").alias("id")), table)
    return w.join(kept.withColumnRenamed("id", "walk"), "walk", "left_semi")


#: Rounds of candidates, each as many as walks are asked for, after which a graph has what it has.
ATTEMPTS = 20
BATCH = "graph bigint, walk bigint, kind string, path array<bigint>, steps array<struct<src:bigint,dst:bigint>>"


def candidates(edges: DataFrame, walks: DataFrame, most: int, kinds: tuple[str, ...], table, seed: int) -> DataFrame:
    """(graph, walk, kind, path, steps) for walks(graph, walk, want), each of a drawn kind, ``chain`` or ``dag``.
    Steps of a chain are its consecutive nodes that an edge joins, those of a dag the edges taken."""
    drawn = F.element_at(F.array(*map(F.lit, kinds)), (F.floor(_draw(seed, F.col("graph"), F.col("walk"), F.lit("kind")) * len(kinds)) + 1).cast("int"))
    w = table(walks.withColumn("kind", drawn))
    parts = []
    if "chain" in kinds:
        c = table(chains(edges, w.where("kind = 'chain'"), most, table, seed))
        pairs = c.select("graph", "walk", F.posexplode(F.arrays_zip(F.col("path").alias("src"), F.slice("path", 2, F.size("path")).alias("dst"))).alias("at", "s")).select("graph", "walk", "at", "s.src", "s.dst")
        linked = pairs.join(edges.where("weight > 0").select("graph", "src", "dst").distinct(), ["graph", "src", "dst"], "left_semi")
        steps = linked.groupBy("graph", "walk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "src", "dst"))), lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("steps"))
        parts.append(c.join(steps, ["graph", "walk"], "left").select("graph", "walk", F.lit("chain").alias("kind"), "path", F.coalesce("steps", F.array().cast(STEP)).alias("steps")))
    if "dag" in kinds:
        parts.append(dags(edges, w.where("kind = 'dag'"), most, table, seed).select("graph", "walk", F.lit("dag").alias("kind"), in_order("nodes").alias("path"), "steps"))
    return reduce(DataFrame.unionAll, parts)


def walk_batches(edges: DataFrame, n_walks: int, least: int, most: int, table, greedy, kinds: tuple[str, ...] = ("chain", "dag"), alike: float = 0.8, seed: int = 42, attempts: int = ATTEMPTS) -> DataFrame:
    """(graph, walk, kind, path, steps): up to ``n_walks`` walks of each graph of edges(graph, src, dst, weight), all graphs at once.

    Candidates are numbered and drawn in rounds of ``n_walks`` a graph, for graphs that lack walks, up to ``attempts`` rounds.
    They are accepted in order of their numbers if they have ``least`` to ``most`` nodes and are unlike every walk accepted
    before: another path, and a Jaccard similarity of node sets of at most ``alike``. A graph of fewer than ``least`` nodes, or
    without any accepted walk, has no rows. A round compares at most 2 * ``n_walks`` walks of a graph with each other."""
    e = table(edges.where("weight > 0 and src <> dst").select("graph", "src", "dst", "weight"))
    nodes = e.select("graph", F.col("src").alias("id")).unionAll(e.select("graph", "dst")).distinct()
    graphs = table(nodes.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("graph"))
    kept = table(e.sparkSession.createDataFrame([], BATCH))
    key = F.struct("graph", "walk")
    for round_ in range(attempts):
        if graphs.isEmpty():
            break
        some = e.join(graphs, "graph", "left_semi")
        new = candidates(some, asked(graphs, round_ * n_walks, n_walks, least, most, seed), most, kinds, table, seed).where(F.size("path").between(least, most))
        new = table(new)
        old = kept.join(graphs, "graph", "left_semi").select("graph", F.col("path").alias("other"))
        fresh = table(new.join(new.select("graph", "walk", "path").join(old, "graph").where(_alike(F.col("path"), F.col("other"), alike)).select("graph", "walk").distinct(), ["graph", "walk"], "left_anti"))
        x = fresh.select("graph", key.alias("src"), F.col("path").alias("p"))
        y = fresh.select("graph", key.alias("dst"), F.col("path").alias("q"))
        pairs = x.join(y, "graph").where((F.col("src") < F.col("dst")) & _alike(F.col("p"), F.col("q"), alike)).select("src", "dst")
        good = greedy(pairs, fresh.select(key.alias("id")), table).select("id.graph", "id.walk")
        kept = kept.unionAll(fresh.join(good, ["graph", "walk"], "left_semi").select(kept.columns))
        ranked = kept.withColumn("at", F.row_number().over(Window.partitionBy("graph").orderBy("walk")))
        kept = table(ranked.where(F.col("at") <= n_walks).drop("at"))
        full = kept.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") >= n_walks)
        graphs = table(graphs.join(full, "graph", "left_anti").select("graph"))
    return kept


def walk_stats(walks: DataFrame) -> DataFrame:
    """One row: walks, mean, least and greatest length."""
    n = F.size("path")
    return walks.agg(F.count("*").alias("n_walks"), F.avg(n).alias("mean_length"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"))


def rendered(walks: DataFrame) -> DataFrame:
    """(walk, text): a chain as one line with arrows."""
    return walks.select("walk", F.concat(F.lit("Chain walk: "), F.array_join(F.transform("path", lambda x: x.cast("string")), " → ")).alias("text"))


def tasks(walks: DataFrame) -> DataFrame:
    """(task_id, walk, n_functions, description): a task for each walk, described by its nodes in order."""
    said = F.concat(F.lit("Call "), F.array_join(F.transform("path", lambda x: x.cast("string")), ", then "), F.lit("."))
    return walks.select(F.concat(F.lit("task_"), F.col("walk").cast("string")).alias("task_id"), "walk", F.size("path").cast("long").alias("n_functions"), said.alias("description"))
