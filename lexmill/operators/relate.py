"""Similarity of entities through shared words, and the graphs drawn from it.

Words held by more than ``most`` of all entities carry no weight by the measure's definition. The entities
that hold a common word are dealt in blocks, and a task of the self-join pairs one block with all holders,
so a hot word spreads over as many tasks as it has blocks; pairs are summed in the task of their first entity.
Edges are kept in both directions; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.staging import bounded, settled


def idf(pairs: DataFrame, entity: str, member: str, most: float = 0.5) -> DataFrame:
    """(member, df, idf) of members held by at most ``most`` of the entities; empty below two entities."""
    n = pairs.agg(F.countDistinct(entity).alias("n"))
    df = pairs.groupBy(member).agg(F.countDistinct(entity).alias("df"))
    held = df.join(F.broadcast(n)).where((F.col("n") >= 2) & (F.col("df") <= most * F.col("n")))
    return held.select(member, "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


def similar(pairs: DataFrame, entity: str, member: str, most: float = 0.5, least_shared: int = 3, top: int = 20, block: int = 1024, each: int = 1 << 21) -> DataFrame:
    """(a, b, score, shared): the ``top`` neighbours of each entity by idf-weighted cosine.

    Entities go by numbers. The holders of a member are lists of at most about ``block``; what is shuffled is each
    entity with the lists of later holders, a row for each of its members. Their pairs, each once, come and are summed
    inside the task that has the entity, ``each`` of them to a task, and only those with enough shared members leave it.
    """
    pairs = settled(pairs.where(F.col(entity).isNotNull()).select(F.col(entity).alias("name"), F.col(member).alias("m")).distinct())
    names = settled(pairs.select("name").distinct().withColumn("e", F.monotonically_increasing_id()))
    weights = settled(idf(pairs.withColumnRenamed("name", "e"), "e", "m", most))
    held = pairs.join(bounded(names), "name").join(weights, "m").select("e", "m", "df", F.col("idf").cast("decimal(18,6)").alias("w"))
    held = settled(held.withColumn("w2", (F.col("w") * F.col("w")).cast("decimal(20,12)")).drop("w"))
    norms = held.groupBy("e").agg(F.sqrt(F.sum("w2").cast("double")).alias("norm")).join(names, "e")
    units = (F.col("w2") * F.lit(10**12).cast("decimal(13,0)")).cast("long")  # whole numbers in two halves, whose sums are exact and quick
    held = held.select("e", "m", F.ceil(F.col("df") / block).cast("int").alias("blocks"), units.alias("u"))
    held = held.withColumn("part", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    lists = settled(held.groupBy("m", "part").agg(F.first("blocks").alias("blocks"), F.first("u").alias("u"), F.sort_array(F.collect_list("e")).alias("es")))
    count = weights.agg(F.sum(F.col("df") * F.col("df") / 2.0)).first()[0] or 0.0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(count // each) + 1)
    other = lists.select("m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("es").alias("ys"))
    rows = lists.select("m", "part", "u", "es").join(other, ["m", "part"]).select(F.explode("es").alias("a"), "ys", "u")
    rows = rows.select("a", F.filter("ys", lambda y: y > F.col("a")).alias("ys"), "u").where("size(ys) > 0").repartition(tasks, "a")
    both = rows.select("a", F.explode("ys").alias("b"), F.expr("u div 1000000").alias("high"), F.expr("u % 1000000").alias("low"))
    shared = both.groupBy("a", "b").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    s = ((F.col("high").cast("decimal(19,0)") * F.lit(1000000).cast("decimal(7,0)") + F.col("low")).cast("decimal(26,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("double")
    scored = settled(shared).select("a", "b", s.alias("s"), "shared")
    for end in "ab":
        scored = scored.join(bounded(settled(norms.select(F.col("e").alias(end), F.col("norm").alias(f"n{end}"), F.col("name").alias(f"name_{end}")))), end)
    scored = scored.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.round(F.least(F.col("s") / (F.col("na") * F.col("nb")), F.lit(1.0)), 6).alias("score"), "shared")
    scored = scored.select(F.explode(F.array(F.struct("a", "b", "score", "shared"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score", "shared"))).alias("r")).select("r.*")
    return best(scored, "a", top)


def best(edges: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` edges of each ``key``, by score, ties to the smaller b."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "b"))
    return edges.withColumn("__n", nth).where(F.col("__n") <= top).drop("__n")


def shared_words(pairs: DataFrame, entity: str, member: str, a, b, most: float = 0.5) -> DataFrame:
    """(member, idf) of members that both entities hold, rarest first by idf."""
    of = lambda e: pairs.where(F.col(entity) == e).select(member)
    return idf(pairs, entity, member, most).join(of(a), member, "left_semi").join(of(b), member, "left_semi").select(member, "idf")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller node first, with its greatest score."""
    return edges.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.max("score").alias("score"))


def ego_graph(edges: DataFrame, center, top: int = 10, second: int = 3, most_nodes: int = 40) -> DataFrame:
    """(node, ring): the center's ``top`` neighbours and, up to ``most_nodes``, the best of theirs."""
    first = best(edges.where(F.col("a") == center), "a", top).select(F.col("b").alias("node"), "score")
    seeds = first.select(F.col("node").alias("a"))
    outer = best(edges.join(seeds, "a", "left_semi").where(F.col("b") != center).join(first.select(F.col("node").alias("b")), "b", "left_anti"), "a", second)
    outer = outer.groupBy(F.col("b").alias("node")).agg(F.max("score").alias("score"))
    ring = first.select("node", F.lit(1).alias("ring"), "score").unionByName(outer.select("node", F.lit(2).alias("ring"), "score"))
    nth = F.row_number().over(Window.orderBy("ring", F.desc("score"), "node"))  # at most top * (second + 1) rows
    return ring.withColumn("nth", nth).where(F.col("nth") < most_nodes).select("node", "ring", "score")


def relatedness(edges: DataFrame, nodes: DataFrame, top: int = 3) -> DataFrame:
    """The undirected graph of each node's ``top`` neighbours among ``nodes`` (node)."""
    inside = edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    return undirected(best(inside, "a", top))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth): the transitive closure, the shortest depth of each pair; cycles end.

    A step is one join, until it finds no new pair; what was found is written at each step.
    """
    step = edges.select(F.col(child).alias("x"), F.col(parent).alias("up")).distinct()
    found = step.select(F.col("x").alias("node"), F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    front, depth = found, 1
    while True:
        depth += 1
        front = front.join(step, F.col("ancestor") == F.col("x")).select("node", F.col("up").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = front.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        front = settled(front)
        if not front.limit(1).count():
            return found
        found = settled(found.unionByName(front)) if depth % 8 == 0 else found.unionByName(front)


def cluster(pairs: DataFrame, entity: str, member: str, nodes: DataFrame, clusters: int = 12, most: float = 0.5) -> DataFrame:
    """(node, cluster, x, y): Ward clusters and a classical scaling of a bounded set of ``nodes``.

    Spark computes the similarity of the nodes with corpus-wide weights; the driver holds only the square
    of the node set, which the caller bounds (top-N by design).
    """
    names, d = distances(pairs, entity, member, nodes, most)
    schema = f"node {dict(nodes.dtypes)['node']}, cluster int, x double, y double"
    if len(names) < 3:
        return nodes.sparkSession.createDataFrame([], schema)
    label, place = ward(d, clusters), scaled(d)
    return nodes.sparkSession.createDataFrame([(name, int(label[i]), float(place[i, 0]), float(place[i, 1])) for i, name in enumerate(names)], schema)


def cluster_tree(pairs: DataFrame, entity: str, member: str, nodes: DataFrame, most: float = 0.5) -> DataFrame:
    """(tree): the Ward tree of a bounded set of ``nodes`` as one JSON row."""
    names, d = distances(pairs, entity, member, nodes, most)
    return nodes.sparkSession.createDataFrame([(dendrogram(d, names),)], "tree string")


def distances(pairs: DataFrame, entity: str, member: str, nodes: DataFrame, most: float):
    """Names in order and the matrix of their distances, sqrt(2 (1 - cosine))."""
    import numpy as np

    names = [r.node for r in nodes.select("node").distinct().orderBy("node").collect()]
    n = len(names)
    weights = idf(pairs, entity, member, most)
    held = pairs.select(entity, member).distinct().join(nodes.select(F.col("node").alias(entity)), entity, "left_semi").join(weights, member)
    x, y = (held.select(F.col(entity).alias(k), member, F.col("idf").alias(f"w{k}")) for k in ("a", "b"))
    grid = x.join(y, member).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s")).collect()
    at = {name: i for i, name in enumerate(names)}
    s = np.zeros((n, n))
    for r in grid:
        s[at[r.a], at[r.b]] = r.s
    norm = np.sqrt(np.maximum(np.diag(s), 1e-12))
    d = np.sqrt(np.maximum(2 * (1 - np.clip(s / norm[:, None] / norm, -1, 1)), 0))
    np.fill_diagonal(d, 0)
    return names, d


def scaled(d):
    """Two coordinates of each row of a distance matrix (classical scaling); the largest of each axis is positive."""
    import numpy as np

    n = len(d)
    center = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * center @ (d**2) @ center)
    place = vector[:, ::-1][:, :2] * np.sqrt(np.maximum(value[::-1][:2], 0))
    for k in range(2):
        if place[np.abs(place[:, k]).argmax(), k] < 0:
            place[:, k] *= -1
    return place


def linkage(d) -> list[tuple[int, int, float, int]]:
    """Ward merges of a distance matrix: (i, j, height, size); i and j are first members of what merges, i < j."""
    import numpy as np

    n = len(d)
    gap, size = d.astype(float) ** 2, np.ones(n)
    np.fill_diagonal(gap, np.inf)
    out = []
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(gap.argmin(), gap.shape))
        height = float(np.sqrt(gap[i, j]))
        total = size[i] + size[j] + size
        merged = ((size[i] + size) * gap[i] + (size[j] + size) * gap[j] - size * gap[i, j]) / total
        merged[~np.isfinite(gap[i]) | ~np.isfinite(gap[j])] = np.inf
        gap[i], gap[:, i], gap[j], gap[:, j] = merged, merged, np.inf, np.inf
        gap[i, i] = np.inf
        size[i] += size[j]
        out.append((int(i), int(j), height, int(size[i])))
    return out


def ward(d, clusters: int):
    """Labels from 1 of at most ``clusters`` Ward clusters of a distance matrix, numbered by first member."""
    import numpy as np

    group = np.arange(len(d))
    for i, j, _, _ in linkage(d)[: max(0, len(d) - clusters)]:
        group[group == j] = i
    first = {g: k + 1 for k, g in enumerate(dict.fromkeys(group.tolist()))}
    return np.array([first[g] for g in group.tolist()])


def leaf_order(d) -> list[int]:
    """Rows of a distance matrix in the order of the Ward tree's leaves that makes neighbours as near as its flips allow.

    From the leaves up, each inner node keeps the least sum of neighbours' distances for every pair of a first and a last
    leaf; of equal ones the first in order counts. Cubic in the rows, which the caller bounds.
    """
    import numpy as np

    if not len(d):
        return []
    trees = {i: ([i], np.zeros((1, 1)), None) for i in range(len(d))}  # members, cost by first and last, (left, right, joined)
    for i, j, _, _ in linkage(d):
        left, right = trees[i], trees.pop(j)
        gap = d[np.ix_(left[0], right[0])]
        joined = np.stack([(row[:, None] + gap).min(axis=0) for row in left[1]])  # first leaf by the right side's first
        through = np.stack([(row[:, None] + right[1]).min(axis=0) for row in joined])
        n = len(left[0])
        cost = np.full((n + len(right[0]),) * 2, np.inf)
        cost[:n, n:], cost[n:, :n] = through, through.T
        trees[i] = (left[0] + right[0], cost, (left, right, joined))

    def ordered(tree, first: int, last: int) -> list[int]:
        members, _, parts = tree
        if parts is None:
            return [members[0]]
        left, right, joined = parts
        n = len(left[0])
        if first >= n:  # from the right to the left
            return ordered(tree, last, first)[::-1]
        begin = int((joined[first] + right[1][:, last - n]).argmin())
        end = int((left[1][first] + d[left[0], right[0][begin]]).argmin())
        return ordered(left, first, end) + ordered(right, begin, last - n)

    cost = trees[0][1]
    return ordered(trees[0], *map(int, np.unravel_index(cost.argmin(), cost.shape)))


def dendrogram(d, names: list) -> str:
    """The Ward tree as nested JSON, its leaves in ``leaf_order``: leaves have a name, inner nodes a height, a size and two children."""
    import json

    place = {row: n for n, row in enumerate(leaf_order(d))}
    node: dict[int, dict] = {i: {"name": x} for i, x in enumerate(names)}
    for i, j, height, size in linkage(d):
        one, two = sorted((i, j), key=place.get)
        node[i], place[i] = {"height": round(height, 6), "size": size, "children": [node[one], node[two]]}, place[one]
    return json.dumps(node[0]) if node else "{}"
