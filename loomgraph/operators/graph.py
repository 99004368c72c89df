"""Graph operators over edges keyed by sample: distances, shortest paths, propagation, features.

Distances grow by frontiers: a round joins only the nodes of the last round
with their edges and keeps those that are new. What reached a node is a set of
sources, packed 64 to a number, so that a node is one row for all of them. Each
round is a part of one table in the shared folder; a round reads its frontier (the
last part), the links, which lie in buckets by their start, and the table of what was
seen, which is compacted every few rounds: two joins and two aggregates, however
deep the search is. A lost executor costs one round. Searches along edges and
against them run together, as two ways of one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.scores import log_share
from loomgraph.operators.joins import beside
from loomgraph.sources import storage
from loomgraph.sources.storage import bucketed, checkpointed, in_place, laid, stored

KEY = "sample_id"


def directed(edges: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    """(sample_id, src, dst): the edges as a set, parallel ones collapsed."""
    return edges.select(KEY, F.col(head).alias("src"), F.col(tail).alias("dst")).distinct()


def reversed_edges(links: DataFrame) -> DataFrame:
    return links.select(KEY, F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    links = edges.select(KEY, F.explode(F.array(F.struct(F.col("head").alias("src"), F.col("tail").alias("dst")), F.struct(F.col("tail").alias("src"), F.col("head").alias("dst")))).alias("e"))
    return links.select(KEY, "e.src", "e.dst").distinct()


def candidate_graph(edges: DataFrame, idx: str = "triple_id") -> DataFrame:
    """One row a (head, tail) pair with all its triple ids."""
    return edges.groupBy(KEY, "head", "tail").agg(F.sort_array(F.collect_list(idx)).alias("ids"))


def both_ways(links: DataFrame) -> DataFrame:
    """Links as they are (way 0) and turned round (way 1)."""
    turned = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(way).alias("way")) for way, (a, b) in enumerate((("src", "dst"), ("dst", "src")))]
    return links.select(KEY, F.explode(F.array(*turned)).alias("e")).select(KEY, "e.*")


#: Rounds after which the table of what was seen is written anew, and sources a number holds.
COMPACT, BITS = 12, 64


def reached(frontier: DataFrame, links: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The next frontier: (keys, word, node, bits) of the sources that get to a node for the first time."""
    ahead = frontier.withColumnRenamed("node", "src").join(links, [*_keys(links), "src"]).groupBy(*keys, "word", F.col("dst").alias("node")).agg(F.bit_or("bits").alias("bits"))
    had = seen.groupBy(*keys, "word", "node").agg(F.bit_or("bits").alias("had"))
    new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
    return ahead.join(had, [*keys, "word", "node"], "left").select(*keys, "word", "node", new.alias("bits")).where(F.col("bits") != 0)


def placed(links: DataFrame, parts: int | None = None) -> DataFrame:
    """links as a table in buckets by their keys and start, as distances() reads them."""
    return bucketed(links, *_keys(links), "src", parts=parts)


def _keys(links: DataFrame) -> list[str]:
    return [KEY, *[c for c in ("way", "source") if c in links.columns]]


def distances(links: DataFrame, sources: DataFrame, depth: int | None = None, by_source: bool = False, parts: int | None = None, ready: bool = False) -> DataFrame:
    """(sample_id[, way][, source], node, distance) along links (sample_id[, way], src, dst) from sources (sample_id[, way], node).

    Sources have distance 0 even where no edge touches them. Rounds run until
    no node is new, or depth times. Where links have ways, so have the results;
    sources without ways start in each; ways of sources alone are searches of their own over the same links. Links that name a source are for searches
    from it only, and results name it too. parts: buckets of links; ready: links come from placed().
    """
    spark = links.sparkSession
    keys = _keys(links) + (["way"] if "way" in sources.columns and "way" not in links.columns else [])
    start = sources.where(F.col("node").isNotNull())
    if "way" in keys and "way" not in start.columns:
        start = start.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    start = start.select(*keys, "node").distinct()
    if by_source:
        place = F.row_number().over(W.partitionBy(*keys).orderBy("node")) - 1
        start = checkpointed(start.withColumn("_n", place).select(*keys, "node", F.floor(F.col("_n") / BITS).cast("int").alias("word"), (F.col("_n") % BITS).alias("bit")))
        first = start.select(*keys, "word", "node", F.expr("shiftleft(1L, bit)").alias("bits"))
    else:
        first = start.select(*keys, F.lit(0).alias("word"), "node", F.lit(1).cast("long").alias("bits"))
    links = links if ready else placed(links.select(*keys, "src", "dst"), parts)
    folder = storage.new_folder(spark, "distances")
    parts = [storage.write_part(first.withColumn("distance", F.lit(0)), f"{folder}/rounds", 0)]
    schema = spark.read.parquet(parts[0]).schema
    read = lambda *paths: spark.read.schema(schema).parquet(*paths)
    base, since = [], [parts[0]]
    while not (frontier := read(parts[-1])).isEmpty() and len(parts) - 1 != depth:
        k = len(parts)
        new = reached(frontier.drop("distance"), links, read(*base, *since), keys)
        parts.append(storage.write_part(new.withColumn("distance", F.lit(k)), f"{folder}/rounds", k))
        since.append(parts[-1])
        if len(since) > COMPACT:
            whole = read(*base, *since).groupBy(*keys, "word", "node").agg(F.bit_or("bits").alias("bits")).withColumn("distance", F.lit(0))
            after = storage.write_part(whole, f"{folder}/seen", k)
            for path in base:
                storage.drop_folder(spark, path)
            base, since = [after], []
    out = read(*parts)
    if not by_source:
        return out.select(*keys, "node", "distance")
    on = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)
    named = start.withColumnRenamed("node", "source")
    return out.withColumn("bit", F.explode(on)).join(named, [*keys, "word", "bit"]).select(*keys, "source", "node", "distance")


def distances_in_place(links: DataFrame, sources: DataFrame, parts: int, depth: int | None = None) -> DataFrame:
    """distances() over links and sources that lie by sample in so many parts: rounds join them where they lie, nothing is shuffled, and the result lies so too.

    Links are written once, each round once. For jobs run in_place().
    """
    spark, keys = links.sparkSession, _keys(links)
    start = sources.where(F.col("node").isNotNull())
    if "way" in keys:
        start = start.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    with in_place(spark):
        links, _ = laid(links.select(*keys, "src", "dst"), KEY, parts)
        found, name = laid(start.select(*keys, "node").distinct().withColumn("distance", F.lit(0)), KEY, parts)
        k = 0
        while not (frontier := found.where(F.col("distance") == k)).isEmpty() and k != depth:
            ahead = frontier.select(*keys, F.col("node").alias("src")).join(links, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
            k += 1
            found, _ = laid(ahead.join(found, [*keys, "node"], "left_anti").withColumn("distance", F.lit(k)), KEY, parts, onto=name)
    return found


def with_hop(triples: DataFrame, found: DataFrame) -> DataFrame:
    """hop: the smaller endpoint distance + 1, null if neither end is reached. Other columns stay as they are."""
    h = found.select(KEY, F.col("node").alias("head"), F.col("distance").alias("_h"))
    t = found.select(KEY, F.col("node").alias("tail"), F.col("distance").alias("_t"))
    out = beside(beside(triples.drop("hop"), h, "head"), t, "tail")
    return out.withColumn("hop", (F.least("_h", "_t") + 1).cast("int")).drop("_h", "_t")


def path_edges(edges: DataFrame, pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """(sample_id, source, target, length, head, tail): edges on a shortest directed path of each pair, of any length or up to depth."""
    links = directed(edges)
    forward = distances(links, pairs.select(KEY, F.col("source").alias("node")), depth, by_source=True)
    backward = distances(reversed_edges(links), pairs.select(KEY, F.col("target").alias("node")), depth, by_source=True).withColumnRenamed("source", "target")
    lengths = pairs.join(forward.where("distance > 0").select(KEY, "source", F.col("node").alias("target"), F.col("distance").alias("length")), [KEY, "source", "target"])
    out = lengths.join(forward.select(KEY, "source", F.col("node").alias("src"), F.col("distance").alias("a")), [KEY, "source"]).where(F.col("a") < F.col("length"))
    out = out.join(links, [KEY, "src"])
    out = out.join(backward.select(KEY, "target", F.col("node").alias("dst"), F.col("distance").alias("b")), [KEY, "target", "dst"]).where(F.col("a") + 1 + F.col("b") == F.col("length"))
    return out.select(KEY, "source", "target", "length", F.col("src").alias("head"), F.col("dst").alias("tail"))


def _pairs(edges: DataFrame, topics: DataFrame, answers: DataFrame, depth: int | None, parts: int | None = None, parallel: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of topics and answers of the graph with the length of each shorter way, and the triples on these ways.

    Pairs: (sample_id, way, topic, answer, distance), way 0 from topic to answer
    and 1 back; of a pair that has both ways the shorter stays, of equal ones
    both. A topic that is an answer has distance 0 to itself. Both ways are searched
    back from where they end (answers, and topics), so that one table of links, by their
    ends and with their triples, is enough and what leads to no end is never read. Edges that lead one step on
    form a graph without cycles, and those that a start reaches in it are on a shortest path.
    parallel: None for no triples, "all" of them between two nodes, or the "last".
    """
    links = edges.select(KEY, F.col("tail").alias("src"), F.col("head").alias("dst"), *(["triple_id"] if parallel else []))
    if parallel != "all":
        grouped = links.groupBy(KEY, "src", "dst")
        links = grouped.agg(F.max("triple_id").alias("triple_id")) if parallel else links.distinct()
    links = placed(links, parts)
    goal, asked = answers.select(KEY, "node").distinct(), topics.select(KEY, "node").distinct()
    either = goal.withColumn("way", F.lit(0)).unionByName(asked.withColumn("way", F.lit(1)))
    far = stored(distances(links, either, depth, by_source=True, ready=True))
    state = [KEY, "way", "source"]
    # where a way starts: topics of way 0, answers of way 1
    starts = either.withColumn("way", 1 - F.col("way"))
    ends = stored(far.join(starts, [KEY, "way", "node"], "left_semi").withColumns({"topic": F.when(F.col("way") == 0, F.col("node")).otherwise(F.col("source")), "answer": F.when(F.col("way") == 0, F.col("source")).otherwise(F.col("node"))}))
    # a topic that no edge touches is no node of the graph
    alone = ends.where("distance = 0").select(KEY, "node").distinct()
    touched = links.select(KEY, F.col("src").alias("node")).join(alone, [KEY, "node"], "left_semi").unionByName(links.select(KEY, F.col("dst").alias("node")).join(alone, [KEY, "node"], "left_semi")).distinct() if not alone.isEmpty() else alone
    ends = ends.where("distance > 0").unionByName(ends.where("distance = 0").join(touched, [KEY, "node"], "left_semi").select(ends.columns))
    best = F.min("distance").over(W.partitionBy(KEY, "topic", "answer"))
    ends = ends.withColumn("best", best).where("distance = best").drop("best")
    if not parallel:
        return ends.select(KEY, "way", "topic", "answer", "distance"), None
    step = far.withColumnRenamed("node", "src").join(links, [KEY, "src"])
    step = step.join(far.select(*state, F.col("node").alias("dst"), (F.col("distance") - 1).alias("distance")), [*state, "dst", "distance"])
    # from the starts along these steps; each search has its own
    step = placed(step.select(*state, F.col("dst").alias("src"), F.col("src").alias("dst"), "triple_id"), parts)
    on = distances(step, ends.select(*state, "node"), parts=parts, ready=True)
    used = step.join(on.select(*state, F.col("node").alias("src")), [*state, "src"], "left_semi")
    return ends, used.select(KEY, "triple_id").distinct()


def shortest_path_triples(edges: DataFrame, topics: DataFrame, answers: DataFrame, depth: int | None = None, parallel: str = "all", parts: int | None = None) -> DataFrame:
    """(sample_id, triple_id): triples on the shorter way of each topic and answer, both ways where they are equally long.

    parallel "all" takes every triple between two nodes, "last" the greatest triple_id.
    """
    return _pairs(edges, topics, answers, depth, parts, parallel)[1]


def weak_labels(edges: DataFrame, topics: DataFrame, answers: DataFrame, depth: int | None = None, parts: int | None = None, zeros: bool = True) -> DataFrame:
    """(sample_id, triple_id, label) of every edge: 1 on a retained shortest path (the last parallel edge), else 0; the labels of 1 alone where zeros is false."""
    hits = shortest_path_triples(edges, topics, answers, depth, parallel="last", parts=parts).withColumn("hit", F.lit(1.0))
    if not zeros:
        return hits.select(KEY, "triple_id", F.col("hit").alias("label"))
    return edges.select(KEY, "triple_id").join(hits, [KEY, "triple_id"], "left").select(KEY, "triple_id", F.coalesce("hit", F.lit(0.0)).alias("label"))


def max_path_length(edges: DataFrame, topics: DataFrame, answers: DataFrame, depth: int | None = None, parts: int | None = None) -> DataFrame:
    """(sample_id, max_path_length) of samples with a path; 0 where the topic is its only answer."""
    ends, _ = _pairs(edges, topics, answers, depth, parts)
    return ends.groupBy(KEY).agg(F.max("distance").alias("max_path_length"))


def directional_distances(edges: DataFrame, topics: DataFrame, cap: int = 6, parts: int | None = None, lies: bool = False) -> DataFrame:
    """Edges with topic-to-head, topic-to-tail, head-to-topic and tail-to-topic distances, capped. lies: edges and topics lie by sample in so many parts, and the result is for jobs run in_place()."""
    links, starts = both_ways(directed(edges)), topics.select(KEY, "node")
    found = distances_in_place(links, starts, parts, cap) if lies else distances(links, starts, cap, parts=parts)
    found = found.repartition(parts, KEY) if parts and not lies else found
    ways = [F.least(F.coalesce(F.min(F.when(F.col("way") == k, F.col("distance"))), F.lit(cap)), F.lit(cap)) for k in (0, 1)]
    table = found.groupBy(KEY, "node").agg(ways[0].alias("_from"), ways[1].alias("_to"))
    out = edges
    for end in ("tail", "head"):  # structural_features leaves its rows by their tails
        out = beside(out, table.withColumnRenamed("node", end), end)
        out = out.withColumn(f"topic_to_{end}", F.coalesce("_from", F.lit(cap))).withColumn(f"{end}_to_topic", F.coalesce("_to", F.lit(cap))).drop("_from", "_to")
    return out


def propagate(edges: DataFrame, topics: DataFrame, rounds: int = 2, backward_rounds: int = 2) -> DataFrame:
    """(sample_id, node, n0, t0, f1_n, f1_t, ..., b1_n, b1_t, ...): means over in-neighbours, forward then along reversed edges.

    Starts from [non-topic, topic] one-hot pairs; parallel edges count as often
    as they come; a node without in-edges gets 0.
    """
    marked = topics.select(KEY, "node").distinct().withColumn("_q", F.lit(1.0))
    nodes = edges.select(KEY, F.explode(F.array("head", "tail")).alias("node")).distinct()
    out = beside(nodes, marked, "node").select(KEY, "node", (1.0 - F.coalesce("_q", F.lit(0.0))).alias("n0"), F.coalesce("_q", F.lit(0.0)).alias("t0"))
    for way, n, (src, dst) in (("f", rounds, ("head", "tail")), ("b", backward_rounds, ("tail", "head"))):
        links = edges.select(KEY, F.col(src).alias("src"), F.col(dst).alias("dst"))
        x = out.select(KEY, "node", F.col("n0").alias("x"), F.col("t0").alias("y"))
        for k in range(1, n + 1):
            mean = beside(links, x.withColumnRenamed("node", "src"), "src").groupBy(KEY, F.col("dst").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
            x = beside(nodes, mean, "node").select(KEY, "node", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
            out = beside(out, x.select(KEY, "node", F.col("x").alias(f"{way}{k}_n"), F.col("y").alias(f"{way}{k}_t")), "node")
    return out


def structural_features(edges: DataFrame) -> DataFrame:
    """Eight features of each edge: logarithmic shares of degrees, mentions and relation counts, and whether its pair repeats."""
    end = lambda c, out: F.struct(F.col(c).alias("k"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    nodes = edges.select(KEY, F.explode(F.array(end("head", 1), end("tail", 0))).alias("e")).groupBy(KEY, "e.k").agg(F.sum("e.out").alias("out"), F.sum("e.into").alias("in"))
    nodes = nodes.withColumn("mentions", F.col("out") + F.col("in"))
    relations = edges.groupBy(KEY, "relation").agg(F.count(F.lit(1)).alias("n"))
    # the share is taken on the small tables; edges are joined once an end and once a relation
    share = lambda c: log_share(F.col(c), F.max(c).over(W.partitionBy(KEY)))
    nodes = nodes.select(KEY, "k", *[share(c).alias(c) for c in ("out", "in", "mentions")])
    pairs = F.count(F.lit(1)).over(W.partitionBy(KEY, "head", "tail"))
    out = edges.withColumn("pair_repeats", F.when(pairs > 1, 1.0).otherwise(0.0))
    out = beside(out, relations.select(KEY, "relation", share("n").alias("relation_count")), "relation")
    for side in ("head", "tail"):
        own = nodes.select(KEY, F.col("k").alias(side), *[F.col(c).alias(f"{side[0]}_{c}") for c in ("out", "in", "mentions")])
        out = beside(out, own, side)
    features = [f"{side}_{c}" for c in ("out", "in", "mentions") for side in ("h", "t")]
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (*features, "relation_count")})


def _star(links: DataFrame, large: bool) -> DataFrame:
    """A round over links (sample_id, u, v), u > v: neighbours of a node (the larger ones, or the smaller ones and itself) are tied to the least of them."""
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    around = links.select(KEY, F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select(KEY, "e.u", "e.v") if large else links
    least = around.groupBy(KEY, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = around.join(least, [KEY, "u"])
    if large:
        return tied.where("v > u").select(KEY, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return tied.select(KEY, F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select(KEY, "e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(sample_id, node, component): the least node that links in either direction reach, of every node of edges (head, tail).

    Large and small stars of all samples together, until nothing moves; a
    sample is in no single group, whatever its size. Rows with a null end are left out.
    """
    ends = edges.where(F.col("head").isNotNull() & F.col("tail").isNotNull())
    nodes = ends.select(KEY, F.explode(F.array("head", "tail")).alias("node")).distinct()
    current = checkpointed(ends.where("head <> tail").select(KEY, F.greatest("head", "tail").alias("u"), F.least("head", "tail").alias("v")).distinct())
    known = None
    while (mark := current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(KEY, "u", "v").cast("decimal(20,0)")).alias("h")).first()) != known:
        known = mark
        current = checkpointed(_star(_star(current, True), False))
    return nodes.join(current.select(KEY, F.col("u").alias("node"), F.col("v").alias("_v")), [KEY, "node"], "left").select(KEY, "node", F.coalesce("_v", "node").alias("component"))


def component_ratio(edges: DataFrame) -> DataFrame:
    """(sample_id, ratio): nodes of the largest undirected component over all nodes; 0 for a sample without whole edges."""
    sizes = components(edges).groupBy(KEY, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(KEY).agg((F.max("n") / F.sum("n")).alias("ratio"))
    return edges.select(KEY).distinct().join(sizes, KEY, "left").select(KEY, F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def connectivity(pairs: list[tuple[str, str]]) -> float:
    """Share of the nodes that the largest component holds; 0 without nodes."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for h, t in pairs:
        root[find(h)] = find(t)
    if not root:
        return 0.0
    sizes: dict[str, int] = {}
    for x in list(root):
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    return max(sizes.values()) / len(root)


def encoded_triples(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(sample_id, triple_id, h_id, r_id, t_id): ends by the sample's entities (node, entity_id), relations by their place in sorted order."""
    relations = edges.select(KEY, "relation").distinct().withColumn("r_id", (F.row_number().over(W.partitionBy(KEY).orderBy("relation")) - 1).cast("int"))
    out = edges.join(relations, [KEY, "relation"])
    for end, name in (("head", "h_id"), ("tail", "t_id")):
        out = out.join(entities.select(KEY, F.col("node").alias(end), F.col("entity_id").alias(name)), [KEY, end])
    return out.select(KEY, "triple_id", "h_id", "r_id", "t_id")


def reachable_answers(gold: DataFrame, topics: DataFrame, answers: DataFrame, retained: DataFrame, depth: int | None = None) -> DataFrame:
    """(sample_id, answer): answers in the undirected closure of the topic over gold triples.

    Where no gold triple touches the topic, the answers that retained paths name.
    """
    closure = distances(undirected(gold), topics, depth)
    touched = undirected(gold).join(topics.select(KEY, F.col("node").alias("src")), [KEY, "src"], "left_semi").select(KEY).distinct()
    inside = answers.join(touched, KEY, "left_semi").join(closure.select(KEY, F.col("node").alias("answer")), [KEY, "answer"], "left_semi")
    outside = answers.join(touched, KEY, "left_anti").join(retained, [KEY, "answer"], "left_semi")
    return inside.select(KEY, "answer").unionByName(outside.select(KEY, "answer"))
