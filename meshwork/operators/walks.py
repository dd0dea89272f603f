"""Random walks as rounds of joins; the only randomness is MD5 of seed, walk, step and candidate.

A walk table is (walk_id, tokens), walk_id unique. Before the first round the edges of each node are
packed into lists of bounded length, several for a hub. A round deals a tip to each list of its node;
what comes out is the best candidate of each list, not every candidate, and the tip moves on. A round
writes a row a walk that moved; the tokens are put together at the end. Walks at a dead end stay.
Uniform walks at a hub are hashed by a kernel, a list with a crowd of tips at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.digests import least_md5
from meshwork.functions.scalars import hashed, uniform
from meshwork.plans.scratch import cut

#: Neighbours in a list, about; tips of one node that a task takes; neighbours of a previous node that go along with the walk; edge types whose transitions do.
ROOM, CROWD, FEW, TYPES = 512, 4096, 64, 1000
#: Neighbours in a list of the kernel, about; partitions of its tasks for each of the shuffle's at most.
WIDE, FINE = 8192, 32


def _draw(seed: str, step: int, dst: Column, weight: Column | None = None) -> Column:
    """What a candidate is chosen by, the least first: plain hash, or an exponential race's time for its weight."""
    key = (F.lit(seed), F.col("walk_id"), F.lit(step), dst)
    return hashed(*key) if weight is None else -F.log(F.greatest(uniform(*key), F.lit(1e-12))) / weight


def start_walks(starts: DataFrame, per_node: int = 1) -> DataFrame:
    """Walks (walk_id = ``id#k``, tokens) from each id."""
    k = starts.select("id", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("k"))
    return k.select(F.concat_ws("#", "id", "k").alias("walk_id"), F.array("id").alias("tokens"))


def degree_starts(degrees: DataFrame) -> DataFrame:
    """As many walks from each node (id, degree) as it has neighbours, one at least."""
    k = degrees.select("id", F.explode(F.sequence(F.lit(0), F.greatest(F.col("degree"), F.lit(1)).cast("int") - 1)).alias("k"))
    return k.select(F.concat_ws("#", "id", "k").alias("walk_id"), F.array("id").alias("tokens"))


def without_start(walks: DataFrame) -> DataFrame:
    return walks.select("walk_id", F.slice("tokens", 2, 1 << 30).alias("tokens"))


class _Lists:
    """Edges (by..., dst, ...) as lists ``near`` of about ROOM structs, dealt by a hash of dst; ``spread`` has each node's number of lists."""

    def __init__(self, edges: DataFrame, by: list[str], room: int | None = None):
        self.by = by
        n = edges.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(room or ROOM)).cast("int").alias("lists"))
        self.spread = cut(n, "spread")  # a table of its own: the joins with it can be split at a hub
        dealt = edges.join(self.spread, by).withColumn("list", F.pmod(F.xxhash64("dst"), F.col("lists")).cast("int"))
        rest = [c for c in edges.columns if c not in by]
        self.lists = cut(dealt.groupBy(*by, "list").agg(F.collect_list(F.struct(*rest)).alias("near")), "lists")

    def meet(self, tips: DataFrame) -> DataFrame:
        """Each tip once for each list of its node.

        A task's time goes with tips times neighbours, not with bytes: rows are dealt by node, list and slice
        of a crowd of tips into a fixed number of partitions, which adaptive execution does not merge.
        """
        n = int(tips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        crowds = tips.groupBy(*self.by).agg(F.ceil(F.count("*") / F.lit(CROWD)).cast("int").alias("slices")).where("slices > 1")
        at = tips.join(self.spread, self.by).join(crowds, self.by, "left").withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).drop("lists")
        at = at.withColumn("slice", F.pmod(F.xxhash64("walk_id"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
        lists = self.lists.join(crowds, self.by, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
        key = [*self.by, "list", "slice"]
        return at.repartition(n, *key).join(lists.repartition(n, *key).hint("merge"), key)

    def crowds(self, tips: DataFrame, *fields: str) -> DataFrame:
        """Each list with each slice of the tips at its node, as arrays ``near`` and ``tips`` of structs of ``fields``: a row is the work of one list and slice.

        Rows take seconds each and are dealt by hash: with several partitions for each row no task gets many.
        """
        slices = cut(tips.groupBy(*self.by).agg(F.ceil(F.count("*") / F.lit(CROWD)).cast("int").alias("slices")), "slices")
        rows = slices.join(self.spread, self.by).agg(F.sum(F.col("slices") * F.col("lists"))).first()[0] or 0
        n = min(max(1, 2 * rows), int(tips.sparkSession.conf.get("spark.sql.shuffle.partitions")) * FINE)
        dealt = tips.join(slices, self.by).withColumn("slice", F.pmod(F.xxhash64("walk_id"), F.col("slices")).cast("int"))
        tables = dealt.groupBy(*self.by, "slice").agg(F.collect_list(F.struct(*fields)).alias("tips"))
        work = tables.join(self.spread, self.by).withColumn("list", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).drop("lists")
        lists = self.lists.join(slices, self.by).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        key = [*self.by, "list", "slice"]
        return work.repartition(n, *key).join(lists.repartition(n, *key).hint("merge"), key)


def _least(work: DataFrame) -> DataFrame:
    """walk_id and best (r, dst) for the tips (walk_id, prefix) of each list ``near`` of structs with dst."""
    kind = {c: work.schema[a].dataType.elementType[c].dataType.simpleString() for a, c in (("tips", "walk_id"), ("near", "dst"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                walk_id, prefix, dst, tail = (b.column(c)[i].values for c in range(4))
                r, t = least_md5([x.as_py() for x in prefix], [x.as_py() for x in tail])
                yield pa.RecordBatch.from_arrays([walk_id, pa.array(r), dst.take(pa.array(t))], names=["walk_id", "r", "dst"])

    binary = lambda x: x.cast("string").cast("binary")
    rows = work.select("tips.walk_id", F.transform("tips.prefix", binary).alias("prefix"), "near.dst", F.transform("near.dst", binary).alias("tail"))
    return rows.mapInArrow(run, f"walk_id {kind['walk_id']}, r string, dst {kind['dst']}").select("walk_id", F.struct("r", "dst").alias("best"))


def _rounds(walks: DataFrame, length: int, choose: Callable[[DataFrame, int], DataFrame], state: dict[str, str]) -> DataFrame:
    """Walks with what ``choose`` (tips, step) gives each tip: rows (walk_id, best) with best.dst, the least best of a walk counts.

    Tips are (walk_id, src, prev) and the fields of ``best`` that ``state`` names with their types.
    """
    first = walks.select("walk_id", "tokens", F.size("tokens").alias("n")).where("n > 0")
    begin = first.select("walk_id", "n", F.element_at("tokens", -1).alias("src"), F.when(F.col("n") > 1, F.get("tokens", F.col("n") - 2)).alias("prev"), *(F.lit(None).cast(t).alias(c) for c, t in state.items()))
    steps, moved = [], None
    for step in range(1, length):
        tips = begin.where(F.col("n") == step).drop("n")
        tips = tips if moved is None else tips.unionByName(moved.select("walk_id", F.col("best.dst").alias("src"), F.col("src").alias("prev"), *(F.col(f"best.{c}").alias(c) for c in state)))
        best = choose(tips, step).groupBy("walk_id").agg(F.min("best").alias("best")).where("best IS NOT NULL")
        moved = cut(best.join(tips.select("walk_id", "src"), "walk_id"), "moved")
        steps.append(moved.select("walk_id", F.lit(step).alias("at"), F.col("best.dst").alias("token")))
    if not steps:
        return walks.select("walk_id", "tokens")
    every = steps[0]
    for x in steps[1:]:
        every = every.union(x)
    more = every.groupBy("walk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("more"))
    return walks.join(more, "walk_id", "left").select("walk_id", F.when(F.col("more").isNull(), F.col("tokens")).otherwise(F.concat("tokens", "more")).alias("tokens"))


def walk(edges: DataFrame, walks: DataFrame, length: int, seed: str = "walk", weighted: bool = False) -> DataFrame:
    """Walks of up to ``length`` nodes along edges to other nodes, uniform or by weight."""
    pairs = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    near = _Lists(pairs, ["src"])
    hubs = wide = None
    if not weighted:
        hubs = cut(near.spread.where("lists > 1").select("src"), "hubs")
        if hubs.limit(1).count():
            wide = _Lists(pairs.join(hubs, "src", "left_semi").select("src", "dst"), ["src"], WIDE)

    def choose(tips: DataFrame, step: int) -> DataFrame:
        if weighted:
            rank = lambda x: F.struct(_draw(seed, step, x["dst"], x["w"]).alias("r"), x["dst"].alias("dst"))
        else:
            # what the hashes of a tip's candidates have in common is put together once, before the lists
            tips = tips.withColumn("prefix", F.concat_ws("|", F.lit(seed), "walk_id", F.lit(step).cast("string"), F.lit("")))
            rank = lambda x: F.struct(F.md5(F.concat("prefix", x["dst"].cast("string"))).alias("r"), x["dst"].alias("dst"))
        least = lambda t: near.meet(t).select("walk_id", F.array_min(F.transform("near", rank)).alias("best"))
        if wide is None:
            return least(tips)
        return least(tips.join(hubs, "src", "left_anti")).union(_least(wide.crowds(tips.join(hubs, "src", "left_semi"), "walk_id", "prefix")))

    return _rounds(walks, length, choose, {})


def metapath_types(metapath: list[str], length: int) -> list[str]:
    """The types at each place of a walk: a symmetric path repeats all but its first type, another repeats whole."""
    if metapath[0] == metapath[-1] and len(metapath) > 1:
        out = metapath[:1]
        while len(out) < length:
            out = out + metapath[1:]
    else:
        out = list(metapath)
        while len(out) < length:
            out = out + metapath
    return out[:length]


def metapath_walk(edges: DataFrame, nodes: DataFrame, walks: DataFrame, metapath: list[str], length: int, seed: str = "metapath", keep: int | None = None) -> DataFrame:
    """Walks whose nodes have the metapath's types in turn, kept if they have ``keep`` nodes (as many as the metapath, if not given)."""
    types = metapath_types(metapath, length)
    kind = nodes.select("id", F.col("type").alias("kind"))
    near = _Lists(edges.where("src <> dst").select("src", "dst").distinct().join(kind.withColumnRenamed("id", "dst"), "dst"), ["src", "kind"])
    begin = walks.join(kind.where(F.col("kind") == types[0]).select("id"), F.element_at("tokens", 1) == F.col("id"), "left_semi")

    def choose(tips: DataFrame, step: int) -> DataFrame:
        rank = lambda x: F.struct(_draw(seed, step, x["dst"]).alias("r"), x["dst"].alias("dst"))
        return near.meet(tips.withColumn("kind", F.lit(types[step]))).select("walk_id", F.array_min(F.transform("near", rank)).alias("best"))

    return _rounds(begin, length, choose, {}).where(F.size("tokens") >= (len(metapath) if keep is None else keep))


def schema_walk(edges: DataFrame, nodes: DataFrame, walks: DataFrame, schema: str, length: int, seed: str = "schema") -> DataFrame:
    """Walks by a cyclic schema ``a-b-a``: the type at place k is the (k mod (len - 1))-th."""
    parts = schema.split("-")
    types = [parts[k % (len(parts) - 1)] for k in range(length)]
    return metapath_walk(edges, nodes, walks, types, length, seed, keep=1)


def second_order_walk(edges: DataFrame, walks: DataFrame, length: int, p: float = 1.0, q: float = 1.0, bias: str = "reference", transitions: DataFrame | None = None, seed: str = "n2v") -> DataFrame:
    """Walks biased by the node before the tip.

    ``reference``: a candidate linked with the previous node in either direction counts w / p, the
    previous node itself w, others w / q. ``published``: the previous node w / p, linked ones w,
    others w / q. With ``transitions`` (from_type, to_type, prob) weights also take the probability
    of the edge's type after the last edge's type.

    Where the previous node has few neighbours they go along with the walk, and candidates stay in
    their lists; where it is a hub, each candidate is a row of a join with the linked pairs.
    """
    e = cut(edges.where("src <> dst").groupBy("src", "dst", "type").agg(F.sum("weight").alias("w")), "edges")
    linked = cut(edges.select(F.col("src").alias("dst"), F.col("dst").alias("prev")).union(edges.select("dst", F.col("src").alias("prev"))).distinct(), "linked")
    near = _Lists(e, ["src"])
    small = linked.groupBy("prev").agg(F.count("*").alias("c")).where(F.col("c") <= FEW).select("prev")
    around = cut(linked.join(small, "prev").groupBy("prev").agg(F.collect_list("dst").alias("around")), "around")
    after = None
    if transitions is not None:
        transitions = cut(transitions.select("from_type", "to_type", "prob"), "transitions")
        if transitions.select("to_type").distinct().limit(TYPES + 1).count() <= TYPES:
            after = cut(transitions.groupBy(F.col("from_type").alias("last")).agg(F.map_from_entries(F.collect_list(F.struct("to_type", "prob"))).alias("after")), "after")

    def weight(w: Column, back: Column, close: Column, prob: Column | None) -> Column:
        if bias == "reference":
            biased = F.when(close, w / p).when(back, w).otherwise(w / q)
        else:
            biased = F.when(back, w / p).when(close, w).otherwise(w / q)
        biased = F.when(F.col("prev").isNull(), w).otherwise(biased)
        return biased if prob is None else biased * F.when(F.col("last").isNull(), F.lit(1.0)).otherwise(F.coalesce(prob, F.lit(0.0)))

    def rank(step: int, dst: Column, kind: Column, w: Column) -> Column:
        return F.struct(_draw(seed, step, dst, w).alias("r"), dst.alias("dst"), kind.alias("last"))

    def choose(tips: DataFrame, step: int) -> DataFrame:
        tips = tips.join(around, "prev", "left")
        listed = F.col("prev").isNull() | F.col("around").isNotNull() if transitions is None or after is not None else F.lit(False)
        few = tips.where(listed) if after is None else tips.where(listed).join(after, "last", "left")
        prob = (lambda x: F.try_element_at("after", x["type"])) if after is not None else (lambda x: None)
        weighed = F.transform("near", lambda x: F.struct(x["dst"].alias("dst"), x["type"].alias("type"), weight(x["w"], x["dst"] == F.col("prev"), F.array_contains("around", x["dst"]), prob(x)).alias("w")))
        best = F.array_min(F.transform(F.filter(weighed, lambda x: x["w"] > 0), lambda x: rank(step, x["dst"], x["type"], x["w"])))
        out = near.meet(few).select("walk_id", best.alias("best"))
        many = tips.where(~listed).drop("around").join(e, "src").join(linked.withColumn("linked", F.lit(True)), ["dst", "prev"], "left")
        if transitions is not None:
            many = many.join(transitions.select(F.col("from_type").alias("last"), F.col("to_type").alias("type"), "prob"), ["last", "type"], "left")
        many = many.withColumn("w", weight(F.col("w"), F.col("dst") == F.col("prev"), F.coalesce("linked", F.lit(False)), F.col("prob") if transitions is not None else None)).where("w > 0")
        return out.union(many.select("walk_id", rank(step, F.col("dst"), F.col("type"), F.col("w")).alias("best")))

    return _rounds(walks, length, choose, {"last": "string"})


def simulate(edges: DataFrame, nodes: DataFrame, per_node: int, length: int, p: float = 1.0, q: float = 1.0, transitions: DataFrame | None = None, most_types: int = 100_000, seed: str = "n2v") -> DataFrame:
    """walk_id, tokens: ``per_node`` biased walks from each node; walks shorter than ``length`` are dropped.

    With ``transitions`` edge types bias the walk, unless there are more than ``most_types`` of them (a matrix of
    their pairs would be too large): then the walk is plain second order.
    """
    if transitions is not None and transitions.select("to_type").distinct().limit(most_types + 1).count() > most_types:
        transitions = None
    return second_order_walk(edges, start_walks(nodes, per_node), length, p, q, transitions=transitions, seed=seed).where(F.size("tokens") >= length)


def edge_walk(edges: DataFrame, starts: DataFrame, length: int, transitions: DataFrame, seed: str = "edges") -> DataFrame:
    """walk_id, types: walks over edges (edge_id, src, dst, type, weight) from the edges ``starts`` (edge_id); the next edge begins where the last ends, by weight times transition."""
    e = cut(edges.select("edge_id", "src", "dst", "type", "weight"), "edges")
    walks = starts.join(e, "edge_id").select(F.col("edge_id").alias("walk_id"), F.array("type").alias("types"), F.col("dst").alias("tip"))
    for step in range(1, length):
        tips = walks.where(F.size("types") == step).select("walk_id", F.col("tip").alias("src"), F.element_at("types", -1).alias("from_type"))
        cand = tips.join(e, "src").join(transitions.withColumnRenamed("to_type", "type"), ["from_type", "type"]).withColumn("w", F.col("weight") * F.col("prob")).where("w > 0")
        chosen = cand.groupBy("walk_id").agg(F.min_by(F.struct("dst", "type"), F.struct(_draw(seed, step, F.col("dst"), F.col("w")).alias("r"), "edge_id")).alias("next"))
        walks = cut(walks.join(chosen, "walk_id", "left").select("walk_id", F.when(F.col("next").isNull(), F.col("types")).otherwise(F.concat("types", F.array("next.type"))).alias("types"), F.coalesce("next.dst", "tip").alias("tip")), "walks")
    return walks.select("walk_id", "types")


def uniform_transitions(types: DataFrame) -> DataFrame:
    """(from_type, to_type, prob) with 1 / T ** 2 for the T distinct types."""
    t = types.select("type").distinct()
    n = t.agg(F.count("*").cast("double").alias("n"))
    return t.select(F.col("type").alias("from_type")).join(t.select(F.col("type").alias("to_type"))).join(n).select("from_type", "to_type", (1 / (F.col("n") * F.col("n"))).alias("prob"))


def type_counts(walks: DataFrame, types: DataFrame) -> DataFrame:
    """walk_id, type, n: occurrences of every type in every walk, zeros included."""
    got = walks.select("walk_id", F.explode("types").alias("type")).groupBy("walk_id", "type").agg(F.count("*").alias("n"))
    t = types.select("type").distinct()
    every = walks.select("walk_id").join(F.broadcast(t)) if t.limit(1001).count() <= 1000 else walks.select("walk_id").join(t)
    return every.join(got, ["walk_id", "type"], "left").na.fill(0, ["n"])


def similarity(counts: DataFrame, how: str) -> DataFrame:
    """from_type, to_type, prob: similarity of the types' count vectors over walks.

    pearson and spearman (average ranks) give sigmoid(r), -1 without variance; kl gives
    sum p ln(p / q) over walks both have, 0 if none; wilcoxon gives 1 / (sqrt(W) + 1) for the lesser
    signed-rank sum, 0 if all differences are 0.
    """
    from pyspark.sql import Window as W

    a = counts.select("walk_id", F.col("type").alias("from_type"), F.col("n").cast("double").alias("x"))
    if how == "spearman":
        w = W.partitionBy("from_type").orderBy("x")
        same = W.partitionBy("from_type", "x")
        a = a.withColumn("x", F.rank().over(w) + (F.count("*").over(same) - 1) / 2.0)
    b = a.select("walk_id", F.col("from_type").alias("to_type"), F.col("x").alias("y"))
    ab = a.join(b, "walk_id")
    if how in ("pearson", "spearman"):
        n, sx, sy = F.count("*").cast("double"), F.sum("x"), F.sum("y")
        cov = n * F.sum(F.col("x") * F.col("y")) - sx * sy
        vx, vy = n * F.sum(F.col("x") * F.col("x")) - sx * sx, n * F.sum(F.col("y") * F.col("y")) - sy * sy
        g = ab.groupBy("from_type", "to_type").agg(cov.alias("cov"), vx.alias("vx"), vy.alias("vy"))
        r = F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))
        return g.select("from_type", "to_type", F.when((F.col("vx") > 0) & (F.col("vy") > 0), 1 / (1 + F.exp(-r))).otherwise(F.lit(-1.0)).alias("prob"))
    if how == "kl":
        t = a.groupBy("from_type").agg(F.sum("x").alias("tx"))
        z = ab.where("x > 0 AND y > 0").join(t, "from_type").join(t.select(F.col("from_type").alias("to_type"), F.col("tx").alias("ty")), "to_type")
        p, q = F.col("x") / F.col("tx"), F.col("y") / F.col("ty")
        g = z.groupBy("from_type", "to_type").agg(F.sum(p * F.log(p / q)).alias("prob"))
        every = ab.select("from_type", "to_type").distinct()
        return every.join(g, ["from_type", "to_type"], "left").na.fill(0.0, ["prob"])
    if how == "wilcoxon":
        d = ab.withColumn("d", F.col("x") - F.col("y"))
        pair = ["from_type", "to_type"]
        z = d.where("d <> 0").withColumn("m", F.abs("d"))
        rk = F.rank().over(W.partitionBy(*pair).orderBy("m")) + (F.count("*").over(W.partitionBy(*pair, "m")) - 1) / 2.0
        z = z.withColumn("rk", rk)
        g = z.groupBy(*pair).agg(F.sum(F.when(F.col("d") > 0, F.col("rk")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rk")).otherwise(0.0)).alias("down"))
        every = ab.select(*pair).distinct()
        return every.join(g, pair, "left").select(*pair, F.when(F.col("up").isNotNull(), 1 / (F.sqrt(F.least("up", "down")) + 1)).otherwise(F.lit(0.0)).alias("prob"))
    raise ValueError(how)


def em_transitions(edges: DataFrame, rounds: int = 5, length: int = 3, how: str = "spearman", links: int = 1000, seed: str = "em") -> DataFrame:
    """Transitions between edge types by turns of walking under them and comparing the types' counts; at most ``links`` hashed start edges a turn (the feature's own limit)."""
    types = cut(edges.select("type").distinct(), "types")
    trans = cut(uniform_transitions(types), "trans")
    for r in range(rounds):
        starts = edges.orderBy(hashed(F.lit(seed), F.lit(r), F.col("edge_id")), "edge_id").limit(links).select("edge_id")
        w = cut(edge_walk(edges, starts, length, trans, f"{seed}{r}"), "walks")
        trans = cut(similarity(type_counts(w, types), how), "trans")
    return trans


def markov(edges: DataFrame, starts: DataFrame, degrees: DataFrame, length: int, restart: float = 0.15) -> DataFrame:
    """walk_id, step, id: where p <- (1 - c) T p + c p0 is greatest (least id of equal ones), T = rows over their in-degree.

    ``starts`` (id) are walks of their own; only nonzero entries are rows.
    """
    t = edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")).join(degrees.select(F.col("id").alias("src"), "degree").where("degree > 0"), "src")
    t = cut(t.select("src", "dst", (F.col("n") / F.col("degree")).alias("v")), "t")
    p0 = starts.select(F.col("id").alias("walk_id"), "id", F.lit(1.0).alias("p"))
    p, out = p0, None
    for k in range(1, length + 1):
        moved = p.withColumnRenamed("id", "dst").join(t, "dst").groupBy("walk_id", F.col("src").alias("id")).agg(F.sum(F.col("p") * F.col("v")).alias("p"))
        p = moved.select("walk_id", "id", ((1 - restart) * F.col("p")).alias("p")).union(p0.select("walk_id", "id", (restart * F.col("p")).alias("p"))).groupBy("walk_id", "id").agg(F.sum("p").alias("p"))
        p = cut(p, "p")
        snap = p.withColumn("s", F.floor(F.col("p") * 1e9 + 0.5))
        best = snap.groupBy("walk_id").agg(F.max("s").alias("s"))
        step = snap.join(best, ["walk_id", "s"]).groupBy("walk_id").agg(F.min("id").alias("id")).select("walk_id", F.lit(k).alias("step"), "id")
        out = step if out is None else out.union(step)
    return out


def nodes_only(tokens: Column) -> Column:
    """Every second token of a walk that alternates nodes and edges."""
    return F.filter(tokens, lambda x, i: i % 2 == 0)


def relational_triples(tokens: Column) -> Column:
    """(head, edge, tail) for each edge of an alternating walk."""
    n = F.size(tokens)
    starts = F.when(n >= 3, F.sequence(F.lit(1), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, 3))


def subwalks(tokens: Column, length: int, stride: int = 2) -> Column:
    """Stretches of ``length`` tokens, each ``stride`` further on."""
    n = F.size(tokens)
    starts = F.when(n >= length, F.sequence(F.lit(1), n - (length - 1), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, length))
