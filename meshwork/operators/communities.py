"""Clusters of nodes: weights inside and between, modularity, and searches that raise it.

``edges`` are directed rows (src, dst, weight); an undirected graph has both directions. ``labels``
is (id, cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scalars import hashed
from meshwork.plans.ranking import numbered
from meshwork.plans.scratch import cut


def with_clusters(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("id").alias("src"), F.col("cluster").alias("c_src"))
    b = labels.select(F.col("id").alias("dst"), F.col("cluster").alias("c_dst"))
    return edges.select("src", "dst", "weight").join(a, "src").join(b, "dst")


def cluster_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, inside (half the weight between members), boundary (weight of rows that leave it), total (in-weights)."""
    e = with_clusters(edges, labels)
    same = F.col("c_src") == F.col("c_dst")
    into = e.groupBy(F.col("c_dst").alias("cluster")).agg(F.sum(F.when(same, F.col("weight") * 0.5).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    out = e.where(~same).groupBy(F.col("c_src").alias("cluster")).agg(F.sum("weight").alias("boundary"))
    every = labels.select("cluster").distinct()
    return every.join(into, "cluster", "left").join(out, "cluster", "left").na.fill(0.0, ["inside", "boundary", "total"])


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row q = sum over clusters of 2 * inside / 2m - (total / 2m) ** 2; 0 without edges."""
    w = cluster_weights(edges, labels)
    return w.agg(F.sum("inside").alias("i"), F.sum("total").alias("t"), F.sum(F.col("total") * F.col("total")).alias("tt")).select(
        F.when(F.col("t") > 0, 2 * F.col("i") / F.col("t") - F.col("tt") / (F.col("t") * F.col("t"))).otherwise(F.lit(0.0)).alias("q")
    )


def move_gains(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """id, cluster, gain: change of modularity if the node leaves its cluster for each one it has a neighbour in.

    With k the node's weight, k_c its weight into cluster c and K_c the cluster's total, both without
    the node: gain = 2 * (k_c - k_own) / 2m - 2 * k * (K_c - K_own) / (2m) ** 2.
    """
    e = with_clusters(edges.where("src <> dst"), labels)
    total = edges.agg(F.sum("weight").alias("mm"))
    k = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("k"))
    own = labels.withColumnRenamed("cluster", "own")
    into = e.groupBy(F.col("src").alias("id"), F.col("c_dst").alias("cluster")).agg(F.sum("weight").alias("kc"))
    sums = edges.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("cluster").agg(F.sum("weight").alias("big"))
    row = into.join(own, "id").join(k, "id").join(sums, "cluster")
    base = row.where("cluster = own").select("id", F.col("kc").alias("k_own"))
    home = labels.join(sums, "cluster").select("id", F.col("big").alias("big_own"))
    cand = row.where("cluster <> own").join(base, "id", "left").join(home, "id").join(F.broadcast(total))
    gain = 2 * (F.col("kc") - F.coalesce("k_own", F.lit(0.0))) / F.col("mm") - 2 * F.col("k") * (F.col("big") - (F.col("big_own") - F.col("k"))) / (F.col("mm") * F.col("mm"))
    return cand.select("id", "cluster", gain.alias("gain"))


def best_moves(gains: DataFrame) -> DataFrame:
    """Of each node the move with the greatest gain above 0, the least cluster of equal ones."""
    best = gains.where("gain > 1e-12").groupBy("id").agg(F.max(F.struct("gain")).alias("g"))
    return gains.join(best, "id").where(F.col("gain") == F.col("g.gain")).groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("gain").alias("gain"))


def local_moves(edges: DataFrame, labels: DataFrame, rounds: int = 10, seed: str = "louvain") -> DataFrame:
    """Rounds in which a hashed half of the nodes take their best move at once; a round that lowers modularity is undone."""
    labels = cut(labels, "labels")
    q = modularity(edges, labels).first()[0]
    quiet = 0
    for r in range(rounds):
        turn = F.pmod(F.conv(F.substring(hashed(F.lit(seed), F.lit(r), F.col("id")), 1, 8), 16, 10).cast("bigint"), F.lit(2)) == 0
        moves = best_moves(move_gains(edges, labels).where(turn)).select("id", F.col("cluster").alias("to"))
        new = cut(labels.join(moves, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster")), "labels")
        better = modularity(edges, new).first()[0]
        if better > q + 1e-12:
            labels, q, quiet = new, better, 0
        else:
            quiet += 1
            if quiet == 3:
                break
    return labels


def louvain(edges: DataFrame, levels: int = 4, rounds: int = 10) -> DataFrame:
    """id, cluster: local moves, then the same on the graph of clusters, until nothing moves.

    A cluster is named by its least member. Modularity never falls, by construction.
    """
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    names = cut(nodes.select("id", F.col("id").alias("cluster")), "names")
    work = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "work")
    for _ in range(levels):
        ids = work.select(F.col("src").alias("id")).union(work.select("dst")).distinct()
        moved = local_moves(work, ids.select("id", F.col("id").alias("cluster")), rounds)
        lead = moved.groupBy("cluster").agg(F.min("id").alias("lead"))
        named = cut(moved.join(lead, "cluster").select("id", F.col("lead").alias("cluster")), "named")
        if named.where("id <> cluster").limit(1).count() == 0:
            break
        names = cut(names.join(named.select(F.col("id").alias("cluster"), F.col("cluster").alias("to")), "cluster").select("id", F.col("to").alias("cluster")), "names")
        work = cut(with_clusters(work, named).groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("weight").alias("weight")), "work")
    return names


def neighborhood_overlap(edges: DataFrame) -> DataFrame:
    """id, members (sorted): for each node the union of the closed neighbourhoods that meet its own. Sets may overlap."""
    e = edges.select("src", "dst").union(edges.select("dst", "src"))
    ids = e.select(F.col("src").alias("id")).distinct()
    closed = e.select(F.col("src").alias("id"), F.col("dst").alias("m")).union(ids.select("id", F.col("id").alias("m"))).distinct()
    meet = closed.join(closed.select(F.col("id").alias("j"), "m"), "m").select("id", "j").distinct()
    return meet.join(closed.select(F.col("id").alias("j"), "m"), "j").groupBy("id").agg(F.sort_array(F.collect_set("m")).alias("members"))


#: Rows of ids and numbers, and bytes of their ids, up to which a table is broadcast; beyond them the join is shuffled. Longest id, in bytes, that is broadcast alone.
BROADCAST_ROWS, BROADCAST_BYTES, LONGEST = 400_000, 24 << 20, 60


def _sent(rows: DataFrame) -> DataFrame:
    """A written table (its id first), broadcast if it is small."""
    width = F.octet_length(F.col(rows.columns[0]).cast("string"))
    n, size = rows.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else rows


def _with_names(links: DataFrame, named: DataFrame) -> DataFrame:
    """Links (id, other) with c and big from the written table ``named`` (other, d, c, big).

    Where that is too large to broadcast, its rows of greatest degree d are: they meet most links. The
    links that are left are dealt.
    """
    plain = named.drop("d")
    if _sent(plain) is not plain:
        return links.join(_sent(plain), "other")
    level = F.floor(F.log2("d") * 4).cast("int")
    short = F.octet_length(F.col("other").cast("string")) <= LONGEST
    room, least = BROADCAST_ROWS, None
    # a few hundred levels at most, whatever the size
    for lv, n in named.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if n > room:
            break
        room, least = room - n, lv
    if least is None:
        return links.join(plain, "other")
    often = short & (level >= least)
    top = F.broadcast(cut(named.where(often).drop("d"), "often"))
    rest = cut(links.join(top, "other", "left_anti"), "rest")  # of its own size when the join is planned
    return links.join(top, "other").unionByName(rest.join(named.where(~often).drop("d"), "other"))


def _argmax_side(links: DataFrame, comm: DataFrame, degree: DataFrame, other_degree: DataFrame, totals: DataFrame, m: float, alone: bool = False) -> DataFrame:
    """For one side: the community with the greatest score n - K * d / m, the least of equal ones.

    links (id, other), comm (other, c), degree (id, d), other_degree (other, d), totals (c, big). Communities
    without a link score -K * d / m, best for the least K: one candidate row for each node covers them all. A
    community's total goes along with its members, so links are joined once and counted with a combine. Of the
    communities that a node has equally many links to only the one of least K can win, so that few
    rows of a node meet its degree. If each community has one member (``alone``) that number is 1.
    """
    named = cut(comm.join(totals, "c").join(other_degree, "other").select("other", "d", "c", "big"), "named")
    met = _with_names(links, named)
    n = met.select("id", "c", "big", F.lit(1).cast("bigint").alias("n")) if alone else met.groupBy("id", "c", "big").agg(F.count("*").alias("n"))
    few = cut(n.groupBy("id", "n").agg(F.min(F.struct("big", "c")).alias("s")), "few")
    low = totals.agg(F.min(F.struct("big", "c")).alias("s")).select(F.col("s.big").alias("big"), F.col("s.c").alias("c"))
    near = few.join(_sent(degree), "id").select("id", "s.c", "n", "d", "s.big")
    far = degree.join(F.broadcast(low)).select("id", "c", F.lit(0).cast("bigint").alias("n"), "d", "big")
    behind = F.col("big") * F.col("d") / F.lit(m) - F.col("n")
    best = near.union(far).select("id", F.struct(behind.alias("behind"), "c").alias("s")).groupBy("id").agg(F.min("s").alias("s"))
    return best.select("id", "s.c")


def brim(pairs: DataFrame, start: DataFrame | None, rounds: int = 20, fixed: bool = False, measured: bool = True, unique: bool = False) -> tuple[DataFrame, DataFrame, list[float]]:
    """Bipartite modularity over distinct pairs (doc, word) from doc communities ``start`` (doc, c; if not given each doc is one): docs, words and the modularity by round.

    A round moves all words, then all docs, to their best community; stops at a gain of at most
    min(1 / m, 1e-5) unless ``fixed``. The modularity matrix stays implicit. Fixed rounds need no
    modularity: it is left out if not ``measured``. Pairs known to be distinct (``unique``) are not compared.
    """
    a = pairs.select("doc", "word")
    a = cut(a if unique else a.distinct(), "pairs")
    dd = cut(a.groupBy("doc").agg(F.count("*").alias("d")), "docs")
    dw = cut(a.groupBy("word").agg(F.count("*").alias("d")), "words")
    total = float(dd.agg(F.sum("d")).first()[0] or 0)
    alone = start is None
    start = dd.select("doc", F.col("doc").alias("c")) if alone else start
    index = cut(start.select("c").distinct(), "index")
    docs, words, qs = cut(start, "start"), None, []
    for _ in range(rounds):
        k = cut(index.join(docs.join(dd, "doc").groupBy("c").agg(F.sum("d").alias("big")), "c", "left").na.fill(0, ["big"]), "totals")
        words = cut(_argmax_side(a.select(F.col("word").alias("id"), F.col("doc").alias("other")), docs.select(F.col("doc").alias("other"), "c"), dw.withColumnRenamed("word", "id"), dd.withColumnRenamed("doc", "other"), k, total, alone).withColumnRenamed("id", "word"), "words")
        alone = False
        k = cut(index.join(words.join(dw, "word").groupBy("c").agg(F.sum("d").alias("big")), "c", "left").na.fill(0, ["big"]), "totals")
        docs = cut(_argmax_side(a.select(F.col("doc").alias("id"), F.col("word").alias("other")), words.select(F.col("word").alias("other"), "c"), dd.withColumnRenamed("doc", "id"), dw.withColumnRenamed("word", "other"), k, total).withColumnRenamed("id", "doc"), "docs")
        if fixed and not measured:
            continue
        inside = a.join(_sent(docs), "doc").join(_sent(words.withColumnRenamed("c", "cw")), "word").where("c = cw").count()
        both = docs.join(dd, "doc").groupBy("c").agg(F.sum("d").alias("x")).join(words.join(dw, "word").groupBy("c").agg(F.sum("d").alias("y")), "c")
        q = (inside - (both.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0) / total) / total if total else 0.0
        if qs and not fixed and q - qs[-1] <= min(1 / total if total else 0.0, 1e-5):
            qs.append(q)
            break
        qs.append(q)
    return docs, words, qs


def cluster_quality(refs: DataFrame) -> DataFrame:
    """cluster, quality from (cluster, ref, token): 1 - H / base over tokens' shares of refs; 1 for one ref or no token."""
    d = refs.distinct()
    n = d.groupBy("cluster").agg(F.countDistinct("ref").alias("refs"))
    t = d.where("token IS NOT NULL").groupBy("cluster", "token").agg(F.count("*").cast("double").alias("k")).join(n, "cluster").withColumn("p", F.col("k") / F.col("refs"))
    h = t.groupBy("cluster").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count("*").alias("tokens"))
    base = -F.col("tokens") * (1.0 / F.col("refs")) * F.log2(1.0 / F.col("refs"))
    return n.join(h, "cluster", "left").select("cluster", F.when((F.col("refs") > 1) & F.col("tokens").isNotNull(), 1 - F.col("h") / base).otherwise(F.lit(1.0)).alias("quality"))


def mean_quality(refs: DataFrame) -> DataFrame:
    """One row: the mean of all clusters' quality, to four places, half up."""
    return cluster_quality(refs).agg((F.floor(F.avg("quality") * F.lit(1e4) + 0.5) / F.lit(1e4)).alias("quality"))


def component_labels(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """id, label: components (id, component) numbered by their least member, then nodes without one."""
    rep = components.groupBy("component").agg(F.min("id").alias("rep"))
    known = components.join(rep, "component").select("id", "rep")
    left = nodes.join(known, "id", "left_anti").select("id", F.lit(None).cast("string").alias("rep"))
    every = known.union(left)
    order = every.select(F.col("rep").isNull().alias("late"), F.coalesce("rep", "id").alias("rep")).distinct()
    places = numbered(order, [F.col("late"), F.col("rep")], "label")
    return every.select("id", F.coalesce("rep", "id").alias("rep")).join(places, "rep").select("id", "label")
