"""Ranking: a personalised PageRank by synchronous rounds, its incremental form, decay and forgetting.

With v a file's opens and P the transition shares, the fixed point is p = (1 - a) * sum of a^k (P^T)^k v. A round takes
each residual r of at least epsilon, adds (1 - a) r to p and sends a * r * P on. What a file without outgoing edges
sends on is lost. After any change of v or P the residual is r = v - p / (1 - a) + a / (1 - a) * P^T p, so work goes on from p.

Edges are kept with their share, stored by source; a round shuffles its contributions once. Every few rounds the
state is written to the shared folder, so plans stay short and a lost executor costs a few rounds at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treadle.constants import ALPHA, DECAY_INTERVAL_SECS, EPSILON, ROUNDS
from treadle.plans.storage import release, stored

NODE = ["root", "path"]
CUT_EVERY = 10
#: Files of a round are broadcast up to this many.
BROADCAST_ROWS = 100_000


def out_weights(edges: DataFrame) -> DataFrame:
    """(root, src, total, out_degree)."""
    return edges.groupBy("root", "src").agg(F.sum("weight").alias("total"), F.count("*").alias("out_degree"))


def shares(edges: DataFrame) -> DataFrame:
    """Edges with the share of their source's weight; sources without weight send nothing."""
    totals = edges.groupBy("root", "src").agg(F.sum("weight").alias("total"))
    return edges.join(totals, ["root", "src"]).where("total > 0").select("root", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def apply_deltas(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    return edges.select("root", "src", "dst", "weight").unionByName(deltas.select("root", "src", "dst", "weight")).groupBy("root", "src", "dst").agg(F.sum("weight").alias("weight"))


def apply_opens(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    return nodes.select(*NODE, "opens").unionByName(deltas.select(*NODE, "opens")).groupBy(*NODE).agg(F.sum("opens").alias("opens"))


def start(nodes: DataFrame) -> DataFrame:
    """Everything still to be settled: p = 0, r = v."""
    return nodes.select(*NODE, F.lit(0.0).alias("p"), F.col("opens").alias("r"))


def moves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, src, dst, share): where a file's residual goes. A row without a share, one per file, is what it keeps itself."""
    own = nodes.select("root", F.col("path").alias("src"), F.col("path").alias("dst"), F.lit(None).cast("double").alias("share"))
    return shares(edges).unionByName(own)


def pushed(state: DataFrame, of: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """One round over the state (root, path, p, r) with the moves ``of``: one join and one sum, the state read once."""
    rows = state.join(of.withColumnRenamed("src", "path"), NODE)
    active, own = F.abs("r") >= epsilon, F.col("share").isNull()
    p = F.when(own & active, F.col("p") + (1 - ALPHA) * F.col("r")).when(own, F.col("p")).otherwise(0.0)
    r = F.when(own & active, 0.0).when(own, F.col("r")).when(active, ALPHA * F.col("r") * F.col("share")).otherwise(0.0)
    return rows.groupBy("root", F.col("dst").alias("path")).agg(F.sum(p).alias("p"), F.sum(r).alias("r"))


def rounds(state: DataFrame, edges: DataFrame, n: int = ROUNDS) -> DataFrame:
    state = stored(state)
    of = stored(moves(state, edges), ["root", "src"])
    for k in range(1, n + 1):
        state = pushed(state, of)
        if k % CUT_EVERY == 0 and k < n:
            state = stored(state)
    return state


def active_rounds(state: DataFrame, edges: DataFrame, n: int, epsilon: float) -> DataFrame:
    """Rounds over those files only whose residual reaches ``epsilon``, and those they send to; all others stay as they are, aside.

    A round joins the active files with the shares of their edges; files that get something for the first time are
    looked up. Few active files are broadcast, so neither the edges nor the other files are shuffled.
    """
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    state, of = stored(state), stored(shares(edges), ["root", "src"])
    active = F.abs("r") >= epsilon
    touched = stored(state.where(active))
    for _ in range(n):
        front = touched.where(active).select("root", F.col("path").alias("src"), "r")
        size = front.count()
        if not size:
            break
        got = stored(of.join(few(front, size), ["root", "src"]).groupBy("root", F.col("dst").alias("path")).agg(F.sum(ALPHA * F.col("r") * F.col("share")).alias("got")))
        fresh = state.join(few(got.select(*NODE).join(touched, NODE, "left_anti"), got.count()), NODE, "left_semi")
        p = F.when(active, F.col("p") + (1 - ALPHA) * F.col("r")).otherwise(F.col("p"))
        r = F.when(active, 0.0).otherwise(F.col("r")) + F.coalesce("got", F.lit(0.0))
        before, touched = touched, stored(touched.unionByName(fresh).join(got, NODE, "left").select(*NODE, p.alias("p"), r.alias("r")))
        release(before, got)
    return state.join(few(touched.select(*NODE), touched.count()), NODE, "left_anti").unionByName(touched)


def with_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and, without opens, files that only edges name."""
    named = edges.select("root", F.explode(F.array("src", "dst")).alias("path")).distinct()
    return named.join(nodes.select(*NODE, "opens"), NODE, "full").select(*NODE, F.coalesce("opens", F.lit(0.0)).alias("opens"))


def full_rank(nodes: DataFrame, edges: DataFrame, n: int = ROUNDS) -> DataFrame:
    """(root, path, p, r) after ``n`` rounds from nothing."""
    return rounds(start(with_targets(nodes, edges)), edges, n)


def residual(nodes: DataFrame, settled: DataFrame, edges: DataFrame) -> DataFrame:
    """The state from which work goes on: the settled p, and r as it follows from v, P and p."""
    all_nodes = with_targets(nodes, edges).join(settled.select(*NODE, "p"), NODE, "left").select(*NODE, "opens", F.coalesce("p", F.lit(0.0)).alias("p"))
    sent = all_nodes.where("p <> 0").select("root", F.col("path").alias("src"), "p").join(shares(edges), ["root", "src"])
    got = sent.groupBy("root", F.col("dst").alias("path")).agg(F.sum(F.col("p") * F.col("share")).alias("got"))
    r = F.col("opens") - F.col("p") / (1 - ALPHA) + ALPHA / (1 - ALPHA) * F.coalesce("got", F.lit(0.0))
    return all_nodes.join(got, NODE, "left").select(*NODE, "p", r.alias("r"))


def incremental_rank(nodes: DataFrame, settled: DataFrame, edges: DataFrame, n: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """The rank after changes: from the settled p of before, only files whose residual reaches epsilon work."""
    state = residual(nodes, settled, edges)
    return active_rounds(state, edges, n, epsilon) if epsilon else rounds(state, edges, n)


def score(p: str = "p") -> F.Column:
    """In units of opens."""
    return F.col(p) / (1 - ALPHA)


def synced(entries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Entries with the score of their file, 0 where it has none."""
    return entries.join(ranked.select(*NODE, score().alias("score")), NODE, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def decay_factor(elapsed: F.Column, half_life: F.Column) -> F.Column:
    """1 if less than an hour has passed or there is no half-life."""
    return F.when((elapsed >= DECAY_INTERVAL_SECS) & (half_life > 0), F.pow(F.lit(0.5), elapsed / half_life)).otherwise(1.0)


def decayed(df: DataFrame, columns: list[str], elapsed: float, half_life: float) -> DataFrame:
    factor = decay_factor(F.lit(float(elapsed)), F.lit(float(half_life)))
    return df.withColumns({c: F.col(c) * factor for c in columns})


def forgotten(state: DataFrame) -> DataFrame:
    """Nodes stay, with nothing settled or to settle; the edges go."""
    return state.withColumns({c: F.lit(0.0) for c in state.columns if c in ("opens", "p", "r", "score")})
