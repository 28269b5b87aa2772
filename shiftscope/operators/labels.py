"""Labelings and partitions: information measures, agreement, products, relabeling.

Rows are counted per label combination first; everything after that works on
contingency tables, which are as small as the label sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def contingency(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def _total(counts: DataFrame) -> DataFrame:
    """Counts with the grand total beside them (one row, broadcast)."""
    total = counts.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def entropy(df: DataFrame, *labels: str, base: float | None = None) -> DataFrame:
    """Entropy of the joint labels, in nats unless a base is given (one row)."""
    p = F.col("n") / F.col("total")
    log = F.log(p) if base is None else F.log(float(base), p)
    return _total(contingency(df, *labels)).agg((-F.sum(p * log)).alias("entropy"))


def total_correlation(df: DataFrame, labels: list[str]) -> DataFrame:
    """Sum of the labels' entropies less their joint entropy."""
    parts = [entropy(df, a).select(F.col("entropy").alias("e")) for a in labels] + [entropy(df, *labels).select((-F.col("entropy")).alias("e"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("e").alias("total_correlation"))


def cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency cells with both margins and the total."""
    counts = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return _total(counts.withColumns({"na": F.sum("n").over(W.partitionBy("a")), "nb": F.sum("n").over(W.partitionBy("b"))}))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """MI, both entropies and both conditional entropies in nats (one row)."""
    n, na, nb, t = (F.col(c).cast("double") for c in ("n", "na", "nb", "total"))
    one = cells(df, a, b).agg(
        F.sum(n / t * F.log(n * t / (na * nb))).alias("mi"),
        F.sum(-n / t * F.log(na / t)).alias("h_a"),
        F.sum(-n / t * F.log(nb / t)).alias("h_b"),
    )
    return one.select("mi", "h_a", "h_b", (F.col("h_a") - F.col("mi")).alias("h_a_given_b"), (F.col("h_b") - F.col("mi")).alias("h_b_given_a"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """NMI (geometric), variation of information, adjusted Rand index and pair precision, recall and F1 (one row)."""
    pairs = lambda c: c * (c - 1) / 2
    n, na, nb, t = (F.col(c).cast("double") for c in ("n", "na", "nb", "total"))
    one = cells(df, a, b).agg(
        F.sum(n / t * F.log(n * t / (na * nb))).alias("mi"),
        F.sum(-n / t * F.log(na / t)).alias("ha"),
        F.sum(-n / t * F.log(nb / t)).alias("hb"),
        F.sum(pairs(n)).alias("both"),
        F.sum(n / na * pairs(na)).alias("in_a"),
        F.sum(n / nb * pairs(nb)).alias("in_b"),
        F.max(pairs(t)).alias("every"),
    )
    expected = F.col("in_a") * F.col("in_b") / F.col("every")
    spread = (F.col("in_a") + F.col("in_b")) / 2 - expected
    precision, recall = F.col("both") / F.nullif(F.col("in_b"), F.lit(0.0)), F.col("both") / F.nullif(F.col("in_a"), F.lit(0.0))
    return one.select(
        (F.col("mi") / F.nullif(F.sqrt(F.col("ha") * F.col("hb")), F.lit(0.0))).alias("nmi"),
        (F.col("ha") + F.col("hb") - 2 * F.col("mi")).alias("vi"),
        F.when(spread == 0, 1.0).otherwise((F.col("both") - expected) / spread).alias("ari"),
        precision.alias("pair_precision"), recall.alias("pair_recall"), (2 * precision * recall / (precision + recall)).alias("pair_f1"),
    )


def g2(df: DataFrame, x: str, y: str, z: list[str] = ()) -> DataFrame:
    """G squared statistic of x and y given z, and its degrees of freedom (one row)."""
    z = list(z)
    counts = df.groupBy(x, y, *z).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"nx": F.sum("n").over(W.partitionBy(x, *z)), "ny": F.sum("n").over(W.partitionBy(y, *z)), "nz": F.sum("n").over(W.partitionBy(*(z or [F.lit(0)])))})
    levels = F.countDistinct(x) - 1, F.countDistinct(y) - 1
    dof = levels[0] * levels[1]
    for c in z:
        dof = dof * F.countDistinct(c)
    n, nx, ny, nz = (F.col(c).cast("double") for c in ("n", "nx", "ny", "nz"))
    return counts.agg(F.sum(2 * n * F.log(n * nz / (nx * ny))).alias("g2"), dof.alias("dof"))


def g2_of_counts(counts: DataFrame, x: str, y: str, z: list[str] = ()) -> tuple[float, int, int]:
    """G squared of x and y given z, the strata that occur and the rows, from a table of row values and their count ``_n``.

    The statistic is a difference of sums of n log n over the cells and their margins, so no window sees all cells.
    """

    def part(name: str, keys: list[str]) -> DataFrame:
        cells = (counts.groupBy(*keys) if keys else counts).agg(F.sum("_n").cast("double").alias("n"))
        return cells.agg(F.lit(name).alias("name"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("n").alias("cells"), F.sum("n").alias("n"))

    z = list(z)
    tables = [part("xyz", [x, y, *z]), part("xz", [x, *z]), part("yz", [y, *z]), part("z", z)]
    found = {r["name"]: r for r in tables[0].unionAll(tables[1]).unionAll(tables[2]).unionAll(tables[3]).collect()}  # four rows
    s = {name: r["s"] or 0.0 for name, r in found.items()}
    return max(0.0, 2 * (s["xyz"] + s["z"] - s["xz"] - s["yz"])), found["z"]["cells"], int(found["z"]["n"] or 0)


def power_divergence(df: DataFrame, x: str, y: str, z: list[str] = (), power: float = 1.0) -> DataFrame:
    """Cressie-Read statistic summed over strata (power 1 is Pearson's chi squared); empty cells count."""
    z = list(z)
    counts = df.groupBy(x, y, *z).agg(F.count(F.lit(1)).alias("n"))
    strata = z or [F.lit(0).alias("_s")]
    xs = counts.groupBy(x, *strata).agg(F.sum("n").alias("nx"))
    ys = counts.groupBy(y, *strata).agg(F.sum("n").alias("ny"))
    keys = z or ["_s"]
    full = xs.join(ys, keys).join(counts if z else counts.withColumn("_s", F.lit(0)), [x, y, *keys], "left").fillna(0, ["n"])
    full = full.withColumn("nz", F.sum("n").over(W.partitionBy(*keys)))
    n, e = F.col("n").cast("double"), F.col("nx") * F.col("ny") / F.col("nz")
    if power == 1.0:
        term = (n - e) * (n - e) / e
    elif power == 0.0:
        term = F.when(n > 0, 2 * n * F.log(n / e)).otherwise(0.0)
    else:
        term = 2 / (power * (power + 1)) * n * (F.pow(n / e, F.lit(power)) - 1)
    return full.agg(F.sum(term).alias("statistic"))


def cantor(a: Column, b: Column) -> Column:
    """Cantor's pairing of two non-negative integers, in whole numbers."""
    a, b = a.cast("long"), b.cast("long")
    return F.shiftright((a + b) * (a + b + 1), 1) + b


def relabel_sorted(df: DataFrame, label: str, out: str, by: list[str] = ()) -> DataFrame:
    """Labels 0..k-1 in value order; ranks are taken over distinct labels, not rows."""
    by = list(by)
    names = df.select(*by, label).distinct()
    window = W.partitionBy(*by).orderBy(label) if by else W.orderBy(label)
    return df.join(names.withColumn(out, F.dense_rank().over(window) - 1), [*by, label])


def relabel_first_seen(df: DataFrame, label: str, position: str, out: str, by: list[str] = ()) -> DataFrame:
    """Labels 0..k-1 in order of first appearance."""
    by = list(by)
    names = df.groupBy(*by, label).agg(F.min(position).alias("_first"))
    window = W.partitionBy(*by).orderBy("_first") if by else W.orderBy("_first")
    return df.join(names.withColumn(out, F.dense_rank().over(window) - 1).drop("_first"), [*by, label])


def partition_product(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """The finest common refinement of two labelings, relabeled 0..k-1."""
    names = df.select(a, b).distinct()
    return df.join(names.withColumn(out, F.dense_rank().over(W.orderBy(a, b)) - 1), [a, b])


def intervention_targets(labels: DataFrame, node: str = "node", context: str = "context", label: str = "label") -> DataFrame:
    """Contexts whose label differs from their node's most frequent one (the lowest on ties)."""
    counts = labels.groupBy(node, label).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy(node).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("mode"))
    return labels.join(mode, node).where(F.col(label) != F.col("mode")).select(node, context, label)


def map_to_shifts(labels: DataFrame, node: str = "node", context: str = "context", label: str = "label") -> DataFrame:
    """For each node and pair of contexts 1 if their labels differ."""
    a = labels.select(F.col(node).alias("node"), F.col(context).alias("c1"), F.col(label).alias("l1"))
    b = labels.select(F.col(node).alias("node"), F.col(context).alias("c2"), F.col(label).alias("l2"))
    return a.join(b, "node").where("c1 < c2").select("node", "c1", "c2", (F.col("l1") != F.col("l2")).cast("int").alias("shift"))


def repair_transitivity(shifts: DataFrame) -> DataFrame:
    """Pairs (node, c1, c2, shift) with every inconsistent triple (two equal, one shifted) set to shift."""
    both = shifts.select("node", "c1", "c2", "shift").union(shifts.select("node", F.col("c2"), F.col("c1"), "shift"))
    a = both.select("node", F.col("c1").alias("x"), F.col("c2").alias("y"), F.col("shift").alias("s1"))
    b = both.select("node", F.col("c1").alias("y"), F.col("c2").alias("z"), F.col("shift").alias("s2"))
    c = both.select("node", F.col("c1").alias("x"), F.col("c2").alias("z"), F.col("shift").alias("s3"))
    bad = a.join(b, ["node", "y"]).where("x <> z").join(c, ["node", "x", "z"]).where("s1 + s2 + s3 = 1").select("node", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2"), F.lit(1).alias("bad")).distinct()
    return shifts.join(bad, ["node", "c1", "c2"], "left").select("node", "c1", "c2", F.greatest("shift", F.coalesce("bad", F.lit(0))).alias("shift"))


def soft_mutual_information(df: DataFrame, p: str, q: str) -> DataFrame:
    """MI of two columns of posterior arrays through their mean outer product (one row)."""
    rows = df.select(F.posexplode(p).alias("i", "pi"), F.col(q)).select("i", "pi", F.posexplode(q).alias("j", "qj"))
    joint = rows.groupBy("i", "j").agg(F.avg(F.col("pi") * F.col("qj")).alias("w"))
    joint = joint.withColumns({"wi": F.sum("w").over(W.partitionBy("i")), "wj": F.sum("w").over(W.partitionBy("j"))}).where("w > 1e-12")
    return joint.agg(F.sum(F.col("w") * F.log(F.col("w") / (F.col("wi") * F.col("wj")))).alias("soft_mi"))


def binned_mi(df: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """H(y) less H(y given the bin of x) in nats, both continuous columns binned alike (one row)."""
    bucket = lambda c: F.least(F.greatest(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return mutual_information(df.select(bucket(x).alias("bx"), bucket(y).alias("by")), "bx", "by").select("mi")


def pool_contexts(df: DataFrame, labels: DataFrame, node: str, context: str = "context") -> DataFrame:
    """Rows with the group of their context in one node's partition (node, context, label), so that contexts of one group are one population."""
    own = labels.where(F.col("node") == node).select(F.col("context").alias(context), F.col("label").alias("group"))
    return df.join(F.broadcast(own), context)  # one row per context


def one_hot_posterior(df: DataFrame, label: str, k: int, out: str = "posterior") -> DataFrame:
    """Labels as arrays of k probabilities, 1 at the label."""
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col(label)).cast("double")))


def confounded_partition(df: DataFrame, observed: str, confounder: str, out: str) -> DataFrame:
    """The product of an observed and a confounder's labeling."""
    return partition_product(df, observed, confounder, out)


def partition_scores(df: DataFrame, by: list[str], true: str, found: str) -> DataFrame:
    """Per group of items: NMI, adjusted Rand index, pair precision, recall and F1, the number of pairs, and whether the true labels vary."""
    counts = df.groupBy(*by, F.col(true).alias("a"), F.col(found).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"na": F.sum("n").over(W.partitionBy(*by, "a")), "nb": F.sum("n").over(W.partitionBy(*by, "b")), "t": F.sum("n").over(W.partitionBy(*by))})
    pairs = lambda c: c * (c - 1) / 2
    n, na, nb, t = (F.col(c).cast("double") for c in ("n", "na", "nb", "t"))
    one = counts.groupBy(*by).agg(
        F.sum(n / t * F.log(n * t / (na * nb))).alias("mi"), F.sum(-n / t * F.log(na / t)).alias("ha"), F.sum(-n / t * F.log(nb / t)).alias("hb"), F.sum(pairs(n)).alias("both"),
        F.sum(n / na * pairs(na)).alias("in_a"), F.sum(n / nb * pairs(nb)).alias("in_b"), F.max(pairs(t)).alias("every"), F.countDistinct("a").alias("ka"),
    )
    expected = F.when(F.col("every") > 0, F.col("in_a") * F.col("in_b") / F.col("every")).otherwise(0.0)
    spread = (F.col("in_a") + F.col("in_b")) / 2 - expected
    p, r = F.when(F.col("in_b") == 0, 1.0).otherwise(F.col("both") / F.col("in_b")), F.when(F.col("in_a") == 0, 1.0).otherwise(F.col("both") / F.col("in_a"))
    product = F.col("ha") * F.col("hb")
    return one.select(
        *by, F.when(product <= 1e-12, F.when((F.col("ha") <= 1e-12) & (F.col("hb") <= 1e-12), 1.0).otherwise(0.0)).otherwise(F.col("mi") / F.sqrt(F.greatest(product, F.lit(1e-12)))).alias("nmi"),
        F.when(F.abs(spread) < 1e-12, 1.0).otherwise((F.col("both") - expected) / F.when(F.abs(spread) < 1e-12, 1.0).otherwise(spread)).alias("ari"),
        p.alias("pair_precision"), r.alias("pair_recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, 1.0).otherwise(p + r)).alias("pair_f1"),
        F.col("every").cast("long").alias("n_pairs"), (F.col("ka") > 1).alias("is_variant"),
    )


def categorical_test(df: DataFrame, x: str, y: str, z: list[str] = (), power: float = 1.0) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p value of x and y being independent given z; strata with one level of x or y add none."""
    from shiftscope.functions.numerics import chi2_sf

    z = list(z)
    counts = df.groupBy(x, y, *z).agg(F.count(F.lit(1)).alias("n"))
    strata = (counts.groupBy(*z) if z else counts.groupBy(F.lit(0).alias("_s"))).agg(F.countDistinct(x).alias("kx"), F.countDistinct(y).alias("ky"))
    dof = strata.agg(F.sum((F.col("kx") - 1) * (F.col("ky") - 1))).first()[0] or 0
    stat = power_divergence(df, x, y, z, power).first()["statistic"] or 0.0
    return float(stat), int(dof), chi2_sf(float(stat), int(dof))
