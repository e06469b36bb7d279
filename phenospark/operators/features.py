"""Annotation hits to presence features, in long form: (genome_id, feature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.constants import BRIDGE, INTRINSIC_COLUMNS
from .lineage import cut


def presence(hits: DataFrame) -> DataFrame:
    """Distinct (genome_id, feature) of hits of type AMR."""
    amr = F.upper(F.coalesce("type", F.lit(""))) == "AMR"
    return hits.where(amr & F.col("symbol").isNotNull()).select("genome_id", F.col("symbol").alias("feature")).distinct()


def counts(genomes: DataFrame, features: DataFrame, name: str = "n_features") -> DataFrame:
    """Features of every genome; genomes without hits stay, with 0."""
    by = features.groupBy("genome_id").agg(F.count("*").alias(name))
    return genomes.select("genome_id").join(by, "genome_id", "left").select("genome_id", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def matrix(genomes: DataFrame, features: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Wide 0/1 table over a stated vocabulary: one conditional maximum a column, no pivot pass to find it."""
    if not vocabulary:
        return genomes.select("genome_id")
    cells = [F.max((F.col("feature") == v).cast("int")).alias(f"_{i}") for i, v in enumerate(vocabulary)]
    wide = features.where(F.col("feature").isin(vocabulary)).groupBy("genome_id").agg(*cells)
    out = genomes.select("genome_id").join(wide, "genome_id", "left")
    return out.select("genome_id", *[F.coalesce(f"_{i}", F.lit(0)).alias(v) for i, v in enumerate(vocabulary)])


def families(features: DataFrame) -> DataFrame:
    return features.select("genome_id", names.gene_family(F.col("feature")).alias("family")).distinct()


def keep(features: DataFrame, labelled: DataFrame, grouped: DataFrame, drop: DataFrame) -> DataFrame:
    """Features of genomes that are labelled and grouped, without columns that name a target."""
    ids = labelled.select("genome_id").intersect(grouped.select("genome_id"))
    return features.join(ids, "genome_id", "left_semi").join(F.broadcast(drop.select("feature")), "feature", "left_anti").select("genome_id", "feature")


def first_rule(symbol: Column, rules: list[tuple[str, str]]) -> Column:
    """The target of the first rule whose pattern matches: one CASE, no join."""
    out = F.when(symbol.rlike(rules[0][0]), rules[0][1])
    for pattern, to in rules[1:]:
        out = out.when(symbol.rlike(pattern), to)
    return out


def annotate(hits: DataFrame, order: str) -> DataFrame:
    """feature, gene_symbol, evidence_type, amr_class, amr_subclass of each feature: those of its last hit in ``order``.

    ``hits`` has genome_id, symbol, type, subtype, class, subclass."""
    amr = hits.where((F.upper(F.coalesce("type", F.lit(""))) == "AMR") & (F.trim("symbol") != ""))
    evidence = names.evidence_class(F.trim("subtype"))
    told = amr.select(F.trim("symbol").alias("feature"), F.struct(F.col(order).alias("o"), evidence.alias("evidence"), F.trim(F.coalesce("class", F.lit(""))).alias("class"), F.trim(F.coalesce("subclass", F.lit(""))).alias("subclass")).alias("m"))
    last = told.groupBy("feature").agg(F.max_by("m", F.col("m.o")).alias("m"))
    return last.select("feature", names.gene_symbol(F.col("feature"), F.col("m.evidence")).alias("gene_symbol"), F.col("m.evidence").alias("evidence_type"), F.col("m.class").alias("amr_class"), F.col("m.subclass").alias("amr_subclass"))


def token_classes(rows: DataFrame, order: str) -> DataFrame:
    """feature, amr_class: the first class that is not blank, in ``order``, empty where all are.

    ``rows`` has token and class."""
    named = F.when(F.trim(F.coalesce("class", F.lit(""))) != "", F.trim("class"))
    return rows.where("token is not null").groupBy(F.col("token").alias("feature")).agg(F.coalesce(F.min_by(named, F.when(named.isNotNull(), F.col(order))), F.lit("")).alias("amr_class"))


def bridge(hits: DataFrame, vocabulary: DataFrame, genomes: DataFrame | None = None, rules: list[tuple[str, str]] = BRIDGE, intrinsic: list[str] = INTRINSIC_COLUMNS) -> DataFrame:
    """(genome_id, feature) of symbols brought to a model's vocabulary: of the rules whose target is in it the first that
    matches the symbol's base, else the feature of that very name in any case; others have no feature. Every genome also
    has the intrinsic features that the vocabulary holds.

    ``hits`` has genome_id and symbol; rules (a fixed table) and the vocabulary are small, symbols are matched once each."""
    numbered = hits.sparkSession.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rules)], "rule int, pattern string, target string")
    known = numbered.join(vocabulary.select(F.col("feature").alias("target")).distinct(), "target", "left_semi")
    symbols = hits.select("symbol").distinct().withColumn("base", F.lower(F.trim(F.substring_index("symbol", "_", 1))))
    ruled = symbols.join(F.broadcast(known), F.expr("base rlike pattern"), "left").groupBy("symbol", "base").agg(F.min_by("target", "rule").alias("target"))
    lower = vocabulary.groupBy(F.lower("feature").alias("base")).agg(F.max("feature").alias("own"))
    placed = ruled.join(lower, "base", "left").select("symbol", F.coalesce("target", "own").alias("feature")).where("feature is not null")
    found = hits.join(placed, "symbol").select("genome_id", "feature")
    if intrinsic:
        always = vocabulary.where(F.col("feature").isin(intrinsic)).select("feature").distinct()
        found = found.unionByName((genomes if genomes is not None else hits).select("genome_id").distinct().join(F.broadcast(always)))
    return found.distinct()


def resolve_curated(curated: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(drug, gene, feature): the feature of that very name or, for names without a mutation, all of the same stem."""
    exact = curated.join(vocabulary, F.col("gene") == F.col("feature")).select("drug", "gene", "feature")
    rest = curated.join(exact.select("drug", "gene"), ["drug", "gene"], "left_anti").where(names.parse_mutation(F.col("gene")).isNull())
    left = rest.withColumn("key", names.match_key(F.col("gene")))
    right = vocabulary.withColumn("key", F.explode(names.match_keys(F.col("feature")))).distinct()
    return exact.unionByName(left.join(right, "key").select("drug", "gene", "feature").distinct())


def sparse_score(genomes: DataFrame, features: DataFrame, coefs: DataFrame, intercept: float) -> DataFrame:
    """P(R) from a sparse dot product; ``coefs`` (feature, coef) is a fitted model's table over a vocabulary."""
    sums = features.join(coefs, "feature").groupBy("genome_id").agg(F.sum("coef").alias("z"))
    z = F.coalesce("z", F.lit(0.0)) + intercept
    return genomes.select("genome_id").join(sums, "genome_id", "left").select("genome_id", (1 / (1 + F.exp(-z))).alias("p"))


def nearest_hamming(queries: DataFrame, train: DataFrame) -> DataFrame:
    """1-NN Hamming distance of presence profiles, exact, without pairing all of them. Both sides are distinct
    (genome_id, feature); a genome without features has a null one."""
    return nearest_by_key(queries.withColumn("_k", F.lit(0)), train.withColumn("_k", F.lit(0)), ["_k"]).select("genome_id", "distance")


def _profiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "genome_id").agg(F.array_sort(F.collect_set("feature")).alias("fs"))


#: Radii of the search for nearest profiles; beyond the last, and where no open one is beyond the first, rare features alone decide.
RADII = (7, 31)
#: Rows of one token that a task joins; those of a commoner one are dealt out.
SPLIT = 1024


def _bands(radius: int) -> Column:
    """Hashes of what a profile has in each of radius + 1 classes of features: two profiles that differ in ``radius``
    features at most have the same in one of them."""
    n = radius + 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, F.filter("fs", lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int") == b)))


def _rarest_first(profiles: DataFrame, common: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles with r, their features and how many training profiles hold each (df), rarest first."""
    rows = profiles.withColumn("feature", F.explode_outer("fs")).join(common, [*keys, "feature"], "left")
    held = F.when(F.col("feature").isNotNull(), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "feature"))
    return rows.groupBy(*profiles.columns).agg(F.array_sort(F.collect_list(held)).alias("r"))


def _closer(open_: DataFrame, t: DataFrame, keys: list[str], radius: int | None) -> DataFrame:
    """keys, fs, d: the least distance to the training profiles that may lie within ``radius`` (none: closer than best).

    A query asks for its bands or for its x + 1 rarest features, whichever fewer training profiles hold: a profile at x or
    less lacks x of its features at most. The first feature that two such profiles share, in the one order of all features,
    stands early in both; where a query has no more than x features, a profile that shares none is no closer than best."""
    x = F.col("best") - 1 if radius is None else F.least(F.col("best") - 1, F.lit(radius))
    early = F.col("r") if radius is None else F.slice("r", 1, radius + 1)
    token = F.xxhash64(F.lit("feature"), F.col("z.feature")).alias("token")
    wanted = open_.withColumn("x", x.cast("int")).withColumn("r", F.slice("r", F.lit(1), F.col("x") + 1))
    index = t.select(*keys, F.col("fs").alias("ts"), "m", F.posexplode(early).alias("j", "z")).select(*keys, "ts", "m", "j", token, F.col("z.df").alias("df"))
    by_feature = wanted
    asked = []
    if radius is not None:
        bands = t.select(*keys, F.col("fs").alias("ts"), "m", F.lit(None).cast("int").alias("j"), F.explode(_bands(radius)).alias("token"))
        counted = bands.groupBy(*keys, "token").agg(F.count("*").alias("df"))
        wide = wanted.select(*keys, "fs", "n", "x", "r", F.explode(_bands(radius)).alias("token")).join(counted, [*keys, "token"], "left")
        both = wide.groupBy(*keys, "fs", "n", "x", "r").agg(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "token"))).alias("z"), F.coalesce(F.sum("df"), F.lit(0)).alias("cost"))
        both = both.withColumn("banded", F.col("cost") < F.aggregate("r", F.lit(0).cast("long"), lambda a, z: a + z["df"]))
        by_feature = both.where("not banded")
        asked = [both.where("banded").select(*keys, "fs", "n", "x", F.lit(None).cast("int").alias("i"), F.explode("z").alias("z")).select(*keys, "fs", "n", "x", "i", F.col("z.token").alias("token"), F.col("z.df").alias("df"))]
        index = index.unionByName(bands.join(counted, [*keys, "token"]))
    rare = by_feature.select(*keys, "fs", "n", "x", F.posexplode("r").alias("i", "z")).where("z.df > 0").select(*keys, "fs", "n", "x", "i", token, F.col("z.df").alias("df"))
    for more in asked:
        rare = rare.unionByName(more)
    parts = F.ceil(F.col("df") / SPLIT).cast("int")
    questions = rare.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("df")
    dealt = index.withColumn("part", F.pmod(F.xxhash64("ts"), parts).cast("int")).drop("df")
    late = F.expr("i + j > x or 2 * i > n - m + x or 2 * j > m - n + x")
    # Few bytes make many pairs here: a stated number of partitions keeps adaptive execution from putting them in one task.
    conf = t.sparkSession.conf
    number = max(int(conf.get("spark.sql.shuffle.partitions")), t.sparkSession.sparkContext.defaultParallelism)
    met = questions.repartition(number, *keys, "token", "part").join(dealt, [*keys, "token", "part"]).where("abs(n - m) <= x").where(~F.coalesce(late, F.lit(False)))
    return met.groupBy(*keys, "fs").agg(F.min(F.col("n") + F.col("m") - 2 * F.size(F.array_intersect("fs", "ts"))).alias("d"))


def nearest_by_key(queries: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """The same within each combination of keys (not null).

    Equal profiles are one on either side. Profiles are looked up by themselves and by what is left when one feature
    goes: that finds all at distance 1 or less, and tells that others are at 2 or more. Those that may be nearer than found
    are looked for in growing radii, by bands of their features or by their rarest ones; profiles that share nothing need
    only the smallest. Rows of a feature that very many profiles hold are dealt over tasks, and pairs are never shuffled."""
    q = cut(_profiles(queries, keys).withColumn("n", F.size("fs")))
    profiles = q.select(*keys, "fs", "n").distinct()
    t = cut(_profiles(train, keys).select(*keys, "fs").distinct().withColumn("m", F.size("fs")))
    least = t.groupBy(*keys).agg(F.min("m").alias("least"))

    def signatures(rows: DataFrame) -> DataFrame:
        less = F.transform("fs", lambda x: F.struct(F.array_remove("fs", x).alias("s"), F.lit(1).alias("gone")))
        return rows.withColumn("z", F.explode(F.concat(F.array(F.struct(F.col("fs").alias("s"), F.lit(0).alias("gone"))), less))).withColumn("s", F.col("z.s")).withColumn("gone", F.col("z.gone")).drop("z")

    held = signatures(t).groupBy(*keys, "s").agg(F.min("gone").alias("there"))
    near = signatures(profiles).join(held, [*keys, "s"]).groupBy(*keys, "fs").agg(F.min(F.col("gone") + F.col("there")).alias("near"))
    far = F.col("n") + F.col("least")
    known = cut(profiles.join(least, keys).join(near, [*keys, "fs"], "left").select(*keys, "fs", "n", F.least(F.coalesce("near", far), far).alias("best")))
    common = t.select(*keys, F.explode("fs").alias("feature")).groupBy(*keys, "feature").agg(F.count("*").alias("df"))
    ordered = None
    searched = 1
    for radius in (*RADII, None):
        farthest = known.agg(F.max("best")).first()[0]
        if farthest is None or farthest <= searched + 1:
            break
        open_ = _rarest_first(known.where(F.col("best") > searched + 1), common, keys)
        ordered = cut(_rarest_first(t, common, keys)) if ordered is None else ordered
        within = radius if farthest > RADII[0] + 1 else None
        found = _closer(open_, ordered, keys, within)
        searched = farthest if within is None else within
        known = cut(known.join(found, [*keys, "fs"], "left").select(*keys, "fs", "n", F.least("best", F.coalesce("d", "best")).alias("best")))
    return q.join(known.select(*keys, "fs", F.col("best").cast("long").alias("distance")), [*keys, "fs"]).select(*keys, "genome_id", "distance")
