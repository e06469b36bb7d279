"""Queries over the driver's tables, each with the SQL it must equal.

Roles: an order is a genome, its customer the cluster; lines are laboratory measurements (drug = return flag, phenotype =
line status F/R, O/S) and, with their part, annotation hits (symbol = part name, ECONOMY and PROMO parts of type AMR);
events are scored test rows. Sums of doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import names, scores
from ..operators import build, contract, features, labels, lineage, metrics, models, predict, report, sets, similarity, splits
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def measurements(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("genome_id"), F.col("l_returnflag").alias("drug"), F.when(F.col("l_linestatus") == "F", "R").when(F.col("l_linestatus") == "O", "S").alias("phenotype"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"))


def hits(s, d) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("part"), F.regexp_replace("p_name", " ", "_").alias("symbol"), F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "AMR").otherwise(F.col("p_type")).alias("type"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("genome_id"), F.col("l_partkey").alias("part")).join(parts, "part")


def genomes(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("genome_id"), F.col("o_custkey").alias("cluster_id"), F.col("o_orderpriority").alias("species"))


def target_table(s) -> DataFrame:
    return s.sql("select * from values ('A', array('red_widget')), ('N', array('blue_bolt', 'hot_gear')) as t(drug, target_genes)")


def training(s, d) -> DataFrame:
    """drug, genome_id, y, cluster_id."""
    return labels.agreed(measurements(s, d)).join(genomes(s, d), "genome_id").select("drug", "genome_id", names.phenotype_code(F.col("phenotype")).alias("y"), "cluster_id")


def scored(s, d) -> DataFrame:
    """drug, y, p, call, cluster of test rows."""
    e = table(s, d, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("drug"), F.col("user_id").alias("cluster"), F.col("event_id"), F.col("event_type").isin("error", "purchase").cast("int").alias("y"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    return e.withColumn("call", scores.calibrated_call(scores.raw_call(F.when(F.col("cluster") % 50 == 7, "absent").otherwise("present"), F.col("p")), F.col("p"), F.lit(True), F.col("cluster") % 40 == 3))


def r6(c):
    return F.round(c, 6)


_M = "m as (select l_orderkey as genome_id, l_returnflag as drug, case l_linestatus when 'F' then 'R' when 'O' then 'S' end as phenotype, l_linenumber as pos, l_partkey as part from lineitem)"
_A = f"{_M}, a as (select genome_id, drug, min(phenotype) as phenotype from m group by all having count(distinct phenotype) = 1)"
_H = "h as (select l_orderkey as genome_id, replace(p_name, ' ', '_') as symbol, case when p_type in ('ECONOMY', 'PROMO') then 'AMR' else p_type end as type from lineitem join part on l_partkey = p_partkey)"
_P = f"{_H}, f as (select distinct genome_id, symbol as feature from h where type = 'AMR')"
_T = f"{_A}, t as (select drug, genome_id, case phenotype when 'R' then 1 else 0 end as y, o_custkey as cluster_id from a join orders on o_orderkey = genome_id)"
_E = """e0 as (select 'd' || (user_id % 3) as drug, user_id as cluster, event_id, case when event_type in ('error', 'purchase') then 1 else 0 end as y, least(value / 100, 1.0::double) as p from events),
e as (select *, case when cluster % 50 = 7 then 'not_applicable' when cluster % 40 = 3 or p between 0.3 and 0.7 then 'no_call' when p >= 0.5 then 'likely_to_fail' else 'likely_to_work' end as call from e0)"""


@query(f"with {_A} select genome_id, drug, phenotype from a")
def label_agreement(s, d):
    return labels.agreed(measurements(s, d))


@query(f"with {_M} select genome_id, drug, phenotype from (select *, row_number() over (partition by genome_id, drug order by pos, part, phenotype) as rn from m) where rn = 1")
def label_first_wins(s, d):
    return labels.first_wins(measurements(s, d), "pos", "part")


@query(f"""with {_A} select drug, count(*) as n, sum((phenotype = 'R')::int)::bigint as n_r, sum((phenotype = 'S')::int)::bigint as n_s,
round(100.0 * sum((phenotype = 'R')::int) / count(*), 6)::double as pct_r, drug in ('A', 'N') as has_target_gate from a group by drug""")
def dataset_summary(s, d):
    return labels.summarize(labels.agreed(measurements(s, d)), target_table(s)).withColumn("pct_r", r6("pct_r"))


@query(f"with {_P} select genome_id, feature from f")
def presence_long(s, d):
    return features.presence(hits(s, d))


_VOCAB = ["red_widget", "blue_bolt", "hot_gear", "small_ring"]


@query(f"with {_P} select o_orderkey as genome_id, " + ", ".join(f"coalesce(max((feature = '{v}')::int), 0) as {v}" for v in _VOCAB) + " from orders left join f on genome_id = o_orderkey group by o_orderkey")
def presence_matrix(s, d):
    return features.matrix(genomes(s, d), features.presence(hits(s, d)), _VOCAB)


@query(f"with {_P} select o_orderkey as genome_id, count(feature)::bigint as n_features from orders left join f on genome_id = o_orderkey group by o_orderkey")
def hitless_genomes_kept(s, d):
    return features.counts(genomes(s, d), features.presence(hits(s, d)))


_FAM = r"case when regexp_matches({0}, '^(.+?)_([A-Z]-?\d+[A-Za-z0-9]*)$') then regexp_extract({0}, '^(.+?)_([A-Z]-?\d+[A-Za-z0-9]*)$', 1) when regexp_replace({0}, '-?\d+$', '') = '' then {0} else regexp_replace({0}, '-?\d+$', '') end"
_KEY = "regexp_replace(regexp_replace(split_part(lower(" + _FAM + r"), '/', 1), '^bla(.+)$', '\1'), '[^a-z0-9]', '', 'g')"
_ALLELE = "concat('bla', upper(substr(p_name, 1, 3)), '-', p_size)"


def alleles(s, d) -> DataFrame:
    """Part names in the shape of alleles and mutations."""
    p = table(s, d, "part")
    allele = F.concat(F.lit("bla"), F.upper(F.substring("p_name", 1, 3)), F.lit("-"), F.col("p_size").cast("string"))
    return p.select("p_partkey", allele.alias("allele"), F.concat(F.substring("p_name", 1, 4), F.lit("_S"), F.col("p_size").cast("string"), F.lit("L")).alias("mutant"))


@query(f"with n as (select p_partkey, {_ALLELE} as x from part) select p_partkey, {_FAM.format('x')} as family from n")
def family_names(s, d):
    return alleles(s, d).select("p_partkey", names.gene_family(F.col("allele")).alias("family"))


@query(f"with {_P}, g as (select genome_id, {_FAM.format('feature')} as family from f) select distinct genome_id, family from g")
def family_presence(s, d):
    return features.families(features.presence(hits(s, d)))


@query(r"""with n as (select p_partkey, substr(p_name, 1, 4) || '_S' || p_size || 'L' as mutant from part)
select p_partkey, regexp_extract(mutant, '^(.+?)_([A-Z]-?\d+[A-Za-z0-9]*)$', 1) as gene, regexp_extract(mutant, '^(.+?)_([A-Z]-?\d+[A-Za-z0-9]*)$', 2) as mutation from n""")
def feature_name_parse(s, d):
    return alleles(s, d).select("p_partkey", names.parse_gene(F.col("mutant")).alias("gene"), names.parse_mutation(F.col("mutant")).alias("mutation"))


@query(f"with n as (select p_partkey, {_ALLELE} as x from part) select p_partkey, {_KEY.format('x')} as key from n")
def match_keys(s, d):
    return alleles(s, d).select("p_partkey", F.explode(names.match_keys(F.col("allele"))).alias("key"))


@query(r"""with n as (select p_partkey, 'enzyme => ' || upper(p_name) || ' family @ x' as product from part),
t as (select p_partkey, trim(regexp_replace(regexp_extract(product, '(?:=>|@)\s*(.+)$', 1), '\bfamily\b', '', 'g'), ' .,;/') as x from n)
select p_partkey, regexp_extract(x, '^(\S+)', 1) as token from t""")
def feature_token(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", names.feature_token(F.lit(None).cast("string"), F.concat(F.lit("enzyme => "), F.upper("p_name"), F.lit(" family @ x"))).alias("token"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then null else 'ST-' || c_custkey end as st from customer""")
def mlst_parse(s, d):
    mlst = F.when(F.col("c_custkey") % 3 == 0, "MLST.x.-").otherwise(F.concat(F.lit("MLST.ecoli_achtman_4."), F.col("c_custkey").cast("string")))
    return table(s, d, "customer").select("c_custkey", names.parse_mlst(mlst).alias("st"))


@query("select r_regionkey, 'Pénicilline/Two-' || upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) as drug from (select r_regionkey, regexp_replace(r_name, '[^A-Za-z].*$', '') as r_name from region)")
def canonical_drug(s, d):
    name = F.regexp_replace("r_name", "[^A-Za-z].*$", "")
    return table(s, d, "region").select("r_regionkey", names.canonical_drug(F.concat(F.lit(" pénicilline/TWO-"), name, F.lit(" "))).alias("drug"))


_CURATED = "c as (select * from (values ('A', 'blaRED'), ('A', 'blaHOT-7'), ('N', 'blaBLU-3'), ('N', 'smal_S5L')) as t(drug, gene))"


def curated(s) -> DataFrame:
    return s.sql("select * from values ('A', 'blaRED'), ('A', 'blaHOT-7'), ('N', 'blaBLU-3'), ('N', 'smal_S5L') as t(drug, gene)")


@query(f"""with {_CURATED}, v as (select distinct {_ALLELE} as feature from part),
x as (select drug, gene, feature from c join v on gene = feature),
r as (select * from c where (drug, gene) not in (select (drug, gene) from x) and not regexp_matches(gene, '^(.+?)_([A-Z]-?\\d+[A-Za-z0-9]*)$'))
select * from x union all select drug, gene, feature from r join v on {_KEY.format('gene')} = {_KEY.format('feature')}""")
def curated_resolution(s, d):
    return features.resolve_curated(curated(s), alleles(s, d).select(F.col("allele").alias("feature")).distinct())


@query(f"with {_P} select o_orderkey as genome_id, count(f.feature)::bigint as n from orders left join f on f.genome_id = o_orderkey and f.feature in ('red_widget', 'blue_bolt', 'hot_gear') group by o_orderkey")
def curated_count(s, d):
    return features.counts(genomes(s, d), features.presence(hits(s, d)).where(F.col("feature").isin("red_widget", "blue_bolt", "hot_gear")), "n")


_RULES = [("^red", "R"), ("^(blue|hot)", "BH"), ("widget$", "W"), ("^small r", "SR")]


@query("select p_partkey, case when regexp_matches(p_name, '^red') then 'R' when regexp_matches(p_name, '^(blue|hot)') then 'BH' when regexp_matches(p_name, 'widget$') then 'W' when regexp_matches(p_name, '^small r') then 'SR' end as bridged from part")
def bridge_first_match(s, d):
    return table(s, d, "part").select("p_partkey", features.first_rule(F.col("p_name"), _RULES).alias("bridged"))


@query("select 'labels_without_features' as rule, k::varchar as key, 'missing' as detail from (select distinct o_orderkey as k from orders where o_orderkey not in (select l_orderkey from lineitem))")
def contract_orphans(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("genome_id"))
    return contract.orphans(rows, table(s, d, "lineitem").select(F.col("l_orderkey").alias("genome_id")), "genome_id", "labels_without_features")


@query("select 'unique_id' as rule, l_orderkey::varchar as key, count(*)::varchar as detail from lineitem group by l_orderkey having count(*) > 1")
def contract_dupes(s, d):
    return contract.duplicates(table(s, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("select 'phenotype' as rule, o_orderkey::varchar as key, o_orderstatus as detail from orders where o_orderstatus not in ('F', 'O')")
def contract_phenotype(s, d):
    return contract.outside(table(s, d, "orders"), "o_orderkey", "o_orderstatus", ["F", "O"], "phenotype")


@query(f"with {_P}, {_M} select genome_id, feature from f where genome_id in (select genome_id from m where phenotype = 'R') and genome_id in (select o_orderkey from orders where o_orderpriority <> '5-LOW') and feature <> 'red_widget'")
def keep_set(s, d):
    drop = s.sql("select 'red_widget' as feature")
    return features.keep(features.presence(hits(s, d)), measurements(s, d).where("phenotype = 'R'"), genomes(s, d).where("species <> '5-LOW'"), drop)


@query(f"""with {_T}, w as (select *, 1.0::double / count(*) over (partition by drug, cluster_id) as w1 from t),
x as (select *, sum(w1) over (partition by drug, y) as cw, count(*) over (partition by drug) as n from w)
select drug, genome_id, y, cluster_id, round(n * w1 / (2 * cw), 6) as weight from x""")
def cluster_weights(s, d):
    return labels.cluster_weights(training(s, d)).withColumn("weight", r6("weight"))


@query(f"""with {_P}, p as (select o_orderkey as genome_id, coalesce(list(feature) filter (feature is not null), []) as fs from orders left join f on genome_id = o_orderkey group by o_orderkey),
d as (select * from (values ('A', ['red_widget']), ('N', ['blue_bolt', 'hot_gear']), ('R', null)) as t(drug, tg))
select genome_id, drug, case when tg is null then 'unknown' when list_has_all(fs, tg) then 'present' else 'absent' end as gate from p, d""")
def target_gate(s, d):
    present = genomes(s, d).join(features.presence(hits(s, d)), "genome_id", "left").groupBy("genome_id").agg(F.collect_set("feature").alias("fs"))
    genes = F.array(*[F.struct(F.lit(k).alias("drug"), (F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<string>")).alias("tg")) for k, v in (("A", ["red_widget"]), ("N", ["blue_bolt", "hot_gear"]), ("R", None))])
    rows = present.select("genome_id", "fs", F.explode(genes).alias("x"))
    vocabulary = F.array(*map(F.lit, _VOCAB))
    return rows.select("genome_id", "x.drug", scores.target_gate(F.col("x.tg"), vocabulary, F.col("fs")).alias("gate"))


_COEF = "k as (select * from (values ('red_widget', 0.5::double), ('blue_bolt', -0.25::double), ('hot_gear', 1.5::double), ('small_ring', 0.125::double)) as t(feature, coef))"


def coefs(s) -> DataFrame:
    return s.sql("select feature, cast(coef as double) as coef from values ('red_widget', 0.5), ('blue_bolt', -0.25), ('hot_gear', 1.5), ('small_ring', 0.125) as t(feature, coef)")


@query(f"with {_P}, {_COEF} select o_orderkey as genome_id, round(1 / (1 + exp(-(coalesce(z, 0) - 0.3))), 6) as p from orders left join (select genome_id, sum(coef) as z from f join k using (feature) group by genome_id) on genome_id = o_orderkey")
def sparse_score(s, d):
    return features.sparse_score(genomes(s, d), features.presence(hits(s, d)), coefs(s), -0.3).withColumn("p", r6("p"))


@query(f"with {_P}, {_COEF} select genome_id, feature, rank from (select genome_id, feature, row_number() over (partition by genome_id order by coef desc, feature)::int as rank from f join k using (feature) where coef > 0) where rank <= 3")
def top_drivers(s, d):
    rows = features.presence(hits(s, d)).join(coefs(s), "feature").where("coef > 0")
    return labels.window_rank(rows, ["genome_id"], [F.desc("coef"), "feature"], "rank").where("rank <= 3").select("genome_id", "feature", "rank")


@query(f"""with {_P}, {_COEF} select o_orderkey as genome_id, case when bool_or(f.feature = 'hot_gear') then 'known_gene_or_mutation' when bool_or(k.coef > 0) then 'statistical_association' else 'no_known_signal' end as evidence
from orders left join f on genome_id = o_orderkey left join k on k.feature = f.feature group by o_orderkey""")
def evidence_tier(s, d):
    columns = s.sql("select 'A' as drug, 'hot_gear' as feature")
    rows = predict.profiles(genomes(s, d), features.presence(hits(s, d)), columns, columns)
    fitted = coefs(s).withColumn("drug", F.lit("A"))
    none = target_table(s).limit(0)
    return predict.tiers(rows, columns, predict.drivers(rows, fitted, none, ["drug"]), ["drug"]).select("genome_id", F.col("evidence_category").alias("evidence"))


@query(f"with {_E} select event_id, call from e")
def calibrated_call(s, d):
    return scored(s, d).select("event_id", "call")


@query("select event_id, round(ln(greatest(1e-6, least(1 - 1e-6, value / 100)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 100)))), 6) as logit from events")
def clipped_logit(s, d):
    return table(s, d, "events").select("event_id", r6(scores.logit(F.col("value") / 100)).alias("logit"))


@query(f"with {_E}, r as (select *, rank() over (partition by drug order by p) + (count(*) over (partition by drug, p) - 1) / 2.0 as mid from e) select drug, round((sum(mid) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6)::double as auroc from r group by drug")
def auroc_midrank(s, d):
    return metrics.auroc(scored(s, d), "drug").withColumn("auroc", r6("auroc"))


@query(f"""with {_E}, g as (select drug, p, sum(y) as pos, count(*) as n from e group by all), c as (select *, sum(pos) over w as tp, sum(n) over w as k from g window w as (partition by drug order by p desc))
select drug, round(sum(pos * tp / k) / sum(pos), 6)::double as pr_auc from (select drug, pos::double as pos, tp::double as tp, k::double as k from c) group by drug""")
def average_precision(s, d):
    return metrics.average_precision(scored(s, d), "drug").withColumn("pr_auc", r6("pr_auc"))


@query(f"""with {_E}, c as (select drug, count(*) filter (call = 'likely_to_fail' and y = 1)::double as tp, count(*) filter (call = 'likely_to_fail' and y = 0)::double as fp,
count(*) filter (call = 'likely_to_work' and y = 0)::double as tn, count(*) filter (call = 'likely_to_work' and y = 1)::double as fn from e group by drug)
select drug, (tp + fp + tn + fn)::bigint as n_answered, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as bal_acc, round(tp / (tp + fn), 6) as recall_r, round(tn / (tn + fp), 6) as recall_s, round(2 * tp / (2 * tp + fp + fn), 6) as f1_r from c""")
def decision_metrics(s, d):
    out = metrics.decisions(scored(s, d), "drug")
    return out.select("drug", "n_answered", *[r6(c).alias(c) for c in ("bal_acc", "recall_r", "recall_s", "f1_r")])


@query(f"with {_E} select drug, count(*) as n, round(100.0 * count(*) filter (call in ('likely_to_fail', 'likely_to_work')) / count(*), 6)::double as coverage, round(100.0 * count(*) filter (call = 'no_call') / count(*), 6)::double as no_call, round(100.0 * count(*) filter (call = 'not_applicable') / count(*), 6)::double as not_applicable from e group by drug")
def coverage_summary(s, d):
    return metrics.coverage(scored(s, d), "drug").select("drug", "n", *[r6(c).alias(c) for c in ("coverage", "no_call", "not_applicable")])


@query(f"with {_E} select drug, round(avg((p - y) * (p - y)), 6) as brier from e group by drug")
def brier_score(s, d):
    return metrics.brier(scored(s, d), "drug").withColumn("brier", r6("brier"))


@query(f"with {_E}, b as (select *, (p >= 0.1)::int + (p >= 0.2)::int + (p >= 0.3)::int + (p >= 0.4)::int + (p >= 0.5)::int + (p >= 0.6)::int + (p >= 0.7)::int + (p >= 0.8)::int + (p >= 0.9)::int as bin from e) select bin, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y, count(*) as n from b group by bin")
def reliability_bins(s, d):
    return metrics.reliability(scored(s, d)).select("bin", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"), "n")


@query(f"""with {_E}, c as (select cluster, count(*) filter (call = 'likely_to_fail' and y = 1)::double as tp, count(*) filter (call = 'likely_to_fail' and y = 0)::double as fp,
count(*) filter (call = 'likely_to_work' and y = 0)::double as tn, count(*) filter (call = 'likely_to_work' and y = 1)::double as fn from e group by cluster)
select cluster, (tp + fp + tn + fn)::bigint as n_answered, round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, case when tp + fn > 0 and tn + fp > 0 then round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) end as bal_acc from c where tp + fp + tn + fn >= 3""")
def per_cluster_metrics(s, d):
    return metrics.per_cluster(scored(s, d), "cluster").select("cluster", "n_answered", r6("accuracy").alias("accuracy"), r6("bal_acc").alias("bal_acc"))


@query(f"with {_E}, v as (select drug, cluster % 8 as seed, avg((p - y) * (p - y)) as value from e group by all) select drug, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, count(value) as seeds from v group by drug")
def multi_seed_summary(s, d):
    seeds = scored(s, d).groupBy("drug", (F.col("cluster") % 8).alias("seed")).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("value"))
    return metrics.over_seeds(seeds, "drug", "value").select("drug", r6("mean").alias("mean"), r6("sd").alias("sd"), "seeds")


@query(f"""with {_E}, v as (select drug, cluster % 8 as seed, case when event_id % 2 = 0 then 'random' else 'grouped' end as split, avg((p - y) * (p - y)) as value from e group by all),
g as (select drug, avg(value) filter (split = 'random') as random, stddev_samp(value) filter (split = 'random') as random_sd, avg(value) filter (split = 'grouped') as grouped, stddev_samp(value) filter (split = 'grouped') as grouped_sd from v group by drug),
r as (select drug, printf('%.3f', (random)::double)::double as random, printf('%.3f', (random_sd)::double)::double as random_sd, printf('%.3f', (grouped)::double)::double as grouped, printf('%.3f', (grouped_sd)::double)::double as grouped_sd from g)
select *, printf('%.3f', ((random - grouped))::double)::double as gap from r""")
def leakage_pivot(s, d):
    split = F.when(F.col("event_id") % 2 == 0, "random").otherwise("grouped").alias("split")
    v = scored(s, d).groupBy("drug", (F.col("cluster") % 8).alias("seed"), split).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("value"))
    return metrics.leakage(v, "drug")


@query(f"""with {_E}, c as (select *, 1 / (1 + exp(-(1.5 * ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) - 0.2))) as q from e)
select drug, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier_raw, round(avg((q - y) * (q - y)), 6) as brier_cal, round(100.0 * count(*) filter (q between 0.3 and 0.7) / count(*), 6)::double as pct_ambiguous,
round(100.0 * count(*) filter (cluster % 40 = 3) / count(*), 6)::double as pct_ood, true as fitted from c group by drug""")
def calibration_report(s, d):
    rows = scored(s, d).withColumn("raw", F.col("p")).withColumn("p", scores.sigmoid(1.5 * scores.logit(F.col("raw")) - 0.2)).withColumn("ood", F.col("cluster") % 40 == 3).withColumn("fitted", F.lit(True))
    out = metrics.calibration(rows, "drug", K.NO_CALL_LOW, K.NO_CALL_HIGH)
    return out.select("drug", "n", *[r6(c).alias(c) for c in ("brier_raw", "brier_cal", "pct_ambiguous", "pct_ood")], "fitted")


_NN = f"""{_P}, g as (select o_orderkey as genome_id, o_orderkey % 5 = 0 as train from orders),
n as (select g.genome_id, g.train, count(feature) as n from g left join f using (genome_id) group by all),
s as (select q.genome_id, t.genome_id as tid, count(*) as both from f q join f t using (feature) join g a on a.genome_id = q.genome_id and not a.train join g b on b.genome_id = t.genome_id and b.train group by all),
b as (select s.genome_id, min(nt.n - 2 * s.both) as best from s join n nt on nt.genome_id = s.tid group by s.genome_id),
d as (select n.genome_id, (n.n + least(coalesce(best, 1000000), (select min(n) from n where train)))::bigint as distance from n left join b using (genome_id) where not n.train)"""


def _profiles(s, d):
    f = genomes(s, d).select("genome_id").join(features.presence(hits(s, d)), "genome_id", "left")
    return f.where("genome_id % 5 <> 0"), f.where("genome_id % 5 = 0")


@query(f"with {_NN} select genome_id, distance from d")
def hamming_nn(s, d):
    return features.nearest_hamming(*_profiles(s, d))


@query(f"with {_NN} select round(greatest(quantile_cont(distance, 0.99), 1.0), 6)::double as threshold from d")
def ood_threshold(s, d):
    return metrics.ood_threshold(features.nearest_hamming(*_profiles(s, d)), [], K.OOD_PERCENTILE, K.OOD_FLOOR).select(r6("threshold").alias("threshold"))


@query(f"with {_NN}, t as (select greatest(quantile_cont(distance, 0.99), 1.0) as threshold from d) select genome_id, distance > threshold as ood from d, t")
def ood_flag(s, d):
    near = features.nearest_hamming(*_profiles(s, d))
    limit = metrics.ood_threshold(near, [], K.OOD_PERCENTILE, K.OOD_FLOOR)
    return near.join(F.broadcast(limit)).select("genome_id", (F.col("distance") > F.col("threshold")).alias("ood"))


_SH = r"""w as (select doc_id as id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from documents),
g as (select id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) as t from w where len(ws) >= 5),
n as (select id, count(*) as n from g group by id), p as (select x.id as a, y.id as b, count(*) as i from g x join g y on x.t = y.t and x.id < y.id group by all),
j as (select a, b, i::double / (u.n + v.n - i) as jaccard from p join n u on u.id = a join n v on v.id = b),
l as (select * from j where case when jaccard >= 1 then 0 else -ln(2 * jaccard / (1 + jaccard)) / 5 end < 0.02)"""


def _texts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"with {_SH} select a, b, round(jaccard, 6) as jaccard, round(case when jaccard >= 1 then 0 else -ln(2 * jaccard / (1 + jaccard)) / 5 end, 6)::double as distance from l")
def kmer_jaccard_pairs(s, d):
    return similarity.similar_pairs(sets.shingles(_texts(s, d), 5), 0.02, 5).select("a", "b", r6("jaccard").alias("jaccard"), r6("distance").alias("distance"))


@query(f"with recursive {_SH}, b as (select a, b from l union all select b, a from l), r(id, root) as (select doc_id, doc_id from documents union select b.b, r.root from r join b on r.id = b.a) select id, min(root) as root from r group by id")
def connected_components(s, d):
    docs = _texts(s, d)
    return docs.select("id").join(similarity.linked(sets.shingles(docs, 5), 0.02, 5), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


@query("""with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents), c as (select doc_id::varchar as genome_id, coalesce(sum(length(line)) filter (not starts_with(line, 'The')), 0)::bigint as total_bp,
count(*) filter (starts_with(line, 'The'))::bigint as n_contigs from l group by doc_id)
select *, total_bp >= 1000000 and n_contigs > 0 as plausible_genome, case when total_bp >= 1000000 and n_contigs > 0 then '' when n_contigs = 0 then 'No FASTA sequence records were found in this file.'
else 'This file is only ' || format('{:,}', total_bp) || ' bp across ' || n_contigs || ' record(s) — that is a gene or partial sequence, not a whole-genome assembly (E. coli genomes are ~4.5-5.5 Mb). Any prediction below is unreliable: with no genome to scan, an absence of resistance genes is indistinguishable from a truly susceptible strain. Upload a complete E. coli assembly for a trustworthy result.' end as message from c""")
def genome_qc(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("genome_id"), "text")
    lines = docs.select("genome_id", F.explode(F.split("text", "\n")).alias("line")).select("genome_id", F.regexp_replace(F.btrim("line", F.lit(" ")), "^The", ">The").alias("line"))
    lines = lines.withColumn("line", F.when(F.startswith("line", F.lit(">The")), F.lit(">")).otherwise(F.col("line")))
    return readers.genome_qc(docs.select("genome_id"), lines)


@query("select p_name, count(*) as n from part group by p_name order by n desc, p_name limit 8")
def value_counts_topk(s, d):
    return table(s, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(8)


def predictions(s, d) -> DataFrame:
    """One prediction for each nation, customer segment standing for the drug."""
    rows = table(s, d, "customer").select(F.col("c_nationkey").alias("sample_id"), F.lit("E. coli").alias("species"), F.array(*map(F.lit, [*K.DRUG_TARGETS, "Colistin"]))[(F.col("c_custkey") % 4).cast("int")].alias("drug"), (F.abs("c_acctbal") / 10000).alias("p")).groupBy("sample_id", "species", "drug").agg(F.avg("p").alias("p"))
    p, sid = F.round("p", 4), F.col("sample_id")
    call = F.when(sid % 7 == 0, "not_applicable").when(p.between(0.4, 0.45), "no_call").when(p >= 0.45, "likely_to_fail").otherwise("likely_to_work")
    fail, work = call == "likely_to_fail", call == "likely_to_work"
    evidence = F.when(fail & (sid % 3 == 0), "statistical_association").when(fail | (work & (sid % 5 == 0)), "known_gene_or_mutation").otherwise("no_known_signal")
    one = F.array(F.struct(F.lit("gyrA").alias("gene"), F.lit("S83L").alias("mutation"), F.lit("curated").alias("note")))
    support = F.when(fail | (work & (sid % 5 == 0)), one).otherwise(F.array().cast(predict.FEATURE))
    return rows.select("sample_id", "species", "drug", call.alias("call"), p.alias("confidence"), evidence.alias("evidence_category"), support.alias("supporting_features"), F.lit("present").alias("target_gate_status"), F.when((call == "no_call") & (sid % 2 == 0), "weak evidence").alias("no_call_reason"))


_PR = """q as (select c_nationkey as sample_id, (['Ampicillin', 'Ciprofloxacin', 'Trimethoprim', 'Colistin'])[(c_custkey % 4 + 1)::int] as drug, round(avg(abs(c_acctbal) / 10000), 4) as p from customer group by all),
pq as (select *, case when sample_id % 7 = 0 then 'not_applicable' when p between 0.4 and 0.45 then 'no_call' when p >= 0.45 then 'likely_to_fail' else 'likely_to_work' end as call from q),
pr as (select *, case when call = 'likely_to_fail' and sample_id % 3 = 0 then 'statistical_association' when call = 'likely_to_fail' or (call = 'likely_to_work' and sample_id % 5 = 0) then 'known_gene_or_mutation' else 'no_known_signal' end as evidence,
  case when call = 'likely_to_fail' or (call = 'likely_to_work' and sample_id % 5 = 0) then 'gyrA S83L' end as genes, case when call = 'no_call' and sample_id % 2 = 0 then 'weak evidence' end as reason,
  case drug when 'Ampicillin' then 'Beta-lactam (aminopenicillin)' when 'Ciprofloxacin' then 'Fluoroquinolone' when 'Trimethoprim' then 'Folate-pathway antagonist (DHFR inhibitor)' end as class,
  case drug when 'Ampicillin' then 'ftsI' when 'Ciprofloxacin' then 'gyrA' when 'Trimethoprim' then 'folA' end as locus,
  round_even(greatest(0.01, least(0.99, p)) * 100, 0)::int || '%' as pct, round_even((1 - greatest(0.01, least(0.99, p))) * 100, 0)::int || '%' as rest from pq)"""


@query(f"""with {_PR} select sample_id, drug, coalesce(class, 'Unknown') as drug_class,
case call when 'likely_to_fail' then 'Likely to fail' when 'likely_to_work' then 'Likely to work' else 'No-call' end as underlying_state,
printf('%.3f', ((case when call = 'likely_to_work' then 1 - p else p end))::double)::double as confidence,
case call when 'not_applicable' then 'N/A' when 'no_call' then 'Ambiguous' else coalesce(genes, 'None detected') end as target_marker, coalesce(locus, 'N/A') as locus_id,
case when call = 'not_applicable' then 'The molecular target for ' || drug || ' (' || coalesce(locus, 'the drug target') || ') was not detected in this genome, so susceptibility cannot be assessed from sequence.'
when call = 'no_call' then 'Evidence for ' || drug || ' is inconclusive, so no confident biological interpretation is made. ' || coalesce(reason, 'the evidence is weak or conflicting')
when call = 'likely_to_fail' and evidence = 'known_gene_or_mutation' then 'Detected a known ' || coalesce(class, 'this antibiotic class') || ' resistance determinant: ' || genes || '. This is an established mechanism, so the drug is predicted to fail.'
when call = 'likely_to_fail' then 'No confirmed causal resistance mutation at the ' || coalesce(locus, 'the drug target') || ' target was detected; the prediction does not rest on a proven mechanism.'
when evidence = 'no_known_signal' then 'No known ' || coalesce(class, 'this antibiotic class') || ' resistance determinant was detected in this genome. (Note: the annotator reports the ' || coalesce(locus, 'the drug target') || ' target only when it is altered, so this is absence of a resistance signal, not a confirmed intact target.)'
else 'Although ' || genes || ' was noted, the model still predicts ' || drug || ' works; interpret with caution and confirm by lab testing.' end as bio_explanation,
case when call = 'not_applicable' then 'No probability is reported: the deterministic target gate overrides the statistical model when the drug has no target to act on.'
when call = 'no_call' then 'A safe prediction cannot be computed for this genome. ' || coalesce(reason, 'the evidence is weak or conflicting')
when call = 'likely_to_fail' and evidence = 'known_gene_or_mutation' then 'The calibrated model assigns ' || pct || ' probability of resistance, consistent with the detected determinant.'
when call = 'likely_to_fail' then 'The model links ' || genes || ' to resistance as a learned statistical pattern (association, not proven cause); calibrated probability ' || pct || '.'
when evidence = 'no_known_signal' then 'Calibrated susceptibility confidence is ' || rest || '; the genomic profile sits within the susceptible range seen in training.'
else 'Calibrated resistance probability is low (' || pct || ') despite the noted feature(s).' end as stat_explanation from pr""")
def report_items(s, d):
    return report.items(predictions(s, d))


@query(f"""with {_PR} select sample_id, drug, case when call = 'likely_to_fail' and evidence = 'known_gene_or_mutation' then drug || ': LIKELY TO FAIL against this E. coli sample (confidence ' || pct || '). Known resistance mechanism detected: gyrA (S83L) — curated.'
when call = 'likely_to_fail' then drug || ': LIKELY TO FAIL (confidence ' || pct || '), based on a statistical association with gyrA (S83L) — curated. This is a model-learned pattern, not a confirmed causal resistance mechanism.'
when call = 'likely_to_work' and evidence = 'no_known_signal' then drug || ': LIKELY TO WORK against this E. coli sample (confidence ' || pct || '). No resistance signal was found, and the drug''s molecular target is present.'
when call = 'likely_to_work' then drug || ': LIKELY TO WORK (confidence ' || pct || '), though note: gyrA (S83L) — curated.'
when call = 'no_call' then drug || ': NO CONFIDENT PREDICTION for this sample. Reason: ' || coalesce(reason, 'insufficient evidence') || '.'
else drug || ': this drug''s molecular target was not found in the genome — not applicable to this organism.' end as explanation_text,
'This is a research prototype. All results must be confirmed with standard laboratory testing.' as disclaimer, pct as confidence_label from pr""")
def explanations(s, d):
    return report.explain(predictions(s, d))


@query(f"with {_PR} select sample_id, count(*) filter (call = 'likely_to_work')::bigint as works, count(*) filter (call = 'likely_to_fail')::bigint as fails, count(*) filter (call in ('no_call', 'not_applicable'))::bigint as holds from pr group by sample_id")
def panel_counts(s, d):
    return report.panel_counts(predictions(s, d))


@query(f"with {_PR} select sample_id, string_agg(drug || '=' || call, ',' order by case call when 'likely_to_work' then 0 when 'likely_to_fail' then 1 else 2 end, drug) as drugs from pr group by sample_id")
def report_order(s, d):
    one = F.from_json("report", "array<struct<drug:string,underlying_state:string,target_marker:string>>")
    state = lambda x: F.when(x["underlying_state"] == "Likely to work", "likely_to_work").when(x["underlying_state"] == "Likely to fail", "likely_to_fail").when(x["target_marker"] == "N/A", "not_applicable").otherwise("no_call")
    return report.report_json(predictions(s, d)).select("sample_id", F.array_join(F.transform(one, lambda x: F.concat(x["drug"], F.lit("="), state(x))), ",").alias("drugs"))


@query("""select p_partkey, (p_partkey % 4 <> 0 and p_partkey % 4 <> 3) as unlisted from part""")
def unlisted_gene_guard(s, d):
    said = F.concat(F.lit("The "), "p_name", F.lit(" with "), F.array(*map(F.lit, ["blaNDM-5", "qnrS1", "tet(A)", "GYRA"]))[((F.col("p_partkey") + 3) % 4).cast("int")], F.lit(" fails."))
    genes = F.array(F.struct(F.when(F.col("p_partkey") % 4 == 3, "tet(A)").otherwise("sul1").alias("gene")))
    return table(s, d, "part").select("p_partkey", report.names_unlisted_gene(said, F.lit("Ciprofloxacin"), genes).alias("unlisted"))


@query(f"""with {_PR}, m as (select *, case sample_id % 4 when 0 then ['TEM', 'CTX-M', 'Tet'] when 1 then ['dhfrI'] when 2 then ['AAC-Ib-cr', 'KPC'] else [] end as fam from pr),
k as (select *, case drug when 'Ampicillin' then list_filter(['CTX-M', 'KPC', 'TEM'], lambda x: list_contains(fam, x)) when 'Ciprofloxacin' then list_filter(['AAC-Ib-cr'], lambda x: list_contains(fam, x)) when 'Trimethoprim' then list_filter(['dhfrI'], lambda x: list_contains(fam, x)) else [] end as causal from m)
select sample_id, drug, case when call = 'likely_to_fail' and len(causal) > 0 then 'known_gene_or_mutation' else evidence end as evidence, case when call = 'likely_to_fail' and len(causal) > 0 then array_to_string(causal, ',') else coalesce('gyrA' || case when genes is null then null else '' end, '') end as genes from k""")
def evidence_upgrade(s, d):
    fam = F.array(F.array(*map(F.lit, ["TEM", "CTX-M", "Tet"])), F.array(F.lit("dhfrI")), F.array(*map(F.lit, ["AAC-Ib-cr", "KPC"])), F.array().cast("array<string>"))[(F.col("sample_id") % 4).cast("int")]
    up = predict.upgrade(predictions(s, d).withColumn("features", fam))
    return up.select("sample_id", "drug", F.col("evidence_category").alias("evidence"), F.array_join(F.transform("supporting_features", lambda f: f["gene"]), ",").alias("genes"))


@query("select case when p >= 0.99 then '>99%' when p <= 0.01 then '<1%' else printf('%.1f%%', p * 100) end as label, n from (select (c_custkey % 101) / 100.0 as p, count(*) as n from customer group by all)")
def certainty_labels(s, d):
    return table(s, d, "customer").groupBy(((F.col("c_custkey") % 101) / 100.0).alias("p")).agg(F.count("*").alias("n")).select(scores.certainty_label(F.col("p") * 100).alias("label"), "n")


@query(f"with {_PR}, x as (select sample_id, drug, case when sample_id % 4 = 1 then 'maybe' else call end as call, case when sample_id % 6 = 2 then p + 1 else p end as confidence from pr) select 'call' as rule, sample_id || '/' || drug as key, call as detail from x where call = 'maybe' union all select 'confidence', sample_id || '/' || drug, confidence::varchar from x where confidence > 1")
def prediction_faults(s, d):
    p = predictions(s, d).withColumn("call", F.when(F.col("sample_id") % 4 == 1, "maybe").otherwise(F.col("call"))).withColumn("confidence", F.when(F.col("sample_id") % 6 == 2, F.col("confidence") + 1).otherwise(F.col("confidence")))
    return contract.prediction_faults(p)


@query(f"""with {_PR}, g as (select sample_id, count(*) as n, string_agg(drug, ', ' order by drug) filter (call = 'likely_to_work') as w, string_agg(drug, ', ' order by drug) filter (call = 'likely_to_fail') as f, string_agg(drug, ', ' order by drug) filter (call in ('no_call', 'not_applicable')) as h from pr group by sample_id)
select sample_id, 'Across ' || n || ' antibiotics, ' || concat_ws('; ', 'predicted to remain effective against this E. coli sample: ' || w, 'predicted to fail (resistance indicated): ' || f, 'no confident call (insufficient or ambiguous evidence): ' || h) || '. These are sequence-based predictions and must be confirmed by standard laboratory susceptibility testing before any clinical use.' as summary from g""")
def clinical_summary(s, d):
    return report.summary(predictions(s, d))


@query()
def grouped_split(s, d):
    return splits.grouped_split(training(s, d).select("drug", "cluster_id", "y"), [0, 1])


@query(f"with {_T}, x as (select *, case when cluster_id % 5 = 0 then 'test' when cluster_id % 5 = 1 then 'calibration' else 'train' end as split from t) select drug, split, count(*) as n, count(distinct cluster_id) as clusters, sum(y)::bigint as n_r, round(100.0 * sum(y) / count(*), 6)::double as pct_r from x group by all")
def split_report(s, d):
    m = F.col("cluster_id") % 5
    return splits.report(training(s, d).withColumn("split", F.when(m == 0, "test").when(m == 1, "calibration").otherwise("train"))).withColumn("pct_r", r6("pct_r"))


def _fit_rows(s, d) -> DataFrame:
    fs = features.presence(hits(s, d)).groupBy("genome_id").agg(F.collect_list("feature").alias("features"))
    rows = labels.cluster_weights(training(s, d)).join(fs, "genome_id", "left")
    return rows.withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


@query()
def fit_models(s, d):
    return models.fit(_fit_rows(s, d), ["drug"])


def _gradient(rows: DataFrame, told: DataFrame, c: float) -> DataFrame:
    """drug, feature, g: the gradient of the fitted loss by coefficient, from every row's score."""
    error = rows.select("drug", "genome_id", "weight", "y", F.explode(F.concat("features", F.array(F.lit("")))).alias("feature")).join(told.select("drug", "genome_id", "p"), ["drug", "genome_id"])
    return error.groupBy("drug", "feature").agg((c * F.sum(F.col("weight") * (F.col("p") - F.col("y")))).alias("g"))


@query(f"""with {_T}, {_P}, q as (select drug from t group by drug having count(distinct y) = 2), u as (select distinct t.drug, f.feature from t join q using (drug) join f using (genome_id))
select q.drug, count(u.feature) + 1 as n_coef, 0.0::double as residual from q left join u using (drug) group by q.drug""")
def fit_residuals(s, d):
    rows = lineage.cut(_fit_rows(s, d))
    fitted = lineage.cut(models.fit(rows, ["drug"]))
    g = _gradient(rows, models.score(rows, fitted, ["drug"]), K.LR_C)
    both = g.join(fitted.select("drug", F.coalesce("feature", F.lit("")).alias("feature"), "coef"), ["drug", "feature"], "full")
    return both.groupBy("drug").agg(F.count("coef").alias("n_coef"), F.round(F.max(F.abs(F.coalesce("g", F.lit(1.0)) + F.coalesce("coef", F.lit(1.0)))), 5).alias("residual"))


@query(f"""with {_E} select drug, count(*) as n, sum(y)::bigint as n_r, 0.0::double as by_slope, 0.0::double as by_intercept from e group by drug having count(distinct y) = 2""")
def platt_residuals(s, d):
    rows = lineage.cut(scored(s, d).select("drug", "y", F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p")))
    x = F.log(F.col("p") / (1 - F.col("p")))
    told = rows.join(models.platt(rows, ["drug"]).where("a is not null"), "drug").withColumn("x", x).withColumn("e", 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b")))) - F.col("y"))
    by = told.groupBy("drug", "n", "n_r").agg(F.round(F.abs(F.sum(F.col("e") * F.col("x")) + F.first("a")), 5).alias("by_slope"), F.round(F.abs(F.sum("e")), 5).alias("by_intercept"))
    return by.select("drug", "n", "n_r", "by_slope", "by_intercept")


@query()
def platt_scaling(s, d):
    return models.platt(scored(s, d).select("drug", "y", "p"), ["drug"])


@query()
def out_of_fold(s, d):
    return models.out_of_fold(_fit_rows(s, d))
