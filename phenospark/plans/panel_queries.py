"""Queries of builds, contracts, bridges and panel predictions over the driver's tables, each with the SQL it must equal.

Roles are those of ``queries``; the coefficients and calibrations here are stated, so that SQL can score the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import build, contract, features, labels, metrics, predict, sets, similarity, splits
from ..operators.lineage import cut
from . import evaluation, panel
from .queries import _E, _H, _P, _T, QUERIES, SQL, genomes, hits, measurements, query, r6, scored, table, training
__all__ = ["QUERIES", "SQL"]


# --- builds ------------------------------------------------------------------------------------------------------


def api_label_rows(s, d) -> DataFrame:
    """API answers: an order line's status as phenotype, its flag as drug, its ship mode as evidence and method."""
    drug = F.when(F.col("l_returnflag") == "A", "ampicillin").when(F.col("l_returnflag") == "N", "Ciprofloxacin").otherwise("tetracycline")
    code = F.when(F.col("l_linestatus") == "F", "Resistant").when(F.col("l_linenumber") % 3 == 0, "Intermediate").otherwise("Susceptible")
    evidence = F.when(F.col("l_linenumber") % 4 == 0, "Computational Method").otherwise(K.LAB_EVIDENCE)
    method = F.when(F.col("l_linenumber") % 2 == 0, "Broth dilution")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("genome_id"), drug.alias("antibiotic"), code.alias("resistant_phenotype"), evidence.alias("evidence"), method.alias("laboratory_typing_method"), F.col("l_linenumber").alias("pos"))


_L = """l as (select l_orderkey::varchar as genome_id, case l_returnflag when 'A' then 'Ampicillin' when 'N' then 'Ciprofloxacin' else 'Tetracycline' end as drug,
case when l_linestatus = 'F' then 'R' when l_linenumber % 3 = 0 then null else 'S' end as phenotype, l_linenumber % 4 <> 0 as lab, case when l_linenumber % 2 = 0 then 'Broth dilution' else '' end as method, l_linenumber as pos from lineitem),
al as (select genome_id, drug, min(phenotype) as phenotype, min(method) as lab_method from l where lab and phenotype is not null and drug <> 'Tetracycline' group by all having count(distinct phenotype) = 1)"""


@query(f"with {_L} select genome_id, drug, phenotype, lab_method from al")
def api_labels(s, d):
    return build.api_labels(api_label_rows(s, d))


@query("""with l as (select l_orderkey::varchar as genome_id, case l_returnflag when 'A' then 'Ampicillin' when 'N' then 'Ciprofloxacin' else 'Trimethoprim/Sulfa' end as drug, case l_linestatus when 'F' then 'R' else 'S' end as phenotype, 'm' || l_linenumber as lab_method, l_linenumber as pos, l_partkey as part
  from lineitem where l_linenumber % 3 <> 0 and l_orderkey in (select o_orderkey from orders where o_orderpriority <> '5-LOW'))
select genome_id, drug, phenotype, lab_method from (select *, row_number() over (partition by genome_id, drug order by pos, part, phenotype, lab_method) as rn from l) where rn = 1""")
def file_labels(s, d):
    drug = F.when(F.col("l_returnflag") == "A", " AMPICILLIN").when(F.col("l_returnflag") == "N", "ciprofloxacin ").otherwise("trimethoprim/sulfa")
    code = F.when(F.col("l_linestatus") == "F", " Resistant").otherwise("SUSCEPTIBLE ")
    method = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))).otherwise(" ")
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("genome_id"), drug.alias("antibiotic"), code.alias("phenotype"), method.alias("lab_method"), F.struct("l_linenumber", "l_partkey").alias("pos"))
    keep = genomes(s, d).where("species <> '5-LOW'").select(F.col("genome_id").cast("string").alias("genome_id"))
    return build.file_labels(rows, keep, "pos")


def api_gene_rows(s, d) -> DataFrame:
    """API gene rows: a part's type in the product text, its brand's last digit as class (blank for some)."""
    parts = table(s, d, "part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_partkey") % 5 == 0, "DNA gyrase subunit A").otherwise(F.concat(F.lit("enzyme => "), F.initcap(F.substring_index("p_name", " ", 1)), F.lit(" family"))).alias("product"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("c"), (F.col("p_partkey") % 7).cast("string"))).otherwise(" ").alias("antibiotics_class"))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("genome_id"), F.col("l_partkey").alias("part"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"))
    return rows.join(parts, "part").withColumn("gene", F.lit(None).cast("string"))


_G = """p as (select p_partkey, case when p_partkey % 5 <> 0 then upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) end as token, case when p_partkey % 3 = 0 then 'c' || (p_partkey % 7) end as class from part),
gr as (select l_orderkey::varchar as genome_id, l_orderkey, l_linenumber, l_partkey, token, class from lineitem join p on p_partkey = l_partkey where token is not null)"""


@query(f"with {_G} select distinct genome_id, token as feature from gr")
def api_features(s, d):
    return build.api_features(api_gene_rows(s, d), "pos")[0]


@query(f"with {_G}, f as (select token, first(class order by l_orderkey, l_linenumber, l_partkey) as c from gr where class is not null group by token) select distinct gr.token as feature_name, coalesce(c, '') as amr_class, 'known_gene' as evidence_type, 'BV-BRC/NDARO' as source from gr left join f using (token)")
def api_feature_classes(s, d):
    return build.api_features(api_gene_rows(s, d), "pos")[1]


def api_genome_rows(s, d) -> DataFrame:
    mlst = F.when(F.col("o_orderkey") % 4 == 0, "MLST.x.-").otherwise(F.concat(F.lit("MLST.ecoli."), F.col("o_custkey").cast("string")))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("genome_id"), mlst.alias("mlst"), F.col("o_custkey").alias("pos"))


@query("select o_orderkey::varchar as genome_id, 'Escherichia coli' as species, 'ST-' || o_custkey as cluster_id from orders where o_orderkey % 4 <> 0")
def typed_genomes(s, d):
    return build.typed_genomes(api_genome_rows(s, d), "pos")


_DATA = f"""{_L}, {_G}, k as (select distinct genome_id from al where genome_id::bigint in (select o_orderkey from orders where o_orderkey % 4 <> 0))"""


def api_dataset(s, d):
    return build.from_api(api_label_rows(s, d), api_gene_rows(s, d), api_genome_rows(s, d), "pos")


@query(f"with {_DATA} select distinct genome_id, token as feature from gr where genome_id in (select genome_id from k)")
def build_features(s, d):
    return api_dataset(s, d)[0].features


@query(f"with {_DATA} select genome_id, drug, phenotype from al where genome_id in (select genome_id from k)")
def build_labels(s, d):
    return api_dataset(s, d)[0].labels.select("genome_id", "drug", "phenotype")


@query(f"with {_DATA}, t as (select * from (values ('Ampicillin', 'ftsI'), ('Ciprofloxacin', 'gyrA,parC'), ('Trimethoprim', 'folA')) as t(drug, target_genes)) select drug, target_genes from t where drug in (select drug from al where genome_id in (select genome_id from k))")
def build_targets(s, d):
    return api_dataset(s, d)[0].targets.select("drug", F.array_join("target_genes", ",").alias("target_genes"))


@query(f"with {_H}, a as (select symbol, case when type = 'AMR' then symbol end as f from h) select f as feature_name, f as gene_symbol, 'acquired_gene' as evidence_type, 'AMR' as amr_class, length(f)::varchar as amr_subclass from a where f is not null group by f")
def feature_metadata(s, d):
    rows = hits(s, d).select("genome_id", "symbol", "type", F.lit("AMR").alias("subtype"), F.lit(" AMR ").alias("class"), F.length("symbol").cast("string").alias("subclass"), F.col("genome_id").alias("pos"))
    return features.annotate(rows, "pos").withColumnRenamed("feature", "feature_name")


# --- contracts ---------------------------------------------------------------------------------------------------


@query("select 'binary' as rule, l_orderkey || '/' || l_linenumber as key, l_linenumber::varchar as detail from lineitem where l_linenumber > 1")
def contract_binary(s, d):
    rows = table(s, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("k"), "l_linenumber")
    return contract.outside(rows, "k", "l_linenumber", [0, 1], "binary")


@query("select 'no_nulls' as rule, c_custkey::varchar as key, case when c_custkey % 6 = 0 then 'a,b' when c_custkey % 2 = 0 then 'a' else 'b' end as detail from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def contract_nulls(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 != 0, 1).alias("a"), F.when(F.col("c_custkey") % 3 != 0, 1).alias("b"))
    return contract.nulls(rows, "c_custkey", ["a", "b"])


_SPLIT = "case when genome_id % 97 = 0 then 'test' when cluster_id % 5 = 0 then 'test' when cluster_id % 5 = 1 then 'calibration' else 'train' end"


@query(f"""with {_T}, x as (select *, cluster_id % 2 as seed, {_SPLIT} as split from t)
select 'cluster_in_two_splits' as rule, drug || '/' || seed || '/' || cluster_id as key, count(distinct split)::varchar as detail from x group by drug, seed, cluster_id having count(distinct split) > 1
union all select 'empty_split', drug || '/' || seed, array_to_string(list_sort(list(distinct split)), ',') from x group by drug, seed having count(distinct split) < 3
union all select 'one_class_split', drug || '/' || seed || '/' || split, count(distinct y)::varchar from x group by drug, seed, split having count(distinct y) < 2""")
def split_faults(s, d):
    return contract.split_faults(training(s, d).withColumn("seed", F.col("cluster_id") % 2).withColumn("split", F.expr(_SPLIT)))


@query(f"""with {_T}, n as (select drug, count(*) as n from t group by drug) select drug, split, case split when 'train' then n * 6 // 10 when 'calibration' then n * 2 // 10 else n - n * 6 // 10 - n * 2 // 10 end::bigint as n
from n, (values ('train'), ('calibration'), ('test')) as s(split)""")
def random_split_sizes(s, d):
    rows = training(s, d).select("drug", "genome_id")
    sizes = rows.groupBy("drug").agg(F.count("*").alias("n")).select("drug", F.floor(F.col("n") * 6 / 10).alias("train"), F.floor(F.col("n") * 2 / 10).alias("calibration"))
    return splits.random_split(rows, sizes).groupBy("drug", "split").agg(F.count("*").alias("n"))


# --- bridges and curated genes -----------------------------------------------------------------------------------

_RULES = [("^red", "R"), ("^(blue|hot)", "BH"), ("widget", "W"), ("^small r", "SR")]


@query("""with v as (select * from (values ('BH'), ('W'), ('SR'), ('Green'), ('Always')) as t(feature)), p as (select p_partkey::varchar as genome_id, lower(split_part(p_name, ' ', 1)) as base from part)
select genome_id, case when regexp_matches(base, '^(blue|hot)') then 'BH' when regexp_matches(base, 'widget') then 'W' when regexp_matches(base, '^small r') then 'SR' when base = 'green' then 'Green' end as feature from p
where regexp_matches(base, '^(blue|hot)') or regexp_matches(base, 'widget') or base = 'green' union select genome_id, 'Always' from p""")
def bridge_features(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("genome_id"), F.regexp_replace("p_name", " ", "_").alias("symbol"))
    vocabulary = s.sql("select * from values ('BH'), ('W'), ('SR'), ('Green'), ('Always') as t(feature)")
    return features.bridge(rows, vocabulary, None, _RULES, ["Always", "Never"])


_PARTS = """p as (select p_brand as drug, 'bla' || upper(replace(p_name, ' ', '')) as family, p_size, p_type from part), k as (select distinct drug, family, family || '-' || p_size as gene from p where p_size <= 3),
v as (select distinct family, family || '-' || p_size as feature from p where p_type = 'ECONOMY' and p_size in (3, 49) union select family, family from p where p_type = 'ECONOMY' and p_size = 50),
c as (select k.drug, v.feature from k join v on feature = gene union select k.drug, v.feature from k join v using (family) where gene not in (select feature from v))"""


def brand_genes(s, d) -> tuple[DataFrame, DataFrame]:
    """Small parts as curated genes of their brands; some economy parts, and bare families of others, as the vocabulary."""
    family = F.concat(F.lit("bla"), F.upper(F.regexp_replace("p_name", " ", "")))
    gene = F.concat(family, F.lit("-"), F.col("p_size").cast("string"))
    parts = table(s, d, "part")
    economy = parts.where("p_type = 'ECONOMY'")
    vocabulary = economy.where("p_size in (3, 49)").select(gene.alias("feature")).union(economy.where("p_size = 50").select(family.alias("feature"))).distinct()
    return parts.where("p_size <= 3").select(F.col("p_brand").alias("drug"), gene.alias("gene")).distinct(), vocabulary


@query(f"with {_PARTS} select distinct drug, drug || ': none of its curated resistance genes match a feature column, so every prediction will report ''statistical_association'' — absence of expressible evidence, NOT absence of known biology.' as message from k where drug not in (select drug from c)")
def unavailable_evidence(s, d):
    return predict.unavailable_evidence(*brand_genes(s, d))


@query(f"with {_PARTS} select drug, count(distinct feature) as n from c group by drug")
def curated_genes(s, d):
    return predict.curated_columns(*brand_genes(s, d)).groupBy("drug").agg(F.count("*").alias("n"))


# --- panel predictions -------------------------------------------------------------------------------------------


def stated_models(s) -> DataFrame:
    return s.sql("""select drug, 0 as seed, feature, cast(coef as double) as coef from values ('A', 'red_widget', 0.5), ('A', 'hot_gear', 1.5), ('A', '_curated_count', 0.25), ('A', null, -0.8),
('N', 'blue_bolt', -0.25), ('N', 'small_ring', 0.75), ('N', 'hot_gear', 0.5), ('N', 'red_widget', 0.125), ('N', null, -0.1) as t(drug, feature, coef)""")


_PANEL = f"""{_P}, k as (select * from (values ('A', 'red_widget', 0.5::double), ('A', 'hot_gear', 1.5), ('N', 'blue_bolt', -0.25), ('N', 'small_ring', 0.75), ('N', 'hot_gear', 0.5), ('N', 'red_widget', 0.125)) as t(drug, feature, coef)),
b as (select * from (values ('A', -0.8::double, 0.25::double), ('N', -0.1, 0)) as t(drug, bias, per)), c as (select * from (values ('A', 'red_widget'), ('A', 'blue_bolt')) as t(drug, feature)),
z as (select drug, genome_id, sum(coef) as z from f join k using (feature) group by all), n as (select drug, genome_id, count(*) as n, string_agg(feature, ',' order by feature) as known from f join c using (feature) group by all),
v as (select drug, genome_id, string_agg(feature, ',' order by coef desc, feature) as drivers from (select drug, genome_id, feature, coef, row_number() over (partition by drug, genome_id order by coef desc, feature) as r from f join k using (feature) where coef > 0 and feature <> 'red_widget' and not starts_with(feature, 'hot_')) where r <= 3 group by all),
w as (select o_orderkey as genome_id, b.drug, 1 / (1 + exp(-(coalesce(z, 0) + bias + per * coalesce(n, 0)))) as p, known, drivers, exists (select 1 from f where f.genome_id = o_orderkey and feature = 'red_widget') as has from orders cross join b left join z on z.genome_id = o_orderkey and z.drug = b.drug left join n on n.genome_id = o_orderkey and n.drug = b.drug left join v on v.genome_id = o_orderkey and v.drug = b.drug),
g as (select genome_id, drug, p, case when drug = 'N' then 'unknown' when has then 'present' else 'absent' end as gate, case when known is not null then 'known_gene_or_mutation' when drivers is not null then 'statistical_association' else 'no_known_signal' end as evidence, coalesce(known, drivers, '') as genes from w),
r as (select *, case when gate = 'absent' then 'not_applicable' when p >= 0.5 then 'likely_to_fail' else 'likely_to_work' end as call from g)"""


def stated_predictions(s, d) -> DataFrame:
    columns = s.sql("select * from values ('A', 'red_widget'), ('A', 'blue_bolt') as t(drug, feature)")
    targets = s.sql("select * from values ('A', array('red_widget')), ('N', array('hot', 'not_there')) as t(drug, target_genes)")
    found = features.presence(hits(s, d))
    rows = predict.profiles(genomes(s, d), found, s.sql("select * from values ('A'), ('N') as t(drug)"), columns).withColumn("seed", F.lit(0))
    return predict.predict(rows, stated_models(s), targets, found.select("feature").distinct(), columns, panel.KEYS)


@query(f"with {_PANEL} select genome_id, drug, round(p, 6) as p, gate, evidence, genes, call from r")
def panel_predictions(s, d):
    out = stated_predictions(s, d)
    return out.select("genome_id", "drug", r6("p").alias("p"), F.col("target_gate_status").alias("gate"), F.col("evidence_category").alias("evidence"), F.array_join(F.transform("supporting_features", lambda f: f["gene"]), ",").alias("genes"), "call")


@query(f"""with {_PANEL}, q as (select *, case when drug = 'A' then 1 / (1 + exp(-(1.25 * ln(p / (1 - p)) - 0.1))) else p end as cal, genome_id % 10 = 0 as ood from r)
select genome_id, drug, round(cal, 6) as p, case when call = 'not_applicable' then call when drug = 'N' or ood or cal between 0.3 and 0.7 then 'no_call' when cal >= 0.5 then 'likely_to_fail' else 'likely_to_work' end as call,
case when call = 'not_applicable' then null when drug = 'N' then 'Confidence could not be calibrated for this drug (calibration data holds only class [0] across 7 rows — Platt scaling needs both classes).'
when ood then 'This genome''s resistance-gene profile is unlike anything in the training data, so the model''s confidence cannot be trusted.'
when cal between 0.3 and 0.7 then 'Calibrated probability ' || printf('%.2f', cal) || ' falls in the ambiguous band (0.30-0.70).' end as no_call_reason from q""")
def panel_calibrated(s, d):
    platt = s.sql("select drug, 0 as seed, cast(a as double) as a, cast(b as double) as b, cast(n as bigint) as n, cast(n_r as bigint) as n_r from values ('A', 1.25, -0.1, 50, 20), ('N', null, null, 7, 0) as t(drug, a, b, n, n_r)")
    out = predict.calibrate(stated_predictions(s, d).withColumn("ood", F.col("genome_id") % 10 == 0), platt, panel.KEYS)
    return out.select("genome_id", "drug", r6("p").alias("p"), "call", "no_call_reason")


@query(f"""with {_E}, v as (select drug, cluster % 8 as seed, avg((p - y) * (p - y)) as m, count(*) as n_test from e group by all)
select drug, round_even(avg(n_test), 0)::bigint as n_test, count(*) as seeds, printf('%.3f', avg(m)) || '±' || printf('%.3f', stddev_pop(m)) as m, count(m) as m_n from v group by drug""")
def seed_table(s, d):
    v = scored(s, d).groupBy("drug", (F.col("cluster") % 8).alias("seed")).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("m"), F.count("*").alias("n_test"))
    return metrics.seed_table(v, "drug", ["m"])


@query(f"""with {_E}, g as (select drug, p, sum(y) as pos, sum(1 - y) as neg from e group by all),
u as (select *, coalesce(sum(neg) over (partition by drug order by p rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over (partition by drug order by p desc) as tp, sum(pos + neg) over (partition by drug order by p desc) as k from g),
a as (select drug, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auroc, sum(pos * tp::double / k) / sum(pos) as pr_auc from u group by drug),
c as (select drug, count(*) as n_test, avg(y) as r, avg((p - y) * (p - y)) as b, avg((least(p + 0.01, 1.0) - y) * (least(p + 0.01, 1.0) - y)) as braw, count(*) filter (call in ('likely_to_fail', 'likely_to_work')) as n_answered, count(*) filter (call = 'no_call') as nc, count(*) filter (call = 'not_applicable') as na,
 count(*) filter (call = 'likely_to_fail' and y = 1)::double as tp, count(*) filter (call = 'likely_to_fail' and y = 0)::double as fp, count(*) filter (call = 'likely_to_work' and y = 0)::double as tn, count(*) filter (call = 'likely_to_work' and y = 1)::double as fn from e group by drug)
select drug, n_test, printf('%.1f', ((100.0 * r))::double)::double as pct_r, printf('%.1f', ((100.0 * n_answered / n_test))::double)::double as coverage, n_answered::bigint as n_answered, printf('%.3f', (((tp / (tp + fn) + tn / (tn + fp)) / 2))::double)::double as bal_acc,
printf('%.3f', ((tp / (tp + fn)))::double)::double as recall_r, printf('%.3f', ((tn / (tn + fp)))::double)::double as recall_s, printf('%.3f', ((2 * tp / (2 * tp + fp + fn)))::double)::double as f1_r, printf('%.3f', (auroc)::double)::double as auroc, printf('%.3f', (pr_auc)::double)::double as pr_auc,
printf('%.4f', (braw)::double)::double as brier_raw, printf('%.4f', (b)::double)::double as brier_cal, printf('%.1f', ((100.0 * nc / n_test))::double)::double as no_call, printf('%.1f', ((100.0 * na / n_test))::double)::double as not_appl from c join a using (drug)""")
def metrics_table(s, d):
    return evaluation.metrics_table(scored(s, d).withColumn("raw", F.least(F.col("p") + 0.01, F.lit(1.0))), ["drug"])


# --- fitted panels (no SQL: held against brute force in the tests) -------------------------------------------------


def order_dataset(s, d) -> build.Dataset:
    """The dataset of orders: labels that agree, features of AMR parts, customers as clusters."""
    said = labels.agreed(measurements(s, d)).where("drug in ('A', 'R')")
    found = features.presence(hits(s, d))
    rows = genomes(s, d)
    targets = s.sql("select * from values ('A', array('red_widget')) as t(drug, target_genes)")
    return build.Dataset(found, found.select("feature").distinct(), said, rows, targets)


def order_split(s, d) -> DataFrame:
    """A stated split of customers, so that fitted results depend on nothing else."""
    m = F.col("cluster_id") % 20
    clusters = genomes(s, d).select("cluster_id").distinct().withColumn("split", F.when(m < 4, "test").when(m < 7, "calibration").otherwise("train"))
    return clusters.select(F.explode(F.array(F.lit("A"), F.lit("R"))).alias("drug"), F.lit(0).alias("seed"), "cluster_id", "split")


@query()
def panel_fit_predict(s, d):
    data = order_dataset(s, d)
    fitted = panel.fit(data, [0], curated=s.sql("select 'A' as drug, 'hot_gear' as gene"), assigned=order_split(s, d))
    return panel.predict_all(fitted, data.genomes, data.features).drop("supporting_features")


@query()
def panel_evaluation(s, d):
    data = order_dataset(s, d)
    fitted = panel.fit(data, [0], curated=s.sql("select 'A' as drug, 'hot_gear' as gene"), assigned=order_split(s, d))
    rows = cut(evaluation.test_rows(data, fitted))  # else each metric scores all rows anew, in one plan of the driver
    return evaluation.metrics_table(rows, ["drug", "seed"])


@query()
def leakage_refit(s, d):
    return evaluation.leakage_rows(order_dataset(s, d), [0, 1])


# --- sequences ---------------------------------------------------------------------------------------------------


def _sequences(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^a-zA-Z]", "")).alias("sequence"))


@query("""with q as (select doc_id as id, upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as x from documents), t as (select distinct id, substr(x, i, 21) as t from (select id, x, unnest(range(1, length(x) - 19)) as i from q where length(x) >= 21))
select id, count(*) as n from t group by id""")
def sequence_kmers(s, d):
    return similarity.heads(sets.kmers(_sequences(s, d), K.MASH_K)).select("id", "n")


@query()
def sequence_sketch(s, d):
    return similarity.sketch(sets.kmers(_sequences(s, d), K.MASH_K))


@query("""with recursive q as (select doc_id as id, upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as x from documents), t as (select distinct id, substr(x, i, 21) as t from (select id, x, unnest(range(1, length(x) - 19)) as i from q where length(x) >= 21)),
n as (select id, count(*) as n from t group by id), p as (select a.id as a, b.id as b, count(*) as i from t a join t b on a.t = b.t and a.id < b.id group by all),
j as (select a, b, i::double / (u.n + v.n - i) as j from p join n u on u.id = a join n v on v.id = b), l as (select a, b from j where case when j >= 1 then 0 else -ln(2 * j / (1 + j)) / 21 end < 0.02),
e as (select a, b from l union all select b, a from l), r(id, root) as (select id, id from q union select e.b, r.root from r join e on r.id = e.a), m as (select id, min(root) as root from r group by id)
select id, printf('CL-%04d', dense_rank() over (order by root) - 1) as cluster_id from m""")
def sequence_clusters(s, d):
    return similarity.cluster(_sequences(s, d))

